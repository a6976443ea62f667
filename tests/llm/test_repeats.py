"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, odd columns, hot groups."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.llm import collocations, minhash, runs

DOCS = "doc_id bigint, text string, lang string, n bigint, key string, words string, id string, runs string"


def table(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "k", "w", "i", "r") for r in rows], DOCS)


def sets_of(text, length=3):
    words = (text or "").encode().lower().split()
    size = min(length, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_components(rows, percent):
    sets = [sets_of(text) for _, text, _ in rows]
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    out = []
    for i, (doc, _, _) in enumerate(rows):
        ids = [d for j, (d, _, _) in enumerate(rows) if sets[i] and root(j) == root(i) and d is not None]
        least = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), least, doc is not None and doc == least))
    return sorted(out, key=str)


def changed(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_near_duplicates(spark, percent):
    rng = random.Random(percent)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    shared = text(80)
    out = [None, "", " \n\t", "one", "One", "two words", "two  WORDS", "x" * 200_000, text(9_000)]
    for n in (3, 5, 8, 20, 60, 97, 110, 300, 900):
        base = text(n)
        out += [base, base.upper(), *(changed(rng, base, rng.randint(1, max(1, n // 30))) for _ in range(6))]
    out += [f"{text(30)} {shared} {text(10)}" for _ in range(15)]  # share most of their words without being copies
    out.append(changed(rng, out[8], 100))
    rows = [(i, t, "en") for i, t in enumerate(out)]
    rows += [rows[10], rows[10], (None, out[12], None), (None, text(40), None), (11, text(50), "en"), (7, None, None)]
    found = minhash.near_duplicates(table(spark, rows), percent=percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_components(rows, percent)


def test_near_duplicates_in_a_hot_list(spark, monkeypatch):
    """Many sets with the same frequent values, cut into pieces: two families and sets that link with neither."""
    monkeypatch.setattr(minhash, "PIECE", 16)
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    common, one, two = text(150), text(60), text(60)
    rows = [(i, f"{common} {changed(rng, (one, two)[i % 2], 1)}", "en") for i in range(80)]
    rows += [(100 + i, f"{common} {text(60)}", "en") for i in range(40)]
    found = minhash.near_duplicates(table(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_components(rows, 85)


def test_near_duplicates_of_nothing(spark):
    docs = table(spark, [(1, None, None)])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(docs).collect()] == [(1, 0, 1, True)]
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=100)


def test_overlaps_are_reached():
    """The quantiles are exact where a union fits into a sketch, and random unions never fall below them."""
    rng = np.random.default_rng(2)
    for union in (1, 7, 50, 96):
        assert minhash.least_overlaps(85)[union] == -(-85 * union // 100)
    for union in (97, 130, 400, 3_000, 40_000):
        shared = -(-85 * union // 100)
        least = minhash.needed(np.array([union]), 85)[0]
        for _ in range(300):
            assert (rng.permutation(union)[: minhash.RETAINED] < shared).sum() >= least


def brute_runs(words, times=4, shortest=6):
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - p:
            start = i
            while i < len(words) - p and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(shortest, times * p):
                found.setdefault((start, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    kinds = rng.choice([1, 2, 3, 40])
    words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, 150))]
    if words and rng.random() < 0.6:
        again = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 45))]
        words[20:20] = again * rng.randint(2, 9) + again[: rng.randrange(len(again))]
    return words


def test_extensions():
    rng = np.random.default_rng(4)
    for size, kinds in ((1, 1), (30, 1), (200, 2), (400, 1), (900, 5)):
        words = np.concatenate([rng.integers(0, kinds, size), [kinds]])
        words[size // 2 :][:size // 3] = words[: size // 3]
        common = runs.Extensions(words)
        one, two = rng.integers(0, size + 1, (2, 500))
        one, two = one[one != two], two[one != two]
        for i, j, n in zip(one, two, common(one, two), strict=True):
            brute = 0
            while max(i, j) + brute <= size and words[i + brute] == words[j + brute]:
                brute += 1
            assert n == brute


def test_find_runs():
    rng = random.Random(6)
    for _ in range(150):
        docs = [random_words(rng) for _ in range(rng.randint(0, 5))]
        number = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
        found = runs.find_runs([np.array([number[w] for w in d], np.int64) for d in docs], 4, 6)
        for words, rows in zip(docs, found, strict=True):
            assert [tuple(int(v) for v in r) for r in zip(*rows, strict=True)] == brute_runs(words)


def test_periodic_runs(spark):
    rng = random.Random(7)
    texts = [None, "", " \n ", "a a a a a a", "a a a a a", "A a A a A a A a", "x" * 100_000, "é é é é é é é", "w " * 30_000]
    texts += [" ".join(random_words(rng)).replace(" ", "\n", 2) for _ in range(60)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(3, texts[3], None)] * 2 + [(None, texts[3], None), (5, "other", None)]
    found = runs.periodic_runs(table(spark, rows)).collect()
    wanted = []
    for doc, text, _ in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        brute = brute_runs(words) if len(words) < 1000 else [(0, 30_000, 1)]
        wanted.append((doc, len(words), brute, brute_collapsed(words, brute)))
    ours = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert sorted(ours, key=str) == sorted(wanted, key=str)
    assert runs.periodic_runs(table(spark, rows[:1]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(table(spark, rows[:1]), times=1)


def test_run_digests(spark):
    """The query's rows, with tails that repeat, against plain Python."""
    rng = random.Random(8)
    rows = [(i, " ".join(random_words(rng)), None) for i in range(200)] + [(6, None, None), (6, "", None), (None, "a " * 9, None)]
    found = runs.run_digests(runs.periodic_runs(runs.periodic_tails(table(spark, rows)))).collect()
    wanted = []
    for doc, text, _ in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        brute = brute_runs(words)
        best = None
        for run in brute:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        said = "".join(f"{s},{n},{p}\n" for s, n, p in brute)
        wanted.append((
            doc, len(brute), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(brute_collapsed(words, brute).encode()).hexdigest(),
        ))
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def brute_phrases(rows, least, percent, top, most=4):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, most + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    out = []
    frequent = {g: a for g, a in counts.items() if a >= least and len(g[1]) > 1}
    within = {}
    for (lang, phrase), f in frequent.items():
        for i in range(len(phrase)):
            for j in range(i + 1, len(phrase) + 1):
                if j - i < len(phrase):
                    within.setdefault((lang, phrase[i:j]), []).append(f)
    for (lang, phrase), a in frequent.items():
        if any(100 * f >= percent * a for f in within.get((lang, phrase), [])):
            continue
        cuts = [(counts[lang, phrase[:k]], counts[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, _, x, y = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.append((lang, " ".join(phrase), a, x, y, totals[lang], score))
    ranked = []
    for lang in totals:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(ranked)


@pytest.mark.parametrize(("least", "top"), [(1, 5000), (4, 5000), (4, 7)])
def test_collocations(spark, monkeypatch, least, top):
    monkeypatch.setattr(collocations, "_HELD", 2000)
    rng = random.Random(least)
    words = ["the", "The", "of", "new", "york", "état", "x1", "İ", "a b", "z-z"]

    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", "!?", "\x0b"]) for _ in range(rng.randint(0, 40)))

    rows = [(i, text(), rng.choice(["en", "fr", "und", None])) for i in range(120)]
    rows += [rows[0]] * 3 + [(None, None, "en"), (1, "", "empty"), (2, "york " * 5000, "long"), (3, "q" * 50_000, "en")]
    found = collocations.collocations(table(spark, rows), least=least, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, least, 80, top)


def test_collocations_of_nothing(spark):
    docs = table(spark, [(1, None, None), (2, "", "en"), (3, ".,;", "en")])
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_are_exact(spark):
    """Products beyond 64 bits."""
    big = 2**62
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 1).alias("b"))
    row = row.withColumn("s", collocations._exact(2_000_000) * collocations._exact("a"))
    assert row.withColumn("t", collocations._exact("a") + collocations._exact("b")).selectExpr("s div t").first()[0] == 2_000_000 * big // (2 * big + 1)


def test_exceptions_are_found_by_intervals():
    """Aho-Corasick with exceptions against looking everywhere."""
    from pairmatch.llm import toxicity

    rng = random.Random(12)
    weights = {"ab": 1.0, "aba": 2.0, "b": 0.5, "ca": 4.0}
    exceptions = ["abab ca", "aba", "b b", "ca ca", "bab"]
    lexicon = toxicity.Lexicon(weights, exceptions)
    for _ in range(300):
        text = f" {' '.join(rng.choice(['ab', 'aba', 'b', 'ca', 'abab', 'bab', 'c']) for _ in range(rng.randint(1, 12)))} "
        clear = [(i + 1, i + len(p) + 2) for p in exceptions for i in range(len(text)) if text.startswith(f" {p} ", i)]
        hits = [(i + 1, i + 1 + len(e), w) for e, w in weights.items() for i in range(len(text)) if text.startswith(f" {e}", i)]
        brute = sum(w for a, b, w in hits if not any(x <= a and b <= y for x, y in clear))
        assert lexicon.match(text)[0] == pytest.approx(brute)


def test_a_node_without_weight_supplies_nothing(spark):
    from pairmatch.llm import mixing

    supplies = spark.createDataFrame(
        [("P", "A", "1", 1000), ("P", "B", "1", 10), ("Q", "C", "1", 1000)], "domain string, lang string, source string, tokens bigint"
    )
    weights = spark.createDataFrame([("P", "A", None, 0)], "domain string, lang string, source string, weight bigint")
    found = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(supplies, weights, 400, 1).collect()}
    assert found == {("P", "A"): 0, ("P", "B"): 10, ("Q", "C"): 390}


def test_line_dedup_keeps_columns_of_any_name(spark):
    from pairmatch.llm import linededup

    rows = [(1, "a\nb\nc", "p", "q", "r", 7), (2, "a\nb\nd", "s", "t", "u", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _doc string, _version string, _gone string, n_lines int")
    found = linededup.remove_repeated_lines(docs)
    assert found.columns == ["doc_id", "text", "_doc", "_version", "_gone", "n_lines", "n_removed"]
    assert sorted(map(tuple, found.collect())) == [(1, "a\nb\nc", "p", "q", "r", 3, 0), (2, "d", "s", "t", "u", 3, 2)]
