"""Edge cases and brute force on small tables: nulls, empty and long texts, ties, repeated rows, odd columns."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.llm import chat, decontaminate, html, jaccard, linededup, mixing, passages, tokens, topk, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, rank string, key string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "a"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [sentence(rng.randint(3, 160)) for _ in range(40)]
    shared = sentence(60)
    out = [None, "", "  \n\t ", "one", "One", "two words", sentence(4000), "x" * 300_000]
    for text in base:
        out.append(text)
        for _ in range(rng.randint(0, 4)):
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    out += [base[0]] * 6 + [f"{sentence(9)} {shared} {sentence(7)}" for _ in range(5)]
    out += [f"{sentence(5)}\n{base[3]}\n{base[4]}\n\n{sentence(6)}" for _ in range(3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", "r", "k") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, texts[9], None, None, None, None), (10, "other text for a known id", "en", "src1", "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard_components(spark, texts, docs, none):
    def brute(found):
        sets = []
        for t in found:
            w = (t or "").encode().lower().split()
            n = min(3, len(w))
            sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
        top = list(range(len(sets)))

        def root(i):
            while top[i] != i:
                i = top[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    top[b] = a
        return {(i, len(s), root(i)) for i, s in enumerate(sets)}

    own = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {tuple(r) for r in jaccard.jaccard_components(own).collect()} == brute(texts)
    found = jaccard.jaccard_components(docs).collect()
    assert len(found) == docs.count()
    first = min(i for i, t in enumerate(texts) if t == texts[9])
    assert {r.component_id for r in found if r.doc_id is None} == {r.component_id for r in found if r.doc_id == first}
    assert jaccard.jaccard_components(none).count() == 0


def test_signature_tree_drops_no_link():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    sets = [np.sort(np.concatenate([base[k:], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in range(0, 60)]
    sizes = np.array([len(s) for s in sets])
    bits = np.array([jaccard.bitmap(s) for s in sets])
    at = np.arange(len(sets))
    found = list(jaccard.SignatureTree(sizes, bits, at, np.full(len(at), -2)).pairs(90))
    left, right = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    found = set(zip(left.tolist(), right.tolist(), strict=True))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in found


def test_mixing(spark, docs, none):
    weights = spark.createDataFrame(
        [("d", None, None, 3), ("d", "en", None, 5)], "domain string, lang string, source string, weight bigint"
    )
    domain = F.when(F.col("source").isNotNull(), F.lit("d"))
    units = docs.select("doc_id", "text").where("text is not null")
    total = units.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    picked = mixing.mix(docs, weights, domain, share=0.5, max_epochs=2)
    rows = picked.collect()
    assert 0.3 * total < sum(r.n_tokens * r.epochs for r in rows) <= 0.5 * total
    assert all(1 <= r.epochs <= 2 for r in rows)
    again = mixing.mix(docs, weights, domain, share=0.5, max_epochs=2).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(none, weights, domain).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    supplies = spark.createDataFrame(
        [("a", "x", "1", 10), ("a", "x", "2", 1000), ("b", "y", "1", 1000)],
        "domain string, lang string, source string, tokens bigint",
    )
    weights = spark.createDataFrame([], "domain string, lang string, source string, weight bigint")
    found = {(r.domain, r.source): r.budget for r in mixing.leaf_budgets(supplies, weights, 400, 1).collect()}
    assert found == {("a", "1"): 10, ("a", "2"): 190, ("b", "1"): 200}


def test_decontamination_against_brute_force(spark, docs, none):
    rng = random.Random(7)
    word = lambda: f"q{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40))) + ". " + " ".join(word() for _ in range(6))) for i in range(30)]
    items += [(30, None), (31, "")]
    pool = [" ".join(word() for _ in range(rng.randint(5, 300))) for _ in range(60)]
    leaks = [f"{pool[i]} {items[i][1]} {pool[i + 1]}" for i in range(0, 30, 3)]
    partly = [items[1][1].rsplit(".", 1)[0]]
    rows = list(enumerate([*pool, *leaks, *partly, None, "", "..."]))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(60 + i // 3, i) for i in range(0, 30, 3)}
    assert all(r.score > 0.999 and r.question_overlap == 1 and r.answer_overlap == 1 for r in found)
    assert decontaminate.find_leaks(docs, benchmark).count() == 0
    assert decontaminate.find_leaks(none, benchmark).count() == 0
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    sharded = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), benchmark, shard_bytes=800)
    assert sorted(sharded.collect()) == sorted(found)


def test_a_text_without_fields_is_verified_as_a_whole(spark):
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(4000)}"
    text = lambda n, tail: " ".join(word() for _ in range(n)) + ". " + " ".join(word() for _ in range(tail)) + "."
    items = [(0, text(30, 1)), (1, text(30, 4)), (2, text(14, 3)), (3, text(8, 3))]
    docs, wanted = [], set()
    for item, whole in items:
        words = whole.split()
        for at in range(len(words)):  # one changed word, at each place
            wanted.add((len(docs), item))
            docs.append((len(docs), " ".join([*words[:at], "changed.", *words[at + 1 :]])))
        if item < 3:  # all but the last sentence
            wanted.add((len(docs), item))
            docs.append((len(docs), f"{text(40, 3)} {whole.partition('. ')[0]}. {text(20, 3)}"))
        docs.append((len(docs), f"{text(20, 3)} {' '.join(words[: len(words) // 3])} {text(20, 3)}"))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = decontaminate.find_leaks(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted
    # with both fields, each is verified
    fields = [(i, *t.split(". ", 1)) for i, t in items]
    benchmark = spark.createDataFrame(fields, "item_id bigint, question string, answer string")
    found = decontaminate.find_leaks(frame, benchmark).collect()
    assert found and all(min(r.question_overlap, r.answer_overlap) >= 0.5 for r in found)


def test_retrieval_is_complete():
    rng = np.random.default_rng(1)
    items = [(i, rng.integers(0, 60, 12).astype(np.uint64), rng.integers(0, 60, 3).astype(np.uint64)) for i in range(50)]
    df = {}
    for _, q, a in items:
        for w in set(np.concatenate([q, a]).tolist()):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.ItemIndex(items, df, len(items), 15.0)
    windows = np.repeat(np.arange(40), 20)
    terms = np.concatenate([rng.choice(index.n_terms, 20, replace=False) for _ in range(40)])
    got = {(w, i): s for w, i, s in zip(*(v.tolist() for v in index.retrieve(windows, terms, 0.4)), strict=True)}
    want = {}
    for w in range(40):
        scores = index.item.dense[terms[windows == w]].sum(axis=0)
        want |= {(w, int(i)): float(scores[i]) for i in np.flatnonzero(scores >= 0.4 - 1e-9)}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_line_dedup_against_brute_force(spark, texts, docs, none):
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t) for i, t in enumerate(["a\na\na\na", "b\n \nc", "x\nb\nc\ny", "b \nc\nz", "\n\n"])]
    seen1, seen2, want = set(), set(), {}
    for i, t in rows:
        if t is None:
            want[i] = (None, 0)
            continue
        lines = t.split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        x = [lines[k].strip(" \t\r") for k in solid]
        gone = set()
        for p, line in enumerate(x):
            if line in seen1 and len(line.split()) >= 10:
                gone.add(p)
            seen1.add(line)
            if p + 1 < len(x):
                if (line, x[p + 1]) in seen2:
                    gone |= {p, p + 1}
                seen2.add((line, x[p + 1]))
        drop = {solid[p] for p in gone}
        want[i] = ("\n".join(v for k, v in enumerate(lines) if k not in drop), len(drop))
    found = linededup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in found} == want
    assert set(linededup.remove_repeated_lines(docs).columns) == {*docs.columns, "n_lines", "n_removed"}
    assert linededup.remove_repeated_lines(docs).count() == docs.count()
    assert linededup.remove_repeated_lines(none).count() == 0
    runs = linededup.repeated_runs(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert runs.where("doc = 102").select("seq", "n_lines", "source_doc", "source_seq").collect() == [(1, 2, 101, 0)]


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, scale):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(120, 8)) * rng.gamma(1.0, 40.0, size=(120, 1)) * scale).astype(np.int64)
    x[5] = x[6] = x[7]
    rows = [(i, [int(v) for v in x[i]], "r", 1) for i in range(120)]
    odd = [(500, None, "", 1), (501, [1, None, 1, 1, 1, 1, 1, 1], "", 1), (502, [1], "", 1), (None, [1] * 8, "", 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, ivec array<bigint>, rank string, score bigint")
    found = topk.top_k(frame, F.col("vec_id") % 5 == 0, k=4, block_rows=30).collect()
    want = set()
    for q in range(0, 120, 5):
        scores = sorted((-int(x[i] @ x[q]), i) for i in range(120) if i != q)[:4]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    assert {tuple(r) for r in found} == want
    few = topk.top_k(frame.where("vec_id < 3"), F.col("vec_id") == 0, k=4).collect()
    assert [r.rank for r in sorted(few)] == [1, 2]
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_coordinate_pruning_is_exact():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    x = ((centre + 0.2 * rng.normal(size=(400, 16))) * 100).astype(np.int64)
    block = topk.Block(np.arange(400), x)
    scores = x @ x[0]
    ids, found = block.search(x[0], 0, 10, float(np.sort(scores[1:])[-10]))
    want = sorted((-int(s), i) for i, s in enumerate(scores) if i)[:10]
    assert sorted(zip((-found).tolist(), ids.tolist(), strict=True)) == want


def test_toxicity(spark, none):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("ma", "po", "ter", "lun") for b in ("ri", "so", "vek") for c in ("na", "du", "lim")]
    rows, labels = [], []
    for i in range(800):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["gronk", "gr0nk", "GRÖNK", "vlopper"]))
        rows.append((i, " ".join(text), "toxic"))
        labels.append((i, int(bad)))
    labels += [(3, None), (None, 1), (4, 7)]
    frame = spark.createDataFrame([*rows, (None, None, ""), (900, "", "")], "doc_id bigint, text string, label string")
    lexicon = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    found = {r.doc_id: r for r in toxicity.score(frame, lexicon).collect()}
    assert len(found) == 802 and all(0 <= r.score <= 1 for r in found.values())
    held = [i for i in range(800) if found[i].held_out]
    assert 100 < len(held) < 300
    assert all(found[i].predicted == int(i % 8 == 0) for i in held)
    assert found[None].predicted == found[900].predicted == 0
    assert toxicity.keep_clean(frame, lexicon).count() == 702
    empty = toxicity.learn(none, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(none, empty).count() == 0 and empty.score("anything") < 0.3


def test_folding_and_exceptions():
    assert toxicity.fold("1d10t, ІDІОT; Ídiôt") == " idiot idiot idiot "
    lexicon = toxicity.Lexicon({"tras": 5.0}, ["trash can"], (-3.0, 2.0, 0.5))
    assert lexicon.match(toxicity.fold("a trash can here"))[0] == 0
    assert lexicon.match(toxicity.fold("tr4sh canvas"))[0] == 5.0


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><nav><a>Home</a></nav>{}<footer>f</footer></body></html>"
    rows = [
        (1, "http://h.org/a/1", page.format("<article><h1>T &amp; x</h1><p>one\n two<br>three<p><b>b</b>old</article><div>side</div>")),
        (2, "http://h.org/b/2", page.format("<div>Shop top</div><p>own text</p><div>Shop end</div>")),
        (3, "http://h.org/b/3", page.format("<div>Shop top</div><p>other text</p><div>Shop end</div>")),
        (4, "http://alone.org/", page.format('<p>kept</p><div class="comments"><p>nice</p></div><script>x</script>')),
        (5, None, None), (6, "http://h.org/b/9", "<p>cut &am"), (None, "nonsense", "plain"),
    ]
    rows += [rows[1], (7, "http://h.org/b/2", rows[1][2])]
    frame = spark.createDataFrame([(*r, "n", "o") for r in rows], "page_id bigint, url string, html string, key string, other string")
    found = sorted(html.extract_main_text(frame).collect(), key=str)
    texts = {r.page_id: r.text for r in found}
    assert texts == {1: "T & x\none two three\nbold", 2: "own text", 3: "other text", 4: "kept", 5: "", 6: "cut &am", None: "plain", 7: "own text"}
    assert len(found) == 9 and all(r.n_chars == len(r.text) for r in found)
    assert html.extract_main_text(frame.limit(0)).count() == 0


def test_layout_classes_lose_no_article():
    for page in (
        '<div class="page has-sidebar"><p>old</p><article><h1>T</h1><p>own</article></div>',
        '<main class="no-sidebar"><h1>T</h1><p>own</p></main>', '<main class="search"><h1>T</h1><p>own</p></main>',
        '<article class="post comments-open"><h1>T</h1><p>own</article>',
        '<div id="sidebar"><p>old</p><article><header><h1>T</h1></header><p>own</p><div class="comments"><article>c</article></div></article></div>',
        '<form><nav>n</nav><div role="main"><h1>T</h1><p>own<span class="ad">ad</span></p></div></form>',
        '<div class="widget">w</div><article><h1>T</h1><p>own</article><aside><article class="teaser">more</article></aside>',
        '<div class="related"><div hidden><main>x</main></div></div><main><h1>T</h1><p>own</main>',
    ):
        assert html.main_text(f'<body class="sidebar">{page}</body>', None) == "T\nown", page
    # a part named so isn't all of the page
    page = '<div>Top</div><div class="{}">by me</div><p>own</p><p>text</p>'
    other = html.line_hashes(html.text_lines("<div>Top</div><p>different</p>"))
    for name in ("post-meta", "post", "entry story", "content"):
        assert html.main_text(page.format(name), other) == "by me\nown\ntext"
    assert html.main_text(page.format("comments"), other) == "own\ntext"


def test_copies_under_several_paths_meet_another_page(spark):
    page = "<div>Shop top</div><p>{}</p><div>Shop end</div>"
    rows = [(i, f"http://h.org/b/{i}", page.format("copied text")) for i in range(1, 6)]
    rows += [(6, "http://h.org/c", page.format("other text")), (7, "http://g.org/b/1", page.format("copied text"))]
    found = html.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    texts = {r.page_id: r.text for r in found.collect()}
    assert texts == dict.fromkeys(range(1, 6), "copied text") | {6: "other text", 7: "Shop top\ncopied text\nShop end"}


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(9))], np.uint64)
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(9))], np.uint64)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert html.shared_lines(a, b).sum() == best[-1][-1]


def test_quotes_that_nothing_closes():
    def lines(page):
        return [line for line, _ in html.text_lines(page)]

    assert lines('<p>own text</p><a href="x>link</a><p>more</p>') == ["own text", "link", "more"]
    assert lines("<p title='a>b\">one</p><p>two") == ["b\">one", "two"]
    assert lines('<p title="a>b">one</p><p>it\'s "two') == ["one", 'it\'s "two']
    assert lines('<p>one</p><a href="x') == ["one"]


@pytest.mark.parametrize("page", [
    "<a " * 300_000 + '"', "<p>x</p><a href=\"x>" * 60_000, "<a '>" * 200_000, "<div>" * 150_000 + "</x>" * 150_000,
    "<p><div>" + "<span>" * 100_000 + "<p></p>" * 100_000, "<div class=ad>" * 60_000 + "<article></article>" * 60_000,
    "<div>" * 100_000 + "<article></article>" * 60_000,
])
def test_time_follows_the_length_of_a_page(page):
    began = time.process_time()
    html.text_lines(page)
    assert time.process_time() - began < 15  # hours, if it followed the square


def test_lines_that_repeat_are_aligned_in_bounded_time():
    a = np.array([1, 2] * 10_000 + [3], np.uint64)
    b = np.array([2] + [1, 1, 2] * 7_000 + [4], np.uint64)
    began = time.process_time()
    kept = html.shared_lines(a, b)
    assert time.process_time() - began < 15
    # 2 and 1 in turn, from the first 2 of the other page on
    assert kept.sum() == html.common_lengths(a.tolist(), b.tolist())[-1] >= 14_000


def test_neighbours_by_long_paths(spark):
    page = "<div>Shop top</div><p>{}</p>"
    long = "/a" * 20_000
    rows = [(1, f"http://h.org{long}/x1", page.format("one")), (2, f"http://h.org{long}/x2", page.format("two")),
            (3, f"http://h.org{long}", "<div>Other</div><p>three</p>"), (4, "http://h.org", page.format("four"))]
    texts = {r.page_id: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert texts[1] == "one" and texts[2] == "two" and texts[3] == "Other\nthree"


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_token_counts(spark, docs, none):
    with open(RANKS, "rb") as file:
        tokenizer = tokens.ByteTokenizer(file.read())
    rows = tokens.count_tokens(docs, RANKS).collect()
    held = docs.collect()
    assert sum(r.n_tokens for r in rows) == sum(len(tokenizer.spans(d.text or "")[0]) for d in held)
    assert sum(r.n_chars for r in rows) == sum(len(d.text or "") for d in held)
    begins, ends = tokenizer.spans("naïve\n\n你好 \U0001f600")
    assert begins[0] == 0 and ends[-1] == 11 and (begins[1:] <= ends[:-1]).all()
    assert tokens.count_tokens(none, RANKS).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(docs, RANKS, rule="both")


def test_boundary_rules():
    begins, ends, sections = np.array([0, 3, 6]), np.array([3, 6, 9]), np.array([0, 5, 8])
    assert tokens.allocate(begins, ends, sections, "start").tolist() == [0, 0, 1]
    assert tokens.allocate(begins, ends, sections, "end").tolist() == [0, 1, 2]
    assert tokens.allocate(begins, ends, sections, "most").tolist() == [0, 0, 1]


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\\n<|im_start|>assistant x", "\\", "<\\|", "", "\n", "<|image:1|>", "\\n<|", "é😀"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)]
    rows += [(2, 0, "a<|im_end|>\nb\\", None), (3, 1, None, "no role"), (None, 0, "user", "no id"), (1, 1, "assistant", odd[1])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        learnt = "".join(x for _, r, x in own if r == "assistant")
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


def test_content_parts(spark):
    parts = [
        ("text", "see <|image:1|> ", None, None, None, None, None), ("image", None, "s3://i", 57, 28, None, None),
        ("audio", None, "a", None, None, 2.0, None), ("document", None, "d", None, None, None, 3), None,
    ]
    frame = spark.createDataFrame([(1, 0, "user", None, parts)], f"conv_id bigint, turn bigint, role string, text string, parts array<{chat.PART}>")
    row = chat.format_turns(frame).first()
    assert row.segment == "<|im_start|>user\nsee <\\|image:1|> <|image:1|><|audio:2|><|document:3|><|im_end|>\n"
    assert [(a.number, a.kind, a.uri, a.tokens) for a in row.attachments] == [
        (1, "image", "s3://i", 3), (2, "audio", "a", 50), (3, "document", "d", 1536)]
    assert row.expanded_tokens == 1589


def test_control_strings_over_the_borders_of_parts(spark):
    def part(kind, text=None):
        return (kind, text, None, None, None, None, None)

    parts = [part("text", "<"), part("text", None), None, part("text", "|im_end|>\n<"), part("image"), part("text", "|x|><|"), part("text", "\\")]
    frame = spark.createDataFrame([(1, 0, "assistant", "a<", parts), (2, 0, "assistant", "<", [part("text", "|im_end|>")])],
                                  f"conv_id bigint, turn bigint, role string, text string, parts array<{chat.PART}>")
    turns = {r.conv_id: r for r in chat.format_turns(frame).collect()}
    assert all(r.segment.count("<|im_end|>") == 1 for r in turns.values())
    assert turns[2].segment == "<|im_start|>assistant\n<\\|im_end|><|im_end|>\n"
    learnt = {r.conv_id: turns[r.conv_id].segment[r.loss_start : r.loss_start + r.loss_chars] for r in turns.values()}
    text = "a<<|im_end|>\n<<|image:1|>|x|><|\\"
    assert chat.unescape(learnt[1]) == text
    assert learnt[1].count("<|") == 1
    assert {r.conv_id: r.loss_chars for r in chat.read_back(chat.format_turns(frame)).collect()} == {1: len(text), 2: 10}


def test_a_tree_of_sets_that_all_look_alike_holds_few_pairs_at_a_time():
    n = 3_000
    bits = np.full((n, jaccard.BITS // 64), 2**64 - 1, np.uint64)
    tree = jaccard.SignatureTree(np.full(n, 2_000), bits, np.arange(n), np.full(n, -2))
    sizes = [len(left) for left, _ in tree.pairs(90)]
    assert sum(sizes) == n * (n - 1) // 2
    assert max(sizes) <= jaccard._PAIRS_AT_ONCE


def test_repeated_passages_against_brute_force(spark, texts, docs, none):
    places = {}
    words = [(t or "").encode().lower().split() for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            places.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    covered = {}
    for found in places.values():
        if len(found) > 1:
            for i, k in found:
                covered.setdefault(i, set()).update(range(k, k + 50))
    rows = passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert got == covered and covered
    assert passages.repeated_passages(docs).where("doc_id is null").count() <= 1
    assert passages.repeated_passages(none).count() == 0
    with pytest.raises(ValueError):
        passages.repeated_passages(docs, min_words=20)


def test_only_pairs_that_marks_leave_are_compared_on_whole_sets(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, 3_000, np.uint64)) for _ in range(3)]
    sets += [np.unique(np.concatenate([sets[0][k:], sets[1][: 2 * k]])) for k in (1, 40, 900)]
    for one in sets:
        for two in sets:
            numbers = [jaccard._numbered(jaccard.marks(s)) for s in (one, two)]
            both = len(np.intersect1d(one, two))
            assert both <= len(np.intersect1d(*numbers)) <= both + 350
            assert [len(n) for n in numbers] == [len(one), len(two)]

    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(40):
        words = list(base)
        for at in rng.integers(0, 400, 4 + k % 9):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    shingles = [{tuple(t.split()[i : i + 3]) for i in range(398)} for t in texts]
    linked = {(i, j) for i in range(40) for j in range(i) if 100 * len(shingles[i] & shingles[j]) >= 90 * len(shingles[i] | shingles[j])}
    tables = []
    cut = jaccard.cut_lineage

    def counted(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            tables.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", counted)
    found = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 90, 3)
    got = {r.doc_id: r.component_id for r in found.collect()}
    label = list(range(40))
    for _ in range(40):
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    assert got == dict(enumerate(label))
    # hubs: met, left by marks, linked; trees: met, left by marks; all links
    met, left, hubs, met_later, left_later, links = tables
    assert left == hubs <= met and left_later == links - hubs <= met_later


def test_keys_that_no_set_of_similar_size_shares_go_no_further(spark, monkeypatch):
    phrase = " ".join(f"p{i}" for i in range(40))
    lengths = [int(60 * 1.5**k) - 40 for k in range(12)]
    texts = [phrase + " " + " ".join(f"w{k}-{i}" for i in range(n)) for k, n in enumerate(lengths)]
    # as large as each other, but with too few n-grams in common
    texts += [" ".join(f"v{k}-{i}" for i in range(2_960)) + " " + phrase for k in range(2)]
    texts += [" ".join(f"{'x' if i == at else 'c'}{i}" for i in range(302)) for at in (7, 290)]
    tables = []
    store = jaccard.stored

    def kept(df):
        tables.append(store(df))
        return tables[-1]

    monkeypatch.setattr(jaccard, "stored", kept)
    found = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 90, 3)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert got == {i: min(i, len(texts) - 2) for i in range(len(texts))}
    dealt = [t for t in tables if t.columns == ["key", "sid", "n", "left"]]
    assert len(dealt) == 1
    assert {r.n for r in dealt[0].collect()} == {300}
    assert dealt[0].select("sid").distinct().count() == 2


@pytest.mark.parametrize("percent", [1, 50, 80, 90, 100])
def test_keys_of_sets_that_link_stay(spark, percent):
    # the smallest set that links with one of n n-grams, and as few keys as the two share at least
    rows = []
    for n in [*range(1, 300), *(2**k + d for k in range(9, 20) for d in (-1, 0, 1))]:
        less = (percent * n + 99) // 100
        rows += [(2 * n + side, size, n * 10**6 + j) for side, size in enumerate((n, less)) for j in range(jaccard.least_shared(less))]
    dealt = spark.createDataFrame(rows, "sid long, n long, key long")
    alone = spark.createDataFrame([(-1, 5, -1)], "sid long, n long, key long")
    assert {tuple(r) for r in jaccard.shared_keys(dealt.union(alone), percent).select("sid", "n", "key").collect()} == set(rows)


def near_copies(many, seed):
    """Texts, some of which link, made of one by other words here and there; and what brute force finds of 90 hundredths."""
    rng = np.random.default_rng(seed)
    texts = []
    for k in range(many):
        words = [f"w{i}" for i in range(400)]
        for at in rng.choice(400, 3 + k % 4, replace=False):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(398)} for t in texts]
    label = list(range(many))
    for i in range(many):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if one == high else one for one in label]
    return texts, dict(enumerate(label))


def test_what_trees_give_grows_no_faster_than_a_group(spark, monkeypatch, tmp_path):
    def counted(make, folder):
        def wrapped(*args):
            run = make(*args)

            def count(batches):
                import uuid

                rows = 0
                for batch in run(batches):
                    rows += batch.num_rows
                    yield batch
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                    out.write(str(rows))

            return count

        return wrapped

    made = {}
    steps = {name: getattr(jaccard, name) for name in ("_leaf_join", "_tree_join") if hasattr(jaccard, name)}
    for many in (60, 240):
        folder = tmp_path / str(many)
        folder.mkdir()
        for name, make in steps.items():
            monkeypatch.setattr(jaccard, name, counted(make, str(folder)))
        texts, wanted = near_copies(many, 3)
        assert len(set(wanted.values())) > many // 4
        found = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 90, 3)
        assert {r.doc_id: r.component_id for r in found.collect()} == wanted
        made[many] = sum(int(f.read_text()) for f in folder.iterdir())
    # four times the sets, sixteen times the pairs
    assert 0 < made[240] <= 6 * made[60]
    assert made[240] <= 240 * 46


@pytest.mark.parametrize("first", [1, 3, 16])
def test_trees_alone_find_all_links_of_a_group(spark, monkeypatch, first):
    texts, wanted = near_copies(70, 5)
    texts += [f"{texts[0]} a b c d", "q r s", "q r s", ""]
    texts.append(" ".join(f"w{i}" for i in range(400)))
    # no hubs, and keys of a few sets are cut into grids already
    for name, value in {"HUBS": 0, "LEAF": 3, "PIECE": 9, "VOLUME": 9_000, "FIRST": first}.items():
        monkeypatch.setattr(jaccard, name, value)
    shingles = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if (w := t.split()) else set() for t in texts]
    label = list(range(len(texts)))
    for i, one in enumerate(shingles):
        for j, two in enumerate(shingles[:i]):
            if one and label[i] != label[j] and 100 * len(one & two) >= 90 * len(one | two):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    found = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 90, 3)
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(label))
    assert len(set(label)) < len(texts) - 3


def test_runs_of_pairs():
    left, right = np.array([3, 1, 3, 2]), np.array([4, 5, 6, 7])
    for some in (0, 1, 4):
        found = [(one, other) for one, others in jaccard._runs(left[:some], right[:some]) for other in others.tolist()]
        assert sorted(found) == sorted(zip(left[:some].tolist(), right[:some].tolist(), strict=True))
        assert len({one for one, _ in found}) == len(list(jaccard._runs(left[:some], right[:some])))
