"""Stages of the corpus pipeline on small tables with nulls, shared ids, repeated rows and odd columns."""

import random

import pytest

import corpus_pipeline

DOCS = "doc_id bigint, text string, lang string, source string, unit string, version string, other bigint"
_RNG = random.Random(9)


def sentence(n):
    return " ".join(f"w{_RNG.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A benchmark of two items and no labels."""
    path = tmp_path_factory.mktemp("tables")
    items = [(1, f"{sentence(30)}. {sentence(5)}."), (2, f"{sentence(25)}. {sentence(4)}.")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), [text for _, text in items]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def row(doc_id, text, other=0):
    return (doc_id, text, "en", "src0", "u", "v", other)


def test_near_copies_are_told_by_id_and_text(spark, folder):
    a, b, c, d, e = (sentence(60) for _ in range(5))
    near = f"{a} end"
    rows = [
        row(3, a), row(10, near), row(10, b),  # only one text of 10 is a copy
        row(11, c, 2), row(11, c, 1), row(11, c, 1), row(12, c),  # repeated rows, and a copy of them
        row(None, d), row(None, d), row(None, a), row(None, e), row(20, e),  # rows without id
        row(30, None), row(30, None), row(31, None), row(31, ""), row(None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    found = corpus_pipeline.drop_near_copies(spark, docs, folder[0])
    assert found.columns == docs.columns
    stay = [row(3, a), row(10, b), row(11, c, 1), row(None, d), row(20, e), row(30, None), row(31, None), row(31, ""), row(None, None)]
    assert rows_of(found) == sorted(stay, key=str)
    # without repeated rows
    found = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows[:3] + rows[6:8], DOCS), folder[0])
    assert rows_of(found) == sorted([row(3, a), row(10, b), row(12, c), row(None, d)], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), folder[0]).count() == 0


def test_benchmark_is_told_by_id_and_text(spark, folder):
    path, items = folder
    clean = [row(1, sentence(50)), row(2, sentence(20)), row(2, sentence(20)), row(None, sentence(40)), row(3, None), row(None, None), row(4, "")]
    leaks = [row(1, f"{sentence(9)} {items[0]} {sentence(9)}"), row(None, f"{sentence(5)} {items[1]}"), row(7, items[1])]
    docs = spark.createDataFrame([*clean, clean[1], *leaks, leaks[0]], DOCS)
    found = corpus_pipeline.drop_benchmark(spark, docs, path)
    assert found.columns == docs.columns
    assert rows_of(found) == sorted([*clean, clean[1]], key=str)
    assert corpus_pipeline.drop_benchmark(spark, docs.limit(0), path).count() == 0


def test_toxic_documents_go(spark, tmp_path):
    """Short labelled texts are learnt from like others; without labels nothing goes."""
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ma", "po", "ter", "lun", "vek") for b in ("riso", "nadu", "limo", "sata")]
    rows = [row(i, f"{rng.choice(words)} {'gronkh' if i % 20 < 3 else rng.choice(words)}") for i in range(400)]
    rows += [row(500, None), row(501, ""), row(None, "gronkh"), row(None, "lunriso"), row(3, "lunriso gronkh")]
    labels = [(i, int(i % 20 < 3)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    found = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    assert rows_of(found) == sorted((r for r in rows if "gronkh" not in (r[1] or "")), key=str)
    assert corpus_pipeline.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_without_labels_nothing_goes(spark, folder):
    docs = spark.createDataFrame([row(1, "some text"), row(None, None)], DOCS)
    assert rows_of(corpus_pipeline.drop_toxic(spark, docs, folder[0])) == rows_of(docs)


def test_repeated_lines_go(spark, folder):
    long = "one two three four five six seven eight nine ten"
    schema = f"{DOCS}, n_chars bigint, n_lines string, N_Removed string, _doc string, _version string, _gone string"
    rest = ("a", "b", "c", "d", "e")

    def full(doc_id, text):
        return (*row(doc_id, text), len(text or ""), *rest)

    rows = [full(1, f"{long}\nx\ny"), full(2, f"  {long}\nz"), full(3, "x\ny\nw"), full(4, long), full(5, None), full(6, ""), full(None, "w"), full(3, "own")]
    docs = spark.createDataFrame(rows, schema)
    found = corpus_pipeline.drop_repeated_lines(spark, docs, folder[0])
    assert found.columns == docs.columns
    assert rows_of(found) == sorted([rows[0], full(2, "z"), full(3, "w"), *rows[4:]], key=str)
    plain = docs.select("doc_id", "text")  # without n_chars
    assert corpus_pipeline.drop_repeated_lines(spark, plain, folder[0]).columns == ["doc_id", "text"]
    assert corpus_pipeline.drop_repeated_lines(spark, docs.limit(0), folder[0]).count() == 0


def test_mixing_keeps_columns(spark, folder):
    schema = f"{DOCS}, domain string, n_tokens string, Epochs string, own string, doc string"
    rows = [(*row(i, sentence(10 + i)), "x", "y", "z", "o", "d") for i in range(40)] + [(*row(50, None), *"xyzod"), (*row(None, sentence(8)), *"xyzod")]
    docs = spark.createDataFrame(rows + rows[:2], schema)
    found = corpus_pipeline.mix_sources(spark, docs, folder[0])
    assert found.columns == [*DOCS_COLUMNS, "own", "doc", "domain", "n_tokens", "epochs"]
    texts = {r[:2]: r for r in rows}
    for r in found.collect():
        n = len(r.text.split())
        assert tuple(r)[:9] == texts[r.doc_id, r.text][:7] + ("o", "d") and r.n_tokens in (n, 2 * n) and r.epochs > 0
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), folder[0]).count() == 0


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "unit", "version", "other"]


def test_run_against_plain_python(spark, tmp_path_factory):
    """All stages over a small corpus with one reason to go at a time."""
    path = tmp_path_factory.mktemp("corpus")
    items = [(1, f"{sentence(30)}. {sentence(5)}.")]
    clean = [sentence(40) for _ in range(60)]
    base, repeated = sentence(80), "\n".join(sentence(12) for _ in range(3))
    rows = [(i, t, "en", f"src{i % 6}", len(t)) for i, t in enumerate(clean)]
    toxic = [(i, f"{sentence(6)} gronkh {sentence(6)}", "en", "src1", 1) for i in range(100, 160)]
    rows += toxic + [(200, base, "en", "src0", 1), (201, f"{base} end", "en", "src0", 1)]
    rows += [(210, f"{sentence(20)}\n{repeated}", "en", "src2", 1), (211, f"{sentence(20)}\n{repeated}", "en", "src2", 1), (212, repeated, "en", "src2", 1)]
    rows += [(220, f"{sentence(5)} {items[0][1]}", "en", "src3", 1), (230, None, "en", "src0", 0), (231, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 0) for i in range(60)] + [(r[0], 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")

    wanted = {r[0]: r[1] for r in rows if r[0] not in {t[0] for t in toxic} | {201, 212, 220}}
    wanted[211] = rows[-5][1].split("\n")[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(path))
    assert {r.doc_id: r.text for r in docs.collect()} == wanted
    tokens = sum(len((t or "").split()) for t in wanted.values())
    mixed = corpus_pipeline.run(spark, str(path)).collect()
    assert mixed and all(wanted[r.doc_id] == r.text and r.n_tokens == len(r.text.split()) and 1 <= r.epochs <= 4 for r in mixed)
    assert 0.2 * tokens < sum(r.n_tokens * r.epochs for r in mixed) <= 0.5 * tokens
