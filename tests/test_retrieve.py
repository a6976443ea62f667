import numpy as np
import pytest
from pairmatch.operators import copies as cp
from pairmatch.plans.retrieve import Retrieval, retrieve


@pytest.fixture(scope="module")
def case(spark):
    """An index and queries in which a third of the rows are copies of one vector."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 6))
    index = {i: base[0] if i % 3 == 0 else base[1 + rng.integers(11)] + 0.02 * rng.normal(size=6) for i in range(90)}
    index[90] = index[1].copy()
    queries = {}
    truth = {}
    for k in range(45):
        q = 1000 + k
        truth[q] = int(rng.integers(91)) if k % 9 else None
        queries[q] = base[0] if k % 3 == 0 else index[truth[q] or 0] + 0.05 * rng.normal(size=6)

    def frame(vectors):
        rows = [(i, v.tolist()) for i, v in vectors.items()]
        return spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)

    truth_df = spark.createDataFrame(list(truth.items()), "query_id long, truth_id long")
    found = retrieve(frame(index), frame(queries), truth_df, p=24, t=6, b=24, r=4, seed=1)
    ih = dict(zip(index, found.model.hash_bits(np.array(list(index.values())))))
    qh = dict(zip(queries, found.model.hash_bits(np.array(list(queries.values())))))
    # gid: the smallest id with the same vector
    gid = {i: min(j for j in index if np.array_equal(index[i], index[j])) for i in index}
    plain = {}
    for q in queries:
        cands = [
            c for c in index
            if any((a == b).all() for a, b in zip(np.split(qh[q], 6), np.split(ih[c], 6)))
        ]
        score = {c: np.exp(-((queries[q] - index[c]) ** 2).sum()) for c in cands}
        # scores of copies are equal, those of different vectors differ
        plain[q] = sorted(cands, key=lambda c: (-round(score[c], 12), gid[c], c))
    qgid = {q: min(r for r in queries if np.array_equal(queries[q], queries[r])) for q in queries}
    return found, plain, truth, {(qgid[q], gid[c]) for q, cands in plain.items() for c in cands}


def test_counts_and_stats(case):
    found, plain, truth, _ = case
    got = {r.query_id: (r.n_candidates, r.hits) for r in found.counts().collect()}
    assert got == {q: (len(c), int(truth[q] in c)) for q, c in plain.items()}
    stats = found.stats().first()
    some = [len(c) for c in plain.values() if c]
    assert stats.pct_with_candidates == pytest.approx(100 * len(some) / len(plain))
    assert stats.mean_candidates == pytest.approx(np.mean(some))


def test_ranks(case):
    found, plain, truth, _ = case
    got = {r.query_id: r.first_rank for r in found.query_ranks().collect()}
    assert got == {q: c.index(truth[q]) + 1 if truth[q] in c else None for q, c in plain.items() if c}
    ranks = [r for r in got.values() if r]
    assert found.metrics().first().mrr == pytest.approx(sum(1 / r for r in ranks) / len(got))


@pytest.mark.parametrize("k", [1, 5, 40])
def test_top(case, k):
    found, plain, truth, _ = case
    rows = found.top(k).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.cand_id)
        assert r.label == float(truth[r.query_id] == r.cand_id)
    assert got == {q: c[:k] for q, c in plain.items() if c}


def test_pairs_are_between_distinct_vectors(case):
    found, plain, _, distinct = case
    matches = [(m.query_gid, m.cand_gid) for m in found.matches.collect()]
    assert len(matches) == len(set(matches)) and set(matches) == distinct
    assert len(distinct) < sum(len(c) for c in plain.values())


def test_several_originals(spark, case):
    """None, one or several originals of a query, copies among them."""
    found, plain, _, _ = case
    wanted = {q: {c for c in range(91) if (c * 7 + q) % 10 < q % 4} for q in plain}
    wanted |= {q: set(c[1:2]) for q, c in plain.items() if q % 4 == 1}
    rows = [(q, c) for q, cands in wanted.items() for c in cands]
    truth = spark.createDataFrame(rows + rows[:5] + [(1000, None)], "query_id long, truth_id long")
    several = Retrieval(found.model, found.layout, found.index, found.queries, truth)
    got = {r.query_id: (r.n_candidates, r.hits) for r in several.counts().collect()}
    assert got == {q: (len(c), len(wanted[q] & set(c))) for q, c in plain.items()}
    assert several.stats("cp").first().pct_found == pytest.approx(100 * sum(h for _, h in got.values()) / 91)
    ranks = {q: [i for i, x in enumerate(c, 1) if x in wanted[q]] for q, c in plain.items() if c}
    per_query = {r.query_id: r for r in several.query_ranks().collect()}
    assert set(per_query) == set(ranks)
    for q, places in ranks.items():
        row = per_query[q]
        assert (row.first_rank, row.top_hits) == (min(places, default=None), sum(p <= 3 for p in places))
        assert row.mean_reciprocal == (pytest.approx(np.mean([1 / p for p in places])) if places else None)
    assert {min(len(p), 2) for p in ranks.values()} == {0, 1, 2}
    figures = several.metrics("cp").first()
    assert figures.precision_at_3 == pytest.approx(np.mean([sum(x <= 3 for x in p) / 3 for p in ranks.values()]))
    top = {(r.query_id, r["rank"]): (r.cand_id, r.label) for r in several.top(5).collect()}
    assert top == {(q, i): (x, float(x in wanted[q])) for q, c in plain.items() for i, x in enumerate(c[:5], 1)}


def test_copy_sets(spark):
    rows = spark.createDataFrame(
        [(i, [1], (i % 2, 0)) for i in range(10)], "id long, sig array<bigint>, digest struct<a: bigint, b: bigint>"
    )
    sets = cp.copy_sets(rows)
    assert {(r.gid, r.copies) for r in sets.collect()} == {(0, 5), (1, 5)}
    members = cp.memberships(rows, sets)
    places = cp.places_in_set(members).orderBy("id").collect()
    assert [(r.id, r.place) for r in places] == [(i, i // 2) for i in range(10)]


def test_all_pairs_of_ids(case):
    found, plain, truth, _ = case
    rows = found.pairs().collect()
    assert sorted((r.query_id, r.cand_id) for r in rows) == sorted((q, c) for q, cands in plain.items() for c in cands)
    assert all(r.label == float(truth[r.query_id] == r.cand_id) for r in rows)


def test_batches_of_a_retrieval(case, tmp_path):
    from pairmatch.sources.store import read_pair_batches

    found, plain, truth, _ = case
    ranges, positions = found.write_batches(str(tmp_path / "pairs"), size=64)
    stored = {(r.query_id, r.cand_id): (r.batch, r.slot) for r in read_pair_batches(found.index.sparkSession, str(tmp_path / "pairs")).collect()}
    order = sorted((q, c) for q, cands in plain.items() for c in cands)
    assert stored == {pair: divmod(n, 64) for n, pair in enumerate(order)}
    first = {}
    for n, (q, _) in enumerate(order):
        first.setdefault(q, n)
    ends = {q: first[q] + len(c) for q, c in plain.items() if c}
    got = {r.query_id: (r.start_batch, r.start_slot, r.end_batch, r.end_slot, r.n_relevant) for r in ranges.collect()}
    assert got == {
        q: (*divmod(first[q], 64), *divmod(ends[q], 64), int(truth[q] in plain[q])) for q in ends
    }
    assert {(r.query_id, r.position) for r in positions.collect()} == {
        (q, sorted(plain[q]).index(truth[q])) for q in ends if truth[q] in plain[q]
    }


def test_batches_are_written_without_tables_of_pairs_on_the_way(case, tmp_path, monkeypatch):
    from dataclasses import replace

    from pairmatch.lineage import cut_lineage
    from pairmatch.operators import ordering
    from pairmatch.plans import retrieve as plan
    from pairmatch.sources.store import read_pair_batches

    kept = []

    def counted(df):
        out = cut_lineage(df)
        kept.append(out.count())
        return out

    for module in (plan, ordering):
        monkeypatch.setattr(module, "cut_lineage", counted)
    found, plain, truth, distinct = case
    replace(found).write_batches(str(tmp_path / "pairs"), size=64)
    assert max(kept) < len(distinct)
    stored = read_pair_batches(found.index.sparkSession, str(tmp_path / "pairs")).orderBy("n").collect()
    assert [(r.query_id, r.cand_id, r.label) for r in stored] == sorted(
        (q, c, float(truth[q] == c)) for q, cands in plain.items() for c in cands
    )


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_get_their_places_without_being_sorted(spark, kind, tmp_path, monkeypatch):
    """Repeated ids, several originals, large and small buckets, many tasks and ranges: as by sorting all pairs."""
    from collections import Counter

    from pairmatch.operators.pairs import pack_labelled
    from pairmatch.operators.placed import placed_pairs
    from pairmatch.plans import retrieve as plan
    from pairmatch.sources.store import read_pair_batches
    from pyspark.sql import functions as F

    rng = np.random.default_rng(13)
    base = rng.normal(size=(6, 4))
    rows = [(i * i, (base[i % 6] + 0.1 * (i % 5) * rng.normal(size=4)).tolist()) for i in range(150)]
    rows += [(90_000, [0.5, None, 0.5, 0.5]), *rows[3:6], (None, rows[0][1]), (95_000, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>").withColumn("id", F.col("id").cast(kind)).repartition(3)
    truth = spark.createDataFrame(
        [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i % 7 :: 40]] + [(1, None), (None, 1)], "query_id long, truth_id long"
    ).select(*[F.col(c).cast(kind).alias(c) for c in ("query_id", "truth_id")])
    found = retrieve(df, df, truth, p=16, t=4, b=6, r=2, seed=1)
    wanted = pack_labelled(found._id_pairs(), found.truth, 64).orderBy("n").collect()
    assert len(wanted) > 10_000 and {r.label for r in wanted} == {0.0, 1.0} and any(r.score is None for r in wanted)

    def listed(rows):
        # equal ids stand in any order
        return Counter((r.query_id, r.cand_id, r.label, -1 if r.score is None else float(np.float32(r.score))) for r in rows)

    queries, index = found._with_ids()
    pairs, per_task = placed_pairs(index, queries, found.truth, found.layout, found.scorer, 1_000, 1, range_bits=3)
    got = pairs.withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    assert per_task < 1_000 or len({r["at"] >> 33 for r in got}) >= len(wanted) // 1_000
    assert [r.n for r in got] == list(range(len(wanted)))
    assert [(r.query_id, r.cand_id, r.label) for r in got] == [(r.query_id, r.cand_id, r.label) for r in wanted]
    assert listed(got) == listed(wanted)

    # pairs are neither sorted as rows nor by the writer, and the session is as before
    monkeypatch.setattr(plan, "pack_labelled", None)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    ranges, _ = found.write_batches(str(tmp_path / "pairs"), size=7)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    stored = read_pair_batches(spark, str(tmp_path / "pairs")).orderBy("n").collect()
    assert [(r.n, r.batch, r.slot) for r in stored] == [(n, n // 7, n % 7) for n in range(len(wanted))]
    assert listed(stored) == listed(wanted)
    assert sum(r.n_relevant for r in ranges.collect()) == sum(r.label for r in wanted)


def test_squared_distances_of_tiles_and_rows():
    from pairmatch.operators.blocks import squared_cells, squared_distances

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(300, 9)), rng.normal(size=(70, 9))
    a[5, 2] = np.nan
    cells = squared_cells(a, b)
    left, right = (m.ravel() for m in np.indices(cells.shape))
    plain = np.zeros(len(left))
    for x, y in zip(a[left].T, b[right].T, strict=True):
        plain += (x - y) * (x - y)
    assert np.array_equal(cells.ravel(), plain, equal_nan=True)
    assert np.array_equal(squared_distances(a[left], b[right]), plain, equal_nan=True)
    with pytest.raises(ValueError):
        squared_distances(a, b[:, :1])


def _split_plain(found, index, queries, target):
    """Candidates by prefixes that grow bit by bit until at most ``target`` signatures of the index share them."""
    width = found.layout.width
    text = lambda bits: "".join(map(str, bits)) * 2
    sigs = {text(b) for b in found.model.hash_bits(np.array(list(index.values())))}
    bits = len(next(iter(sigs))) // 2

    def keys(sig):
        out = []
        for band in range(found.layout.bands):
            at = band * width
            depth = width
            while depth < bits and sum(s[at : at + depth] == sig[at : at + depth] for s in sigs) > target:
                depth += 1
            out.append((depth, sig[at : at + depth]))
        return out

    ik = {i: keys(text(b)) for i, b in zip(index, found.model.hash_bits(np.array(list(index.values()))))}
    qk = {q: keys(text(b)) for q, b in zip(queries, found.model.hash_bits(np.array(list(queries.values()))))}
    return {q: {i for i in ik if any(a == b for a, b in zip(qk[q], ik[i]))} for q in qk}


@pytest.mark.parametrize("target", [1, 3, 1000])
def test_split_buckets_in_the_retrieval(spark, target):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(10, 6))
    index = {i: base[0] if i % 3 == 0 else base[rng.integers(10)] + 0.05 * rng.normal(size=6) for i in range(120)}
    queries = {1000 + k: index[2 * k + 1] + 0.02 * rng.normal(size=6) for k in range(50)}
    truth = spark.createDataFrame([(1000 + k, 2 * k + 1) for k in range(50)], "query_id long, truth_id long")

    def frame(vectors):
        return spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, vec array<double>").repartition(3)

    found = retrieve(frame(index), frame(queries), truth, p=24, t=6, b=24, r=4, seed=1, target=target)
    plain = _split_plain(found, index, queries, target)
    rows = found.pairs().collect()
    assert len(rows) == sum(len(c) for c in plain.values())
    assert {(r.query_id, r.cand_id) for r in rows} == {(q, c) for q, cands in plain.items() for c in cands}
    assert {r.query_id: (r.n_candidates, r.hits) for r in found.counts().collect()} == {
        q: (len(c), int(2 * (q - 1000) + 1 in c)) for q, c in plain.items()
    }


def test_a_search_of_ones_own_has_no_split_buckets(case):
    found = case[0]
    with pytest.raises(ValueError, match="split"):
        Retrieval(found.model, found.layout, found.index, found.queries, search=lambda *a: None, target=2)


def _by_model(pairs):
    from pairmatch.operators.scoring import score_pairs

    def closeness():
        return lambda a, b: np.exp(-((a - b) ** 2).sum(axis=1))

    return score_pairs(pairs, closeness, dim=6)


def _scorers():
    from pairmatch.operators.bucketwise import Closeness, Distance
    from pairmatch.operators.scoring import PairScorer, segment_distances

    return {
        "closeness": Closeness(), "distance": Distance(), "learned": PairScorer((0.5, -1.0, -0.25), segment_distances(2)),
        "model": _by_model,
    }


@pytest.mark.parametrize("scorer", ["closeness", "distance", "learned", "model"])
def test_buckets_are_reduced_without_a_table_of_pairs(spark, scorer):
    """Large and small buckets, copies, ties and far vectors: the same as from all scored pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 6))
    # whole numbers give equal distances between different vectors
    index = [np.round(base[0] + rng.integers(-2, 3, 6)) if i % 2 else base[rng.integers(12)] + 0.1 * rng.normal(size=6) for i in range(240)]
    queries = [index[(7 * k) % 240] + (0 if k % 3 else 40.0 if k % 5 == 0 else 1.0) for k in range(120)]
    truth = [(1000 + k, c) for k in range(120) for c in range(240) if c == (7 * k) % 240 or (c + k) % 40 == 0]

    def frame(rows, first, kind):
        data = [(first + i, v.tolist()) for i, v in enumerate(rows)]
        return spark.createDataFrame(data, f"id long, vec array<{kind}>").repartition(3)

    args = (frame(index, 0, "float"), frame(queries, 1000, "double"), spark.createDataFrame(truth, "query_id long, truth_id long"))
    made = [retrieve(*args, p=24, t=6, b=8, r=2, seed=1, scorer=_scorers()[scorer]) for _ in range(2)]
    blocks, table = made
    assert table.scored.count() > 5_000
    for k in (1, 7):
        got, want = (
            sorted((r.query_id, r["rank"], r.cand_id, r.label, round(r.score, 9)) for r in found.top(k).collect()) for found in made
        )
        assert got == want
    got, want = ({r.query_id: (r.n_candidates, r.hits) for r in found.counts().collect()} for found in made)
    assert got == want
    if scorer != "model":
        got, want = (
            {r.query_id: (r.first_rank, round(r.mean_reciprocal or 0, 9), r.top_hits) for r in found.query_ranks().collect()}
            for found in made
        )
        assert got == want
    assert not {"scored", "matches"} & set(blocks.__dict__)


def test_a_model_scores_in_blocks_without_a_stream_of_vectors(spark, monkeypatch):
    """As with scores from a table, for pairs without one too; no pair leaves its task with its vectors."""
    from pairmatch.operators.scoring import PairModel
    from pairmatch.plans import retrieve as plan
    from pairmatch.registry import vectors

    rng = np.random.default_rng(21)
    rows = [(i, (rng.normal(size=4) if i % 3 else np.zeros(4)).tolist()) for i in range(180)]
    rows += [(180, [0.5, None, 0.5, 0.5]), (181, [0.5, None, 0.5, 0.5]), *rows[3:9]]
    df = spark.createDataFrame(rows, "id long, vec array<float>")

    def scorer(pairs):
        return PairModel(vectors._closeness, dim=4)(pairs)

    blocks, table = (retrieve(df, df, p=16, t=4, b=4, r=2, seed=1, scorer=s) for s in (PairModel(vectors._closeness, dim=4), scorer))
    assert table.scored.where("score is null").count()
    monkeypatch.setattr(plan, "listed_in_blocks", None)
    for k in (3, 150):
        got, want = (
            sorted((r.query_id, r["rank"], r.cand_id, round(r.score or 0, 9)) for r in f.top(k).collect()) for f in (blocks, table)
        )
        assert got == want
    wrong = retrieve(df, df, p=16, t=4, b=4, r=2, seed=1, scorer=PairModel(lambda: lambda a, b: np.zeros(1 + len(a)), dim=4))
    with pytest.raises(Exception, match="one score for each pair"):
        wrong.top(1).collect()


def test_ids_that_repeat_and_vectors_without_some_elements(spark):
    """A row for each time an id is there, as in a join by ids; no score comes last."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=4) if i < 50 else np.zeros(4)).tolist()) for i in range(60)]
    rows += [(60, [0.5, None, 0.5, 0.5]), (61, [0.5, None, 0.5, 0.5]), *rows[3:9], rows[55]]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    truth = spark.createDataFrame([(i, i) for i in range(62)], "query_id long, truth_id long")
    blocks, table = (retrieve(df, df, truth, p=16, t=4, b=4, r=2, seed=1) for _ in range(2))
    assert table.scored.where("score is null").count()
    got, want = (sorted((r.query_id, r["rank"], r.cand_id, round(r.score or 0, 9)) for r in f.top(5).collect()) for f in (blocks, table))
    assert got == want
    got, want = (sorted((r.query_id, r.first_rank or 0, r.top_hits) for r in f.query_ranks().collect()) for f in (blocks, table))
    assert got == want


def test_nothing_to_find(spark, case):
    found = case[0]
    far = Retrieval(found.model, found.layout, found.index, found.queries.limit(0))
    assert far.pairs().count() == 0
