import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.functions.names import number_of_str, stem
from pairmatch.functions.vectors import (
    hamming_distance,
    packed_hamming_distance,
    permute_bits,
    squared_l2,
    weighted_score,
)
from pairmatch.operators import assets as at
from pairmatch.operators import distances as ds
from pairmatch.operators import metrics as mt
from pairmatch.operators import pairs as pr
from pairmatch.operators import scoring as sc
from pairmatch.operators import splices as sp
from pairmatch.operators.ordering import number_rows, rank_within, running_total


def scored_pairs(spark, n=600, seed=1):
    """Query 0 holds a third of the pairs; scores tie often."""
    rng = random.Random(seed)
    rows = {}
    for i in range(n):
        q = 0 if i % 3 == 0 else rng.randrange(1, 12)
        rows[q, rng.randrange(1000)] = (rng.choice([0.0, 0.0, 0.5, 1.0]) if q != 11 else 0.0, rng.randrange(20) / 20)
    flat = [(q, c, label, score) for (q, c), (label, score) in rows.items()]
    df = spark.createDataFrame(flat, "query_id long, cand_id long, label double, score double")
    return df.repartition(5), flat


def test_number_rows_and_rank_within(spark):
    df, rows = scored_pairs(spark)
    numbered = number_rows(df, ["query_id", "cand_id"], "n", start=3).collect()
    order = sorted((r[0], r[1]) for r in rows)
    assert [(r.query_id, r.cand_id) for r in sorted(numbered, key=lambda r: r.n)] == order
    assert sorted(r.n for r in numbered) == list(range(3, 3 + len(rows)))
    ranked = rank_within(df, ["query_id"], [F.desc("score"), "cand_id"]).collect()
    for q in range(12):
        mine = sorted((r for r in ranked if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r.cand_id for r in mine] == [r.cand_id for r in sorted(mine, key=lambda r: (-r.score, r.cand_id))]


def test_rank_within_keeps_rows_with_a_null_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 5)], "g string, v int")
    got = {(r.g, r.v, r["rank"]) for r in rank_within(df, ["g"], ["v"]).collect()}
    assert got == {(None, 1, 1), (None, 2, 2), ("a", 5, 1)}


def test_running_total(spark):
    df, rows = scored_pairs(spark)
    weighted = df.withColumn("w", F.col("cand_id") % 7)
    got = running_total(weighted, ["query_id"], [F.desc("score"), "cand_id"], "w").collect()
    for q in range(12):
        total = 0
        for r in sorted((r for r in got if r.query_id == q), key=lambda r: (-r.score, r.cand_id)):
            assert r.before == total
            total += r.cand_id % 7
    assert len(got) == len(rows)


def test_running_total_of_a_group_over_many_partitions(spark):
    """Partitions that hold one group only, and groups that end where a partition does."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sizes = {"a": 1, "b": 150, "c": 3, None: 120, "e": 40}
        rows = [(g, i, (i * 7) % 5) for g, n in sizes.items() for i in range(n)]
        df = spark.createDataFrame(rows, "g string, i int, w int").repartition(4)
        got = running_total(df, ["g"], ["i"], "w").collect()
        assert len(got) == len(rows)
        for g, n in sizes.items():
            mine = sorted((r for r in got if r.g == g), key=lambda r: r.i)
            assert [r.before for r in mine] == [sum((j * 7) % 5 for j in range(i)) for i in range(n)]
        two = running_total(df.withColumn("h", F.col("i") % 2), ["g", "h"], ["i"], "w").collect()
        for r in two:
            assert r.before == sum((j * 7) % 5 for j in range(r.i % 2, r.i, 2))
        ranks = rank_within(df, ["g"], [F.desc("i")]).collect()
        assert all(r["rank"] == sizes[r.g] - r.i for r in ranks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_results_do_not_depend_on_shuffle_partitions(spark):
    df, _ = scored_pairs(spark)
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(mt.rank_candidates(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_batches_partition_the_pairs(spark):
    df, rows = scored_pairs(spark)
    packed = pr.pack_batches(df, 50)
    got = packed.collect()
    assert sorted((r.batch, r.slot) for r in got) == [(i // 50, i % 50) for i in range(len(rows))]
    index = {r.query_id: r for r in pr.batch_index(packed, 50).collect()}
    order = sorted(rows)
    for q, r in index.items():
        places = [i for i, row in enumerate(order) if row[0] == q]
        assert (r.start_batch, r.start_slot) == divmod(places[0], 50)
        assert (r.end_batch, r.end_slot) == divmod(places[-1] + 1, 50)
        relevant = [i - places[0] for i in places if order[i][2] == 1.0]
        assert r.n_relevant == len(relevant)
        found = pr.relevant_positions(packed).where(F.col("query_id") == q).collect()
        assert sorted(x.position for x in found) == relevant


def plain_metrics(rows, mode):
    by_query = {}
    for q, c, label, score in rows:
        by_query.setdefault(q, []).append((-score, c, label))
    mrr, every, precision, firsts = [], [], [], []
    for found in by_query.values():
        ranks = [i + 1 for i, (_, _, label) in enumerate(sorted(found)) if label == 1.0]
        if not ranks:
            mrr.append(0), every.append(0), precision.append(0)
            continue
        mrr.append(1 / ranks[0])
        firsts.append(ranks[0])
        if mode == "cp":
            every.append(np.mean([1 / r for r in ranks]))
            precision.append(sum(r <= 3 for r in ranks) / 3)
    shares = [100 * firsts.count(r) / len(firsts) if firsts else None for r in range(1, 5)]
    mean = lambda v: float(np.mean(v)) if v else None
    return [len(by_query), mean(mrr), mean(every), mean(precision), *shares]


@pytest.mark.parametrize("mode", ["pc", "cp"])
def test_ranking_metrics(spark, mode):
    df, rows = scored_pairs(spark)
    assert list(mt.ranking_metrics(mt.rank_candidates(df), mode).first()) == pytest.approx(plain_metrics(rows, mode))


def test_ranking_metrics_edges(spark):
    schema = "query_id long, cand_id long, label double, score double"
    hit = spark.createDataFrame([(1, 1, 1.0, 0.5)], schema)
    got = mt.ranking_metrics(mt.rank_candidates(hit), "pc").first()
    assert got.mrr == 1.0 and got.mrr_all is None and got.precision_at_3 is None
    miss = spark.createDataFrame([(1, 1, 0.5, 0.5)], schema)
    got = mt.ranking_metrics(mt.rank_candidates(miss), "cp").first()
    assert got.mrr == 0.0 and got.pct_rank_1 is None
    with pytest.raises(ValueError):
        mt.ranking_metrics(mt.rank_candidates(hit), "xx")


def test_topk_limits_before_the_shuffle(spark):
    df, rows = scored_pairs(spark)
    best = mt.topk(df, 4)
    assert "WindowGroupLimit" in best._jdf.queryExecution().toString()
    expected = set()
    for q in {r[0] for r in rows}:
        mine = sorted((-r[3], r[1]) for r in rows if r[0] == q)[:4]
        expected |= {(q, c, i + 1) for i, (_, c) in enumerate(mine)}
    assert {(r.query_id, r.cand_id, r["rank"]) for r in best.collect()} == expected


def test_retrieval_stats(spark):
    queries = spark.createDataFrame([(i,) for i in range(4)], "query_id long")
    pairs = spark.createDataFrame(
        [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 0.0), (1, 4, 0.0), (1, 5, 0.0)], "query_id long, cand_id long, label double"
    )
    counts = mt.candidate_counts(pairs, queries)
    assert list(mt.retrieval_stats(counts, "pc").first()) == [50.0, 2.5, 25.0]
    assert list(mt.retrieval_stats(counts, "cp", 10).first()) == [50.0, 2.5, 20.0]
    assert list(mt.retrieval_stats(counts, None).first()) == [50.0, 2.5]
    none = mt.candidate_counts(pairs.where("false"), queries)
    assert list(mt.retrieval_stats(none, "pc").first()) == [0.0, None, 0.0]
    with pytest.raises(ValueError):
        mt.retrieval_stats(counts, "cp")


def test_recall(spark):
    truth = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "query_id long, truth_id long")
    found = spark.createDataFrame([(1, 10), (1, 11), (2, 21)], "query_id long, cand_id long")
    assert mt.recall(found, truth).first()[0] == pytest.approx(100 / 3)


POSTS = {
    "t3_a": ["t3_a.jpg", "t3_a_1.jpg", "t3_a_2.jpg", "t3_a_3.png"],
    "t3_ab": ["t3_ab.jpg", "t3_ab_1.jpg"],
    "t3_c": ["t3_c_1.jpg", "t3_c_2.jpg"],
    "t3_d": ["t3_d.jpg"],
}


def assets(spark, posts=POSTS):
    rows = [(i, p, f, [float(i)]) for i, (p, f) in enumerate((p, f) for p, fs in posts.items() for f in fs)]
    return spark.createDataFrame(rows, "vec_id long, post_id string, filename string, embedding array<double>")


def test_asset_roles(spark):
    roles = {r.filename: r.role for r in at.asset_roles(assets(spark)).collect()}
    assert roles == {
        "t3_a.jpg": "parent", "t3_a_1.jpg": "child", "t3_a_2.jpg": "child", "t3_a_3.png": "child",
        "t3_ab.jpg": "parent", "t3_ab_1.jpg": "child",
    }


def test_retrieval_sets_and_truth(spark):
    candidates, queries = at.build_retrieval_sets(assets(spark), "pc")
    assert {(r.name, r.stem) for r in candidates.collect()} == {("t3_a.jpg", "t3_a"), ("t3_ab.jpg", "t3_ab")}
    assert {r.stem for r in queries.collect()} == {"t3_a", "t3_ab"}
    truth = at.truth_lookup(queries, candidates.where("stem = 't3_a'"))
    assert sorted(r.truth_id is None for r in truth.collect()) == [False, False, False, True]
    flipped = at.build_retrieval_sets(assets(spark), "cp")
    assert {r.name for r in flipped[1].collect()} == {"t3_a.jpg", "t3_ab.jpg"}
    with pytest.raises(ValueError):
        at.build_retrieval_sets(assets(spark), "xx")


def test_stem(spark):
    names = ["t3_a_1.jpg", "abc", "_x", "a.b.c", ""]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    for sep in "_.":
        assert [r[0] for r in df.select(stem(F.col("n"), sep)).collect()] == [n.rsplit(sep, 1)[0] for n in names]


@pytest.mark.parametrize("mode", ["pc", "cp"])
@pytest.mark.parametrize("match", ["contains", "exact"])
def test_exhaustive_index_equals_the_product(spark, mode, match):
    candidates, queries = at.build_retrieval_sets(assets(spark), mode)
    ranges, positives = pr.exhaustive_index(queries, candidates, match, size=3)
    cands = sorted((r.name, r.id, r.stem) for r in candidates.collect())
    n, expected, positive = 0, {}, set()
    for name, qid, qstem in sorted((r.name, r.id, r.stem) for r in queries.collect()):
        hits = 0
        start = divmod(n, 3)
        for position, (_, cid, cstem) in enumerate(cands):
            if (cstem in name) if match == "contains" else cstem == qstem:
                positive.add((qid, cid, position, *divmod(n, 3), 1.0))
                hits += 1
            n += 1
        expected[qid] = (len(cands), *start, *divmod(n, 3), hits)
    assert {r.query_id: tuple(r)[1:] for r in ranges.collect()} == expected
    assert {tuple(r) for r in positives.collect()} == positive
    for df in (ranges, positives):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_exhaustive_index_with_stems_that_share_no_beginning(spark):
    names = [(0, "ab_ab_x", "zz"), (1, "q", "q"), (2, "abc", "c"), (3, "", "")]
    stems = [(10, "n1", "ab"), (11, "n2", "c"), (12, "n3", "ab"), (13, "n4", "x"), (14, "n5", "q"), (15, "n6", "")]
    queries = spark.createDataFrame(names, "id long, name string, stem string")
    candidates = spark.createDataFrame(stems, "id long, name string, stem string")
    ranges, positives = pr.exhaustive_index(queries, candidates)
    expected = {(q, c) for q, name, _ in names for c, _, stem in stems if stem in name}
    assert {(r.query_id, r.cand_id) for r in positives.collect()} == expected
    assert {r.query_id: r.n_relevant for r in ranges.collect()} == {
        q: sum(a == q for a, _ in expected) for q, _, _ in names
    }


def test_label_pairs_by_part_and_exact(spark):
    pairs = spark.createDataFrame(
        [("t3_p12_1.jpg", "t3_p12", "t3_p1"), ("t3_p12_1.jpg", "t3_p12", "t3_p12"), ("t3_p2_1.jpg", "t3_p2", "t3_p1")],
        "query_name string, query_stem string, cand_stem string",
    )
    assert [r.label for r in pr.label_pairs(pairs).collect()] == [1.0, 1.0, 0.0]
    assert [r.label for r in pr.label_pairs(pairs, "exact").collect()] == [0.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        pr.label_pairs(pairs, "other")


def test_training_pairs(spark):
    posts = {f"t3_{i}": [f"t3_{i}.jpg"] + [f"t3_{i}_{k}.jpg" for k in range(i % 5)] for i in range(40)}
    posts["t3_hot"] = ["t3_hot.jpg"] + [f"t3_hot_{k}.jpg" for k in range(60)]
    rows = at.make_training_pairs(assets(spark, posts), seed=3).collect()
    for post, files in posts.items():
        n = len(files) - 1
        mine = [r for r in rows if r.post_id == post]
        by_label = {label: [r for r in mine if r.label == label] for label in (0.0, 0.5, 1.0)}
        assert [len(by_label[v]) for v in (1.0, 0.5, 0.0)] == [n, n if n > 1 else 0, n]
        assert {(r.left, r.right) for r in by_label[1.0]} == {(files[0], f) for f in files[1:]}
        for r in by_label[0.5]:
            assert r.left != r.right and {r.left, r.right} <= set(files[1:])
        for r in by_label[0.0]:
            assert r.left == files[0] and r.right != files[0] and r.right.count("_") == 1
    again = at.make_training_pairs(assets(spark, posts).repartition(6), seed=3).collect()
    assert sorted(rows) == sorted(again)
    assert sorted(rows) != sorted(at.make_training_pairs(assets(spark, posts), seed=4).collect())


def test_sample_groups_and_names(spark):
    df = assets(spark)
    sample = at.sample_groups(df, "post_id", 2, seed=1)
    chosen = {r.post_id for r in sample.collect()}
    assert len(chosen) == 2
    assert sample.count() == sum(len(POSTS[p]) for p in chosen)
    names = at.sequential_names(df, ["filename"]).orderBy("filename").collect()
    assert [r.new_name for r in names] == [f"{i:010d}.jpg" for i in range(1, len(names) + 1)]
    inside = at.sequential_names(df, ["filename"], "data_batch_%03d", 0, folder=["post_id"]).collect()
    assert {r.filename: r.new_name for r in inside}["t3_a_1.jpg"] == "data_batch_001"


def test_vector_functions(spark):
    df = spark.createDataFrame(
        [([1.5, 2.0], [0.5, 4.0], [1, 0, 1], [1, 1, 0], [5, 1], [4, 3])],
        "a array<float>, b array<float>, x array<tinyint>, y array<tinyint>, p array<bigint>, q array<bigint>",
    )
    row = df.select(
        squared_l2(F.col("a"), F.col("b")),
        hamming_distance(F.col("x"), F.col("y")),
        packed_hamming_distance(F.col("p"), F.col("q")),
        permute_bits(F.col("x"), [2, 1, 0]),
        weighted_score([F.lit(0.5), F.lit(1.0)], [0.25, 0.75]),
    ).first()
    assert list(row) == [5.0, 2, 2, [1, 0, 1], 0.875]
    with pytest.raises(ValueError):
        weighted_score([F.lit(1.0)], [0.9])
    with pytest.raises(ValueError):
        weighted_score([F.lit(1.0)], [0.5, 0.5])


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_percentiles_and_histogram(spark, n):
    values = np.random.default_rng(n).normal(size=n).round(1)
    df = spark.createDataFrame([(float(v),) for v in values], "distance double").repartition(3)
    probs = [0.0, 0.33, 0.66, 1.0]
    assert list(ds.percentiles(df, "distance", probs).first()) == pytest.approx(np.percentile(values, np.array(probs) * 100))
    counts, edges = np.histogram(values, bins=3, weights=np.full(n, 1 / n))
    rows = ds.distance_histogram(df).orderBy("bin").collect()
    assert [r.share for r in rows] == pytest.approx(counts)
    assert [r.low for r in rows] + [rows[-1].high] == pytest.approx(edges)


def test_histogram_and_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "distance double")
    assert [r.n for r in ds.distance_histogram(empty).collect()] == [0, 0, 0]
    assert list(ds.percentiles(empty, "distance", [0.5]).first()) == [None]


def test_pair_distance_stats(spark):
    rows = [([float(i), 0.0], [0.0, 0.0], [1.0, 0.5, 0.0][i % 3]) for i in range(30)]
    pairs = spark.createDataFrame(rows, "query_vec array<double>, cand_vec array<double>, label double")
    expected = np.percentile([i * i for i in range(0, 30, 3)], [33, 66])
    assert list(ds.pair_distance_stats(pairs).first()) == pytest.approx(expected)


def test_evaluate_pairs(spark):
    rows = [(0, 1.0, 0.9), (0, 0.0, 0.5), (0, 0.5, 0.5), (1, 1.0, 0.0), (1, 0.0, 1.5)]
    scored = spark.createDataFrame(rows, "batch int, label double, score double")
    got = {r.batch: r for r in sc.evaluate_pairs(scored, loss_scale=10.0).collect()}

    def loss(y, p):
        p = min(max(p, 1e-7), 1 - 1e-7)
        return -(y * math.log(p) + (1 - y) * math.log(1 - p))

    for batch in (0, 1):
        mine = [(y, p) for b, y, p in rows if b == batch]
        assert got[batch].loss == pytest.approx(np.mean([loss(y, p) for y, p in mine]))
        assert got[batch].mae == pytest.approx(np.mean([abs(y - p) for y, p in mine]))
        assert got[batch].scaled_mse == pytest.approx(10 * np.mean([(y - p) ** 2 for y, p in mine]))
    # a score of one half rounds to zero
    assert got[0].accuracy == pytest.approx(2 / 3) and got[1].accuracy == 0.0
    assert sc.evaluate_pairs(scored, None).first().n == 5


def test_train_and_score(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        a = rng.normal(size=4)
        near = i % 2 == 0
        b = a + rng.normal(size=4) * (0.1 if near else 2.0)
        rows.append((i, a.tolist(), b.tolist(), 1.0 if near else (0.5 if i % 10 == 1 else 0.0)))
    pairs = spark.createDataFrame(rows, "i int, query_vec array<double>, cand_vec array<double>, label double")
    for binary_only in (True, False):
        model = sc.train_pair_scorer(pairs, binary_only)
        scored = sc.apply_pair_scorer(pairs, model)
        assert scored.columns == ["i", "query_vec", "cand_vec", "label", "score"]
        figures = sc.evaluate_pairs(pr.filter_binary_labels(scored), None).first()
        assert figures.accuracy > 0.85 and figures.n == 270


def test_score_pairs_in_small_batches(spark):
    rows = [(i, [float(i), 1.0], [1.0, float(i)]) for i in range(50)]
    pairs = spark.createDataFrame(rows, "i int, query_vec array<double>, cand_vec array<double>")

    def make():
        def predict(a, b):
            assert len(a) <= 7
            return (a * b).sum(axis=1)

        return predict

    got = sc.score_pairs(pairs, make, dim=2, batch_size=7).collect()
    assert {r.i: r.score for r in got} == {i: 2.0 * i for i in range(50)}


def test_splices(spark):
    splices = spark.createDataFrame(
        [
            ("Tp_D_CND_M_N_ani00100_sec00101_1.tif", [0.0, 0.0]),
            ("Tp_D_CND_M_N_ani00100_sec00101_2.tif", [9.0, 9.0]),
            ("Tp_D_CND_M_N_ani00100_sec00101_3.tif", [5.0, 5.0]),
            ("Tp_D_CND_M_N_ani00100_sec00999_4.tif", [5.0, 5.0]),
        ],
        "file string, vec array<double>",
    )
    keys = sp.splice_keys(F.col("file"))
    splices = splices.select("file", keys["s1"].alias("s1"), keys["s2"].alias("s2"), "vec")
    originals = spark.createDataFrame(
        [("Au_ani_00100.jpg", [0.0, 0.0]), ("Au_sec_00101.jpg", [10.0, 10.0])], "name string, vec array<double>"
    ).select(sp.original_key(F.col("name")).alias("key"), "vec")
    numbered = sp.number_splices(sp.match_splices(splices, originals))
    got = {r.file[-5]: (r.au, r.number, r.pair_name) for r in numbered.collect()}
    # a tie goes to the second original, a missing original drops the splice
    assert got == {
        "1": ("ani00100", 1, "ani00100_1.jpg"), "2": ("sec00101", 1, "sec00101_1.jpg"),
        "3": ("sec00101", 2, "sec00101_2.jpg"),
    }
    assert {r.au: r.n for r in sp.splice_counts(numbered).collect()} == {"ani00100": 1, "sec00101": 2}
    assert sp.splice_pairs(numbered, originals).count() == 3


def test_wrapped_distance(spark):
    a, b = [0, 200, 30], [10, 7, 250]
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    x, y = np.array(a, dtype=np.uint8), np.array(b, dtype=np.uint8)
    assert df.select(sp.wrapped_squared_l2(F.col("a"), F.col("b"))).first()[0] == ((x - y) ** 2).sum()


def test_draws_are_spread():
    draws = [number_of_str(f"x{i}") % 10 for i in range(1000)]
    assert min(draws.count(d) for d in range(10)) > 60


def test_newton_reaches_the_optimum(spark):
    """The gradient of the penalised loss vanishes, with soft labels, empty tasks and rows without a vector."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = rng.choice([0.0, 0.5, 1.0], size=200)
    rows = [(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)]
    frame = spark.createDataFrame(rows, "features array<double>, label double").repartition(7)
    weights = sc.newton_steps(frame, 3, reg=0.05)
    full = np.column_stack([np.ones(200), x])
    gradient = full.T @ (y - 1 / (1 + np.exp(-full @ weights))) / 200 - 0.05 * weights
    assert np.abs(gradient).max() < 1e-9
    assert (sc.newton_steps(frame.limit(0), 3, reg=0.05) == 0).all()


def test_scorer_without_usable_pairs(spark):
    pairs = spark.createDataFrame(
        [([1.0, 2.0], None, 1.0), ([1.0, 2.0], [0.0, 1.0], None), ([1.0], [0.5], 0.5)],
        "query_vec array<double>, cand_vec array<double>, label double",
    )
    assert sc.train_pair_scorer(pairs).weights == (0.0,)
    features = pairs.select(sc.segment_distances(2)(pairs.query_vec, pairs.cand_vec).alias("f")).collect()
    assert features[0].f is None and features[1].f == [1.0, 1.0]


@pytest.mark.parametrize("vectors_per_block,pairs_per_piece", [(1_000, 10_000), (7, 10_000), (7, 3), (1_000, 3)])
def test_pairs_in_blocks_equal_the_join(spark, vectors_per_block, pairs_per_piece):
    """Hot and unknown ids, repeated pairs, null ids and vectors, other columns of the pairs."""
    from pairmatch.operators import blocks as bl

    rng = np.random.default_rng(3)
    vectors = {f"v{i}": rng.normal(size=4).tolist() for i in range(30)}
    vectors["v4"] = None
    table = spark.createDataFrame(list(vectors.items()), "id string, vec array<double>").repartition(3)
    # a third of the pairs have one query, one pair comes many times, some ids have no vector
    data = [("v0", f"v{j}") for j in range(40)] + [("v1", "v2")] * 15 + [(f"v{i}", f"v{3 * i % 31}") for i in range(50)]
    data += [(None, "v1"), ("v1", None)]
    pairs = spark.createDataFrame([(q, c, i) for i, (q, c) in enumerate(data)], "query_id string, cand_id string, vec int")
    sizes = {"vectors_per_block": vectors_per_block, "pairs_per_piece": pairs_per_piece}

    want = {r.vec: (r.query_vec, r.cand_vec) for r in pr.attach_payload(pairs, table, table).collect()}
    got = bl.attach_vectors(pairs, table, table, **sizes).collect()
    assert len(got) == len(want) and {r.vec: (r.query_vec, r.cand_vec) for r in got} == want
    scored = bl.measure_pairs(pairs, table, table, lambda: bl.squared_distances, "apart", **sizes).collect()
    assert {r.vec for r in scored} == set(want)
    for r in scored:
        a, b = want[r.vec]
        if a is None or b is None:
            assert r.apart is None
        else:
            assert r.apart == pytest.approx(((np.array(a) - np.array(b)) ** 2).sum(), abs=1e-12)
    assert bl.attach_vectors(pairs.limit(0), table, table, **sizes).collect() == []
    assert bl.attach_vectors(pairs, table.limit(0), table, **sizes).collect() == []


def test_pairs_in_blocks_are_shuffled_without_vectors(spark):
    from pairmatch.operators import blocks as bl

    table = spark.range(50).select("id", F.array(*[F.lit(0.5)] * 64).alias("vec"))
    pairs = spark.range(50).crossJoin(spark.range(50).withColumnRenamed("id", "cand_id")).withColumnRenamed("id", "query_id")
    cells = bl._in_cells(pairs, table, table, 1_000, 10_000)
    assert cells.where("vec is not null").count() == 100 and cells.where("_kind = 2 and vec is null").count() == 2_500


def test_labels_and_numbers_in_one_sort(spark):
    """Pairs that repeat over many Arrow batches, null ids and true pairs that were not found."""
    rows = [(q, c, q + c / 8) for q in range(4) for c in range(9) for _ in range(1 + 5 * (c == 3))]
    rows += [(None, 3, 0.5), (2, None, None)]
    truth = [(0, 3), (1, 8), (3, 0), (3, 77), (9, 9), (None, 3), (2, None)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        packed = pr.pack_labelled(
            spark.createDataFrame(rows, "query_id long, cand_id long, score double").repartition(5),
            spark.createDataFrame(truth, "query_id long, truth_id long"), 7,
        ).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    packed = sorted(packed, key=lambda r: r.n)
    rows.sort(key=lambda r: tuple(-1 if v is None else v for v in r))
    assert [(r.query_id, r.cand_id, r.score) for r in packed] == rows
    assert [(r.n, r.batch, r.slot) for r in packed] == [(n, *divmod(n, 7)) for n in range(len(rows))]
    true = {t for t in truth if None not in t}
    assert [r.label for r in packed] == [float((q, c) in true) for q, c, _ in rows]
