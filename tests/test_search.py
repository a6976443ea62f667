import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.functions.bands import BandLayout, split_bands
from pairmatch.functions.names import number_of, number_of_str
from pairmatch.operators import candidates as cd
from pairmatch.operators import klsh as kl
from pairmatch.operators import lsh as ls
from pairmatch.operators import prefixes as px
from pairmatch.operators.skew import split_join
from pairmatch.plans.baseline import lsh_baseline
from pairmatch.sources import store
from pairmatch.streaming.probe import probe_index, read_probes, start_probe_sink


def vectors(spark, rng, n, dim=8, first=0, like=None):
    """n vectors, a third of them copies of one."""
    rows = []
    for i in range(n):
        v = rng.normal(size=dim) if like is None else like[i % len(like)]
        rows.append((first + i, v.tolist()))
    hot = rows[0][1]
    rows = [(i, hot if k % 3 == 0 else v) for k, (i, v) in enumerate(rows)]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(3), dict(rows)


def bits_of(model, vecs):
    ids = list(vecs)
    hashed = model.hash_bits(np.array([vecs[i] for i in ids]))
    return dict(zip(ids, hashed))


def sharing_a_band(index, queries, bands):
    return {
        (q, c)
        for q, c in itertools.product(queries, index)
        if any((a == b).all() for a, b in zip(np.split(queries[q], bands), np.split(index[c], bands)))
    }


def pairs_in(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_band_layout_widths():
    assert (BandLayout(10, 4).bands, BandLayout(10, 4).width) == (2, 5)
    for bits, rows in [(10, 3), (5, 6), (5, 0)]:
        with pytest.raises(ValueError):
            BandLayout(bits, rows)


@pytest.mark.parametrize("bits,rows", [(10, 5), (180, 9), (64, 64), (200, 100), (126, 63), (130, 65)])
def test_packing_keeps_every_bit(bits, rows):
    layout = BandLayout(bits, rows)
    values = np.random.default_rng(bits).integers(0, 2, size=(50, bits)).astype(np.uint8)
    packed = layout.pack(values)
    assert packed.shape == (50, layout.words) and (packed >= 0).all()
    assert (layout.unpack(packed) == values).all()


@pytest.mark.parametrize("bits,rows", [(12, 3), (130, 65)])
def test_band_candidates_match_brute_force(spark, bits, rows):
    rng = np.random.default_rng(bits)
    df, vecs = vectors(spark, rng, 60)
    near = np.array(list(vecs.values())) + rng.normal(size=(60, 8)) * 0.1
    qdf, qvecs = vectors(spark, rng, 30, first=1000, like=near)
    model = kl.KLSH(p=20, t=5, b=bits, seed=2).fit(df)
    layout = model.layout(rows)
    expected = sharing_a_band(bits_of(model, vecs), bits_of(model, qvecs), layout.bands)
    index, queries = model.signatures(df, layout), model.signatures(qdf, layout)
    assert expected
    for rows_per_split in (100_000, 5):
        assert pairs_in(cd.band_candidates(index, queries, layout, rows_per_split)) == expected


def test_every_row_finds_itself_and_more_bands_find_more(spark):
    rng = np.random.default_rng(1)
    df, vecs = vectors(spark, rng, 40)
    model = kl.KLSH(p=16, t=4, b=24, seed=3).fit(df)
    found = []
    for rows in (12, 6, 3):
        layout = model.layout(rows)
        signed = model.signatures(df, layout)
        found.append(pairs_in(cd.band_candidates(signed, signed, layout)))
        assert {(i, i) for i in vecs} <= found[-1]
    assert found[0] <= found[1] <= found[2]


def test_copy_groups_are_bounded_and_whole(spark):
    signed = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit(7))).otherwise(
        F.array(F.col("id"))).alias("sig"))
    rows = cd.copy_groups(signed, 10).collect()
    assert max(len(r.ids) for r in rows) <= 10
    assert sorted(i for r in rows for i in r.ids) == list(range(1000))
    for r in rows:
        assert all((i % 3 == 0) == (r.sig == [7]) or i == 7 for i in r.ids)
    assert len(rows) < 800


def test_bucket_sizes_and_split_bands(spark):
    rng = np.random.default_rng(4)
    df, vecs = vectors(spark, rng, 30)
    model = kl.KLSH(p=16, t=4, b=8, seed=3).fit(df)
    layout = model.layout(4)
    sizes = cd.bucket_sizes(model.signatures(df, layout), layout)
    text = model.transform(df).select("id", F.posexplode(split_bands(F.col("bits"), layout)).alias("band", "k"))
    expected = sorted(r.n for r in text.groupBy("band", "k").agg(F.count("*").alias("n")).collect())
    assert sorted(r.n for r in sizes.collect()) == expected
    assert sizes.agg(F.sum("n")).first()[0] == 30 * layout.bands


@pytest.mark.parametrize("bits,n_perm", [(6, 3), (70, 2)])
def test_permutation_candidates_match_brute_force(spark, bits, n_perm):
    rng = np.random.default_rng(6)
    df, vecs = vectors(spark, rng, 60)
    qdf, qvecs = vectors(spark, rng, 20, first=1000)
    qvecs[2000] = vecs[1]
    qdf = qdf.union(spark.createDataFrame([(2000, vecs[1])], "id long, vec array<double>"))
    model = kl.KLSH(p=20, t=5, b=bits, seed=5).fit(df)
    index, queries = bits_of(model, vecs), bits_of(model, qvecs)
    expected = set()
    for order in cd.permutations(bits, n_perm, 9):
        ids = sorted(index, key=lambda i: (index[i][order].tolist(), i))
        keys = [index[i][order].tolist() for i in ids]
        for q, b in queries.items():
            wanted = b[order].tolist()
            if wanted in keys:
                at = keys.index(wanted)
                expected |= {(q, c) for c in ids[max(at - 2 * n_perm, 0) : at + 2 * n_perm]}
    layout = model.layout(bits)
    got = cd.permutation_candidates(
        model.signatures(df, layout), model.signatures(qdf, layout), layout, n_perm, seed=9, rows_per_split=7
    )
    assert expected and pairs_in(got) == expected


def test_split_join_equals_plain_join(spark):
    left = spark.range(400).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 25).alias("k"), F.col("id").alias("b"))
    plain = left.join(right, "k").select("a", "b")
    split = split_join(left, right, ["k"], ["a"], ["b"], rows_per_split=9).select("a", "b")
    assert sorted(plain.collect()) == sorted(split.collect())


def test_probe_of_a_stored_index_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(8)
    df, vecs = vectors(spark, rng, 40)
    qdf, qvecs = vectors(spark, rng, 15, first=500)
    model = kl.KLSH(p=16, t=4, b=12, seed=3).fit(df)
    layout = model.layout(3)
    store.write_band_index(model.signatures(df, layout), layout, str(tmp_path / "bands"), model)
    stored = store.load_band_index(spark, str(tmp_path / "bands"))
    expected = sharing_a_band(bits_of(model, vecs), bits_of(model, qvecs), layout.bands)
    assert pairs_in(probe_index(model.signatures(qdf, layout), stored, layout, model)) == expected
    qdf.write.parquet(str(tmp_path / "queries"))
    stream = spark.readStream.schema(qdf.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "queries"))
    found = probe_index(model.signatures(stream, layout), stored, layout, model)
    run = found.writeStream.format("memory").queryName("probed").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert pairs_in(spark.table("probed")) == expected
    other = model.layout(6)
    with pytest.raises(ValueError, match="rows"):
        probe_index(model.signatures(qdf, other), stored, other, model)
    refit = kl.KLSH(p=16, t=4, b=12, seed=4).fit(df)
    with pytest.raises(ValueError, match="model"):
        probe_index(refit.signatures(qdf, layout), stored, layout, refit)


@pytest.mark.parametrize("bits,rows,target", [(12, 3, 2), (12, 3, 1), (12, 12, 2), (70, 7, 3), (140, 70, 2)])
def test_buckets_split_until_they_are_small(spark, bits, rows, target):
    rng = np.random.default_rng(bits + target)
    layout = BandLayout(bits, rows)
    # many bits in common, a third of the rows equal, queries that share beginnings only
    stored = (rng.random((60, bits)) < 0.15).astype(np.uint8)
    stored[::3] = stored[0]
    asked = np.concatenate([stored[:10], stored[10:20], (rng.random((10, bits)) < 0.15).astype(np.uint8)])
    asked[10:20, -1] ^= 1

    def table(matrix, first):
        packed = layout.pack(matrix).tolist()
        return spark.createDataFrame([(first + i, w) for i, w in enumerate(packed)], "id long, sig array<long>")

    index, queries = table(stored, 0), table(asked, 1_000)

    def turned(row, band):
        text = "".join(map(str, row))
        return text[band * layout.width :] + text[: band * layout.width]

    texts = ["".join(map(str, row)) for row in stored]
    assert [r[0] for r in index.orderBy("id").select(layout.bit_text(F.col("sig"))).collect()] == texts
    expected, sizes = set(), {}
    for band in range(layout.bands):
        known = {turned(row, band) for row in stored}
        for c, row in enumerate(stored):
            mine = turned(row, band)
            depth = next(
                d
                for d in range(layout.width, bits + 1)
                if sum(k[:d] == mine[:d] for k in known) <= target
            )
            n, members = sizes.setdefault((band, depth, mine[:depth]), [0, set()])
            sizes[band, depth, mine[:depth]] = [n + 1, members | {mine}]
            expected |= {(1_000 + q, c) for q, a in enumerate(asked) if turned(a, band)[:depth] == mine[:depth]}
    assert pairs_in(px.split_candidates(index, queries, layout, target, rows_per_split=10)) == expected
    found = {tuple(r)[:3]: list(r)[3:] for r in px.split_bucket_sizes(index, layout, target).collect()}
    assert found == {k: [n, len(members)] for k, (n, members) in sizes.items()}
    assert max(n for _, n in found.values()) <= target
    assert px.split_candidates(index.limit(0), queries, layout, target).count() == 0
    assert px.split_candidates(index, queries.limit(0), layout, target).count() == 0
    with pytest.raises(ValueError):
        px.split_candidates(index, queries, layout, 0)


def test_stored_index_splits_hot_keys_and_is_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(9)
    df, vecs = vectors(spark, rng, 90)
    qdf, qvecs = vectors(spark, rng, 30, first=500, like=[np.array(v) for v in vecs.values()])
    model = kl.KLSH(p=16, t=4, b=12, seed=3).fit(df)
    layout = model.layout(3)
    path = str(tmp_path / "bands")
    store.write_band_index(model.signatures(df, layout), layout, path, model, buckets=8, rows_per_split=10)
    stored = store.load_band_index(spark, path)
    sizes = stored.rows.groupBy("band", "key", "piece").count()
    whole = stored.rows.groupBy("band", "key").count().where("count > 10").count()
    assert 0 < whole == stored.hot.count()
    assert sizes.agg({"count": "max"}).first()[0] <= 25
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = probe_index(model.signatures(qdf, layout), stored, layout, model)
        expected = sharing_a_band(bits_of(model, vecs), bits_of(model, qvecs), layout.bands)
        assert pairs_in(found) == expected
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # from the last join to the scan of the index there is no exchange
    index_side = plan[plan.rindex("FileScan parquet") - 600 : plan.rindex("FileScan parquet")]
    assert "Bucketed: true" in plan and "Exchange" not in index_side
    # written again with other bucket numbers, and empty
    store.write_band_index(model.signatures(df, layout), layout, path, model, buckets=3)
    again = probe_index(model.signatures(qdf, layout), store.load_band_index(spark, path), layout, model)
    assert pairs_in(again) == expected
    store.write_band_index(model.signatures(df.limit(0), layout), layout, path, model)
    assert probe_index(model.signatures(qdf, layout), store.load_band_index(spark, path), layout, model).count() == 0


def test_probe_sink_has_every_batch_once(spark, tmp_path):
    rng = np.random.default_rng(10)
    df, vecs = vectors(spark, rng, 40)
    qdf, qvecs = vectors(spark, rng, 15, first=500, like=[np.array(v) for v in vecs.values()])
    model = kl.KLSH(p=16, t=4, b=12, seed=3).fit(df)
    layout = model.layout(3)
    store.write_band_index(model.signatures(df, layout), layout, str(tmp_path / "bands"), model)
    stored = store.load_band_index(spark, str(tmp_path / "bands"))
    expected = sharing_a_band(bits_of(model, vecs), bits_of(model, qvecs), layout.bands)
    qdf.write.parquet(str(tmp_path / "queries"))
    source = spark.readStream.schema(qdf.schema).option("maxFilesPerTrigger", 1)
    found = probe_index(
        model.signatures(source.parquet(str(tmp_path / "queries")), layout), stored, layout, model
    )
    table, checkpoint = str(tmp_path / "found"), tmp_path / "checkpoint"

    def run(where=checkpoint):
        assert start_probe_sink(found, table, str(where)).awaitTermination(120)
        return read_probes(spark, table)

    rows = run()
    assert pairs_in(rows.select("query_id", "cand_id")) == expected
    batches = sorted(r["batch"] for r in rows.select("batch").distinct().collect())
    last = max(int(p.name) for p in (checkpoint / "commits").iterdir() if p.name.isdigit())
    # the stream stopped between the mark of its last batch and its commit
    for name in [str(last), f".{last}.crc"]:
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    assert pairs_in(run().select("query_id", "cand_id")) == expected
    # or before the mark, with part of the rows written
    for name in [str(last), f".{last}.crc"]:
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    for mark in (tmp_path / "found" / "done").glob(f"stream=*/batch={last}/*"):
        mark.unlink()
    for mark in (tmp_path / "found" / "done").glob(f"stream=*/batch={last}"):
        for hidden in mark.iterdir():
            hidden.unlink()
        mark.rmdir()
    assert last not in {r["batch"] for r in read_probes(spark, table).select("batch").distinct().collect()}
    again = run()
    assert pairs_in(again.select("query_id", "cand_id")) == expected
    assert sorted(r["batch"] for r in again.select("batch").distinct().collect()) == batches
    # a stream with a new checkpoint adds its own batches
    assert run(tmp_path / "other").count() == 2 * len(expected)


def test_pairs_of_the_sink_are_kept_as_differences(spark, tmp_path):
    import pyarrow.parquet as pq

    layout = BandLayout(bits=2, rows=2)
    rng = np.random.default_rng(3)
    model = ls.random_projection_lsh(2, 4, seed=1)
    index, _ = vectors(spark, rng, 4_000, dim=4)
    queries, _ = vectors(spark, rng, 150, dim=4)
    store.write_band_index(model.signatures(index, layout), layout, str(tmp_path / "bands"), model, buckets=4)
    for file in (tmp_path / "bands" / "rows").glob("*.parquet"):
        places = pq.read_table(file, columns=["band", "key", "piece", "id"]).to_pylist()
        assert [tuple(p.values()) for p in places] == sorted(tuple(p.values()) for p in places)
    queries.write.parquet(str(tmp_path / "queries"))
    arriving = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "queries"))
    band_index = store.load_band_index(spark, str(tmp_path / "bands"))
    found = probe_index(model.signatures(arriving, layout), band_index, layout, model)
    assert start_probe_sink(found, str(tmp_path / "found"), str(tmp_path / "checkpoint")).awaitTermination(120)
    files = list((tmp_path / "found" / "rows").glob("*/batch=0/*.parquet"))
    n = read_probes(spark, str(tmp_path / "found")).count()
    assert n > 100_000
    assert sum(f.stat().st_size for f in files) < n


def test_klsh_algebra():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 5))
    k = kl.rbf_kernel(x, x, 0.2)
    assert np.allclose(k, [[np.exp(-0.2 * ((a - b) ** 2).sum()) for b in x] for a in x])
    centered = kl.center_kernel(k, k.mean(axis=0), k.mean())
    assert np.allclose(centered.mean(axis=0), 0) and np.allclose(centered.mean(axis=1), 0)
    spd = x.T @ x
    root = kl.inverse_sqrt(spd)
    assert np.allclose(root @ spd @ root, np.eye(5))
    # an eigenvalue too small to invert is kept as it is
    assert np.allclose(kl.inverse_sqrt(np.diag([4.0, 1e-10])), np.diag([0.5, 1e-10]))


def test_klsh_picks_collapse_and_model_is_checked(spark):
    rng = np.random.default_rng(0)
    df, _ = vectors(spark, rng, 30)
    hasher = kl.KLSH(p=4, t=50, b=6, seed=0)
    model = hasher.fit(df)
    # all four rows are drawn for every bit, and each counts once
    root = kl.inverse_sqrt(model.kernel(model.sample))
    assert np.allclose(model.weights, root.sum(axis=1)[:, None])
    with pytest.raises(ValueError):
        model.signatures(df, BandLayout(8, 2))
    with pytest.raises(ValueError):
        kl.KLSH(p=31).fit(df)
    with pytest.raises(ValueError):
        kl.KLSH(p=5000).fit(df)


def test_null_and_wrong_vectors(spark):
    rng = np.random.default_rng(0)
    df, _ = vectors(spark, rng, 30)
    model = kl.KLSH(p=8, t=3, b=6, seed=0).fit(df)
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 8)], "id long, vec array<double>")
    assert [r.bits is None for r in model.transform(odd).orderBy("id").collect()] == [True, False]
    assert [r.id for r in model.signatures(odd, model.layout(3)).collect()] == [2]
    short = spark.createDataFrame([(1, [0.0] * 7)], "id long, vec array<double>")
    with pytest.raises(Exception, match="8 elements"):
        model.transform(short).collect()


def test_sample_is_the_same_however_partitioned(spark):
    df = spark.range(500)
    one = kl.sample_rows(df.coalesce(1), "id", 20, 3).collect()
    assert one == kl.sample_rows(df.repartition(9), "id", 20, 3).collect()
    assert one != kl.sample_rows(df, "id", 20, 4).collect()


def test_number_of(spark):
    got = spark.createDataFrame([("a",), ("é",)], "s string").select(number_of(F.col("s"))).collect()
    assert [r[0] for r in got] == [number_of_str("a"), number_of_str("é")]


@pytest.mark.parametrize("radius", [0, 1])
def test_lsh_baseline_matches_brute_force(spark, radius):
    rng = np.random.default_rng(3)
    df, vecs = vectors(spark, rng, 80)
    qdf, qvecs = vectors(spark, rng, 25, first=500)
    model = ls.random_projection_lsh(5, 8, seed=1)
    index, queries = bits_of(model, vecs), bits_of(model, qvecs)
    expected = set()
    for q, b in queries.items():
        inside = [c for c, h in index.items() if (h != b).sum() <= radius]
        dist = {c: ((np.array(vecs[c]) - np.array(qvecs[q])) ** 2).sum() for c in inside}
        best = sorted(inside, key=lambda c: (dist[c], c))[:3]
        expected |= {(q, c, r + 1) for r, c in enumerate(best)}
    got = lsh_baseline(df, qdf, bits=5, k=3, seed=1, radius=radius)
    assert {(r.query_id, r.cand_id, r["rank"]) for r in got.collect()} == expected


def test_lsh_probes_reach_past_one_word(spark):
    layout = BandLayout(70, 70)
    bits = np.zeros((2, 70), dtype=np.uint8)
    bits[1, 66] = 1
    rows = [(i, s, 1) for i, s in enumerate(layout.pack(bits).tolist())]
    sets = spark.createDataFrame(rows, "gid long, sig array<bigint>, copies long")
    for rows_per_split in (100, 1):
        found = ls.near_matches(sets, sets, layout, rows_per_split)
        assert pairs_in(found.select("query_gid", "cand_gid")) == {(0, 0), (0, 1), (1, 0), (1, 1)}


@pytest.mark.parametrize("rows,rows_per_split", [(4, 1_000), (4, 7), (64, 3)])
def test_bucket_measures_equal_the_join_by_pairs(spark, rows, rows_per_split):
    """Whole buckets, buckets cut into pieces, and bands wider than a word."""
    from pairmatch.operators.blocks import bucket_measures
    from pairmatch.operators.copies import set_matches

    rng = np.random.default_rng(5)
    layout = BandLayout(128 if rows == 64 else 24, rows)
    base = rng.integers(0, 2, (4, layout.bits))

    def sets(n, first):
        bits = base[rng.integers(4, size=n)] ^ (rng.random((n, layout.bits)) < 0.01)
        # a third of the rows in one bucket of every band
        bits[::3] = base[0]
        vecs = rng.normal(size=(n, 5)).astype(np.float32)
        words = layout.pack(bits)
        data = [(first + i, w.tolist(), v.tolist(), i % 3 + 1) for i, (w, v) in enumerate(zip(words, vecs))]
        frame = spark.createDataFrame(data, "gid long, sig array<long>, vec array<float>, copies long").repartition(3)
        return frame, {first + i: v.astype(np.float64) for i, v in enumerate(vecs)}

    (index, index_vecs), (queries, query_vecs) = sets(80, 0), sets(50, 1_000)
    got = bucket_measures(index, queries.drop("copies"), layout, rows_per_split=rows_per_split).collect()
    want = {(r.query_gid, r.cand_gid, r.copies) for r in set_matches(index, queries, layout).collect()}
    assert len(got) == len(want) and {(r.query_gid, r.cand_gid, r.copies) for r in got} == want
    for r in got:
        assert r.measure == pytest.approx(((query_vecs[r.query_gid] - index_vecs[r.cand_gid]) ** 2).sum(), abs=1e-12)
    nothing = bucket_measures(index.limit(0), queries.drop("copies"), layout)
    assert nothing.collect() == [] and nothing.columns == ["query_gid", "cand_gid", "copies", "measure"]


def test_bucket_measures_of_vectors_with_nulls(spark):
    from pairmatch.operators.blocks import bucket_measures

    rows = spark.createDataFrame(
        [(1, [3], [1.0, None], 1), (2, [3], [1.0, 2.0], 1)], "gid long, sig array<long>, vec array<double>, copies long"
    )
    got = {(r.query_gid, r.cand_gid): r.measure for r in bucket_measures(rows, rows, BandLayout(4, 2)).collect()}
    assert got == {(1, 1): None, (1, 2): None, (2, 1): None, (2, 2): 0.0}


@pytest.mark.parametrize("radius", [0, 1])
def test_lsh_baseline_makes_no_table_of_pairs(spark, radius, monkeypatch):
    from pairmatch.plans import retrieve as rt

    def refuse(*args):
        raise AssertionError("all pairs were attached")

    monkeypatch.setattr(rt, "attach_payload", refuse)
    rng = np.random.default_rng(4)
    df, vecs = vectors(spark, rng, 150)
    qdf, qvecs = vectors(spark, rng, 120, first=500)
    for bits in (3, 70):
        model = ls.random_projection_lsh(bits, 8, seed=1)
        index, queries = bits_of(model, vecs), bits_of(model, qvecs)
        got = {(r.query_id, r["rank"]): r.cand_id for r in lsh_baseline(df, qdf, bits=bits, k=4, seed=1, radius=radius).collect()}
        want = {}
        for q, b in queries.items():
            inside = [c for c, h in index.items() if (h != b).sum() <= radius]
            dist = {c: ((np.array(vecs[c]) - np.array(qvecs[q])) ** 2).sum() for c in inside}
            want |= {(q, i): c for i, c in enumerate(sorted(inside, key=lambda c: (dist[c], c))[:4], 1)}
        assert got == want
