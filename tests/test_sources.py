import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairmatch.operators import images as im
from pairmatch.operators.klsh import KLSH, KLSHModel
from pairmatch.operators.pairs import pack_batches
from pairmatch.sources import dumps, images, store


def write_dumps(folder):
    (folder / "submissions_01.csv").write_text(
        '1,u,pics,t3_1,link,"a title, with\na break",http://a/1.jpg,body\n'
        "2,u,NA,t3_2,self,title,NA,body\n"
        "3,u,cats,t3_3,link,\"say \"\"hi\"\"\",http://a/1.jpg,null\n"
        "4,u,cats,t3_4,link,t,,x\n"
    )
    (folder / "submissions_02.csv").write_text("5,u,dogs,t3_5,link,t,http://a/1.jpg,x\n")
    (folder / "other.csv").write_text("6,u,dogs,t3_6,link,t,http://a/9.jpg,x\n")


def test_link_dump(spark, tmp_path):
    write_dumps(tmp_path)
    df = dumps.read_link_dump(spark, str(tmp_path), path_glob="submissions_*.csv")
    rows = df.orderBy("ord").collect()
    assert [(r.link, r.name, r.post_id) for r in rows] == [
        ("http://a/1.jpg", "pics", "t3_1"), ("http://a/1.jpg", "cats", "t3_3"), ("http://a/1.jpg", "dogs", "t3_5"),
    ]
    only = dumps.read_link_dump(
        spark, str(tmp_path), ("post_fullname", "post_target_url"), path_glob="other.csv"
    )
    assert [(r.link, r.name) for r in only.collect()] == [("http://a/9.jpg", None)]


def test_link_dump_feeds_classification(spark, tmp_path):
    from pairmatch.operators.links import classify_links

    write_dumps(tmp_path)
    df = dumps.read_link_dump(spark, str(tmp_path), path_glob="submissions_*.csv")
    assert [tuple(r) for r in classify_links(df).collect()] == [("image", "http://a/1.jpg", "dogs", "t3_5")]


def test_link_dump_reads_only_its_columns(spark, tmp_path):
    write_dumps(tmp_path)
    plan = dumps.read_link_dump(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<subreddit_name:string,post_fullname:string,post_target_url:string>" in plan


def test_comment_dump(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        '1,u,pics,t1_1,"[x](http://a/1.jpg)\nmore",t3_1,t3_1\n2,u,pics,t1_2,NaN,t3_1,t3_1\n'
    )
    rows = dumps.read_comment_dump(spark, str(tmp_path)).collect()
    assert [(r.comment_body, r.post_fullname) for r in rows] == [("[x](http://a/1.jpg)\nmore", "t3_1")]


def test_split_files_with_line_breaks(spark, tmp_path):
    rng = random.Random(4)
    bits = ["a", "é", "\n", '"', ",", "\r\n", " ", "end\n\n", "NaN", "x" * 40]

    def cell(text):
        return '"' + text.replace('"', '""') + '"'

    bodies = {}
    for name, n, end in [("a.csv", 60, "\n"), ("b.csv", 1, "\n"), ("c.csv", 40, "\r\n"), ("d.csv", 0, "")]:
        lines = []
        for i in range(n):
            body = "".join(rng.choices(bits, k=rng.choice([0, 1, 5, 30])))
            bodies[f"{name}{i}"] = body
            lines.append(f"1,u,pics,{name}{i},{cell(body)},t3_{i},t3_{i}{end}" + (end if i % 9 == 0 else ""))
        (tmp_path / name).write_bytes("".join(lines).encode())
    # one record over many blocks, the last one without a line break
    long = "\n".join(f'line {i} "quoted"' for i in range(200))
    (tmp_path / "e.csv").write_bytes(f"1,u,pics,e,{cell(long)},t3_e,t3_e\n1,u,pics,f,last,t3_f,t3_f".encode())
    expected = sorted(b for b in bodies.values() if b not in dumps.NA_VALUES) + [long, "last"]
    settings = {"spark.sql.files.maxPartitionBytes": "90", "spark.sql.files.openCostInBytes": "0"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df = dumps.read_comment_dump(spark, str(tmp_path), split_files=True)
        rows = df.collect()
        assert len({(r.ord.file, r.ord.block) for r in rows}) > 20
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sorted(r.comment_body for r in rows) == sorted(expected)
    # places are in the order of the files
    numbers = [int(r.post_fullname[3:]) for r in sorted(rows, key=lambda r: r.ord) if r.ord.file.endswith("a.csv")]
    assert numbers == sorted(numbers) and len(numbers) > 30
    assert len({tuple(r.ord) for r in rows}) == len(rows)
    whole = dumps.read_comment_dump(spark, str(tmp_path), split_files=True, path_glob="b.csv")
    assert whole.count() == (bodies["b.csv0"] not in dumps.NA_VALUES)
    assert dumps.read_comment_dump(spark, str(tmp_path), split_files=True, path_glob="d.csv").count() == 0
    write_dumps(tmp_path)
    links = [dumps.read_link_dump(spark, str(tmp_path), path_glob="submissions_*.csv", split_files=b) for b in (True, False)]
    assert len({tuple(sorted(map(str, df.drop("ord").collect()))) for df in links}) == 1


def png(path, pixels, color):
    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


@pytest.fixture
def pictures(tmp_path):
    png(tmp_path / "rgb.png", [[(10, 20, 30), (10, 20, 30)], [(50, 60, 70), (50, 60, 70)]], 2)
    png(tmp_path / "grey.png", [[(9,), (9,)]], 0)
    png(tmp_path / "rgba.png", [[(1, 2, 3, 255)]], 6)
    (tmp_path / "junk.png").write_bytes(b"not a picture")
    (tmp_path / "rgb.txt").write_text("x")
    return str(tmp_path)


def test_scan_images_keeps_three_channels(spark, pictures):
    rows = images.scan_images(spark, pictures).collect()
    assert [r.origin.rsplit("/", 1)[-1] for r in rows] == ["rgb.png"]


def test_prepare_and_features(spark, pictures):
    found = images.scan_images(spark, pictures)
    pixels = np.array(im.prepare_images(found, 4).first().pixels).reshape(4, 4, 3)
    assert (pixels[0, 0] == [30, 20, 10]).all() and (pixels[3, 3] == [70, 60, 50]).all()
    assert im.prepare_images(found).first().pixels.__len__() == 224 * 224 * 3
    vec = im.extract_features(found).first().vec
    assert len(vec) == 48
    assert im.extract_features(found, lambda p: 1 / 0).count() == 0
    centered = im.extract_features(found, lambda p: p[0, 0]).select(
        im.center_channels(F.col("vec").cast("array<double>")).alias("v")
    )
    assert np.allclose(centered.first().v, [30 - 103.939, 20 - 116.779, 10 - 123.68])


def test_resample_is_an_area_average():
    pixels = np.arange(36, dtype=np.uint8).reshape(6, 2, 3)
    assert np.allclose(im.resample(pixels, 3, 1), pixels.reshape(3, 2, 2, 3).mean(axis=(1, 2))[:, None, :])
    assert np.allclose(im.resample(pixels, 12, 4)[::2, ::2], pixels)
    # a size that does not divide keeps the mean
    assert np.allclose(im.resample(pixels, 5, 3).mean(axis=(0, 1)), pixels.mean(axis=(0, 1)))


def test_scan_assets(spark, tmp_path):
    for name in ["t3_a/t3_a.jpg", "t3_a/t3_a_1.jpg", "t3_b/t3_b.jpg"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = images.scan_assets(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.post_id, r.filename) for r in rows] == [
        ("t3_a", "t3_a.jpg"), ("t3_a", "t3_a_1.jpg"), ("t3_b", "t3_b.jpg"),
    ]


def test_pair_batches_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame(
        [(q, c, [0.0, 0.5, 1.0][(q + c) % 3], 0.25) for q in range(5) for c in range(7)],
        "query_id long, cand_id long, label double, score double",
    )
    path = str(tmp_path / "batches")
    store.write_pair_batches(pack_batches(pairs, 10), path)
    everything = store.read_pair_batches(spark, path)
    assert everything.count() == 35
    assert dict(everything.dtypes)["label"] == "float"
    one = store.read_pair_batches(spark, path, batches=[2])
    assert "PartitionFilters: [" in one._jdf.queryExecution().toString()
    assert sorted(r.slot for r in one.collect()) == list(range(10))
    assert "label" not in store.read_pair_batches(spark, path, expect_label=False).columns
    assert store.read_pair_batches(spark, path, binary_only=True).where("label = 0.5").count() == 0
    shuffled = [(r.batch, r.slot) for r in store.read_pair_batches(spark, path, seed=3).collect()]
    again = [(r.batch, r.slot) for r in store.read_pair_batches(spark, path, seed=3).collect()]
    order = list(dict.fromkeys(b for b, _ in shuffled))
    assert shuffled == again and sorted(order) == [0, 1, 2, 3]
    assert shuffled == [(b, s) for b in order for s in range(10 if b < 3 else 5)]
    in_turn = [(b, sorted(r.slot for r in df.collect())) for b, df in store.shuffled_batches(spark, path, 3)]
    assert in_turn == [(b, list(range(10 if b < 3 else 5))) for b in order]
    places = {r.batch: r.place for r in store.batch_order(spark, path, 3).collect()}
    assert places == {b: i for i, b in enumerate(order)}


def test_many_batches_in_few_folders_and_small_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "batches"
    n, size = 400_000, 4
    packed = spark.range(0, n, 1, 2).select(
        F.col("id").alias("query_id"), F.xxhash64("id").alias("cand_id"), F.lit(1.0).alias("label"),
        F.floor(F.col("id") / size).alias("batch"), F.pmod("id", F.lit(size)).alias("slot"),
    )
    store.write_pair_batches(packed, str(path), row_group_bytes=8_192)
    folders = [f for f in path.iterdir() if f.is_dir()]
    assert len(folders) == n // size // 1_000 < 200
    held = []
    for file in (path / "batch_folder=70").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = [c for c in range(meta.num_columns) if meta.schema.column(c).name == "batch"][0]
        held += [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
    assert len(held) > 1 and sum(s.min <= 70_500 <= s.max for s in held) <= 2
    one = store.read_pair_batches(spark, str(path), batches=[70_500])
    plan = one._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(batch), EqualTo(batch,70500)]" in plan
    assert sorted(r.query_id for r in one.collect()) == [282_000, 282_001, 282_002, 282_003]
    assert len(one.inputFiles()) >= 1


def test_features_are_written_once(spark, tmp_path):
    path = str(tmp_path / "features")
    store.write_features(spark.range(3), path)
    store.write_features(spark.range(9), path)
    assert store.load_features(spark, path).count() == 3


def test_model_and_index_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    model = KLSH(p=20, t=5, b=12, seed=4).fit(df)
    model.save(spark, str(tmp_path / "model"))
    loaded = KLSHModel.load(spark, str(tmp_path / "model"))
    assert np.array_equal(model.weights, loaded.weights) and loaded.gamma == model.gamma
    layout = model.layout(4)
    signed = model.signatures(df, layout)
    store.write_signatures(signed, str(tmp_path / "sig"))
    kept = {r.id: r.sig for r in store.load_signatures(spark, str(tmp_path / "sig")).collect()}
    assert kept == {r.id: r.sig for r in loaded.signatures(df, layout).collect()}
    store.write_band_index(signed, layout, str(tmp_path / "bands"), model)
    stored = store.load_band_index(spark, str(tmp_path / "bands"))
    assert stored.count() == 60 * layout.bands
    store.check_band_index(stored, layout, loaded)


def test_broken_images_are_reported_and_programming_errors_fail(spark):
    from pairmatch.operators.images import extract_features, image_failures

    rows = [("good", (2, 2, 3, bytes(12))), ("short", (2, 2, 3, bytes(5)))]
    images = spark.createDataFrame(
        rows, "origin string, image struct<height:int, width:int, nChannels:int, data:binary>"
    )
    assert [r.origin for r in extract_features(images).collect()] == ["good"]
    assert [r.origin for r in image_failures(images).collect()] == ["short"]

    def wrong(pixels):
        return undefined_name  # noqa: F821

    with pytest.raises(Exception, match="undefined_name"):
        extract_features(images, wrong).collect()


def test_rows_are_counted_by_the_job_that_writes_them(spark, tmp_path):
    df = spark.range(100).withColumn("bad", F.when(F.col("id") % 10 == 3, "why"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    try:
        counts = store.write_counted(
            df, str(tmp_path / "t"), {"good": F.col("bad").isNull(), "bad": F.col("bad").isNotNull()}, F.col("bad").isNull()
        )
        assert len(jobs.getJobIdsForGroup("counted")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts == {"good": 90, "bad": 10}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 90
    assert store.write_counted(df.limit(0), str(tmp_path / "e"), {"n": F.lit(True)}) == {"n": 0}


def test_lines_of_split_files_are_neither_moved_nor_sorted(spark, tmp_path):
    """A task that sorted its lines held whole blocks of a file."""
    (tmp_path / "a.csv").write_text("".join(f'"{i}\n{i}","x"\n' for i in range(50)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        records = dumps.read_records(spark, str(tmp_path))
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        # what is left of sorting is between parts that go over a border, after they are made from lines
        scans = [part for part in plan.split("MapInArrow _parts_of_blocks")[1:]]
        assert scans and "Sort" not in scans[0].split("FileScan")[0]
        assert sorted(r.record for r in records.collect()) == sorted(f'"{i}\n{i}","x"' for i in range(50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
