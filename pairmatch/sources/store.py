"""Features, hash indexes and pair batches kept between runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairmatch.functions.bands import BandLayout
from pairmatch.lineage import SORTED_PARQUET, cut_lineage
from pairmatch.operators.candidates import band_rows
from pairmatch.operators.hashing import HashModel
from pairmatch.operators.ordering import number_rows
from pairmatch.operators.skew import ROWS_PER_SPLIT

BATCHES_PER_FOLDER = 1_000
# a writer holds a row group
MOST_OPEN_WRITERS = 64
# of columns that have more values than a dictionary may hold, or that take less as differences
_NO_DICTIONARY = {f"parquet.enable.dictionary#{name}": "false" for name in ("score", "n", "slot")}
_OPEN_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], keep: Column | None = None) -> dict[str, int]:
    """Write ``df``, or its rows that ``keep`` holds for, and count the rows each condition holds for while they are written.

    One job does both: the counts are observed in the tasks that write, right before ``keep`` is applied, so a
    task that runs again counts once.
    """
    seen = Observation()
    counted = df.observe(seen, *[F.count_if(condition).alias(name) for name, condition in counts.items()])
    (counted if keep is None else counted.where(keep)).write.mode("overwrite").parquet(path)
    return seen.get


def write_features(df: DataFrame, path: str) -> None:
    """Write descriptors unless they are already there."""
    df.write.mode("ignore").parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_signatures(signed: DataFrame, path: str) -> None:
    """Write the hashed index (id, sig)."""
    signed.write.mode("overwrite").parquet(path)


def load_signatures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class BandIndex:
    """A stored index: rows bucketed by (band, key, piece), the split buckets, and what it was hashed with."""

    rows: DataFrame
    hot: DataFrame
    written_with: dict

    def count(self) -> int:
        """How many entries are stored: one for every id and band."""
        return self.rows.count()


def _about(layout: BandLayout, model: HashModel) -> dict:
    return {"bits": layout.bits, "rows": layout.rows, "model": model.digest}


def _table_name(path: str) -> str:
    return f"band_index_{hashlib.md5(path.encode()).hexdigest()}"


def write_band_index(
    signed: DataFrame,
    layout: BandLayout,
    path: str,
    model: HashModel,
    buckets: int | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> None:
    """Write (band, key, piece, id, sig) as a bucketed table, sorted by key inside its buckets.

    A key with more than ``rows_per_split`` rows is cut into pieces by the hash of the id, so that no file
    and no task of a probe holds a hot key; ``hot`` lists those keys, at most one per ``rows_per_split`` rows.
    The table has as many buckets as the session has shuffle partitions unless told otherwise: a session
    that shuffles into more partitions than the index has buckets may shuffle the index too.
    Ids ascend inside a bucket, so a probe finds the candidates of a query in order.
    Layout and model are written last, so an index that was only written in part can't be loaded.
    """
    spark = signed.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = cut_lineage(band_rows(signed, layout).select("band", "key", "id", "sig"))
    counted = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_split)
    counted.select("band", "key", F.ceil(F.col("n") / rows_per_split).cast("int").alias("pieces")).coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/hot")
    hot = spark.read.parquet(f"{path}/hot")
    piece = F.pmod(F.xxhash64("id"), F.coalesce(F.col("pieces"), F.lit(1))).cast("int")
    spark.sql(f"drop table if exists {_table_name(path)}")
    (
        keyed.join(hot, ["band", "key"], "left")
        .select("band", "key", piece.alias("piece"), "id", "sig")
        .repartition(buckets, "band", "key", "piece")
        .write.mode("overwrite")
        .bucketBy(buckets, "band", "key", "piece")
        .sortBy("band", "key", "piece", "id")
        .option("path", f"{path}/rows")
        .saveAsTable(_table_name(path))
    )
    id_type = signed.schema["id"].dataType.simpleString()
    about = spark.range(1).select(
        F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type"), *[F.lit(v).alias(k) for k, v in _about(layout, model).items()]
    )
    about.write.mode("overwrite").parquet(f"{path}/about")


def load_band_index(spark: SparkSession, path: str) -> BandIndex:
    """The index written at ``path``, by this session or another; it is named in this session's catalog."""
    about = spark.read.parquet(f"{path}/about").first().asDict()
    buckets = about.pop("buckets")
    columns = f"band int, key bigint, piece int, id {about.pop('id_type')}, sig array<bigint>"
    # only the name is dropped: the files belong to the path
    spark.sql(f"drop table if exists {_table_name(path)}")
    spark.sql(
        f"""create table {_table_name(path)} ({columns}) using parquet options (path '{path}/rows')
            clustered by (band, key, piece) sorted by (band, key, piece) into {buckets} buckets"""
    )
    return BandIndex(spark.table(_table_name(path)), spark.read.parquet(f"{path}/hot"), about)


def check_band_index(band_index: BandIndex, layout: BandLayout, model: HashModel) -> None:
    """Raise if the index was not written with this layout and this model."""
    wanted = _about(layout, model)
    if band_index.written_with != wanted:
        raise ValueError(f"the index was written with {band_index.written_with}, the queries are hashed with {wanted}")


def write_pair_batches(
    packed: DataFrame,
    path: str,
    batches_per_folder: int = BATCHES_PER_FOLDER,
    row_group_bytes: int = 4 << 20,
    folders_in_task: int | None = None,
) -> None:
    """Write packed pairs in folders of ``batches_per_folder`` batches, sorted by batch and slot inside.

    So the number of folders is that of the batches over ``batches_per_folder``, a file has the batches of
    one stretch, and row groups are small enough for a reader of one batch to skip the others by their
    bounds.  Rows are already in batch order, so each task holds only a few folders and nothing is shuffled.
    ``folders_in_task`` says that tasks have their rows in order and about so many folders: nothing is sorted then.
    """
    folder = F.floor(F.col("batch") / batches_per_folder)
    rows = packed.withMetadata("batch", {"batches_per_folder": batches_per_folder}).withColumn("batch_folder", folder)
    if folders_in_task is None:
        _write_folders(rows.sortWithinPartitions("batch_folder", "batch", "slot"), path, row_group_bytes)
        return
    conf = packed.sparkSession.conf
    before = conf.get(_OPEN_WRITERS)
    # with a writer for each folder Spark doesn't sort by folder; it still does once a task has more of them
    conf.set(_OPEN_WRITERS, min(MOST_OPEN_WRITERS, folders_in_task))
    try:
        _write_folders(rows, path, row_group_bytes)
    finally:
        conf.set(_OPEN_WRITERS, before)


def _write_folders(rows: DataFrame, path: str, row_group_bytes: int) -> None:
    (
        rows.write.mode("overwrite")
        .options(**SORTED_PARQUET, **_NO_DICTIONARY)
        .option("parquet.block.size", row_group_bytes)
        .partitionBy("batch_folder")
        .parquet(path)
    )


def read_pair_batches(
    spark: SparkSession,
    path: str,
    expect_label: bool = True,
    batches: list[int] | None = None,
    seed: int | None = None,
    binary_only: bool = False,
) -> DataFrame:
    """Pairs of the given batches, or of all; only their folders, and row groups that may hold them, are read.

    Scores and labels come back as 32-bit floats.  ``seed`` puts the batches in a seeded
    random order, each batch still in slot order, which sorts all pairs (``shuffled_batches`` doesn't);
    ``binary_only`` drops the label 0.5.
    """
    df = spark.read.parquet(path)
    if batches is not None:
        per_folder = df.schema["batch"].metadata["batches_per_folder"]
        df = df.where(F.col("batch_folder").isin(sorted({b // per_folder for b in batches})))
        df = df.where(F.col("batch").isin(*batches))
    df = df.drop("batch_folder")
    if expect_label:
        if binary_only:
            df = df.where(F.col("label") != 0.5)
        df = df.withColumn("label", F.col("label").cast("float"))
    elif "label" in df.columns:
        df = df.drop("label")
    if "score" in df.columns:
        df = df.withColumn("score", F.col("score").cast("float"))
    if seed is not None:
        df = df.orderBy(_draw(seed), "batch", "slot")
    return df


def _draw(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col("batch").cast("string")))


def batch_order(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(batch, place): the seeded order of the stored batches, drawn from their numbers alone.

    Only the column of batch numbers is read, and every task sends each number once.
    """
    numbers = spark.read.parquet(path).select("batch").distinct().withColumn("_draw", _draw(seed))
    return number_rows(numbers, ["_draw", "batch"], "place").select("batch", "place")


def shuffled_batches(
    spark: SparkSession, path: str, seed: int, expect_label: bool = True, binary_only: bool = False
) -> Iterator[tuple[int, DataFrame]]:
    """(batch, its pairs) one after the other in the seeded order.

    Pairs are neither sorted nor moved to reorder them: each table reads the row groups of its batch when it
    is used.  The driver gets batch numbers only, a partition of them at a time.
    """
    for row in batch_order(spark, path, seed).orderBy("place").toLocalIterator():
        yield row["batch"], read_pair_batches(spark, path, expect_label, [row["batch"]], binary_only=binary_only)
