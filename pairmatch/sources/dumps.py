"""Header-less CSV dumps of submissions and comments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.operators.ordering import running_total

# Columns of the dumps, in order
SUBMISSION_COLUMNS = [
    "timestamp", "user_id", "subreddit_name", "post_fullname",
    "post_type", "post_title", "post_target_url", "post_body",
]
COMMENT_COLUMNS = [
    "timestamp", "user_id", "subreddit_name", "comment_fullname",
    "comment_body", "parent_fullname", "post_fullname",
]
# Cells that mean "missing"
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


_PARTS = "file string, block long, row long, text string, is_head boolean, is_open boolean"


def _parts_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: lines in order to records, or to the parts of records that a block holds.

    The last part of a batch may go on in the next one and is held back, with what was known where it began.
    """
    rest, rest_inside = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        place = [rows.column(name).to_numpy(zero_copy_only=False) for name in ("file", "block")]
        odd, inside = (rows.column(name).to_numpy(zero_copy_only=False) for name in ("odd", "inside"))
        fresh = np.ones(rows.num_rows, dtype=bool)
        fresh[1:] = (place[0][1:] != place[0][:-1]) | (place[1][1:] != place[1][:-1])
        first = np.flatnonzero(fresh)
        begun_inside = inside[first].copy()
        if rest is not None:
            begun_inside[0] = rest_inside
        total = np.cumsum(odd) - odd
        block = np.cumsum(fresh) - 1
        # whether each line begins inside quotes
        before = (begun_inside[block] + total - total[first][block]) % 2
        starts = np.flatnonzero(fresh | (before == 0))
        yield _parts(rows, starts[:-1], starts[1:], before, odd)
        rest, rest_inside = rows.slice(starts[-1]), before[starts[-1]]
    if rest is not None:
        odd = rest.column("odd").to_numpy(zero_copy_only=False)
        before = (rest_inside + np.cumsum(odd) - odd) % 2
        yield _parts(rest, np.array([0]), np.array([rest.num_rows]), before, odd)


def _parts(
    rows: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, odd: np.ndarray
) -> pa.RecordBatch:
    lines = rows.column("value")
    texts = lines.take(pa.array(starts)).to_pylist()
    for i in np.flatnonzero(ends - starts > 1):
        texts[i] = "\n".join(lines.slice(starts[i], ends[i] - starts[i]).to_pylist())
    begin = rows.take(pa.array(starts))
    last = ends - 1
    return pa.RecordBatch.from_arrays(
        [
            begin.column("file"),
            begin.column("block"),
            begin.column("row"),
            pa.array(texts, pa.string()),
            pa.array(before[starts] == 1),
            pa.array((before[last] + odd[last]) % 2 == 1),
        ],
        ["file", "block", "row", "text", "is_head", "is_open"],
    )


def read_records(spark: SparkSession, path: str, path_glob: str | None = None) -> DataFrame:
    """(record, ord) of CSV files that Spark splits into blocks although quoted fields hold line breaks.

    A line break ends a record if an even number of quotes comes before it in the file.  A first pass counts the quotes
    of every block, and their running sums tell which blocks begin inside quotes; a second puts lines together
    inside each block.  Only the parts of records that go over the border of a block, at most two of a block, are shuffled.
    Quotes have to be balanced as in RFC 4180: a quote inside a field is doubled and the field quoted.
    Empty lines between records are dropped.  Numbering the blocks runs jobs when this is called.
    """
    reader = spark.read.option("lineSep", "\n")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
        (quotes % 2).cast("long").alias("odd"),
    )
    blocks = lines.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd"))
    begins = running_total(blocks, ["file"], ["block"], "odd", "before").select(
        "file", "block", (F.col("before") % 2).alias("inside")
    )
    parts = (
        # a row for each block, so the lines stay in the tasks that read them, and in order
        lines.join(F.broadcast(begins), ["file", "block"])
        .select("file", "block", "row", "value", "odd", "inside")
        .mapInArrow(_parts_of_blocks, _PARTS)
    )
    place = F.struct("file", "block", "row")
    whole = parts.where("not is_head and not is_open").select(F.col("text").alias("record"), place.alias("ord"))
    pieces = parts.where("is_head or is_open").withColumn("_new", (~F.col("is_head")).cast("long"))
    numbered = running_total(pieces, ["file"], ["block", "row"], "_new", "_earlier")
    joined = (
        numbered.groupBy("file", (F.col("_earlier") + F.col("_new")).alias("number"))
        .agg(F.sort_array(F.collect_list(F.struct("block", "row", "text"))).alias("parts"))
        .select(
            F.array_join(F.col("parts.text"), "\n").alias("record"),
            F.struct(
                "file", F.col("parts")[0].getField("block").alias("block"), F.col("parts")[0].getField("row").alias("row")
            ).alias("ord"),
        )
    )
    ended = F.regexp_replace("record", "\\r$", "").alias("record")
    return whole.unionAll(joined).select(ended, "ord").where("record <> ''")


def _read_dump(
    spark: SparkSession,
    path: str,
    names: Sequence[str],
    keep: Sequence[str],
    required: str,
    na_values: Sequence[str],
    path_glob: str | None,
    multi_line: bool,
    split_files: bool,
) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    present = [F.when(~F.col(c).isin(*na_values), F.col(c)).alias(c) for c in keep]
    if split_files:
        cells = F.from_csv("record", ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"'})
        records = read_records(spark, path, path_glob).select(cells.alias("cells"), "ord").select("cells.*", "ord")
        return records.select(*present, "ord").where(F.col(required).isNotNull())
    reader = (
        spark.read.schema(schema)
        .option("header", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    # place in the input: file, block of the file, row in the block, however files are packed
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return reader.csv(path).select(*present, place.alias("ord")).where(F.col(required).isNotNull())


def read_link_dump(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = ("subreddit_name", "post_fullname", "post_target_url"),
    na_values: Sequence[str] = tuple(NA_VALUES),
    path_glob: str | None = None,
    multi_line: bool = True,
    split_files: bool = False,
) -> DataFrame:
    """(link, name, post_id, ord) of a submission dump; rows without a link are dropped.

    ``path_glob`` picks files by name.  Quoted fields may hold line breaks; ``multi_line``
    off lets Spark split large files that have none.  ``split_files`` splits files that have some, see ``read_records``.
    """
    rows = _read_dump(
        spark, path, SUBMISSION_COLUMNS, columns, "post_target_url", na_values, path_glob, multi_line, split_files
    )
    name = F.col("subreddit_name") if "subreddit_name" in columns else F.lit(None).cast("string")
    return rows.select(
        F.col("post_target_url").alias("link"),
        name.alias("name"),
        F.col("post_fullname").alias("post_id"),
        "ord",
    )


def read_comment_dump(
    spark: SparkSession,
    path: str,
    na_values: Sequence[str] = tuple(NA_VALUES),
    path_glob: str | None = None,
    multi_line: bool = True,
    split_files: bool = False,
) -> DataFrame:
    """(comment_body, parent_fullname, post_fullname, ord); comments without text are dropped.

    ``multi_line`` and ``split_files`` are those of ``read_link_dump``.
    """
    return _read_dump(
        spark, path, COMMENT_COLUMNS, ("comment_body", "parent_fullname", "post_fullname"),
        "comment_body", na_values, path_glob, multi_line, split_files,
    )
