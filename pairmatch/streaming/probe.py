"""New queries, batch or stream, against a stored band index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairmatch.functions.bands import BandLayout
from pairmatch.lineage import SORTED_PARQUET
from pairmatch.operators.candidates import band_rows
from pairmatch.operators.hashing import HashModel
from pairmatch.sources.store import BandIndex, check_band_index


def probe_index(signed: DataFrame, band_index: BandIndex, layout: BandLayout, model: HashModel) -> DataFrame:
    """(query_id, cand_id) of signed queries against a stored index.

    The index is read bucket by bucket and is never shuffled; queries go to every piece of a split key.
    A pair is kept in the first band it shares, so no duplicate has to be remembered and
    the join needs no state when the queries are a stream.  An index of another layout or
    model is refused.
    """
    check_band_index(band_index, layout, model)
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("pieces"), F.lit(1)) - 1)
    probes = (
        band_rows(signed, layout)
        .select(F.col("id").alias("query_id"), F.col("sig").alias("query_sig"), "band", "key")
        .join(band_index.hot, ["band", "key"], "left")
        .select("query_id", "query_sig", "band", "key", F.explode(pieces).alias("piece"))
    )
    stored = band_index.rows.select("band", "key", "piece", F.col("id").alias("cand_id"), "sig")
    first = layout.first_shared_band(F.col("query_sig"), F.col("sig"))
    return (
        probes.join(stored, ["band", "key", "piece"])
        .where(first == F.col("band"))
        .select("query_id", "cand_id")
    )


_BATCH = ["stream", "batch"]


def _done(spark: SparkSession, path: str) -> DataFrame:
    """(stream, batch) of the batches that are done."""
    return spark.read.option("basePath", f"{path}/done").parquet(f"{path}/done").where("done").select(*_BATCH)


def start_probe_sink(found: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a stream of pairs to a table in which every batch is there exactly once, and start it.

    A batch is written to a folder of its own, named by the stream and its number, and then marked as done.
    A stream that stopped before the mark writes the same folder over when it comes back; one that stopped
    between the mark and its own commit finds the mark and leaves the batch alone.  The stream's id lives in its
    checkpoint, so a stream with a new checkpoint adds to the table and replaces nothing.  Only the first batch
    of a run can have been written before, so marks are looked up once.  Pairs are written as the join gives them: query
    by query with candidates in the order of the stored index, so ids are kept as differences.
    """
    spark = found.sparkSession
    # a table without batches can be read too
    nothing = "stream=none/batch=-1"
    spark.createDataFrame([], found.schema).write.mode("ignore").parquet(f"{path}/rows/{nothing}")
    spark.createDataFrame([], "done boolean").write.mode("ignore").parquet(f"{path}/done/{nothing}")
    first = True

    def write(batch: DataFrame, number: int) -> None:
        nonlocal first
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        again = first and not _done(session, path).where(
            (F.col("stream") == stream) & (F.col("batch") == number)
        ).isEmpty()
        first = False
        if again:
            return
        folder = f"stream={stream}/batch={number}"
        batch.write.mode("overwrite").options(**SORTED_PARQUET).parquet(f"{path}/rows/{folder}")
        session.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{path}/done/{folder}")

    return (
        found.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, cand_id, stream, batch) of all batches that are done."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    # one row per batch
    return rows.join(_done(spark, path), _BATCH, "left_semi").select("query_id", "cand_id", *_BATCH)
