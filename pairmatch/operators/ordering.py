"""Positions in a total order, without a task that sees a whole group.

A window without a partition key, or with a key that holds a third of the rows, sorts
all of those rows in one task.  Here the rows are range partitioned on the full order
instead, so even a single hot group is spread over many tasks, and each row's position
is its place inside its partition plus the rows in the partitions before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.lineage import cut_lineage

# monotonically_increasing_id puts the partition number above bit 33
_ROW_BITS = 33


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def number_rows(
    df: DataFrame, order: Sequence[str | Column], name: str = "n", start: int = 0
) -> DataFrame:
    """Add ``name``: the position of each row in ``order``, from ``start``.

    ``order`` should be a total order; rows that tie get distinct positions in no fixed order.
    The sorted rows are checkpointed once, because the partition sizes and the rows that
    use them must come from the same partitioning.
    """
    sorted_rows = cut_lineage(
        df.orderBy(*_columns(order)).withColumn("_at", F.monotonically_increasing_id())
    )
    placed = sorted_rows.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        with_offset(placed, F.count(F.lit(1)))
        .withColumn(name, F.col("_offset") + inside + F.lit(start).cast("bigint"))
        .drop("_at", "_part", "_offset")
    )


def with_offset(placed: DataFrame, size: Column) -> DataFrame:
    """Adds ``_offset``: the sizes of all partitions before the row's own."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: small by construction, so the window and broadcast are too
    offsets = (
        placed.groupBy("_part")
        .agg(size.alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return placed.join(F.broadcast(offsets), "_part")


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    here, last = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(here, last), False)
    return np.asarray(pc.or_(differs, pc.xor(pc.is_null(here), pc.is_null(last))))


def _totals_in_partition(group: list[str], weight: str):
    """Task function: running sums per group inside a sorted partition."""

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, so_far, leading = None, 0, True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            fresh = np.zeros(batch.num_rows, dtype=bool)
            for name in group:
                fresh[1:] |= changes(batch.column(name))
            first = [batch.column(name)[0].as_py() for name in group]
            fresh[0] = last is not None and first != last
            weights = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(weights) - weights
            # what was summed up before the group of each row began in this batch
            starts = np.flatnonzero(fresh)
            nth = np.cumsum(fresh)
            base = np.concatenate([[-so_far], before[starts]])[nth]
            leads = leading & (nth == 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before - base), pa.array(np.full(len(nth), part)), pa.array(leads)],
                [*batch.schema.names, "_before", "_part", "_lead"],
            )
            last = [batch.column(name)[-1].as_py() for name in group]
            so_far = int(before[-1] - base[-1] + weights[-1])
            leading = bool(leads[-1])

    return accumulate


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    weight: str,
    name: str = "before",
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the group that come earlier.

    The table is range partitioned on group and order, so a hot group is spread over many
    tasks, and each task sums up what it holds.  Only the group a partition starts with can
    have rows in earlier partitions, so what is carried over is a table with one row per
    partition and is broadcast; nothing is shuffled or joined by group.
    """
    group = list(group)
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("_before", T.LongType()),
            T.StructField("_part", T.LongType()),
            T.StructField("_lead", T.BooleanType()),
        ]
    )
    placed = cut_lineage(
        df.orderBy(*_columns([*group, *order])).mapInArrow(_totals_in_partition(group, weight), schema)
    )
    key = F.struct(*group)
    # at most one key per partition
    leads = placed.where("_lead").select(key.alias("_key")).distinct()
    sums = (
        placed.join(F.broadcast(leads), key.eqNullSafe(F.col("_key")))
        .groupBy("_key", "_part")
        .agg(F.sum(weight).alias("_sum"))
    )
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("_key"), F.col("_part").alias("_p"), F.sum("_sum").over(earlier).alias("_carried")
    ).where("_carried is not null")
    return (
        placed.join(
            F.broadcast(carried), (F.col("_part") == F.col("_p")) & key.eqNullSafe(F.col("_key")), "left"
        )
        .withColumn(name, F.col("_before") + F.coalesce("_carried", F.lit(0)))
        .drop("_before", "_part", "_lead", "_key", "_p", "_carried")
    )


def rank_within(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """Add ``name``: 1-based position of each row in its group, like ``row_number``."""
    counted = running_total(df.withColumn("_one", F.lit(1)), group, order, "_one", "_earlier")
    return counted.withColumn(name, F.col("_earlier") + 1).drop("_one", "_earlier")
