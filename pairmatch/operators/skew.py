"""Equi-join that spreads hot keys of either side over several tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 100_000
# what the broadcast table of split keys holds at most, some 50 MB
MOST_SPLIT_KEYS = 1_000_000


def _splits(df: DataFrame, keys: Sequence[str], rows_per_split: int, name: str) -> DataFrame:
    """Number of pieces for the keys above ``rows_per_split``, the largest first.

    Counts are combined map-side.  At most ``MOST_SPLIT_KEYS`` keys come out, which bounds the broadcast in
    ``lay_out_grid``; so a key that stays whole has ``rows_per_split`` rows or a millionth of the table at most.
    The order is total, because the table is computed for both sides.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_split)
        .orderBy(F.desc("_rows"), *keys)
        .limit(MOST_SPLIT_KEYS)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_split).cast("int").alias(name))
    )


def lay_out_grid(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    rows_per_split: int = ROWS_PER_SPLIT,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_lslot`` and ``_rslot``, so that rows of equal keys and slots meet exactly once.

    A key with ``l`` left pieces and ``r`` right pieces becomes ``l * r`` join keys: each
    left row goes to one of ``l`` rows of the grid and is repeated along its ``r`` columns,
    and the other way round for right rows.
    """
    left_splits = F.broadcast(_splits(left, keys, rows_per_split, "_ls"))
    right_splits = F.broadcast(_splits(right, keys, rows_per_split, "_rs"))

    def lay_out(df, ids, own, own_slot, other, other_slot):
        one = F.lit(1)
        return (
            df.join(left_splits, list(keys), "left")
            .join(right_splits, list(keys), "left")
            .withColumn(
                own_slot, F.pmod(F.xxhash64(*ids), F.coalesce(F.col(own), one)).cast("int")
            )
            .withColumn(
                other_slot,
                F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), one) - 1)),
            )
            .drop("_ls", "_rs")
        )

    return (
        lay_out(left, left_id, "_ls", "_lslot", "_rs", "_rslot"),
        lay_out(right, right_id, "_rs", "_rslot", "_ls", "_lslot"),
    )


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    residual: Column | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Inner join on ``keys``; a key with many rows is cut into a grid of pieces.

    ``residual`` may use columns of both sides; besides ``keys`` their names must differ.
    """
    lefts, rights = lay_out_grid(left, right, keys, left_id, right_id, rows_per_split)
    joined = lefts.join(rights, [*keys, "_lslot", "_rslot"])
    if residual is not None:
        joined = joined.where(residual)
    return joined.drop("_lslot", "_rslot")
