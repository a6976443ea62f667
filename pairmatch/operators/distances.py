"""Percentiles and histogram of pair distances."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.vectors import squared_l2
from pairmatch.lineage import cut_lineage
from pairmatch.operators.ordering import number_rows
from pairmatch.operators.pairs import filter_positive


def positive_distances(pairs: DataFrame) -> DataFrame:
    """(distance) of the positive pairs; pairs carry query_vec and cand_vec."""
    return filter_positive(pairs).select(
        squared_l2(F.col("query_vec"), F.col("cand_vec")).alias("distance")
    )


def percentiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row with the exact, linearly interpolated percentiles p0, p1, ….

    The values are sorted across tasks and only the ranks needed are picked, because the
    exact percentile aggregate would gather all distinct values in one task.
    """
    placed = number_rows(df.select(value).where(F.col(value).isNotNull()), [value], "n")
    total = placed.count()
    picks = []
    ranks = set()
    for i, prob in enumerate(probs):
        place = max(total - 1, 0) * prob
        low, high = math.floor(place), math.ceil(place)
        ranks |= {low, high}
        below = F.max(F.when(F.col("n") == low, F.col(value)))
        above = F.max(F.when(F.col("n") == high, F.col(value)))
        picks.append((below + (above - below) * (place - low)).alias(f"p{i}"))
    return placed.where(F.col("n").isin(*ranks)).agg(*picks)


def pair_distance_stats(pairs: DataFrame, probs: Sequence[float] = (0.33, 0.66)) -> DataFrame:
    """Percentiles of the squared distance over positive pairs."""
    return percentiles(positive_distances(pairs), "distance", probs)


def distance_histogram(df: DataFrame, value: str = "distance", bins: int = 3) -> DataFrame:
    """(bin, low, high, n, share): equal-width bins over the range, the last one closed."""
    spark = df.sparkSession
    # bounds first, then counts: both read one stored column and not the input
    numbers = cut_lineage(df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull()))
    low, high, total = numbers.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if total and low == high:
        low, high = low - 0.5, high + 0.5
    if not total:
        low, high = 0.0, 1.0
    # multiplying first keeps the edges of equal-width bins where a plain division puts them
    place = F.floor((F.col("v") - low) * bins / (high - low))
    counts = (
        numbers.groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    step = (high - low) / bins
    return (
        spark.range(bins).withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .select(
            (F.col("bin") + 1).alias("bin"),
            (F.lit(low) + F.col("bin") * step).alias("low"),
            (F.lit(low) + (F.col("bin") + 1) * step).alias("high"),
            F.coalesce("n", F.lit(0)).alias("n"),
            (F.coalesce("n", F.lit(0)) / F.lit(max(total, 1))).alias("share"),
        )
    )
