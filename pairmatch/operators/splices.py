"""Spliced images matched with the nearer of their two originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.vectors import squared_l2
from pairmatch.operators.ordering import rank_within


def original_key(name: Column) -> Column:
    """Fields 1 and 2 of an original's file name, without the four characters at the end."""
    parts = F.split(name, "_")
    joined = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))
    return F.substring(joined, F.lit(1), F.length(joined) - 4)


def splice_keys(name: Column) -> Column:
    """Struct (s1, s2): fields 5 and 6 of a splice's file name, its possible originals."""
    parts = F.split(name, "_")
    return F.struct(F.get(parts, F.lit(5)).alias("s1"), F.get(parts, F.lit(6)).alias("s2"))


def wrapped_squared_l2(a: Column, b: Column) -> Column:
    """Squared distance of byte values as unsigned byte arithmetic gives it."""

    def square(x, y):
        d = F.pmod(x.cast("bigint") - y.cast("bigint"), F.lit(256))
        return F.pmod(d * d, F.lit(256))

    return F.aggregate(F.zip_with(a, b, square), F.lit(0).cast("bigint"), lambda t, v: t + v)


def match_splices(splices: DataFrame, originals: DataFrame, wrap_uint8: bool = False) -> DataFrame:
    """(file, au, distance): each splice with its nearer original, the second on a tie.

    ``splices`` is (file, s1, s2, vec) and ``originals`` (key, vec); both originals must exist.
    """
    distance = wrapped_squared_l2 if wrap_uint8 else squared_l2

    def original(n: int) -> DataFrame:
        return originals.select(F.col("key").alias(f"s{n}"), F.col("vec").alias(f"v{n}"))

    measured = (
        splices.join(original(1), "s1")
        .join(original(2), "s2")
        .select(
            "file", "s1", "s2",
            distance(F.col("v1"), F.col("vec")).alias("d1"),
            distance(F.col("v2"), F.col("vec")).alias("d2"),
        )
    )
    first = F.col("d1") < F.col("d2")
    return measured.select(
        "file",
        F.when(first, F.col("s1")).otherwise(F.col("s2")).alias("au"),
        F.when(first, F.col("d1")).otherwise(F.col("d2")).alias("distance"),
    )


def number_splices(matched: DataFrame) -> DataFrame:
    """Adds ``number``, running per original, and the file name both sides get from it."""
    numbered = rank_within(matched, ["au"], ["file"], "number")
    return numbered.withColumn(
        "pair_name", F.concat(F.col("au"), F.lit("_"), F.col("number").cast("string"), F.lit(".jpg"))
    )


def splice_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("au").agg(F.count(F.lit(1)).alias("n"))


def splice_pairs(numbered: DataFrame, originals: DataFrame) -> DataFrame:
    """(au, file, pair_name, label): originals joined to their own splices by key."""
    return numbered.join(originals.select(F.col("key").alias("au")), "au").select(
        "au", "file", "pair_name", F.lit(1).alias("label")
    )
