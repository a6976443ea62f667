"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    """Sum of squared differences, each element taken as a double first."""
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.aggregate(squares, F.lit(0.0), lambda total, v: total + v)


def hamming_distance(a: Column, b: Column) -> Column:
    """Number of positions in which two 0/1 arrays differ."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)),
        F.lit(0),
        lambda total, v: total + v,
    )


def packed_hamming_distance(a: Column, b: Column) -> Column:
    """The same for signatures packed into arrays of words."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, v: total + v,
    )


def permute_bits(bits: Column, order: Sequence[int]) -> Column:
    """The elements of ``bits`` in the given 0-based order."""
    return F.transform(F.array(*[F.lit(int(i)) for i in order]), lambda i: F.get(bits, i))


def weighted_score(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum of per-layer scores; the weights must sum to one."""
    if len(scores) != len(weights):
        raise ValueError("need one weight per score")
    if abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1")
    total = F.lit(0.0)
    for score, weight in zip(scores, weights):
        total = total + F.lit(float(weight)) * score
    return total
