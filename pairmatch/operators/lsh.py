"""Random hyperplanes: the hash and the search of the plain baseline."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.bands import WORD_BITS, BandLayout
from pairmatch.functions.names import number_of_str
from pairmatch.operators.hashing import HashModel
from pairmatch.operators.skew import ROWS_PER_SPLIT, split_join


def hyperplanes(bits: int, dim: int, seed: int) -> np.ndarray:
    """[bits, dim] normal numbers derived from hashes of seed, plane and dimension."""

    def normal(i: int, j: int) -> float:
        u = (number_of_str(f"{seed}-{i}-{j}-u") + 1) / 4294967297.0
        v = number_of_str(f"{seed}-{i}-{j}-v") / 4294967296.0
        return math.sqrt(-2.0 * math.log(u)) * math.cos(2.0 * math.pi * v)

    return np.array([[normal(i, j) for j in range(dim)] for i in range(bits)])


@dataclass(frozen=True)
class HyperplaneModel(HashModel):
    planes: np.ndarray

    @property
    def bits(self) -> int:
        return self.planes.shape[0]

    @property
    def dim(self) -> int:
        return self.planes.shape[1]

    def hash_bits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.planes.T > 0).astype(np.int8)


def random_projection_lsh(bits: int = 300, dim: int = 960, seed: int = 0) -> HyperplaneModel:
    return HyperplaneModel(hyperplanes(bits, dim, seed))


def near_probes(query_sets: DataFrame, layout: BandLayout) -> DataFrame:
    """The same rows with their own ``sig`` and with each that is a single bit away."""
    flipped = F.transform(
        "sig",
        lambda word, i: F.when(
            i == F.floor(F.col("_flip") / WORD_BITS),
            word.bitwiseXOR(F.expr(f"shiftleft(1L, cast(_flip % {WORD_BITS} as int))")),
        ).otherwise(word),
    )
    flips = [
        word * WORD_BITS + shift + i
        for band in range(layout.bands)
        for word, shift, size in layout.places(band)
        for i in range(size)
    ]
    return (
        query_sets.withColumn("_flip", F.explode(F.array(F.lit(None).cast("int"), *[F.lit(f) for f in flips])))
        .withColumn("sig", F.when(F.col("_flip").isNull(), F.col("sig")).otherwise(flipped))
        .drop("_flip")
    )


def near_matches(
    index_sets: DataFrame,
    query_sets: DataFrame,
    layout: BandLayout,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """(query_gid, cand_gid, copies): distinct vectors whose bits differ in one place at most.

    Each query probes its own bucket and the ones a single bit away, so this is an equi-join
    like any other.
    """
    probes = near_probes(query_sets.select(F.col("gid").alias("query_gid"), "sig"), layout)
    return split_join(
        probes,
        index_sets.select("sig", F.col("gid").alias("cand_gid"), "copies"),
        ["sig"],
        left_id=["query_gid"],
        right_id=["cand_gid"],
        rows_per_split=rows_per_split,
    ).select("query_gid", "cand_gid", "copies")
