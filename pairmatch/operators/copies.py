"""Equal vectors searched once: groups of copies and who belongs to them.

Copies have the same bits, the same candidates and the same scores.  Everything between
hashing and the final report therefore runs on one row per distinct vector that knows how
many copies it stands for, and never on pairs of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.bands import BandLayout
from pairmatch.operators.hashing import HashModel
from pairmatch.operators.candidates import band_rows
from pairmatch.operators.ordering import rank_within
from pairmatch.operators.skew import ROWS_PER_SPLIT, split_join


def digest(vec: Column) -> Column:
    """128 bits that tell vectors apart, cheaper to shuffle than the vectors."""
    return F.struct(F.xxhash64(vec).alias("a"), F.xxhash64(F.lit(1), vec).alias("b"))


def signed_rows(df: DataFrame, model: HashModel, layout: BandLayout) -> DataFrame:
    """(id, sig, digest) of (id, vec), in one pass over the vectors."""
    return model.signatures(
        df.select("id", "vec", digest(F.col("vec")).alias("digest")), layout, keep=["digest"]
    )


def copy_sets(rows: DataFrame) -> DataFrame:
    """(gid, sig, digest, copies): one row per distinct vector, named by its smallest id.

    Copies are combined map-side, so however many there are, each task sends one row.
    """
    return rows.groupBy("sig", "digest").agg(
        F.min("id").alias("gid"), F.count(F.lit(1)).alias("copies")
    )


def memberships(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, gid, sig, copies) of every row."""
    return rows.join(sets, ["sig", "digest"]).select("id", "gid", "sig", "copies")


def places_in_set(members: DataFrame) -> DataFrame:
    """(id, place): 0-based place of each id among the copies of its vector."""
    return rank_within(members.select("gid", "id"), ["gid"], ["id"], "place").select(
        "id", (F.col("place") - 1).alias("place")
    )


def set_matches(
    index_sets: DataFrame,
    query_sets: DataFrame,
    layout: BandLayout,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """(query_gid, cand_gid, copies): distinct vectors that share a band, each pair once."""
    left = band_rows(
        query_sets.select(F.col("sig"), F.col("gid").alias("query_gid")), layout
    ).withColumnRenamed("sig", "query_sig")
    right = band_rows(
        index_sets.select(F.col("sig"), F.col("gid").alias("cand_gid"), "copies"), layout
    ).withColumnRenamed("sig", "cand_sig")
    return split_join(
        left,
        right,
        ["band", "key"],
        left_id=["query_gid"],
        right_id=["cand_gid"],
        residual=layout.first_shared_band(F.col("query_sig"), F.col("cand_sig")) == F.col("band"),
        rows_per_split=rows_per_split,
    ).select("query_gid", "cand_gid", "copies")
