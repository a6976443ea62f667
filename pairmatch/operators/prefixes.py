"""Buckets that split until they are small: every band goes on with further bits where too many signatures share it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.functions.bands import BandLayout
from pairmatch.lineage import cut_lineage
from pairmatch.operators.candidates import copy_groups, pairs_of
from pairmatch.operators.skew import ROWS_PER_SPLIT, split_join

# levels looked at in the first round; every further round looks at twice as many
FIRST_LEVELS = 4


def _prefix(layout: BandLayout, band: Column, depth: Column) -> Column:
    """The first ``depth`` bits of ``text`` from the start of the band on, going on at the first bit after the last."""
    return F.substring(F.concat("text", "text"), band * layout.width + 1, depth)


def _different(index: DataFrame, queries: DataFrame, layout: BandLayout) -> DataFrame:
    """(sid, sig, in_index, text): the different signatures of both sides, numbered, and their bits as text."""
    sides = index.select("sig", F.lit(1).alias("in_index")).unionAll(queries.select("sig", F.lit(0).alias("in_index")))
    return cut_lineage(
        sides.groupBy("sig")
        .agg(F.max("in_index").alias("in_index"))
        .select(
            F.monotonically_increasing_id().alias("sid"), "sig", "in_index", layout.bit_text(F.col("sig")).alias("text")
        )
    )


def _walk(sigs: DataFrame, layout: BandLayout, target: int) -> DataFrame:
    """(sid, band, depth) of numbered signatures; see ``split_depths``."""
    if target < 1:
        raise ValueError("a bucket holds at least one signature")
    state = sigs.select(
        "sid",
        "in_index",
        "text",
        F.explode(F.sequence(F.lit(0), F.lit(layout.bands - 1))).alias("band"),
        F.lit(layout.width).alias("depth"),
    )
    if layout.width == layout.bits:
        return state.select("sid", "band", "depth")
    settled = []
    levels = FIRST_LEVELS
    while True:
        tried = F.least(F.lit(levels), F.lit(layout.bits) - F.col("depth"))
        # only keys of the prefixes are shuffled, no texts
        rows = state.select(
            "sid", "in_index", "text", "band", "depth", F.explode(F.sequence("depth", F.col("depth") + tried - 1)).alias("level")
        ).select(
            "sid", "in_index", "band", "depth", "level",
            F.xxhash64(_prefix(layout, F.col("band"), F.col("level"))).alias("key"),
        )
        full = rows.groupBy("band", "level", "key").agg(F.sum("in_index").alias("n")).where(F.col("n") > target)
        # buckets inside a small one are small, so the full levels are the first ones
        passed = (
            rows.drop("in_index")
            .join(full, ["band", "level", "key"], "left")
            .groupBy("sid", "band", "depth")
            .agg(F.count("n").cast("int").alias("passed"))
        )
        moved = cut_lineage(
            passed.select(
                "sid",
                "band",
                (F.col("depth") + F.col("passed")).alias("depth"),
                ((F.col("passed") == tried) & (F.col("depth") + tried < layout.bits)).alias("goes_on"),
            )
        )
        settled.append(moved.where(~F.col("goes_on")).drop("goes_on"))
        open_rows = moved.where("goes_on").drop("goes_on")
        if open_rows.isEmpty():
            return reduce(DataFrame.unionAll, settled)
        state = open_rows.join(sigs.drop("sig"), "sid")
        levels *= 2


def split_depths(index: DataFrame, queries: DataFrame, layout: BandLayout, target: int) -> DataFrame:
    """(sig, in_index, band, depth): how many bits tell the bucket of a signature, for every distinct one and band.

    A bucket holds the signatures that share the first bits of a band.  It is split by the next bit while it
    holds more than ``target`` different signatures of the index, so a signature's depth is the least, from the width of
    a band on, at which at most ``target`` share its bits.  Copies count once, as no bit can tell them apart.  A query
    follows the same buckets down.

    Rounds look at 4, 8, 16, ... levels at once, each only at signatures whose buckets are all too full so far;
    so there are as many rounds as the logarithm of the depth, and counts are combined before they are shuffled.
    """
    sigs = _different(index, queries, layout)
    return _walk(sigs, layout, target).join(sigs, "sid").select("sig", "in_index", "band", "depth")


def split_bucket_sizes(signed: DataFrame, layout: BandLayout, target: int) -> DataFrame:
    """(band, depth, prefix, n, n_signatures): the buckets after splitting, their ids and different signatures."""
    sigs = _different(signed, signed.limit(0), layout)
    copies = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"))
    return (
        _walk(sigs, layout, target)
        .join(sigs.join(copies, "sig"), "sid")
        .select("band", "depth", _prefix(layout, F.col("band"), F.col("depth")).alias("prefix"), "copies")
        .groupBy("band", "depth", "prefix")
        .agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("n_signatures"))
    )


def split_keys(index: DataFrame, queries: DataFrame, layout: BandLayout, target: int) -> DataFrame:
    """(sig, keys): the buckets of every different signature after splitting, a 64-bit key for each band."""
    sigs = _different(index, queries, layout)
    depths = (
        _walk(sigs, layout, target)
        .groupBy("sid")
        # one for each band
        .agg(F.sort_array(F.collect_list(F.struct("band", "depth"))).alias("depths"))
    )
    return cut_lineage(
        depths.join(sigs, "sid").select(
            "sig",
            F.transform("depths", lambda d: F.xxhash64(d.band, d.depth, _prefix(layout, d.band, d.depth))).alias("keys"),
        )
    )


def first_shared_key(one: Column, two: Column, layout: BandLayout) -> Column:
    """The first band in which two lists of ``split_keys`` agree; null if there is none."""
    return reduce(
        lambda chain, band: F.when(F.get(one, F.lit(band)) == F.get(two, F.lit(band)), band).otherwise(chain),
        reversed(range(layout.bands)),
        F.lit(None).cast("int"),
    )


def split_matches(
    index: DataFrame, queries: DataFrame, layout: BandLayout, target: int, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """(query_ids, cand_ids): groups of copies that share a bucket of ``split_depths``.

    As in ``band_matches``, a pair is kept in the first band it shares; both sides carry one 64-bit key per band, that of
    their bucket.  A query meets at most ``target`` different signatures per band, however large the index is.
    """
    keys = split_keys(index, queries, layout, target)

    def buckets(signed: DataFrame, side: str) -> DataFrame:
        groups = cut_lineage(
            copy_groups(signed)
            .join(keys, "sig")
            .select(F.col("keys").alias(f"{side}_keys"), F.col("ids").alias(f"{side}_ids"))
        )
        return groups.select("*", F.posexplode(f"{side}_keys").alias("band", "key"))

    return split_join(
        buckets(queries, "query"),
        buckets(index, "cand"),
        ["band", "key"],
        left_id=["query_ids"],
        right_id=["cand_ids"],
        residual=first_shared_key(F.col("query_keys"), F.col("cand_keys"), layout) == F.col("band"),
        rows_per_split=rows_per_split,
    ).select("query_ids", "cand_ids")


def split_set_matches(
    index_sets: DataFrame, query_sets: DataFrame, keys: DataFrame, layout: BandLayout, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """(query_gid, cand_gid, copies): distinct vectors that share a bucket of ``split_keys``, each pair once."""
    left = query_sets.join(keys, "sig").select(F.col("keys").alias("query_keys"), F.col("gid").alias("query_gid"))
    right = index_sets.join(keys, "sig").select(F.col("keys").alias("cand_keys"), F.col("gid").alias("cand_gid"), "copies")
    return split_join(
        left.select("*", F.posexplode("query_keys").alias("band", "key")),
        right.select("*", F.posexplode("cand_keys").alias("band", "key")),
        ["band", "key"],
        left_id=["query_gid"],
        right_id=["cand_gid"],
        residual=first_shared_key(F.col("query_keys"), F.col("cand_keys"), layout) == F.col("band"),
        rows_per_split=rows_per_split,
    ).select("query_gid", "cand_gid", "copies")


def split_candidates(
    index: DataFrame, queries: DataFrame, layout: BandLayout, target: int, rows_per_split: int = ROWS_PER_SPLIT
) -> DataFrame:
    """(query_id, cand_id): every candidate sharing a bucket of bounded size with the query, once."""
    return pairs_of(split_matches(index, queries, layout, target, rows_per_split))
