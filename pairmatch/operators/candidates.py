"""Candidate search: signatures that share a band, or that sort near each other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.functions.bands import BandLayout
from pairmatch.lineage import cut_lineage
from pairmatch.operators.ordering import number_rows
from pairmatch.operators.skew import ROWS_PER_SPLIT, split_join

COPIES_PER_ROW = 64


def copy_groups(signed: DataFrame, copies_per_row: int = COPIES_PER_ROW) -> DataFrame:
    """(sig, ids): rows with equal signatures folded together before anything is shuffled.

    Folding happens inside each Arrow batch, so it costs no shuffle and a list never holds
    more than ``copies_per_row`` ids.  Copies that fill a third of the table shrink by about
    that factor; a signature may still come in several rows.
    """
    id_type = signed.schema["id"].dataType

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sig, ids = batch.column("sig"), batch.column("id")
            words = sig.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            order = np.lexsort(words.T)
            ordered = words[order]
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
            begin = np.flatnonzero(fresh)
            place = np.arange(len(order)) - begin[np.cumsum(fresh) - 1]
            starts = np.flatnonzero(place % copies_per_row == 0)
            ends = np.append(starts, len(order)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays(
                [sig.take(pa.array(order[starts])), lists], ["sig", "ids"]
            )

    schema = T.StructType(
        [
            T.StructField("sig", T.ArrayType(T.LongType())),
            T.StructField("ids", T.ArrayType(id_type)),
        ]
    )
    return signed.select("id", "sig").mapInArrow(fold, schema)


def band_rows(groups: DataFrame, layout: BandLayout) -> DataFrame:
    """One row per band of every signature: (band, key, ...)."""
    return groups.select("*", F.posexplode(layout.keys(F.col("sig"))).alias("band", "key"))


def bucket_sizes(signed: DataFrame, layout: BandLayout) -> DataFrame:
    """(band, key, n): how many ids fall in each bucket.  Counts only, no member lists."""
    return (
        band_rows(signed, layout).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    )


def band_matches(
    index: DataFrame,
    queries: DataFrame,
    layout: BandLayout,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """(query_ids, cand_ids): groups of copies that share at least one band.

    ``index`` and ``queries`` are (id, sig).  A pair of groups meets in every band it
    shares; it is kept only in the first of them, which both signatures can tell on the
    spot.  So the union over the bands needs neither a distinct nor a shuffle of the pairs.
    The groups are checkpointed because the bucket counts and the join both read them.
    """
    query_groups = cut_lineage(
        copy_groups(queries).select(F.col("sig"), F.col("ids").alias("query_ids"))
    )
    index_groups = cut_lineage(
        copy_groups(index).select(F.col("sig"), F.col("ids").alias("cand_ids"))
    )
    return split_join(
        band_rows(query_groups, layout).withColumnRenamed("sig", "query_sig"),
        band_rows(index_groups, layout).withColumnRenamed("sig", "cand_sig"),
        ["band", "key"],
        left_id=["query_ids"],
        right_id=["cand_ids"],
        residual=layout.first_shared_band(F.col("query_sig"), F.col("cand_sig")) == F.col("band"),
        rows_per_split=rows_per_split,
    ).select("query_ids", "cand_ids")


def pairs_of(matches: DataFrame) -> DataFrame:
    """(query_id, cand_id): the groups of ``band_matches`` written out, without a shuffle."""
    return matches.select(F.explode("query_ids").alias("query_id"), "cand_ids").select(
        "query_id", F.explode("cand_ids").alias("cand_id")
    )


def band_candidates(
    index: DataFrame,
    queries: DataFrame,
    layout: BandLayout,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """(query_id, cand_id): every candidate sharing a bucket with the query, once."""
    return pairs_of(band_matches(index, queries, layout, rows_per_split))


def permutations(bits: int, n_perm: int, seed: int) -> list[list[int]]:
    """Seeded permutations: bit numbers in the order of a hash of seed, permutation and bit."""
    return [
        sorted(range(bits), key=lambda i: (hashlib.md5(f"{seed}-{p}-{i}".encode()).hexdigest(), i))
        for p in range(n_perm)
    ]


def sort_keys(signed: DataFrame, layout: BandLayout, n_perm: int, seed: int) -> DataFrame:
    """One row per permutation: (perm, key, ...), where keys sort like the permuted bits."""
    orders = np.array(permutations(layout.bits, n_perm, seed))

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def permuted(column: pa.Array) -> pa.Array:
        words = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        bits = layout.unpack(words)
        packed = np.packbits(bits[:, orders], axis=2)
        rows, width = len(column) * n_perm, packed.shape[2]
        starts = np.arange(rows + 1, dtype=np.int32) * np.int32(width)
        values = pa.Array.from_buffers(
            pa.binary(), rows, [None, pa.py_buffer(starts), pa.py_buffer(packed.tobytes())]
        )
        offsets = np.arange(len(column) + 1, dtype=np.int32) * n_perm
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return signed.select("*", F.posexplode(permuted("sig")).alias("perm", "key"))


def permutation_candidates(
    index: DataFrame,
    queries: DataFrame,
    layout: BandLayout,
    n_perm: int = 250,
    seed: int = 0,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """(query_id, cand_id): rows that sort near an exact match under some permutation.

    For every permutation the index is sorted by its permuted bits; around the first row
    that equals the query, the 2 * n_perm rows before it and the 2 * n_perm rows from it on
    are candidates.  A query whose bits occur nowhere in the index has none.

    Positions come from one range-partitioned sort of all permutations.  Positions are cut
    into blocks as long as a window, so a window meets two blocks and a block never holds
    more rows than that, however skewed the signatures are.
    """
    reach = 2 * n_perm
    block = 2 * reach
    # the sort samples its input before it reads it; signatures are cheaper to read twice
    index, queries = cut_lineage(index), cut_lineage(queries)
    # equal queries have equal windows: look each signature up once
    wanted = queries.select("sig").distinct()
    placed = cut_lineage(
        number_rows(
            sort_keys(index, layout, n_perm, seed).select("perm", "key", "id"),
            ["perm", "key", "id"],
            "pos",
        )
    )
    firsts = placed.groupBy("perm", "key").agg(F.min("pos").alias("first"))
    windows = (
        sort_keys(wanted, layout, n_perm, seed)
        .join(firsts, ["perm", "key"])
        .select(
            "sig",
            "perm",
            "first",
            F.explode(
                F.sequence(
                    F.floor((F.col("first") - reach) / block),
                    F.floor((F.col("first") + reach - 1) / block),
                )
            ).alias("block"),
        )
    )
    near = (
        placed.select("perm", F.floor(F.col("pos") / block).alias("block"), "pos", "id")
        .join(windows, ["perm", "block"])
        .where((F.col("pos") >= F.col("first") - reach) & (F.col("pos") < F.col("first") + reach))
        .select("sig", F.col("id").alias("cand_id"))
        .distinct()
    )
    return split_join(
        queries.select("sig", F.col("id").alias("query_id")),
        near,
        ["sig"],
        left_id=["query_id"],
        right_id=["cand_id"],
        rows_per_split=rows_per_split,
    ).select("query_id", "cand_id")
