"""All candidate pairs in their order and with their places, without sorting pairs.

How many candidates a query has is counted from signatures first, so the place of its first pair is known before any pair is
there.  Blocks then give a list of candidates for each query and range of the index; lists are dealt to tasks by
those places, and a task only has to bring the few lists of a query and range into one order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.functions.bands import BandLayout
from pairmatch.lineage import cut_lineage
from pairmatch.operators.blocks import block_rows, whole_blocks
from pairmatch.operators.bucketwise import BlockScorer, _Blocks, _order_of, _scores, _tasks, _vectors, count_in_blocks
from pairmatch.operators.candidates import band_rows
from pairmatch.operators.ordering import number_rows, running_total
from pairmatch.operators.pairs import NEGATIVE, POSITIVE

# index rows whose lists a task holds together
RANGE_BITS = 16
PAIRS_PER_TASK, LEAST_PER_TASK = 1 << 22, 1 << 16
PAIRS_AT_ONCE = 1 << 18
PAIRS_PER_BATCH = 1 << 16
_RANGE = ["first", "range"]


def _pair_lists(
    lefts: DataFrame, rights: DataFrame, layout: BandLayout, scorer: BlockScorer, n_rows: int, range_bits: int
) -> DataFrame:
    """(first, query_id, range, cands, scores): the candidates that a query meets in a block, a row for each range of the index.

    Left rows of bands have first, which tells query ids apart, query_id, sig and vec, right ones cand_gid, no, sig and vec.
    """
    lefts = lefts.select("band", "key", "sig", "vec", "query_id", F.col("first").alias("query_gid"))
    rights = rights.select("band", "key", "sig", "vec", "cand_gid", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_blocks(batches):
            blocks = _Blocks(batch, layout)
            vectors = _vectors(batch.column("vec"))
            ranges = batch.column("no").fill_null(0).to_numpy(zero_copy_only=False) >> range_bits

            def scored():
                for left, right in blocks.listed():
                    yield left, right, _scores(scorer, vectors, left, right)
                for left, right in blocks.tiles():
                    fresh = blocks.fresh(left, right)
                    if fresh is not None and not fresh.any():
                        continue
                    found = scorer.cells(vectors[left], vectors[right])
                    rows, columns = np.nonzero(np.ones(found.shape, dtype=bool) if fresh is None else fresh)
                    yield rows + left.start, columns + right.start, found[rows, columns]

            def lists(parts):
                left, right, score = (np.concatenate(side) for side in zip(*parts, strict=True))
                of = ranges[right]
                fresh = np.ones(len(left), dtype=bool)
                fresh[1:] = (left[1:] != left[:-1]) | (of[1:] != of[:-1])
                begin = np.flatnonzero(fresh)
                ends = pa.array(np.append(begin, len(left)).astype(np.int32))
                owner = pa.array(left[begin])
                # as they are read from stored batches
                single = pa.array(score.astype(np.float32), mask=np.isnan(score))
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column("query_gid").take(owner),
                        batch.column("query_id").take(owner),
                        pa.array(of[begin]),
                        pa.ListArray.from_arrays(ends, batch.column("cand_gid").take(pa.array(right))),
                        pa.ListArray.from_arrays(ends, single),
                    ],
                    [*schema.names],
                )

            held, size = [], 0
            for part in scored():
                held.append(part)
                size += len(part[0])
                if size >= PAIRS_PER_BATCH:
                    yield lists(held)
                    held, size = [], 0
            if held:
                yield lists(held)

    schema = T.StructType(
        [
            T.StructField("first", T.LongType()),
            T.StructField("query_id", lefts.schema["query_id"].dataType),
            T.StructField("range", T.LongType()),
            T.StructField("cands", T.ArrayType(rights.schema["cand_gid"].dataType)),
            T.StructField("scores", T.ArrayType(T.FloatType())),
        ]
    )
    return block_rows(lefts, rights, partitions=_tasks(n_rows), then=["no"]).mapInArrow(run, schema)


def _sorted(group: np.ndarray, cands: pa.Array, is_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs by group and candidate, nulls first, whether each of them is in its group's rows that are no pairs)."""
    order = _order_of(cands)
    low, high = int(order.min()), int(order.max())
    if (int(group[-1]) + 1) * (high - low + 2) >= 1 << 62:
        order = np.unique(order, return_inverse=True)[1]
        low, high = 0, int(order.max())
    place = order - low + 1
    if cands.null_count:
        place[np.asarray(cands.is_null())] = 0
    key = group * (high - low + 2) + place
    pairs, true = key[is_pair], np.unique(key[~is_pair])
    bits = len(pairs).bit_length()
    if len(pairs) and int(pairs.max()) < 1 << (62 - bits):
        # place and key in one word, which sorts much faster
        by = np.sort((pairs << bits) | np.arange(len(pairs))) & ((1 << bits) - 1)
    else:
        by = np.argsort(pairs, kind="stable")
    ordered = pairs[by]
    if not len(true):
        return np.flatnonzero(is_pair)[by], np.zeros(len(by), dtype=bool)
    at = np.minimum(np.searchsorted(true, ordered), len(true) - 1)
    return np.flatnonzero(is_pair)[by], true[at] == ordered


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where another query or range begins."""
    fresh = np.zeros(batch.num_rows, dtype=bool)
    fresh[:1] = True
    for name in _RANGE:
        values = batch.column(name).to_numpy(zero_copy_only=False)
        fresh[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(fresh)


def _written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: lists by query and range, true candidates first, become labelled pairs in order with their place."""
    last, met = None, 0

    def written(part: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal last, met
        sizes = part.column("cands").value_lengths().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(part.num_rows), sizes)
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, part.num_rows)))[rows]
        cands, scores = part.column("cands").flatten(), part.column("scores").flatten()
        is_pair = part.column("is_pair").to_numpy(zero_copy_only=False).astype(bool)[rows]
        if not is_pair.any():
            return
        by, true = _sorted(group, cands, is_pair)
        rows = rows[by]
        first = part.column("first").to_numpy(zero_copy_only=False)[rows]
        at = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        place = np.arange(len(first)) - np.repeat(at, np.diff(np.append(at, len(first))))
        if first[0] == last:
            place[: at[1] if len(at) > 1 else None] += met
        last, met = first[-1], int(place[-1]) + 1
        n, labels = first + place, np.where(true, POSITIVE, NEGATIVE)
        for begin in range(0, len(by), PAIRS_PER_BATCH):
            few = slice(begin, begin + PAIRS_PER_BATCH)
            to = pa.array(by[few])
            yield pa.RecordBatch.from_arrays(
                [part.column("query_id").take(pa.array(rows[few])), cands.take(to), pa.array(labels[few]), scores.take(to), pa.array(n[few])],
                ["query_id", "cand_id", "label", "score", "n"],
            )

    def whole(held: pa.RecordBatch, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Some ranges at a time."""
        sizes = held.column("cands").value_lengths().to_numpy(zero_copy_only=False)
        slot = np.cumsum(np.add.reduceat(sizes.astype(np.int64), begin)) // PAIRS_AT_ONCE
        cuts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        for at, to in zip(cuts, np.append(cuts[1:], len(begin)), strict=True):
            until = begin[to] if to < len(begin) else held.num_rows
            yield from written(held.slice(begin[at], until - begin[at]), begin[at:to] - begin[at])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if rest is None else pa.concat_batches([rest, batch])
        begin = _starts(held)
        # the last range may go on in the next batch
        if len(begin) > 1:
            yield from whole(held.slice(0, begin[-1]), begin[:-1])
        rest = pa.concat_batches([held.slice(begin[-1])])
    if rest is not None:
        yield from whole(rest, np.array([0]))


def placed_pairs(
    index: DataFrame, queries: DataFrame, truth: DataFrame, layout: BandLayout, scorer: BlockScorer,
    pairs_per_task: int = PAIRS_PER_TASK, least_per_task: int = LEAST_PER_TASK, range_bits: int = RANGE_BITS,
) -> tuple[DataFrame, int]:
    """(query_id, cand_id, label, score, n) of every pair of rows that share a band, and how many of them a task has.

    Both sides are (gid, sig, vec), ``truth`` is (query_id, truth_id).  ``n`` numbers the pairs from 0 by query_id and cand_id.
    Tasks hold stretches of pairs that follow each other, and each has its pairs in order.  A label is positive if the pair is in
    ``truth``.  Scores are 32-bit floats.  Shuffled are vectors for every band and piece, and pairs as lists without
    the query; a task holds the lists of one query id and of ``1 << range_bits`` rows of the index.
    """
    spark = index.sparkSession
    rights = number_rows(index.select(F.col("gid").alias("cand_gid"), "sig", "vec"), ["cand_gid"], "no")
    # rows that repeat an id share its number
    numbers = number_rows(queries.select(F.col("gid").alias("_id")).distinct(), ["_id"], "no")
    numbered = cut_lineage(
        queries.select(F.col("gid").alias("query_id"), "sig", "vec")
        .join(numbers, F.col("query_id").eqNullSafe(F.col("_id")))
        .drop("_id")
    )
    n_rows = (rights.count() + numbered.count()) * layout.bands
    met = count_in_blocks(
        band_rows(numbered.select(F.col("no").alias("query_gid"), "sig"), layout),
        band_rows(rights.select(F.col("no").alias("cand_gid"), "sig", F.lit(1).cast("bigint").alias("copies")), layout),
        layout, n_rows,
    ).groupBy(F.col("query_gid").alias("no")).agg(F.sum("n").alias("n"))
    placed = cut_lineage(
        running_total(met.withColumn("_all", F.lit(0)), ["_all"], ["no"], "n", "first").select("no", "n", "first")
    )
    total = placed.agg(F.max(F.col("first") + F.col("n"))).first()[0] or 0
    aim = -(-total // int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_task = min(pairs_per_task, max(least_per_task, aim))
    asked = numbered.join(placed.select("no", "first"), "no").drop("no")
    lists = _pair_lists(band_rows(asked, layout), band_rows(rights, layout), layout, scorer, n_rows, range_bits)

    of = F.shiftright("no", range_bits).alias("range")
    known = (
        truth.join(asked.select("query_id", "first").distinct(), "query_id")
        .join(rights.select(F.col("cand_gid").alias("truth_id"), "cand_gid", of), "truth_id")
        .select("first", "query_id", "range", "cand_gid")
        .distinct()
        .select("first", "query_id", "range", F.array("cand_gid").alias("cands"), F.array(F.lit(None).cast("float")).alias("scores"))
    )
    rows = lists.withColumn("is_pair", F.lit(True)).unionByName(known.withColumn("is_pair", F.lit(False)))
    task = F.floor(F.col("first") / per_task).cast("int")
    dealt = rows.repartitionById(max(1, -(-total // per_task)), task).sortWithinPartitions(*_RANGE, "is_pair")
    schema = T.StructType(
        [
            lists.schema["query_id"],
            T.StructField("cand_id", rights.schema["cand_gid"].dataType),
            T.StructField("label", T.DoubleType()),
            T.StructField("score", T.FloatType()),
            T.StructField("n", T.LongType()),
        ]
    )
    return dealt.mapInArrow(_written_out, schema), per_task
