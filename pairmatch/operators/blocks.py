"""Pairs of one bucket, met and measured block against block: vectors travel once per bucket and piece, never per pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.functions.arrow import to_matrix
from pairmatch.functions.bands import BandLayout
from pairmatch.lineage import cut_lineage
from pairmatch.operators.candidates import band_rows
from pairmatch.operators.skew import lay_out_grid

Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]

ROWS_PER_BLOCK = 20_000
PAIRS_AT_ONCE = 1 << 16
ROWS_IN_CACHE, CELLS_IN_CACHE = 1 << 10, 1 << 14
VECTORS_PER_BLOCK = 20_000
PAIRS_PER_PIECE = 1_000_000
_CELL = ["_lb", "_rb", "_piece"]
_PLACE = ["band", "key", "_lslot", "_rslot"]


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the sum of squared differences, added up element after element like ``squared_l2``."""
    if a.shape != b.shape:
        raise ValueError("both sides need vectors of the same length")
    total = np.zeros(len(a))
    # some rows at a time stay in the cache
    for at in range(0, len(a), ROWS_IN_CACHE):
        few = slice(at, at + ROWS_IN_CACHE)
        apart = a[few] - b[few]
        apart *= apart
        for squares in np.ascontiguousarray(apart.T):
            total[few] += squares
    return total


def squared_cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all rows of ``a`` with all of ``b``, to the last digit."""
    columns, step = np.ascontiguousarray(b.T), max(1, CELLS_IN_CACHE // max(1, len(b)))
    total = np.zeros((len(a), len(b)))
    held = np.empty((min(step, len(a)), len(b)))
    for at in range(0, len(a), step):
        few, here = a[at : at + step], total[at : at + step]
        apart = held[: len(few)]
        for x, y in zip(few.T, columns, strict=True):
            np.subtract(x[:, None], y, out=apart)
            np.multiply(apart, apart, out=apart)
            here += apart
    return total


def runs(batch: pa.RecordBatch) -> np.ndarray:
    """Where the blocks of a sorted batch begin."""
    fresh = np.zeros(batch.num_rows, dtype=bool)
    fresh[:1] = True
    for name in _PLACE:
        values = batch.column(name).to_numpy(zero_copy_only=False)
        fresh[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(fresh)


def pairs_of_blocks(
    batch: pa.RecordBatch, begin: np.ndarray, chosen: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left rows, right rows) of all pairs of whole blocks, or of the chosen ones, in slices.

    Left rows come first in a block, and a slice has all pairs of its left rows.
    """
    is_right = batch.column("_right").to_numpy(zero_copy_only=False).astype(bool)
    sizes = np.diff(np.append(begin, batch.num_rows))
    rights = np.add.reduceat(is_right.astype(np.int64), begin)
    left = np.flatnonzero(~is_right)
    block = np.repeat(np.arange(len(begin)), sizes)[left]
    if chosen is not None:
        left, block = left[chosen[block]], block[chosen[block]]
    partners, first = rights[block], (begin + sizes - rights)[block]
    left, first, partners = left[partners > 0], first[partners > 0], partners[partners > 0]
    ends = np.cumsum(partners)
    at = 0
    while at < len(left):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
        n = partners[at:to]
        offset = np.arange(n.sum()) - np.repeat(ends[at:to] - n - done, n)
        yield np.repeat(left[at:to], n), np.repeat(first[at:to], n) + offset
        at = to


def _measured(batch: pa.RecordBatch, layout: BandLayout, measure: Measure) -> Iterator[pa.RecordBatch]:
    words = batch.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    band = batch.column("band").to_numpy(zero_copy_only=False)
    vectors, _ = to_matrix(batch.column("vec"))
    for left, right in pairs_of_blocks(batch, runs(batch)):
        fresh = layout.first_shared(words[left], words[right]) == band[left]
        left, right = left[fresh], right[fresh]
        found = np.asarray(measure(vectors[left], vectors[right]), dtype=np.float64)
        right = pa.array(right)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("query_gid").take(pa.array(left)),
                batch.column("cand_gid").take(right),
                batch.column("copies").take(right),
                pa.array(found, mask=np.isnan(found)),
            ],
            ["query_gid", "cand_gid", "copies", "measure"],
        )


def block_rows(
    lefts: DataFrame,
    rights: DataFrame,
    rows_per_split: int = ROWS_PER_BLOCK,
    partitions: int | None = None,
    then: Sequence[str] = (),
) -> DataFrame:
    """The rows of both sides by bucket and piece, sorted inside every task: a block has its left rows first, ``then`` by columns.

    Both tables have band and key, the left one query_gid and the right one cand_gid.  A bucket with more than
    ``rows_per_split`` rows of a side is cut into a grid of pieces.
    """
    lefts, rights = lay_out_grid(lefts, rights, ["band", "key"], ["query_gid"], ["cand_gid"], rows_per_split)
    return (
        lefts.withColumn("_right", F.lit(False))
        .unionByName(rights.withColumn("_right", F.lit(True)), allowMissingColumns=True)
        .repartition(*([partitions] if partitions else []), *_PLACE)
        .sortWithinPartitions(*_PLACE, "_right", *then)
    )


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the same rows in batches that end where a block ends."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if rest is None else pa.concat_batches([rest, batch])
        # the last block may go on in the next batch
        last = int(runs(held)[-1])
        rest = held.slice(last)
        if last:
            yield pa.concat_batches([held.slice(0, last)])
    if rest is not None:
        yield pa.concat_batches([rest])


def bucket_measures(
    index_sets: DataFrame,
    query_sets: DataFrame,
    layout: BandLayout,
    measure: Measure = squared_distances,
    rows_per_split: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """(query_gid, cand_gid, copies, measure): distinct vectors that share a band, each pair once, and how they compare.

    Both tables are (gid, sig, vec), the index with ``copies``.  Rows are sorted by bucket and piece inside every
    task, so that a task holds one block and one Arrow batch: a bucket with more than ``rows_per_split`` rows of a side is cut into
    a grid of pieces.  What is shuffled is a vector for every band and piece, and no pair.  ``measure`` gets two
    matrices with a pair in every row; a value that isn't a number is null, as is that of a vector with a null element.
    """
    lefts = band_rows(query_sets.select("sig", "vec", F.col("gid").alias("query_gid")), layout)
    rights = band_rows(index_sets.select("sig", "vec", F.col("gid").alias("cand_gid"), "copies"), layout)
    rows = block_rows(lefts, rights, rows_per_split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_blocks(batches):
            yield from _measured(batch, layout, measure)

    schema = T.StructType(
        [
            T.StructField("query_gid", query_sets.schema["gid"].dataType),
            T.StructField("cand_gid", index_sets.schema["gid"].dataType),
            T.StructField("copies", T.LongType()),
            T.StructField("measure", T.DoubleType()),
        ]
    )
    return rows.mapInArrow(run, schema)


def _in_cells(pairs: DataFrame, left: DataFrame, right: DataFrame, vectors_per_block: int, pairs_per_piece: int) -> DataFrame:
    """The rows of all three tables by cell: first the left vectors a cell needs (0), the right ones (1), then its pairs (2)."""
    n_pairs, n_left, n_right = pairs.count(), left.count(), right.count()
    blocks = [max(1, -(-n // vectors_per_block)) for n in (n_left, n_right)]
    pieces = max(1, -(-n_pairs // (blocks[0] * blocks[1] * pairs_per_piece)))

    def dealt(seed, n, *ids):
        return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(n)).cast("int")

    placed = pairs.select(
        dealt(1, blocks[0], "query_id").alias("_lb"),
        dealt(2, blocks[1], "cand_id").alias("_rb"),
        dealt(3, pieces, "query_id", "cand_id").alias("_piece"),
        "query_id",
        "cand_id",
        F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("_pair"),
    )

    def needed(vectors, id_name, kind):
        wanted = placed.select(*_CELL, id_name).distinct()
        return wanted.join(vectors.select(F.col("id").alias(id_name), "vec"), id_name).withColumn("_kind", F.lit(kind))

    return (
        needed(left, "query_id", 0)
        .unionByName(needed(right, "cand_id", 1), allowMissingColumns=True)
        .unionByName(placed.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
        .repartition(*_CELL)
        .sortWithinPartitions(*_CELL, "_kind")
    )


def _join_cells(emit: Callable[[pa.Array, pa.Array], list[pa.Array]], columns: list[str], added: list[str]):
    """Task function: holds the vectors of one cell at a time, and the pairs of one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*_CELL, "_kind"]]
            fresh = np.zeros(batch.num_rows, dtype=bool)
            fresh[:1] = True
            for values in marks:
                fresh[1:] |= values[1:] != values[:-1]
            begin = np.flatnonzero(fresh)
            for at, to in zip(begin, np.append(begin[1:], batch.num_rows), strict=True):
                here, kind = tuple(int(m[at]) for m in marks[:3]), int(marks[3][at])
                if here != cell:
                    cell, held = here, {0: [], 1: []}
                part = batch.slice(at, to - at)
                if kind < 2:
                    held[kind].append((part.column(("query_id", "cand_id")[kind]), part.column("vec")))
                    continue
                if not (held[0] and held[1]):
                    continue
                sides = []
                for k, name in enumerate(("query_id", "cand_id")):
                    if len(held[k]) > 1:
                        held[k] = [tuple(pa.concat_arrays(a) for a in zip(*held[k], strict=True))]
                    ids, vecs = held[k][0]
                    sides.append((pc.index_in(part.column(name), value_set=ids), vecs))
                known = pc.and_(sides[0][0].is_valid(), sides[1][0].is_valid())
                part = part.filter(known)
                a, b = (vecs.take(places.filter(known)) for places, vecs in sides)
                pair = part.column("_pair")
                own = [pair.field(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*own, *emit(a, b)], [*columns, *added])

    return run


def _over_pairs(pairs, left, right, emit, fields, vectors_per_block, pairs_per_piece):
    pairs = cut_lineage(pairs)
    cells = _in_cells(pairs, left, right, vectors_per_block, pairs_per_piece)
    schema = T.StructType([*pairs.schema.fields, *fields])
    return cells.mapInArrow(_join_cells(emit, pairs.columns, [f.name for f in fields]), schema)


def measure_pairs(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    make_measure: Callable[[], Measure],
    name: str = "score",
    vectors_per_block: int = VECTORS_PER_BLOCK,
    pairs_per_piece: int = PAIRS_PER_PIECE,
) -> DataFrame:
    """Adds what a model says of the vectors of each pair; ``left`` and ``right`` are (id, vec), ids being unique.

    Pairs (query_id, cand_id, ...) are dealt to cells of a grid, a block of left against a block of right vectors,
    and a vector goes once to every cell that has a pair for it.  So a pair is shuffled without its vectors; pairs of a
    popular vector are spread over the cells of its row or column, and a cell with very many pairs is cut into
    pieces.  A task holds the vectors of one cell and streams its pairs, repeated ones too.  ``make_measure`` loads the model once
    per task.  Pairs with an id that has no row go, as in an inner join; a null vector or a result that isn't a number gives null.
    """
    loaded = []

    def emit(a: pa.Array, b: pa.Array) -> list[pa.Array]:
        if not loaded:
            loaded.append(make_measure())
        whole = np.asarray(pc.and_(a.is_valid(), b.is_valid()))
        found = np.full(len(a), np.nan)
        if whole.any():
            mask = pa.array(whole)
            found[whole] = loaded[0](to_matrix(a.filter(mask))[0], to_matrix(b.filter(mask))[0])
        return [pa.array(found, mask=np.isnan(found))]

    return _over_pairs(pairs, left, right, emit, [T.StructField(name, T.DoubleType())], vectors_per_block, pairs_per_piece)


def attach_vectors(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    vectors_per_block: int = VECTORS_PER_BLOCK,
    pairs_per_piece: int = PAIRS_PER_PIECE,
) -> DataFrame:
    """Adds ``query_vec`` and ``cand_vec`` in the same way: the rows of ``attach_payload``, no vector shuffled per pair."""
    fields = [
        T.StructField("query_vec", left.schema["vec"].dataType),
        T.StructField("cand_vec", right.schema["vec"].dataType),
    ]
    if fields[0].dataType != fields[1].dataType:
        raise ValueError("both sides need vectors of the same type")
    return _over_pairs(pairs, left, right, lambda a, b: [a, b], fields, vectors_per_block, pairs_per_piece)
