"""Buckets searched block against block and reduced on the spot: counts, best candidates and ranks without a table of pairs.

There are as many pairs as candidates, which grow with the square of the rows in a bucket.  Here they only
exist as tiles of at most ``CELLS_AT_ONCE`` cells inside a task, and what leaves it has a few rows for each left row.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.functions.arrow import to_matrix
from pairmatch.functions.bands import BandLayout
from pairmatch.functions.vectors import squared_l2
from pairmatch.operators.blocks import ROWS_PER_BLOCK, block_rows, pairs_of_blocks, runs, squared_cells, squared_distances, whole_blocks

CELLS_AT_ONCE = 1 << 19
# blocks with at most so many pairs are listed together, larger ones are compared as matrices
PAIRS_OF_SMALL_BLOCK = 1 << 10
PAIRS_SCORED_AT_ONCE = 1 << 15
ROWS_PER_TASK, MOST_TASKS = 2_000, 2_000
TARGETS_PER_ROW = 64


class RowScorer(ABC):
    """A score of two vectors that can be had row by row."""

    @abstractmethod
    def rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The score of every row of ``a`` with the same row of ``b``; NaN stands for none."""

    @property
    def rows_at_once(self) -> int:
        """How many rows ``rows`` gets at most."""
        return PAIRS_SCORED_AT_ONCE

    @abstractmethod
    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Adds ``score`` to pairs with query_vec and cand_vec."""


class BlockScorer(RowScorer):
    """A score of two vectors that can be had row by row and, near enough, for a whole tile."""

    @abstractmethod
    def tile(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        """The ``places`` of all rows of ``a`` with all of ``b``, and how far off they may be."""

    @abstractmethod
    def places(self, scores: np.ndarray) -> np.ndarray:
        """Finite numbers that rise as scores fall, equal for equal scores."""

    def cells(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What ``rows`` gives for all rows of ``a`` with all of ``b``."""
        found, step = np.empty((len(a), len(b))), max(1, PAIRS_SCORED_AT_ONCE // max(1, len(b)))
        for at in range(0, len(a), step):
            few = a[at : at + step]
            scores = self.rows(np.repeat(few, len(b), axis=0), np.tile(b, (len(few), 1)))
            found[at : at + step] = np.reshape(scores, (len(few), len(b)))
        return found

    @property
    def works_on_tiles(self) -> bool:
        """Whether ``rows`` and ``tile`` can be had; otherwise the scorer is for tables of pairs only."""
        return True


def _squared_tile(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """All squared distances by one matrix product, and a bound of the rounding."""
    one, two = (a * a).sum(axis=1), (b * b).sum(axis=1)
    apart = a @ (-2.0 * b.T)
    apart += one[:, None]
    apart += two
    largest = max(np.nan_to_num(one, nan=0.0, posinf=np.inf).max(initial=0.0), np.nan_to_num(two, nan=0.0, posinf=np.inf).max(initial=0.0))
    return apart, 1e-12 + 1e-14 * (a.shape[1] + 8) * largest


class Distance(BlockScorer):
    """The negative squared distance."""

    def rows(self, a, b):
        return -squared_distances(a, b)

    def cells(self, a, b):
        return -squared_cells(a, b)

    def tile(self, a, b):
        return _squared_tile(a, b)

    def places(self, scores):
        return -scores

    def __call__(self, pairs):
        return pairs.withColumn("score", -squared_l2(F.col("query_vec"), F.col("cand_vec")))


class Closeness(BlockScorer):
    """exp(-|a - b|^2)."""

    # beyond it exp loses digits, until all scores are 0
    _far = 700.0

    def rows(self, a, b):
        return np.exp(-squared_distances(a, b))

    def cells(self, a, b):
        return np.exp(-squared_cells(a, b))

    def tile(self, a, b):
        apart, slack = _squared_tile(a, b)
        return np.minimum(apart, self._far, out=apart), slack

    def places(self, scores):
        with np.errstate(divide="ignore"):
            return np.minimum(-np.log(scores), self._far)

    def __call__(self, pairs):
        return pairs.withColumn("score", F.exp(-squared_l2(F.col("query_vec"), F.col("cand_vec"))))


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows as float64, NaN for null vectors."""
    present_rows, present = to_matrix(column)
    if present.all():
        return present_rows
    rows = np.full((len(present), present_rows.shape[1]), np.nan)
    rows[present] = present_rows
    return rows


def _order_of(column: pa.Array) -> np.ndarray:
    """Integers in the order of the values; nulls get any."""
    if pa.types.is_integer(column.type):
        return column.fill_null(0).to_numpy(zero_copy_only=False)
    filled = np.array([v if v is not None else "" for v in column.to_pylist()], dtype=object)
    return np.unique(filled, return_inverse=True)[1]


class _Blocks:
    """Whole blocks of one batch."""

    def __init__(self, batch: pa.RecordBatch, layout: BandLayout):
        self.batch, self.layout = batch, layout
        self.begin = runs(batch)
        self.end = np.append(self.begin[1:], batch.num_rows)
        is_right = batch.column("_right").to_numpy(zero_copy_only=False).astype(bool)
        self.middle = self.end - np.add.reduceat(is_right.astype(np.int64), self.begin)
        self.band = batch.column("band").to_numpy(zero_copy_only=False)
        self.words = batch.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        self._parts: dict[int, list[np.ndarray]] = {}

    def listed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(left rows, right rows): the pairs of small blocks that share their first band there."""
        small = (self.middle - self.begin) * (self.end - self.middle) <= PAIRS_OF_SMALL_BLOCK
        for left, right in pairs_of_blocks(self.batch, self.begin, small):
            fresh = self.layout.first_shared(self.words[left], self.words[right]) == self.band[left]
            if fresh.any():
                yield left[fresh], right[fresh]

    def tiles(self) -> Iterator[tuple[slice, slice]]:
        """(left rows, right rows) of the large blocks: some left rows with all right rows of the block."""
        for begin, middle, end in zip(self.begin.tolist(), self.middle.tolist(), self.end.tolist(), strict=True):
            if (middle - begin) * (end - middle) > PAIRS_OF_SMALL_BLOCK:
                step = max(1, CELLS_AT_ONCE // (end - middle))
                for at in range(begin, middle, step):
                    yield slice(at, min(at + step, middle)), slice(middle, end)

    def _part(self, band: int) -> list[np.ndarray]:
        """The bits of a band, as small as they fit."""
        if band not in self._parts:
            found = []
            for word, shift, size in self.layout.places(band):
                bits = (self.words[:, word] >> np.int64(shift)) & np.int64((1 << size) - 1)
                found.append(bits.astype(np.min_scalar_type((1 << size) - 1)))
            self._parts[band] = found
        return self._parts[band]

    def fresh(self, left: slice, right: slice) -> np.ndarray | None:
        """Which pairs of a tile share their first band there; None if all do."""
        band = int(self.band[left.start])

        def same(b: int) -> np.ndarray:
            equal = None
            for part in self._part(b):
                here = part[left, None] == part[None, right]
                equal = here if equal is None else equal & here
            return equal

        seen = None
        for b in range(band):
            seen = same(b) if seen is None else np.logical_or(seen, same(b), out=seen)
        fresh = None if seen is None else np.logical_not(seen, out=seen)
        if len(self._part(band)) > 1:
            # a key of several words is a hash of them
            own = same(band)
            fresh = own if fresh is None else fresh & own
        return fresh


def _scores(scorer: RowScorer, vectors: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores of listed pairs, some at a time."""
    found = np.empty(len(left))
    for at in range(0, len(left), scorer.rows_at_once):
        to = at + scorer.rows_at_once
        found[at:to] = scorer.rows(vectors[left[at:to]], vectors[right[at:to]])
    return found


def _first_of_each(group: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the ``k`` best of their group: highest score, no score last, then by ``order``."""
    by = np.lexsort((order, np.where(np.isnan(score), np.inf, -score), group))
    sorted_group = group[by]
    fresh = np.ones(len(by), dtype=bool)
    fresh[1:] = sorted_group[1:] != sorted_group[:-1]
    begin = np.flatnonzero(fresh)
    place = np.arange(len(by)) - begin[np.cumsum(fresh) - 1]
    return by[place < k]


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def _tasks(n_rows: int) -> int:
    return min(MOST_TASKS, max(1, n_rows // ROWS_PER_TASK))


def count_in_blocks(
    lefts: DataFrame, rights: DataFrame, layout: BandLayout, n_rows: int, rows_per_split: int = ROWS_PER_BLOCK
) -> DataFrame:
    """(query_gid, n): the copies that a left row meets, a row for each block in which it meets some.

    Both sides are rows of bands with sig, the left one with query_gid, the right one with cand_gid and copies.
    ``n_rows`` is about how many there are.  Each pair counts once, in the first band it shares.
    """
    lefts = lefts.select("band", "key", "sig", "query_gid")
    rights = rights.select("band", "key", "sig", "cand_gid", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_blocks(batches):
            blocks = _Blocks(batch, layout)
            copies = batch.column("copies").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for left, right in blocks.listed():
                np.add.at(total, left, copies[right])
            for left, right in blocks.tiles():
                fresh = blocks.fresh(left, right)
                total[left] += copies[right].sum() if fresh is None else _weighed(fresh, copies[right])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_gid").take(pa.array(some)), pa.array(total[some])], ["query_gid", "n"]
            )

    schema = T.StructType([T.StructField("query_gid", lefts.schema["query_gid"].dataType), T.StructField("n", T.LongType())])
    return block_rows(lefts, rights, rows_per_split, _tasks(n_rows)).mapInArrow(run, schema)


def _weighed(chosen: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Copies of the chosen cells, by row."""
    if (copies == 1).all():
        return np.count_nonzero(chosen, axis=1)
    # rows of a side are far fewer than 2^53, copies too
    total = np.zeros(len(chosen), dtype=np.int64)
    for weight in np.unique(copies):
        total += weight * np.count_nonzero(chosen[:, copies == weight], axis=1)
    return total


def best_in_blocks(
    lefts: DataFrame,
    rights: DataFrame,
    layout: BandLayout,
    scorer: RowScorer,
    k: int,
    n_rows: int,
    rows_per_split: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """(query_gid, cand_gid, copies, score): what may be among the ``k`` best candidates of a left row, at most ``k`` of each block.

    Both sides are rows of bands with sig and vec.  A tile is compared by places that are near enough to tell which pairs can't be
    among the best; the others get their score row by row, as do all pairs if the scorer is for rows only.  Best is the highest score, then the smallest cand_gid; no score comes last.
    """
    lefts = lefts.select("band", "key", "sig", "query_gid", "vec")
    rights = rights.select("band", "key", "sig", "cand_gid", "vec", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_blocks(batches):
            blocks = _Blocks(batch, layout)
            vectors = _vectors(batch.column("vec"))
            order = _order_of(batch.column("cand_gid"))

            def best(left, right, score):
                kept = _first_of_each(left, score, order[right], k)
                to_left, to_right = pa.array(left[kept]), pa.array(right[kept])
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column("query_gid").take(to_left),
                        batch.column("cand_gid").take(to_right),
                        batch.column("copies").take(to_right),
                        _nullable(score[kept]),
                    ],
                    ["query_gid", "cand_gid", "copies", "score"],
                )

            for left, right in blocks.listed():
                yield best(left, right, _scores(scorer, vectors, left, right))
            for left, right in blocks.tiles():
                if not isinstance(scorer, BlockScorer):
                    fresh = blocks.fresh(left, right)
                    shape = (left.stop - left.start, right.stop - right.start)
                    rows, columns = np.nonzero(np.ones(shape, dtype=bool) if fresh is None else fresh)
                    score = _scores(scorer, vectors, rows + left.start, columns + right.start)
                    if shape[1] > k:
                        apart = np.full(shape, np.inf)
                        apart[rows, columns] = np.where(np.isnan(score), np.inf, -score)
                        near = apart[rows, columns] <= np.partition(apart, k - 1, axis=1)[rows, k - 1]
                        rows, columns, score = rows[near], columns[near], score[near]
                    if len(rows):
                        yield best(rows + left.start, columns + right.start, score)
                    continue
                apart, slack = scorer.tile(vectors[left], vectors[right])
                np.copyto(apart, np.inf, where=np.isnan(apart))
                fresh = blocks.fresh(left, right)
                if fresh is not None:
                    np.copyto(apart, np.inf, where=~fresh)
                if apart.shape[1] > k:
                    limit = np.partition(apart, k - 1, axis=1)[:, k - 1] + 2 * slack
                    kept = apart <= limit[:, None]
                else:
                    kept = np.ones(apart.shape, dtype=bool)
                if fresh is not None:
                    kept &= fresh
                rows, columns = np.nonzero(kept)
                if len(rows):
                    rows, columns = rows + left.start, columns + right.start
                    yield best(rows, columns, _scores(scorer, vectors, rows, columns))

    schema = T.StructType(
        [
            T.StructField("query_gid", lefts.schema["query_gid"].dataType),
            T.StructField("cand_gid", rights.schema["cand_gid"].dataType),
            T.StructField("copies", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return block_rows(lefts, rights, rows_per_split, _tasks(n_rows)).mapInArrow(run, schema)


def _is_ahead(score, order, target_score, target_order):
    """Whether scores come before those of targets."""
    none, target_none = np.isnan(score), np.isnan(target_score)
    tied = (none & target_none) | (score == target_score)
    return (~none & target_none) | (score > target_score) | (tied & (order < target_order))


def ahead_in_blocks(
    lefts: DataFrame,
    rights: DataFrame,
    layout: BandLayout,
    scorer: BlockScorer,
    n_rows: int,
    rows_per_split: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """(query_gid, tid, ahead): copies that come before a target, a row for each block that has some.

    Sides as for ``best_in_blocks``; a left row also has its targets, at most ``TARGETS_PER_ROW`` (tid, gid, score), or null.
    Before a target come higher scores and equal ones with a smaller cand_gid.  Left rows that meet any candidate in a
    block also give a row without tid.
    """
    lefts = lefts.select("band", "key", "sig", "query_gid", "vec", "targets")
    rights = rights.select("band", "key", "sig", "cand_gid", "vec", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_blocks(batches):
            blocks = _Blocks(batch, layout)
            vectors = _vectors(batch.column("vec"))
            copies = batch.column("copies").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("targets")
            held = lists.flatten()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(sizes) - sizes
            tid, gid, score = (held.field(i) for i in range(3))
            target = score.to_numpy(zero_copy_only=False).astype(np.float64)
            place = scorer.places(target)
            place[np.isnan(target)] = np.inf
            orders = _order_of(pa.concat_arrays([batch.column("cand_gid"), gid]))
            order, target_order = orders[: batch.num_rows], orders[batch.num_rows :]
            some = np.zeros(batch.num_rows, dtype=bool)
            ahead = np.zeros(len(held), dtype=np.int64)

            def settle(left, right, which):
                """Listed pairs against one target each."""
                found = _scores(scorer, vectors, left, right)
                before = _is_ahead(found, order[right], target[which], target_order[which])
                np.add.at(ahead, which[before], copies[right[before]])

            for left, right in blocks.listed():
                some[left] = True
                for nth in range(int(sizes[left].max())):
                    has = sizes[left] > nth
                    settle(left[has], right[has], first[left[has]] + nth)
            for left, right in blocks.tiles():
                fresh = blocks.fresh(left, right)
                some[left] |= True if fresh is None else fresh.any(axis=1)
                asked = np.arange(left.start, left.stop)
                with_targets = (sizes[left] > 0) & some[left]
                if not with_targets.any():
                    continue
                asked = asked[with_targets]
                apart, slack = scorer.tile(vectors[asked], vectors[right])
                np.copyto(apart, np.inf, where=np.isnan(apart))
                if fresh is not None:
                    fresh = fresh[with_targets]
                for nth in range(int(sizes[asked].max())):
                    has = np.flatnonzero(sizes[asked] > nth)
                    which = first[asked[has]] + nth
                    cells = apart if len(has) == len(asked) else apart[has]
                    inside = None if fresh is None else fresh[has]
                    sure = cells < (place[which] - slack)[:, None]
                    unsure = ~sure & (cells <= (place[which] + slack)[:, None])
                    if inside is not None:
                        sure &= inside
                        unsure &= inside
                    ahead[which] += _weighed(sure, copies[right])
                    rows, columns = np.nonzero(unsure)
                    settle(asked[has[rows]], columns + right.start, which[rows])
            met, before = np.flatnonzero(some), np.flatnonzero(ahead)
            owner = np.repeat(np.arange(batch.num_rows), sizes)[before]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("query_gid").take(pa.array(np.concatenate([met, owner]))),
                    pa.concat_arrays([pa.nulls(len(met), pa.int64()), tid.take(pa.array(before)).cast(pa.int64())]),
                    pa.array(np.concatenate([np.zeros(len(met), dtype=np.int64), ahead[before]])),
                ],
                ["query_gid", "tid", "ahead"],
            )

    schema = T.StructType(
        [
            T.StructField("query_gid", lefts.schema["query_gid"].dataType),
            T.StructField("tid", T.LongType()),
            T.StructField("ahead", T.LongType()),
        ]
    )
    return block_rows(lefts, rights, rows_per_split, _tasks(n_rows)).mapInArrow(run, schema)


def score_rows(pairs: DataFrame, scorer: BlockScorer) -> DataFrame:
    """Adds ``score`` to pairs with query_vec and cand_vec, which are dropped."""
    kept = [c for c in pairs.columns if c not in ("query_vec", "cand_vec")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_vectors(batch.column(c)) for c in ("query_vec", "cand_vec"))
                found = np.asarray(scorer.rows(a, b), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], _nullable(found)], [*kept, "score"])

    schema = T.StructType([*[pairs.schema[c] for c in kept], T.StructField("score", T.DoubleType())])
    return pairs.mapInArrow(run, schema)


def listed_in_blocks(
    lefts: DataFrame, rights: DataFrame, layout: BandLayout, n_rows: int, rows_per_split: int = ROWS_PER_BLOCK
) -> DataFrame:
    """(query_gid, cand_gid, copies, query_vec, cand_vec): every pair once with its vectors, streamed and never shuffled.

    For scorers that want a table of pairs.  Pairs of a left row come together.
    """
    types = [df.schema["vec"].dataType for df in (lefts, rights)]
    lefts = lefts.select("band", "key", "sig", "query_gid", F.col("vec").alias("query_vec"))
    rights = rights.select("band", "key", "sig", "cand_gid", F.col("vec").alias("cand_vec"), "copies")
    at_once = 4_096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_blocks(batches):
            blocks = _Blocks(batch, layout)

            def pieces():
                yield from blocks.listed()
                for left, right in blocks.tiles():
                    fresh = blocks.fresh(left, right)
                    shape = (left.stop - left.start, right.stop - right.start)
                    rows, columns = np.nonzero(np.ones(shape, dtype=bool) if fresh is None else fresh)
                    yield rows + left.start, columns + right.start

            for left, right in pieces():
                for at in range(0, len(left), at_once):
                    to_left, to_right = pa.array(left[at : at + at_once]), pa.array(right[at : at + at_once])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("query_gid").take(to_left),
                            batch.column("cand_gid").take(to_right),
                            batch.column("copies").take(to_right),
                            batch.column("query_vec").take(to_left),
                            batch.column("cand_vec").take(to_right),
                        ],
                        ["query_gid", "cand_gid", "copies", "query_vec", "cand_vec"],
                    )

    schema = T.StructType(
        [
            T.StructField("query_gid", lefts.schema["query_gid"].dataType),
            T.StructField("cand_gid", rights.schema["cand_gid"].dataType),
            T.StructField("copies", T.LongType()),
            T.StructField("query_vec", types[0]),
            T.StructField("cand_vec", types[1]),
        ]
    )
    return block_rows(lefts, rights, rows_per_split, _tasks(n_rows)).mapInArrow(run, schema)


def best_in_task(scored: DataFrame, k: int, held_rows: int = 200_000) -> DataFrame:
    """The same columns (query_gid, cand_gid, copies, score): rows that may be among the ``k`` best of their query.

    Every task drops rows that ``k`` others of the same query in it come before, holding about ``held_rows`` at a time.
    """
    columns = ["query_gid", "cand_gid", "copies", "score"]

    def best(table: pa.Table) -> pa.Table:
        score = table.column("score").to_numpy().astype(np.float64)
        group, order = (_order_of(table.column(c).combine_chunks()) for c in columns[:2])
        return table.take(pa.array(np.sort(_first_of_each(group, score, order, k))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            few = best(pa.Table.from_batches([batch]))
            held = few if held is None else pa.concat_tables([held, few])
            if held.num_rows > held_rows:
                held = best(held)
                if held.num_rows > held_rows // 2:
                    yield from held.to_batches()
                    held = None
        if held is not None:
            yield from best(held).to_batches()

    return scored.select(columns).mapInArrow(run, scored.select(columns).schema)
