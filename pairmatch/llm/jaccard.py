"""Join of documents by the Jaccard similarity of their word n-grams, with signature trees.

1. Documents with the same set are folded into one node, so copies never meet each other.
2. Each set is dealt to its prefix keys: with a threshold of t, two sets that link share at least l of their
   first n - ceil(t n) + l n-grams in any common order.  Frequent n-grams come last in that order.
   A key of a set counts only if a set of similar size has it too, and a set only if it has l such keys.
3. Hubs: a set is compared with those ``HUBS`` that share most of its prefix, of the few sets that stand for one of its
   keys, which joins large groups of near copies by a few links each instead of all pairs.
4. Trees: sets of one key that aren't joined yet go into a tree.  A node holds the OR of the token bitmaps
   below it, their range of sizes and the most n-grams that share bits; pairs of nodes are traversed from the root,
   and a pair is dropped if its highest possible overlap is too small.
5. Keys of up to ``LEAF`` sets give pairs.  Pairs that are left in l such keys or more are bounded by 16 bits of each
   n-gram, then verified on whole sets.
6. Keys of more sets give the sets that are in any pair, not the pairs, which grow with the square of a group.  The key's
   sets meet again as 16 bits of each n-gram, and those left once more as whole sets; then come out as many links as join
   them.  A pair counts in the first such key it has, as far as the ``FIRST`` first keys of its sets tell.
7. Links become components.

A pair that links shares l keys, all of the kind of step 5 or at least one of the kind of step 6.  So only step 3 may miss
links, to save work, and the components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmatch.lineage import cut_lineage
from pairmatch.llm.common import bound_batches, components, id_filter, lists, may_hold, scramble, signed, small_batches, stored, window_hashes, word_hashes

BITS = 1024
_LONGS = BITS // 64
FANOUT, LEAF = 8, 16
FREQUENT = 65_536
PIECE = 20_000
VOLUME = 1 << 21
FIRST = 16
HUBS = 4
_PAIRS_AT_ONCE = 100_000


def shingle_sets(column: pa.Array, length: int) -> list[np.ndarray]:
    """For each text, sorted hashes of its distinct runs of ``length`` words; of all words if there are fewer."""
    words, edges = word_hashes(column)
    runs = window_hashes(words, length)
    out = []
    for start, end in zip(edges, edges[1:], strict=False):
        if end - start >= length:
            found = np.sort(runs[start : end - length + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        else:
            found = window_hashes(words[start:end], end - start) if end > start else words[:0]
        out.append(found)
    return out


def set_id(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes()) - 2**63


def least_shared(n):
    """How many prefix keys two sets share at least if they link, the smaller of which has ``n`` n-grams."""
    return 1 + n // 64


def prefix(members: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """The first n-grams of the set in the common order: frequent ones last, else by hash."""
    n = len(members)
    size = n - (percent * n + 99) // 100 + least_shared(n) if n else 0
    if len(frequent) and n:
        at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        often = frequent[at] == members
        members = np.concatenate([members[~often], members[often]])
    return members[:size]


def bitmap(members: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, np.uint8)
    out[(scramble(members) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


class SignatureTree:
    """Sets in order of size under nodes of ``FANOUT`` children, with leaves of ``LEAF`` sets."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, groups: np.ndarray, slots: np.ndarray, firsts: np.ndarray | None = None):
        one = self.leaves(sizes, bits, groups, slots, firsts)
        self.levels = [one]
        width = LEAF
        while len(one["low"]) > 1:
            starts = np.arange(0, len(one["low"]), width)
            group, slot = one["group"].copy(), one["slot"].copy()
            one = {
                "low": np.minimum.reduceat(one["low"], starts),
                "high": np.maximum.reduceat(one["high"], starts),
                "bits": np.bitwise_or.reduceat(one["bits"], starts, axis=0),
                "surplus": np.maximum.reduceat(one["surplus"], starts),
                "group": _same(group, starts),
                "slot": _same(slot, starts),
                "first": _same(one["first"], starts),
            }
            self.levels.append(one)
            width = FANOUT

    @staticmethod
    def leaves(sizes: np.ndarray, bits: np.ndarray, groups: np.ndarray, slots: np.ndarray, firsts: np.ndarray | None = None) -> dict:
        surplus = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        firsts = np.full(len(sizes), -1) if firsts is None else firsts
        return {"low": sizes, "high": sizes, "bits": bits, "surplus": surplus, "group": groups, "slot": slots, "first": firsts}

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets, by place, that may link, aren't in one group yet and have different slots and firsts or ones below 0.

        The traversal goes down first, with at most ``_PAIRS_AT_ONCE`` pairs of nodes at a time, so what is held
        follows the depth of the tree and not the number of pairs.
        """
        open_pairs = [(len(self.levels) - 1, False, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while open_pairs:
            depth, tested, left, right = open_pairs.pop()
            if not tested:
                keep = able(self.levels[depth], left, right, percent)
                left, right = left[keep], right[keep]
            if not len(left):
                continue
            if depth == 0:
                yield left, right
                continue
            width = LEAF if depth == 1 else FANOUT
            at_once = _PAIRS_AT_ONCE // width**2
            if len(left) > at_once:
                # the rest waits as pairs of nodes, not of children
                open_pairs.append((depth, True, left[at_once:], right[at_once:]))
            below = len(self.levels[depth - 1]["low"])
            open_pairs.append((depth - 1, False, *self._children(left[:at_once], right[:at_once], below, width)))

    @staticmethod
    def _children(left: np.ndarray, right: np.ndarray, below: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.divmod(np.arange(width * width), width)
        a = (left[:, None] * width + one).ravel()
        b = (right[:, None] * width + two).ravel()
        keep = (a <= b) & (b < below) if width != LEAF else (a < b) & (b < below)
        return a[keep], b[keep]


def able(level: dict, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes, or of sets, can hold a pair that links and is wanted."""
    low = np.maximum(level["low"][left], level["low"][right])
    high = np.minimum(level["high"][left], level["high"][right])
    keep = 100 * high >= percent * low
    for mark in (level["group"], level["slot"], level["first"]):
        keep &= (mark[left] != mark[right]) | (mark[left] < 0)
    at = np.flatnonzero(keep)
    a, b = left[at], right[at]
    shared = np.bitwise_count(level["bits"][a] & level["bits"][b]).sum(axis=1, dtype=np.int64)
    most = shared + np.minimum(level["surplus"][a], level["surplus"][b])
    # |a and b| >= percent |a or b| with |a or b| = |a| + |b| - |a and b|, and no more than the smaller size
    wanted = percent * (level["low"][a] + level["low"][b])
    keep[at] = ((100 + percent) * most >= wanted) & (100 * most >= percent * low[at])
    return keep


def _same(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value that a run shares, -1 if it has several."""
    low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
    return np.where(low == high, low, -1)


def _first_pass(length: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"), length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_id(s) for s in sets], pa.int64()),
                 lists([signed(prefix(s, percent, none)) for s in sets], pa.int64())],
                ["doc_id", "n", "sid", "keys"],
            )

    return run


def _second_pass(length: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in small_batches(batches, "text"):
            sets = [s for s in shingle_sets(batch.column("text"), length) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 lists([signed(prefix(s, percent, last)) for s in sets], pa.int64()),
                 pa.array([bitmap(s).tobytes() for s in sets], pa.binary())],
                ["sid", "n", "keys", "bits"],
            )

    return run


def marks(members: np.ndarray) -> np.ndarray:
    """16 bits of each n-gram, sorted: two sets have no more n-grams in common than marks, repeated ones counted."""
    return np.sort((scramble(members) >> np.uint64(48)).astype(np.uint16))


def _whole_sets(length: int, wanted, rough: bool):
    shape = marks if rough else lambda members: members

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            batch = batch.filter(may_hold(wanted.value, batch.column("doc_id")))
            sets = shingle_sets(batch.column("text"), length)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([shape(s).tobytes() for s in sets], pa.binary())],
                ["sid", "members"],
            )

    return run


def _numbered(values: np.ndarray) -> np.ndarray:
    """Sorted marks as different numbers: the mark and how many equal ones come before."""
    at = np.arange(len(values)) - np.searchsorted(values, values)
    return (values.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64)


def _verified(percent: int, rough: bool):
    def read(value: pa.Scalar) -> np.ndarray:
        return _numbered(np.frombuffer(value.as_buffer(), np.uint16)) if rough else np.frombuffer(value.as_buffer(), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = read(one), read(two)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _by_cell(work):
    """Task function: ``work`` gets tables of whole cells, from rows sorted by key and grid cell."""

    def cells(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        key, x, y = (rows.column(c).to_numpy() for c in ("key", "x", "y"))
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        start = np.flatnonzero(fresh)
        yield from work(rows, start, np.diff(np.append(start, len(key))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole cells, and the beginning of the last one
        for batch in batches:
            marks = [np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "x", "y")]
            changes = np.zeros(max(0, batch.num_rows - 1), bool)
            for mark in marks:
                changes |= np.diff(mark) != 0
            last = int(np.flatnonzero(changes)[-1]) + 1 if changes.any() else 0
            if held and batch.num_rows and last == 0:
                here = tuple(int(m[0]) for m in marks)
                if tuple(held[-1].column(c)[-1].as_py() for c in ("key", "x", "y")) != here:
                    yield from cells(held)
                    held = []
            if last:
                yield from cells([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if any(b.num_rows for b in held):
            yield from cells(held)

    return run


def _bits(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, _LONGS)


def _leaf_join(percent: int):
    """Task function: candidate pairs of cells of one leaf each."""

    def work(rows: pa.Table, start: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        sid, sizes, group = (rows.column(c).to_numpy() for c in ("sid", "n", "component"))
        group = np.unique(group, return_inverse=True)[1].astype(np.int64)
        cell = np.repeat(np.arange(len(start)), count)
        level = SignatureTree.leaves(sizes, _bits(rows.column("held")), group, np.full(len(sid), -2))
        lefts, rights = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for apart in range(1, min(LEAF, len(cell))):
            left = np.flatnonzero(cell[:-apart] == cell[apart:])
            left = left[able(level, left, left + apart, percent)]
            lefts.append(left)
            rights.append(left + apart)
        left, right = np.concatenate(lefts), np.concatenate(rights)
        a, b = sid[left], sid[right]
        wanted = least_shared(np.minimum(sizes[left], sizes[right]))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(wanted)], ["a", "b", "wanted"])

    return _by_cell(work)


class Members:
    """The sets of a cell as numbers from 0, to count what a set shares with many others."""

    def __init__(self, sets: list[np.ndarray]):
        self.edges = np.cumsum([0, *(len(s) for s in sets)])
        values = np.concatenate(sets)
        different = np.unique(values)
        self.numbers = np.searchsorted(different, values).astype(np.int32)
        self.mask = np.zeros(len(different), bool)

    def __getitem__(self, at: int) -> np.ndarray:
        return self.numbers[self.edges[at] : self.edges[at + 1]]

    def linked(self, one: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of the other sets are similar enough to one; no set is empty."""
        self.mask[self[one]] = True
        sizes = self.edges[others + 1] - self.edges[others]
        both = np.add.reduceat(self.mask[np.concatenate([self[i] for i in others])], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.mask[self[one]] = False
        return 100 * both >= percent * (len(self[one]) + sizes - both)


def _padded_firsts(column: pa.ChunkedArray) -> np.ndarray:
    """A row of ``FIRST`` ascending keys for each set, filled up with the highest number."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    counts = column.value_lengths().to_numpy()
    out = np.full((len(column), FIRST), np.iinfo(np.int64).max)
    out[np.arange(FIRST) < counts[:, None]] = column.flatten().to_numpy()
    return out


def met_before(firsts: np.ndarray, key: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs have a key below this one among the first keys of both sets."""
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), 1 << 13):
        part = slice(at, at + (1 << 13))
        one, two = firsts[left[part]], firsts[right[part]]
        out[part] = ((one[:, :, None] == two[:, None, :]) & (one < key)[:, :, None]).any(axis=(1, 2))
    return out


def _runs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each left place with its right places."""
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    edges = [0, *(np.flatnonzero(left[1:] != left[:-1]) + 1).tolist(), len(left)] if len(left) else []
    for start, end in zip(edges, edges[1:], strict=False):
        yield int(left[start]), right[start:end]


def _tree_join(percent: int, shape: str):
    """Task function: rows of cells that are in a candidate pair, by what is held of the sets: their bits, or their marks.

    Of whole sets, pairs that link, as many as join what the links of a cell join.
    """

    def whole(tree: SignatureTree, members: Members, sid: np.ndarray, label: np.ndarray, before) -> Iterator[tuple[int, int]]:
        label = label.copy()
        for left, right in tree.pairs(percent):
            keep = label[left] != label[right]
            left, right = left[keep], right[keep]
            keep = ~before(left, right)
            for one, others in _runs(left[keep], right[keep]):
                others = others[label[others] != label[one]]
                others = others[members.linked(one, others, percent)] if len(others) else others
                for other in others:
                    if label[other] != label[one]:
                        yield min(sid[one], sid[other]), max(sid[one], sid[other])
                        label[label == label[other]] = label[one]
            if (label == label[0]).all():
                return

    def in_pairs(tree: SignatureTree, members: Members | None, count: int, before) -> np.ndarray:
        taken = np.zeros(count, bool)
        for left, right in tree.pairs(percent):
            keep = ~(taken[left] & taken[right])
            left, right = left[keep], right[keep]
            keep = ~before(left, right)
            left, right = left[keep], right[keep]
            if members is None:
                taken[left] = taken[right] = True
            else:
                for one, others in _runs(left, right):
                    others = others[~taken[others]] if taken[one] else others
                    others = others[members.linked(one, others, percent)] if len(others) else others
                    taken[others] = True
                    taken[one] |= len(others) > 0
            if taken.all():
                break
        return taken

    def read(value: bytes) -> np.ndarray:
        return _numbered(np.frombuffer(value, np.uint16)) if shape == "marks" else np.frombuffer(value, np.uint64)

    def work(rows: pa.Table, start: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, x, y, slot, sid, sizes, group = (rows.column(c).to_numpy() for c in _CELL)
        # marks: below 0 for what is mixed or doesn't matter
        slot = np.where(x == y, -2, slot).astype(np.int64)
        group = np.unique(group, return_inverse=True)[1].astype(np.int64)
        firsts = _padded_firsts(rows.column("first"))
        first = np.where(firsts[:, 0] < key, np.unique(firsts[:, 0], return_inverse=True)[1], -1).astype(np.int64)
        for at, many in zip(start.tolist(), count.tolist(), strict=True):
            own = at + np.lexsort((sid[at : at + many], sizes[at : at + many]))
            held, members = rows.column("held").slice(at, many), None
            if shape == "bits":
                bits = _bits(held)[own - at]
            else:
                sets = [read(v) for v in held.take(own - at).to_pylist()]
                bits = np.array([bitmap(s) for s in sets])
                members = Members(sets)
            tree = SignatureTree(sizes[own], bits, group[own], slot[own], first[own])

            def before(left: np.ndarray, right: np.ndarray, own=own, key=key[at]) -> np.ndarray:
                return met_before(firsts, key, own[left], own[right])

            if shape == "whole":
                links = np.array(list(whole(tree, members, sid[own], group[own], before)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])
            else:
                kept = np.sort(own[in_pairs(tree, members, many, before)])
                yield from rows.select([*_CELL, "first"]).take(kept).to_batches()

    return _by_cell(work)


_CELL = ["key", "x", "y", "slot", "sid", "n", "component"]
_ROWS = "key bigint, x int, y int, slot int, sid bigint, n bigint, component bigint, first array<bigint>"


def _frequent_keys(sets: DataFrame) -> np.ndarray:
    """Keys of the most sets: all above a count that at most ``FREQUENT`` keys reach.

    They only set the order of n-grams, which decides how much work there is and not what is found.
    """
    counts = cut_lineage(
        sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 3")
    )
    # one row for each power of two
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("keys")).collect()
    least, total = 64, 0
    for level, keys in sorted(((r["level"], r["keys"]) for r in levels), reverse=True):
        total += keys
        if total > FREQUENT:
            break
        least = level
    rows = counts.where(F.col("n") >= F.lit(2.0**least)).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def shared_keys(dealt: DataFrame, percent: int) -> DataFrame:
    """Of rows (sid, n, key), those that may belong to a link, with how many keys are left of the set; all that do are among them.

    Sets that link have sizes in one band or in neighbouring ones.  A key has a mask of its bands modulo 64; with more
    rows than bits, two sets are in one band.  What is left of a set must be as many keys as its smallest partner
    shares with it.
    """
    # a little wider than the ratio of sizes, so that rounding puts no band between two sets that link
    width = float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1e-9
    banded = dealt.withColumn("band", F.pmod(F.floor(F.log("n") / F.lit(width)), F.lit(64)).cast("int"))
    several = (
        banded.groupBy("key")
        .agg(F.count(F.lit(1)).alias("rows"), F.bit_or(F.expr("shiftleft(1L, band)")).alias("bands"))
        .where("rows > 1")
    )
    beside = [F.getbit("bands", F.pmod(F.col("band") + step, F.lit(64))) == 1 for step in (1, 63)]
    return (
        banded.join(several, "key")
        .where((F.col("rows") > F.bit_count("bands")) | beside[0] | beside[1])
        .withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("sid")))
        .where(F.col("left") > F.floor(F.col("n") * percent / 6400))
        .select("key", "sid", "n", "left")
    )


def jaccard_links(documents: DataFrame, percent: int = 90, length: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents' sets, links between sets).

    Sets: rows (doc_id, n, sid), one per row of ``documents``; rows with the same n-grams share ``sid``.
    Links: rows (a, b) of set ids whose similarity is at least ``percent`` hundredths: all links that the
    components need, between different sets only.  Empty sets link with nothing.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    first = cut_lineage(
        texts.mapInArrow(_first_pass(length, percent), "doc_id bigint, n bigint, sid bigint, keys array<bigint>")
    )
    frequent = spark.sparkContext.broadcast(_frequent_keys(first))
    sets = stored(
        texts.mapInArrow(_second_pass(length, percent, frequent), "sid bigint, n bigint, keys array<bigint>, bits binary")
        .dropDuplicates(["sid"])
    )
    holders = first.groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    # most keys belong to one set only, or to sets that meet by chance; from here on there are just the others
    dealt = stored(shared_keys(sets.select("sid", "n", F.explode("keys").alias("key")), percent))

    def held(sids: DataFrame, rough: bool) -> DataFrame:
        """Rows (sid, members) of the sets asked for, and of some others."""
        wanted = id_filter(sids.distinct().join(holders, "sid"), "doc_id")
        return texts.mapInArrow(_whole_sets(length, wanted, rough), "sid bigint, members binary").dropDuplicates(["sid"])

    def compared(pairs: DataFrame, rough: bool) -> DataFrame:
        pairs = cut_lineage(pairs)
        whole = held(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")), rough)
        return (
            pairs.join(whole.select(F.col("sid").alias("a"), F.col("members").alias("one")), "a")
            .join(whole.select(F.col("sid").alias("b"), F.col("members").alias("two")), "b")
            .select("a", "b", "one", "two")
            .mapInArrow(_verified(percent, rough), "a bigint, b bigint")
        )

    def verify(pairs: DataFrame) -> DataFrame:
        # a set is shuffled for each of its pairs: as marks first, whole for what they leave
        return compared(compared(pairs, rough=True), rough=False)

    # hubs: of the sets that stand for a key and size, the nearest that share three quarters of the prefix
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)) if percent < 100 else 1e-9))
    banded = dealt.withColumn("band", band)
    # a set of which most keys are left has the fewest n-grams of its own, so it is nearest to a group's middle
    middle = [F.shiftleft("left", 40) + F.shiftrightunsigned(F.xxhash64(F.lit(k), "sid"), 24) for k in range(HUBS - 2)]
    picks = [F.min("sid"), F.max("sid"), *[F.max_by("sid", m) for m in middle]]
    hubs = (
        banded.groupBy("key", "band")
        .agg(F.array_distinct(F.array(*picks)).alias("hubs"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select("key", "band", F.explode("hubs").alias("hub"))
    )
    best = Window.partitionBy("sid").orderBy(F.desc("shared"), "hub")
    near = (
        banded.join(hubs, ["key", "band"])
        .where("sid <> hub")
        .groupBy("hub", "sid", "n")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(4 * F.col("shared") >= 3 * (F.col("n") - F.ceil(F.col("n") * percent / 100) + F.floor(F.col("n") / 64) + 1))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= HUBS)
        .select(F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b"))
        .distinct()
    )
    joined = cut_lineage(verify(near))
    known = components(joined)

    # trees: keys whose sets aren't all joined
    # both uses have the same filter, so they share a shuffle
    labelled = dealt.where("key is not null and sid is not null").join(known, dealt.sid == known.id, "left").select(
        "key", "sid", "n", F.coalesce("component", "sid").alias("component")
    )
    open_keys = (
        labelled.groupBy("key")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"),
             F.min("n").alias("least"), F.max("n").alias("most"))
        .where("low < high").where((F.col("rows") > 2) | (100 * F.col("least") >= percent * F.col("most")))
        .select("key", "rows", F.ceil(F.col("rows") / PIECE).cast("int").alias("pieces"))
    )
    open_rows = labelled.join(open_keys, "key")

    def by_cell(rows: DataFrame, sketch: DataFrame) -> DataFrame:
        return (
            rows.join(sketch.toDF("sid", "held"), "sid")
            .repartition("key", "x", "y")
            .sortWithinPartitions("key", "x", "y")
            .select(*rows.columns, "held")
        )

    none = F.lit(0)
    few = open_rows.where(F.col("rows") <= LEAF).select("key", none.alias("x"), none.alias("y"), none.alias("slot"), "sid", "n", "component")
    candidates = (
        by_cell(few, sets.select("sid", "bits"))
        .mapInArrow(_leaf_join(percent), "a bigint, b bigint, wanted bigint")
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"), F.min("wanted").alias("wanted"))
        .where("shared >= wanted")
        .select("a", "b")
    )
    many = cut_lineage(open_rows.where(F.col("rows") > LEAF))
    firsts = many.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST).alias("first"))

    def gridded(rows: DataFrame) -> DataFrame:
        """A key of several pieces becomes a grid: each cell holds two pieces, or one against itself."""
        return (
            rows.withColumn("slot", F.pmod(F.xxhash64("sid"), F.col("pieces")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .withColumns({"x": F.least("slot", "other"), "y": F.greatest("slot", "other")})
            .select(*_CELL, "first")
        )

    rows = by_cell(gridded(many.join(firsts, "sid")), sets.select("sid", "bits"))
    rows = cut_lineage(rows.mapInArrow(_tree_join(percent, "bits"), _ROWS)).dropDuplicates(["key", "sid"])
    # sets are larger than bits, so what is left of a key is cut into pieces by its n-grams
    pieces = rows.groupBy("key").agg(F.ceil(F.sum("n") / VOLUME).cast("int").alias("pieces"))
    rows = by_cell(gridded(rows.join(pieces, "key")), held(rows.select("sid"), rough=True))
    rows = cut_lineage(rows.mapInArrow(_tree_join(percent, "marks"), _ROWS))
    within = by_cell(rows, held(rows.select("sid"), rough=False)).mapInArrow(_tree_join(percent, "whole"), "a bigint, b bigint")
    return first.select("doc_id", "n", "sid"), joined.union(verify(candidates)).union(within)


def jaccard_components(documents: DataFrame, percent: int = 90, length: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``documents`` (doc_id, text).

    Words are what stands between ASCII white space, with A-Z in lower case.  A text with fewer than
    ``length`` words has its whole sequence as its only n-gram.  Null and empty texts have the empty
    set, link with nothing and are their own component.  component_id is the smallest doc_id of the
    component; rows without doc_id have the one of the others, or null if there is none.  Repeated rows and
    texts that share a doc_id are nodes each.  Other columns are ignored.

    Sets and n-grams are told apart by 64-bit hashes.
    """
    sets, links = jaccard_links(documents, percent, length)
    links = cut_lineage(links)
    known = components(links).withColumnRenamed("id", "sid")
    nodes = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(known, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "component").select("sid", "component_id")
    return sets.join(named, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
