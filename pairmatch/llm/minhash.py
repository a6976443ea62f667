"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's sketch are its ``RETAINED`` n-grams with the least hashes, all of them if it has no more.
   Documents with the same set are folded into one node, so copies never meet each other.
2. Of two sets that link, the sketches share a number of values that depends on their size: all that are needed
   if the union is no larger than a sketch, else a quantile of the hypergeometric distribution that is missed
   with a probability below ``MISSED``.  Inverted lists are therefore made of the values that come first in a
   common order, rare ones before frequent ones, and as many as it takes to meet in one list.
3. In each list sets are paired with one hub, the set of similar size with the fewest rare values: in a group of
   near copies that is the text they were made from.  Each set meets the two hubs it shares most with first, so
   that a large group is joined by a link each.
4. Lists with the same least set are merged, as those of a group of near copies have mostly the same members.  In what
   still holds several components, pairs are kept whose overlap can be large enough by bitmaps of the sketches and
   of the whole sets; a long list is cut into a grid of pieces.
5. The union sketch of a pair, the least values of both sketches together, estimates its similarity.  Pairs below the
   quantile are dropped, all others are verified on whole sets, and links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.lineage import cut_lineage
from pairmatch.llm.common import bound_batches, components, id_filter, may_hold, scramble, signed, small_batches, stored
from pairmatch.llm.jaccard import set_id, shingle_sets

RETAINED = 96
MISSED = 1e-15
FREQUENT = 65_536
PIECE = 8_192
_SKETCH_BITS, _SET_BITS = 512, 1024
_PAIRS_AT_ONCE = 200_000
_HELD = 1 << 21
_LARGE = 4_096


@cache
def least_overlaps(percent: int) -> np.ndarray:
    """For a union of u n-grams the fewest of its ``RETAINED`` least ones that a linked pair has in both sets."""
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 4 * _LARGE)))])
    out = np.zeros(4 * _LARGE, np.int64)
    for union in range(1, len(out)):
        shared = -(-percent * union // 100)
        if union <= RETAINED:
            out[union] = shared
            continue
        # chances of x shared values: of all ways to choose those retained, x are from the intersection
        x = np.arange(max(0, RETAINED - (union - shared)), min(RETAINED, shared) + 1)
        ways = logs[shared] - logs[x] - logs[shared - x]
        ways += logs[union - shared] - logs[RETAINED - x] - logs[union - shared - RETAINED + x]
        chance = np.exp(ways - logs[union] + logs[RETAINED] + logs[union - RETAINED])
        out[union] = x[np.searchsorted(np.cumsum(chance), MISSED, "right")]
    return out


@cache
def _needed(percent: int) -> np.ndarray:
    """By the size of a set, the fewest retained values it shares with any set it links with; the last entry is for all larger ones."""
    by_union = least_overlaps(percent)
    sizes = np.arange(_LARGE + 1)
    most = np.minimum(100 * sizes // percent, len(by_union) - 1)
    out = np.array([by_union[n : m + 1].min() for n, m in zip(sizes, most, strict=True)])
    # with replacement the spread is largest; that bounds all unions beyond the table
    share = percent / 100
    chance, x = (1 - share) ** RETAINED, 0
    total = chance
    while total <= MISSED:
        chance *= (RETAINED - x) / (x + 1) * share / (1 - share)
        total += chance
        x += 1
    out[-1] = min(x, out.min(where=sizes > RETAINED, initial=RETAINED))
    return out


def needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    return _needed(percent)[np.minimum(sizes, _LARGE)]


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, np.uint8)
    out[(scramble(values) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out)


def _sketches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"), length)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()),
                 pa.array([s[:RETAINED].tobytes() for s in sets], pa.binary()),
                 pa.array([bitmap(s, _SET_BITS).tobytes() for s in sets], pa.binary())],
                ["doc_id", "n", "sid", "sketch", "bits"],
            )

    return run


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of sketches, and how many each row has."""
    held = [np.frombuffer(v.as_buffer(), np.uint64) for v in column]
    return np.concatenate(held) if held else np.empty(0, np.uint64), np.array([len(h) for h in held], np.int64)


def _common_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: values that the task sees more than once, and how often."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        values, count = np.unique(np.concatenate(held), return_counts=True)
        often = count > 1
        return pa.RecordBatch.from_arrays([pa.array(signed(values[often])), pa.array(count[often])], ["key", "n"])

    for batch in batches:
        values, _ = _values(batch.column("sketch"))
        held.append(values)
        size += len(values)
        if size >= _HELD:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def _postings(percent: int, frequent):
    """Task function: the values under which each set is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = frequent.value
        for batch in batches:
            values, count = _values(batch.column("sketch"))
            sizes = batch.column("n").to_numpy()
            order = np.zeros(len(values), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, values), len(often) - 1)
                order = np.where(often[at] == values, rank[at], 0)
            row = np.repeat(np.arange(len(count)), count)
            by = np.lexsort((values, order, row))
            values, order = values[by], order[by]
            place = np.arange(len(values)) - np.repeat(np.cumsum(count) - count, count)
            at = np.flatnonzero(place <= np.repeat(count - needed(sizes, percent), count))
            row = row[at]
            rare = np.bincount(row, weights=order[at] == 0, minlength=len(count)).astype(np.int32)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(values[at])), batch.column("sid").take(row), batch.column("n").take(row), pa.array(rare).take(row)],
                ["key", "sid", "n", "rare"],
            )

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the sketch and, after it, of the whole set."""
    for batch in batches:
        sketches = [bitmap(np.frombuffer(v.as_buffer(), np.uint64), _SKETCH_BITS).tobytes() for v in batch.column("sketch")]
        both = [one + whole for one, whole in zip(sketches, batch.column("bits").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(both, pa.binary())], ["sid", "bits"])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of the upper halves of the hashes, in the same order; equal halves can only raise an estimate."""
    for batch in batches:
        values, count = _values(batch.column("sketch"))
        halves = (values >> np.uint64(32)).astype(np.uint32)
        cut = np.split(halves, np.cumsum(count)[:-1]) if len(count) else []
        yield pa.RecordBatch.from_arrays(
            [batch.column("sid"), batch.column("n"), pa.array([c.tobytes() for c in cut], pa.binary())], ["sid", "n", "half"]
        )


def _estimated(percent: int):
    """Task function: pairs whose union sketch doesn't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in ("n", "m")]
            wanted = np.maximum(needed(sizes[0], percent), needed(sizes[1], percent))
            keep = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            for i in np.flatnonzero(keep):
                one, two = (np.frombuffer(batch.column(c)[int(i)].as_buffer(), np.uint32) for c in ("one", "two"))
                both = np.sort(np.concatenate([one, two]), kind="stable")
                again = both[1:] == both[:-1]
                # the last value of the union sketch; a value in both sketches stands there twice
                union = np.cumsum(np.concatenate([[True], ~again]))
                last = np.searchsorted(union, RETAINED, "right")
                keep[i] = np.count_nonzero(again[: max(0, last - 1)]) >= wanted[i]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _whole(length: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            batch = batch.filter(may_hold(wanted.value, batch.column("doc_id")))
            sets = shingle_sets(batch.column("text"), length)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sid", "members"]
            )

    return run


def _similar(percent: int):
    """Task function: pairs that link by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("one", "two"))
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep[i] = 100 * shared >= percent * (len(one) + len(two) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _most_shared(bits: np.ndarray, surplus: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[one] & bits[two]).sum(axis=1, dtype=np.int64) + np.minimum(surplus[one], surplus[two])


_CELL = ["key", "x", "y", "slot", "sid", "n", "component", "bits"]


def _listed(percent: int):
    """Task function: rows sorted by list and piece; pairs of a cell that are not joined yet and may share enough values."""

    def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        key, x, y, slot, sid, sizes, component = (rows.column(c).to_numpy() for c in _CELL[:-1])
        cell = np.zeros(len(key), np.int64)
        cell[1:] = np.cumsum((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        order = np.lexsort((sid, sizes, cell))
        cell, slot, sid, sizes, component = (v[order] for v in (cell, np.where(x == y, -1, slot), sid, sizes, component))
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(order), -1)[order]
        # for sketches and for sets: bits, and values beyond those that the bits stand for
        maps = [(part, size - np.bitwise_count(part).sum(axis=1, dtype=np.int64))
                for part, size in zip(np.split(bits, [_SKETCH_BITS // 64], axis=1), (np.minimum(sizes, RETAINED), sizes), strict=True)]
        wanted = needed(sizes, percent)
        # inside a cell sets stand by size: each meets those after it that are no larger than allowed
        most = 100 * sizes // percent
        span = np.int64(int(most.max()) + 1)
        until = np.searchsorted(cell * span + sizes, cell * span + most, "right")
        edges = np.concatenate([[0], np.cumsum(until - np.arange(len(cell)) - 1)])
        low = 0
        while low < len(cell):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + _PAIRS_AT_ONCE, "right")) - 1)
            one = np.repeat(np.arange(low, high), np.diff(edges[low : high + 1]))
            two = one + 1 + np.arange(len(one)) + edges[low] - edges[one]
            keep = (component[one] != component[two]) & ((slot[one] != slot[two]) | (slot[one] < 0)) & (sid[one] != sid[two])
            one, two = one[keep], two[keep]
            shared = _most_shared(*maps[0], one, two)
            keep = shared >= np.maximum(wanted[one], wanted[two])
            one, two = one[keep], two[keep]
            keep = (100 + percent) * _most_shared(*maps[1], one, two) >= percent * (sizes[one] + sizes[two])
            a, b = sid[one[keep]], sid[two[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole cells, and the beginning of the last one
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y")])
            if held and [held[-1].column(c)[-1].as_py() for c in ("key", "x", "y")] != marks[:, 0].tolist():
                yield from pairs(held)
                held = []
            changes = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))
            if len(changes):
                yield from pairs([*held, batch.slice(0, int(changes[-1]) + 1)])
                held = [batch.slice(int(changes[-1]) + 1)]
            else:
                held.append(batch)
        if held:
            yield from pairs(held)

    return run


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent values, ``FREQUENT`` at most, sorted, and how often each was counted.

    They only set the order in which values are listed, which decides how much work there is and not what is found.
    """
    counts = cut_lineage(
        sets.mapInArrow(_common_values, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 8")
    )
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("keys")).collect()  # 63 rows at most
    least, total = 63, 0
    for level, keys in sorted(((r["level"], r["keys"]) for r in levels), reverse=True):
        total += keys
        if total > FREQUENT:
            break
        least = level
    rows = counts.where(F.col("n") >= F.lit(2.0**least)).select("key", "n").collect()
    keys = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["n"] for r in rows], np.int64)[order]


def near_duplicate_links(documents: DataFrame, percent: int = 85, length: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents' sets, links between sets).

    Sets: rows (doc_id, n, sid), one per row of ``documents``; rows with the same n-grams share ``sid``.
    Links: rows (a, b) of set ids whose similarity is at least ``percent`` hundredths: all links that the
    components need, between different sets only.  Empty sets link with nothing.
    """
    if not 0 < percent < 100:
        raise ValueError("percent must be from 1 to 99")
    spark = documents.sparkSession
    bound_batches(spark)
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    first = stored(texts.mapInArrow(_sketches(length), "doc_id bigint, n bigint, sid bigint, sketch binary, bits binary"))
    sets = stored(first.where("n > 0").select("sid", "n", "sketch", "bits").dropDuplicates(["sid"]))
    holders = first.groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    frequent = spark.sparkContext.broadcast(_frequent(sets))
    listed = stored(sets.mapInArrow(_postings(percent, frequent), "key bigint, sid bigint, n bigint, rare int"))
    # most values belong to one set only; from here on there are just the others
    several = listed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    listed = stored(listed.join(several, "key").select("key", "sid", "n", "rare"))
    light = sets.mapInArrow(_halves, "sid bigint, n bigint, half binary")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs)
        estimated = cut_lineage(
            pairs.join(light.select(F.col("sid").alias("a"), "n", F.col("half").alias("one")), "a")
            .join(light.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("half").alias("two")), "b")
            .select("a", "b", "n", "m", "one", "two")
            .mapInArrow(_estimated(percent), "a bigint, b bigint")
        )
        sids = estimated.select("a").union(estimated.select("b")).distinct()
        wanted = id_filter(sids.join(holders, F.col("a") == F.col("sid")), "doc_id")
        whole = texts.mapInArrow(_whole(length, wanted), "sid bigint, members binary").dropDuplicates(["sid"])
        links = cut_lineage(
            estimated.join(whole.select(F.col("sid").alias("a"), F.col("members").alias("one")), "a")
            .join(whole.select(F.col("sid").alias("b"), F.col("members").alias("two")), "b")
            .select("a", "b", "one", "two")
            .mapInArrow(_similar(percent), "a bigint, b bigint")
        )
        wanted.unpersist()
        return links

    # hubs: of the sets of similar size in a list, the one with the fewest rare values
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))))
    banded = listed.withColumn("band", band)
    hubs = banded.groupBy("key", "band").agg(F.min(F.struct("rare", "sid")).alias("hub"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    near = (
        banded.join(hubs.select("key", "band", F.col("hub.sid").alias("hub")), ["key", "band"])
        .where("sid <> hub")
        .groupBy("hub", "sid", "n")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where((F.col("shared") > 1) | (F.col("n") < 12))
        .groupBy("sid")
        .agg(F.min("hub").alias("least"), F.max_by("hub", F.struct("shared", "hub")).alias("most"))
        .select(F.col("sid").alias("b"), F.explode(F.array_distinct(F.array("least", "most"))).alias("a"))
        .select("a", "b")
    )
    joined = verify(near)
    known = components(joined)

    # lists, merged by their least set, whose sets aren't all joined
    least = listed.groupBy("key").agg(F.min(F.struct("rare", "sid")).alias("hub"))
    merged = listed.join(least, "key").select(F.col("hub.sid").alias("key"), "sid", "n").distinct()
    labelled = merged.join(known, merged.sid == known.id, "left").select(
        "key", "sid", "n", F.coalesce("component", "sid").alias("component")
    )
    open_lists = (
        labelled.groupBy("key")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"),
             F.min("n").alias("least"), F.max("n").alias("most"))
        .where("low < high").where((F.col("rows") > 2) | (100 * F.col("least") >= percent * F.col("most")))
        .select("key", F.ceil(F.col("rows") / PIECE).cast("int").alias("pieces"))
    )
    # a long list becomes a grid: each cell holds two pieces, or one against itself
    placed = (
        labelled.join(open_lists, "key")
        .withColumn("slot", F.pmod(F.xxhash64("sid"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select("key", F.least("slot", "other").alias("x"), F.greatest("slot", "other").alias("y"), "slot", "sid", "n", "component")
        .join(sets.mapInArrow(_bitmaps, "sid bigint, bits binary"), "sid")
    )
    candidates = (
        placed.repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y")
        .select(*_CELL)
        .mapInArrow(_listed(percent), "a bigint, b bigint")
        .distinct()
    )
    return first.select("doc_id", "n", "sid"), joined.union(verify(candidates))


def near_duplicates(documents: DataFrame, percent: int = 85, length: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents`` (doc_id, text).

    Words are what stands between ASCII white space, with A-Z in lower case.  A text with fewer than ``length``
    words has its whole sequence as its only n-gram.  Null and empty texts have the empty set, link with nothing
    and are their own component.  component_id is the smallest doc_id that links lead to; kept says whether it is the row's
    own.  Rows without doc_id have the component of the others, or null if there is none, and aren't kept.  Repeated rows and
    texts that share a doc_id are nodes each.  Other columns are ignored; an empty table gives no rows.

    Sets and n-grams are told apart by 64-bit hashes.  A link between sets that are larger than a sketch is missed with a
    probability below ``MISSED``, all others never.
    """
    sets, links = near_duplicate_links(documents, percent, length)
    known = components(links).withColumnRenamed("id", "sid")
    nodes = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(known, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    names = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "component").select("sid", "component_id")
    found = sets.join(named, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
