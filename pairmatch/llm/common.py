"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.lineage import cut_lineage, scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores behind those that a table already has in any case."""
    held = {name.lower() for name in taken}
    out = []
    for name in names:
        while name in held:
            name += "_"
        held.add(name)
        out.append(name)
    return out


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From here on the session hands texts to Python in Arrow batches of about ``most`` bytes, one row at least.

    The usual bound is 10,000 rows or 64 MB, which a task holds several times over: in the JVM, in
    Python and while buffers grow.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def stored(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into a Parquet table in the session's shared checkpoint folder and reads it back."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_FILTER_BITS = 25
_FOLDED = (1 << _FILTER_BITS) - 1


def id_filter(ids: DataFrame, column: str):
    """Broadcast of a bitmap of 4 MB, whatever the number of ids, that ``may_hold`` looks ids up in.

    It keeps most of the texts nobody asks for from being shuffled to an exact join, which has to
    follow: with tens of millions of ids it lets all texts pass.
    """
    spot = F.col(column).bitwiseXOR(F.shiftrightunsigned(column, _FILTER_BITS)).bitwiseAND(F.lit(_FOLDED).cast("bigint"))
    words = (
        ids.where(F.col(column).isNotNull())
        .select(F.shiftright(spot, 6).alias("word"), F.expr("1L").alias("one"), spot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .select("word", F.expr("shiftleft(one, bit)").alias("mask"))
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .collect()
    )
    bitmap = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    for row in words:
        bitmap[row.word] = row.mask
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def may_hold(bitmap: np.ndarray, ids: pa.Array) -> pa.Array:
    """Which ids may be in the filter; null ids always may."""
    values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).view(np.uint64)
    spot = (values ^ (values >> np.uint64(_FILTER_BITS))) & np.uint64(_FOLDED)
    found = (bitmap.view(np.uint64)[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1)
    return pc.or_(pa.array(found.astype(bool)), pc.is_null(ids))


_PIECE = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
# a random value for each byte, the same for A-Z as for a-z
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_VALUES[0x41:0x5B] = _VALUES[0x61:0x7B]


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; a null text has none."""
    return text.encode().lower().split() if text else []


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def scramble(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * _MIX[0]
        values = (values ^ (values >> np.uint64(27))) * _MIX[1]
        return values ^ (values >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(count: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, as many as asked for so far."""
    if len(_powers[0]) < count:
        size = max(count, 2 * len(_powers[0]))
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` neighbouring words; empty if there are fewer."""
    count = len(words) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    powers, inverses = _power_tables(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers[: len(words)], out=sums[1:])
        return scramble((sums[length:] - sums[:-length]) * inverses[:count] + np.uint64(length))


def _hashed(data: np.ndarray, rows: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in some text, and where they begin and end; no word crosses the positions ``rows``."""
    solid = ~spaces[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    before[rows] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = solid
    after[rows] = False
    begins = np.flatnonzero(solid & ~before[:-1])
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    powers, inverses = _power_tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * powers[: len(data)], out=sums[1:])
        return scramble((sums[ends] - sums[begins]) * inverses[begins] + (ends - begins).astype(np.uint64)), begins, ends


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a column, and where each text begins and the last ends; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def word_hashes(column: pa.Array, spaces: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a column, and the edges of each text's words among them.

    Words are what stands between ASCII white space, with A-Z in lower case; a null text has none.
    ``spaces`` marks the bytes that part words.
    """
    data, offsets = text_bytes(column)
    hashes, begins, _ = placed_words(data, offsets, spaces)
    return hashes, np.searchsorted(begins, offsets)


def placed_words(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, and where in ``data`` they begin and end; it is hashed in pieces of about a megabyte, cut between words."""
    start, end = int(offsets[0]), int(offsets[-1])
    hashes, begins, ends = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while start < end:
        stop = min(end, start + _PIECE)
        while stop < end:  # up to the next white space or text
            gap = np.flatnonzero(spaces[data[stop : stop + 4096]])
            row = offsets[np.searchsorted(offsets, stop)]
            stop = min(int(row), stop + (int(gap[0]) if len(gap) else 4096), end)
            if len(gap) or stop == row:
                break
        rows = offsets[np.searchsorted(offsets, start) : np.searchsorted(offsets, stop, "right")] - start
        found, at, last = _hashed(data[start:stop], rows, spaces)
        hashes.append(found)
        begins.append(at + start)
        ends.append(last + start)
        start = stop
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return np.ascontiguousarray(values).view(np.int64)


def lists(values: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one array per row."""
    ends = np.cumsum([0, *(len(v) for v in values)])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def small_batches(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` has about ``most`` bytes of text in each, one row at least."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def components(links: DataFrame) -> DataFrame:
    """Smallest id that each linked id reaches: rows (id, component) for the ids in ``links`` (a, b).

    Alternating star contraction: every round hangs the neighbours of an id on the smallest of
    them, first the larger ones, then the smaller ones, until nothing changes; the rounds grow
    with the logarithm of the longest chain.  Minima are combined before the shuffle and the
    joins are on ids, so adaptive execution can split a hub with many links.  Null ids and
    links from an id to itself are ignored.
    """
    edges = cut_lineage(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v"), F.col("m")).where("v <> m").union(low.select("u", "m"))
        edges = cut_lineage(small.toDF("u", "v").distinct())
        # the same edges again: each id hangs on one smaller id, and no such id hangs on another
        state = edges.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(1), "u"))
        ).first()
        if state == before or state[0] == 0:
            break
        before = state
    tops = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        tops.select("id", F.col("id").alias("component"))
    )
