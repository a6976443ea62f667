"""Stretches of words that repeat with a period, found by longest common extensions.

Extensions of two places are told by a difference cover: places whose number modulo ``MODULUS`` is in ``COVER`` are
samples, and any two places reach a pair of samples after the same few words.  Only the suffixes at samples
are sorted; the common words of neighbours in that order go into a sparse table, so that an extension is a
comparison of fewer than ``MODULUS`` words and one range minimum.

Runs are enumerated on harmonic grids: a run of period q and at least ``times`` q words holds two places q words apart
whose first one is a multiple of (times - 1) q.  For every period such pairs are extended to both sides, on n/q
places for the period q and so on n log n places in all.

All texts of an Arrow batch are one sequence, with a mark of its own before, between and behind them, which
no extension crosses.  Words are compared by number and not by hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.llm.common import bound_batches, small_batches

# fixed values: every number below the modulus is a difference of two of these in just one way
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])

_PLACES = 1 << 20


def _shifts() -> np.ndarray:
    """For each pair of remainders, how many words on both are in the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    ahead = np.array([inside[r : r + MODULUS] for r in range(MODULUS)])
    return (ahead[:, None, :] & ahead[None, :, :]).argmax(axis=2)


_SHIFT = _shifts()
_NTH = np.cumsum(np.isin(np.arange(MODULUS), COVER)) - 1


class Extensions:
    """How many words two places of a sequence have in common from there on.

    Numbers in the sequence are not negative; between two places that are compared there is one that occurs only once.
    """

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate([words, np.full(MODULUS, words.max(initial=0) + 1)])
        blocks = np.arange(-(-len(words) // MODULUS)) * MODULUS
        self.samples = (blocks[:, None] + COVER).ravel()
        self.samples = self.samples[self.samples < len(words)]
        ranks = [self._first_ranks()]
        step = len(COVER)
        while len(ranks[0]) and ranks[-1].max() < len(self.samples) - 1:
            ranks.append(self._doubled(ranks[-1], step))
            step *= 2
        self.rank = ranks[-1]
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(self.rank))
        self.table = [self._common(ranks, order[:-1], order[1:]).astype(np.int32)]
        width = 1
        while 2 * width <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _first_ranks(self) -> np.ndarray:
        """Ranks of the samples by their first MODULUS words, several of which are packed into one number."""
        bits = int(self.words.max()).bit_length()
        packed = max(1, 63 // max(1, bits))

        def column(start: int) -> np.ndarray:
            key = np.zeros(len(self.samples), np.int64)
            for i in range(start, min(start + packed, MODULUS)):
                key = (key << bits) | self.words[self.samples + i]
            return key

        order = np.arange(len(self.samples))
        for start in reversed(range(0, MODULUS, packed)):
            order = order[np.argsort(column(start)[order], kind="stable")]
        differs = np.zeros(len(order), bool)
        for start in range(0, MODULUS, packed):
            key = column(start)[order]
            differs[1:] |= key[1:] != key[:-1]
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.cumsum(differs)
        return ranks

    @staticmethod
    def _doubled(ranks: np.ndarray, step: int) -> np.ndarray:
        """Ranks by twice as many words; the sample that many words on is ``step`` samples on."""
        after = np.zeros(len(ranks), np.int64)
        after[:-step] = ranks[step:] + 1
        return np.unique(ranks * (len(ranks) + 1) + after, return_inverse=True)[1]

    def _common(self, ranks: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Common words of the suffixes at two samples, by the ranks of ever shorter beginnings, the rest word by word."""
        one, two = one.copy(), two.copy()
        found = np.zeros(len(one), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            step = len(COVER) << level
            at = np.flatnonzero((one < len(self.rank)) & (two < len(self.rank)))
            at = at[ranks[level][one[at]] == ranks[level][two[at]]]
            one[at] += step
            two[at] += step
            found[at] += MODULUS << level
        at = np.flatnonzero((one < len(self.rank)) & (two < len(self.rank)))
        one, two = self.samples[one[at]], self.samples[two[at]]
        for i in range(MODULUS):
            same = self.words[one + i] == self.words[two + i]
            at, one, two = at[same], one[same], two[same]
            found[at] += 1
        return found

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Common words from each of ``one`` and ``two``, which are different places."""
        found = np.zeros(len(one), np.int64)
        shift = _SHIFT[one % MODULUS, two % MODULUS]
        at = np.arange(len(one))
        synchronised = []
        for i in range(MODULUS):
            here = shift[at] == i
            synchronised.append(at[here])
            at = at[~here]
            at = at[self.words[one[at] + i] == self.words[two[at] + i]]
            found[at] += 1
        at = np.concatenate(synchronised)
        a, b = (self.rank[self._sample(side[at] + shift[at])] for side in (one, two))
        low, high = np.minimum(a, b), np.maximum(a, b)
        depth = np.frexp(high - low)[1] - 1
        for level in np.unique(depth):
            own = depth == level
            table = self.table[level]
            found[at[own]] += np.minimum(table[low[own]], table[high[own] - (1 << int(level))])
        return found

    @staticmethod
    def _sample(places: np.ndarray) -> np.ndarray:
        return places // MODULUS * len(COVER) + _NTH[places % MODULUS]


def find_runs(texts: list[np.ndarray], times: int, shortest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text, given as numbers of words, the runs by start and period: (start, length, period)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    words = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    parts = []
    for i, text in enumerate(texts):
        parts += [np.array([words + i]), text]
    parts.append(np.array([words + len(texts)]))
    joined = np.concatenate(parts).astype(np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    # every text with every period that fits into it
    most = sizes // times
    text = np.repeat(np.arange(len(texts)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    stride = (times - 1) * period
    places = -(-(sizes[text] - period) // stride)
    edges = np.concatenate([[0], np.cumsum(places)])
    found = [np.empty((0, 3), np.int64)]
    forward = backward = None
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + _PLACES, "right")) - 1)
        own = np.repeat(np.arange(low, high), places[low:high])
        nth = np.arange(len(own)) + edges[low] - edges[own]
        one = begins[text[own]] + nth * stride[own]
        two = one + period[own]
        at = np.flatnonzero(joined[one] == joined[two])
        own, one, two = own[at], one[at], two[at]
        low = high
        if not len(one):
            continue
        if forward is None:
            forward, backward = Extensions(joined), Extensions(joined[::-1].copy())
        start = one - backward(len(joined) - one, len(joined) - two)
        end = two + forward(one, two)
        keep = end - start >= np.maximum(shortest, times * period[own])
        start, end, own = start[keep], end[keep], own[keep]
        found.append(_smallest(np.stack([start, end, period[own]], axis=1)))
    start, end, period = _smallest(np.concatenate(found)).T
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    cut = np.searchsorted(start, np.append(begins, len(joined)))
    return [
        (start[a:b] - begin, end[a:b] - start[a:b], period[a:b]) for begin, a, b in zip(begins, cut, cut[1:], strict=False)
    ]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period) with the same words the one with the smallest period, which divides the others."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[fresh]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(times: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            split = [(text or "").encode().split() for text in batch.column("text").to_pylist()]
            coded = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in split]
            found = find_runs(coded, times, shortest)
            collapsed = []
            for words, (start, length, period) in zip(split, found, strict=True):
                if len(start):
                    marks = np.zeros(len(words) + 1, np.int64)
                    np.add.at(marks, start + period, 1)
                    np.add.at(marks, start + length, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]
                collapsed.append(b" ".join(words).decode())
            columns = [np.concatenate([f[i] for f in found]) for i in range(3)]
            edges = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32))
            rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(w) for w in split], pa.int64()),
                 pa.ListArray.from_arrays(edges, rows), pa.array(collapsed, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(documents: DataFrame, times: int = 4, shortest: int = 6) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed), one for each of ``documents`` (doc_id, text).

    Words are what stands between ASCII white space.  A run is a stretch of words that repeats with a smallest period of q
    words, has at least ``times`` q words and ``shortest``, and that no neighbour extends with the same period.
    ``runs`` has the number of its first word, its length and its period, by start and period.  ``collapsed`` are the words
    that no run holds after its first period, joined by spaces.

    A null or empty text has no words, no runs and an empty ``collapsed``.  Rows that repeat, or share a doc_id, or
    have none, give a row each; other columns are ignored.  A row's text is held whole, several times over, by its task.
    """
    if times < 2:
        raise ValueError("times must be at least 2")
    bound_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(
        _runs(times, shortest),
        "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string",
    )


def periodic_tails(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with a tail that repeats in about every tenth text, by the CRC-32 of its doc_id.

    With h that number, g = h // 10 and n words, the words from a = g % n on are the next
    1 + (n - a) // (3 + g % 8) words over and over, if h % 10 is 0.  Words of such texts are joined by spaces; texts
    without words or doc_id stay as they are.
    """
    n = F.size("words").cast("bigint")
    tailed = (
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
        .withColumn("g", F.expr("h div 10"))
        .withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
        .withColumn("a", F.when(n > 0, F.col("g") % n))
        .withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    )
    said = F.concat(
        F.slice("words", 1, F.col("a").cast("int")),
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), n - F.col("a") - 1),
            lambda i: F.element_at("words", (F.col("a") + i % F.col("p") + 1).cast("int")),
        ),
    )
    return tailed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(said, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, the run with the greatest exponent, hashes of all runs and of the collapsed words) of ``periodic_runs``."""

    def longer(best: Column, run: Column) -> Column:
        # runs come by start and period, so that the first of equal ones stays
        return F.when(best.isNull() | (run.length * best.period > best.length * run.period), run).otherwise(best)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    line = lambda r: F.concat_ws("", F.concat_ws(",", *(r[f].cast("string") for f in ("start", "length", "period"))), F.lit("\n"))
    return found.withColumn("best", F.aggregate("runs", none, longer)).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The digests of texts with periodic tails.  Pairs of equal words at every distance form stretches, which are the runs.
ORACLE = r"""
with recursive bits(b, c, i) as (
    select b, b, 0 from range(256) r(b)
    union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from bits where i < 8
), steps as (
    select list(c order by b) as step from bits where i = 8
), h as (
    select rowid as id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
           xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
               lambda x, y: xor(x >> 8, step[(xor(x, y) & 255) + 1])), 4294967295) as h
    from (select row_number() over () as rowid, doc_id, text from documents), steps
), g as (
    select *, len(w)::bigint as n, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from h
), p as (
    select *, 1 + (n - a) // (3 + g % 8) as p from g
), t as (
    select id, doc_id, n, case when a is null then w
           else w[1:a] || list_transform(range(0, n - a), lambda i: w[a + i % p + 1]) end as w from p
), o as (
    select id, n, unnest(w) as word, unnest(range(0, n)) as i from t
), pairs as (
    select x.id, x.i, y.i - x.i as p, row_number() over (partition by x.id, y.i - x.i order by x.i) as k
    from o x join o y on x.id = y.id and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 4
), found as (
    select id, min(i) as s, max(i) + p + 1 as e, p from pairs group by id, p, i - k
    having max(i) + p + 1 - min(i) >= greatest(6, 4 * p)
), runs as (
    select id, s, e - s as l, min(p) as p from found group by id, s, e
), digest as (
    select id, count(*) as n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' order by s, p) as said from runs group by id
), best as (
    select * from runs r qualify row_number() over (partition by id order by l * 1000000000000::hugeint // p desc, s, p) = 1
), kept as (
    select id, string_agg(word, ' ' order by i) as said from o
    where not exists (select 1 from runs r where r.id = o.id and o.i >= r.s + r.p and o.i < r.s + r.l) group by id
)
select t.doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.s as start, b.l as length, b.p as period, 1000 * b.l // b.p as exponent_milli,
       sha256(coalesce(d.said, '')) as runs_sha256, sha256(coalesce(k.said, '')) as collapsed_sha256
from t left join digest d using (id) left join best b using (id) left join kept k using (id)
"""
