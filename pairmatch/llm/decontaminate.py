"""Benchmark decontamination: every passage is a BM25 query to an inverted index of test items.

The index holds impacts: what a term adds to an item's BM25 score, as a share of the score the item
reaches with all its own terms.  Items are grouped into blocks, and for each term the index has its
highest impact in every block.  A batch of passages is answered with block-max WAND: terms that
can't reach the threshold together don't open a block, a block is passed over if its highest impacts
can't reach it, and only the items of what is left are scored in full.  Every item above the threshold
is retrieved, then verified by the overlap of its question and its answer with the passage, or of its
whole text if it came without fields.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.llm.common import bound_batches, lists, signed, small_batches, window_hashes, word_hashes

K1, B = 1.2, 0.75
BLOCK = 8
_DENSE = 8_000_000
# least share of a whole text's runs of three words: one changed word costs at most three runs, a third of nine
WHOLE = 2 / 3
# words are parted by ASCII white space, punctuation and signs
_SPACES = np.array([b in b" \t\n\r\v\f" or (33 <= b < 127 and not chr(b).isalnum()) for b in range(256)])


def question_and_answer(text: str | None) -> tuple[str, str]:
    """A text without fields: its last line answers, or its last sentence if it is one line."""
    text = (text or "").strip()
    head, line_break, tail = text.rpartition("\n")
    if line_break:
        return head, tail
    sentences = re.split(r"(?<=[.!?])\s+", text)
    return (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, "")


def grams(words: np.ndarray, length: int) -> np.ndarray:
    """Distinct runs of ``length`` words, or the run of all words if there are fewer, as hashes."""
    return np.unique(window_hashes(words, min(length, len(words)))) if len(words) else words


class Impacts:
    """Impacts by (term, column): a dense table if it is small, else sorted keys."""

    def __init__(self, terms: np.ndarray, columns: np.ndarray, values: np.ndarray, n_terms: int, n_columns: int):
        self.n_columns = n_columns
        self.dense = None
        if n_terms * n_columns <= _DENSE:
            self.dense = np.zeros((n_terms, n_columns), np.float64)
            self.dense[terms, columns] = values
        else:
            self.keys, self.values = terms.astype(np.int64) * n_columns + columns, values
            order = np.argsort(self.keys)
            self.keys, self.values = self.keys[order], self.values[order]

    def __call__(self, terms: np.ndarray, columns: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[terms, columns]
        keys = terms.astype(np.int64) * self.n_columns + columns
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions starts[i] .. starts[i] + counts[i] - 1 for each i, and which i each belongs to."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[owner] + inside, owner


class ItemIndex:
    """Block-max inverted index of some items; ``df`` and ``n``, ``mean`` are over all items.

    split: the items are texts without fields, so their two parts are a guess.
    """

    def __init__(
        self, items: list[tuple[int, np.ndarray, np.ndarray]], df: dict[int, int], n: int, mean: float, longest: int = 1,
        split: bool = False,
    ):
        items = sorted(items, key=lambda i: (len(i[1]) + len(i[2]), i[0]))
        self.ids = [i[0] for i in items]
        self.wanted = [((grams(q, 5), min(5, len(q))), (grams(a, 3), min(3, len(a)))) for _, q, a in items]
        texts = [np.concatenate([q, a]) for _, q, a in items] if split else []
        self.whole = [(grams(t, 3), min(3, len(t))) for t in texts]
        self.words = np.unique(np.concatenate([w for _, q, a in items for w in (q, a)]))
        terms, columns, values = [], [], []
        self.longest = longest
        for column, (_, question, answer) in enumerate(items):
            words = np.concatenate([question, answer])
            self.longest = max(self.longest, len(words))
            scores = {}
            for word, times in Counter(words.tolist()).items():
                idf = np.log(1 + (n - df[word] + 0.5) / (df[word] + 0.5))
                scores[word] = idf * times * (K1 + 1) / (times + K1 * (1 - B + B * len(words) / mean))
            own = sum(scores.values())
            for word, value in scores.items():
                terms.append(int(np.searchsorted(self.words, np.uint64(word))))
                columns.append(column)
                values.append(value / own)
        terms, columns, values = np.array(terms, np.int64), np.array(columns, np.int64), np.array(values)
        self.n_items, self.n_terms = len(items), len(self.words)
        self.n_blocks = -(-self.n_items // BLOCK)
        self.item = Impacts(terms, columns, values, self.n_terms, self.n_items)
        order = np.lexsort((columns, terms))
        group = terms[order] * self.n_blocks + columns[order] // BLOCK
        first = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.empty(0, np.int64)
        top = np.maximum.reduceat(values[order], first) if len(first) else np.empty(0)
        self.block_terms, self.blocks = group[first] // max(1, self.n_blocks), group[first] % max(1, self.n_blocks)
        self.block = Impacts(self.block_terms, self.blocks, top, self.n_terms, self.n_blocks)
        self.block_start = np.searchsorted(self.block_terms, np.arange(self.n_terms))
        self.block_count = np.bincount(self.block_terms, minlength=self.n_terms)
        self.highest = np.zeros(self.n_terms)
        np.maximum.at(self.highest, terms, values)

    def retrieve(self, windows: np.ndarray, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, item, score) with a score of at least ``threshold``.

        (windows, terms): the distinct terms of each window, sorted by window.
        """
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if not len(windows):
            return none
        least = threshold - 1e-9
        order = np.lexsort((self.highest[terms], windows))
        windows, terms = windows[order], terms[order]
        start = np.flatnonzero(np.diff(windows, prepend=-1))
        count = np.diff(np.append(start, len(windows)))
        rank = np.repeat(np.arange(len(start)), count)
        total = np.cumsum(self.highest[terms])
        total -= np.repeat(total[start] - self.highest[terms[start]], count)
        opens = total >= least  # the pivot: weaker terms can't reach the threshold without one of these
        at, owner = _spread(self.block_start[terms[opens]], self.block_count[terms[opens]])
        if self.block.dense is not None and self.n_blocks <= 64:
            open_blocks = np.zeros((len(start), self.n_blocks), bool)
            open_blocks[rank[opens][owner], self.blocks[at]] = True
            rows, blocks = np.nonzero(open_blocks)
            keep = np.add.reduceat(self.block.dense[terms], start, axis=0)[rows, blocks] >= least
        else:
            pairs = np.unique(rank[opens][owner] * self.n_blocks + self.blocks[at])
            rows, blocks = pairs // self.n_blocks, pairs % self.n_blocks
            keep = self._total(self.block, start, count, terms, rows, blocks) >= least
        rows, blocks = rows[keep], blocks[keep]
        width = np.minimum(BLOCK, self.n_items - blocks * BLOCK)
        items, owner = _spread(blocks * BLOCK, width)
        scores = self._total(self.item, start, count, terms, rows[owner], items)
        keep = scores >= least
        return windows[start[rows[owner][keep]]], items[keep], scores[keep]

    @staticmethod
    def _total(table: Impacts, start, count, terms, rows, columns) -> np.ndarray:
        """Sum of a window's impacts in a column, for each (window, column), in pieces of bounded size."""
        out = np.zeros(len(rows))
        ends = np.cumsum(count[rows]) if len(rows) else np.empty(0, np.int64)
        done = 0
        while done < len(rows):
            base = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, base + 2_000_000, "right")))
            part = slice(done, upto)
            at, owner = _spread(start[rows[part]], count[rows[part]])
            out[part] = np.bincount(owner, table(terms[at], columns[part][owner]), minlength=upto - done)
            done = upto
        return out


def passages(words: np.ndarray, edges: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of 2 * step words that overlap by half, so each run of ``step`` words lies in one.

    For words of several texts: the text and the first word of each window, then (window, place) for
    every word, in one or two windows each.
    """
    size = np.diff(edges)
    count = np.where(size > 2 * step, -(-(size - 2 * step) // step) + 1, np.minimum(size, 1))
    base = np.cumsum(count) - count
    text = np.repeat(np.arange(len(size)), count)
    begin = edges[:-1][text] + (np.arange(len(text)) - base[text]) * step
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(words))
    nth = (place - edges[:-1][row]) // step
    windows, places = [], []
    for at in (nth, nth - 1):
        inside = (at >= 0) & (at < count[row])
        windows.append(base[row[inside]] + at[inside])
        places.append(place[inside])
    return text, begin, np.concatenate(windows), np.concatenate(places)


def _share(wanted: np.ndarray, passage: np.ndarray, length: int) -> float:
    """The share of the ``wanted`` runs that are in the passage."""
    return float(np.isin(wanted, grams(passage, length)).mean()) if len(wanted) else 1.0


def _search(index: ItemIndex, threshold: float, overlap: float):
    step = index.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            words, edges = word_hashes(batch.column("text"), _SPACES)
            text, begin, windows, places = passages(words, edges, step)
            known = np.minimum(np.searchsorted(index.words, words), index.n_terms - 1)
            held = (index.words[known] == words)[places]
            pairs = np.unique(windows[held] * index.n_terms + known[places[held]])
            best: dict[tuple[int, int], tuple] = {}
            found = index.retrieve(pairs // index.n_terms, pairs % index.n_terms, threshold)
            for window, item, score in zip(*(v.tolist() for v in found), strict=True):
                row, first = int(text[window]), int(begin[window])
                passage = words[first : min(first + 2 * step, int(edges[row + 1]))]
                shares = [_share(wanted, passage, length) for wanted, length in index.wanted[item]]
                leaks = min(shares) >= overlap
                if not leaks and index.whole:
                    wanted, length = index.whole[item]
                    leaks = _share(wanted, passage, length) >= WHOLE
                if leaks:
                    key, start = (row, item), first - int(edges[row])
                    here = (round(score, 6), *(round(s, 6) for s in shares), start)
                    if key not in best or (here[:3], -start) > (best[key][:3], -best[key][3]):
                        best[key] = here
            keys = sorted(best)
            columns = list(zip(*(best[k] for k in keys), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())),
                 pa.array([index.ids[k[1]] for k in keys], pa.int64()),
                 *(pa.array(c, pa.float64()) for c in columns[:3]), pa.array(columns[3], pa.int64())],
                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "start_word"],
            )

    return run


_FOUND = (
    "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, start_word bigint"
)


def find_leaks(
    documents: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, shard_bytes: int = 32 << 20
) -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap, start_word): documents with a test item.

    items: item_id and text, or item_id, question and answer.  Items with the same id are searched
    each.  An item without words is in no document.  documents: doc_id and text; a null or empty text
    holds nothing, a null doc_id stays null, repeated rows are reported each, other columns are
    ignored.  A text is cut into windows of twice the longest item's words that overlap by half, so
    every item lies whole in one; the best window of each document and item is reported, once.

    An item is a leak if a window reaches ``threshold`` of the item's own score and holds at least
    ``overlap`` of the question's runs of five words and of the answer's runs of three.  Where a text
    without fields is parted is a guess, so its parts can't clear a window: it is a leak as well if the
    window holds two thirds of the whole text's runs of three words, whatever the parts' overlaps.

    The index is cut into shards of at most about ``shard_bytes`` of item text, which bounds each
    broadcast; documents are scanned once per shard and never shuffled.  Term statistics are over all items.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    if "question" in items.columns and "answer" in items.columns:
        fields = [F.col("question").cast("string").alias("question"), F.col("answer").cast("string").alias("answer")]
    else:
        fields = [F.col("text").cast("string").alias("question"), F.lit(None).cast("string").alias("answer")]
    split = "question" not in items.columns or "answer" not in items.columns
    source = items.select(F.col("item_id").cast("bigint"), *fields)
    size = F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0)) + 1

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(*(batch.column(c).to_pylist() for c in ("question", "answer")), strict=True))
            if split:
                both = [question_and_answer(q) for q, _ in both]
            parts = []
            for side in (0, 1):
                words, edges = word_hashes(pa.array([b[side] for b in both], pa.string()), _SPACES)
                parts.append(lists([signed(words[i:j]) for i, j in zip(edges, edges[1:], strict=False)], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("shard"), *parts], ["item_id", "shard", "q", "a"])

    total = source.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    parsed = source.withColumn(
        "shard", F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(shards)).cast("bigint")
    ).mapInArrow(words_of, "item_id bigint, shard bigint, q array<bigint>, a array<bigint>")
    parsed = parsed.where("size(q) + size(a) > 0")
    words = F.size("q") + F.size("a")
    n, mean, longest = parsed.agg(F.count(F.lit(1)), F.avg(words), F.max(words)).first()
    terms = parsed.select("shard", F.explode(F.array_distinct(F.concat("q", "a"))).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = spark.createDataFrame([], _FOUND)
    for shard in range(shards if n else 0):
        own = parsed.where(F.col("shard") == shard)
        # one shard: its bytes are bounded
        rows = [(r.item_id, *(np.array(w, np.int64).view(np.uint64) for w in (r.q, r.a))) for r in own.collect()]
        counts = df.join(terms.where(F.col("shard") == shard).select("term").distinct(), "term", "left_semi").collect()
        if not rows:
            continue
        index = ItemIndex(rows, {r.term % 2**64: r.df for r in counts}, n, float(mean), longest, split)
        shipped = spark.sparkContext.broadcast(index)
        found = found.union(texts.mapInArrow(_with(shipped, threshold, overlap), _FOUND))
    return found


def _with(shipped, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _search(shipped.value, threshold, overlap)(batches)

    return run
