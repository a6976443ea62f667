"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding undoes disguises: accents go, letters that look alike in other scripts become Latin, and
digits and signs that stand for letters become those letters.  The lexicon holds beginnings of
words with weights learnt from labelled rows; longer words that begin alike but are harmless are
exceptions.  The weight of the matches is set against the length of the text.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmatch.lineage import cut_lineage
from pairmatch.llm.common import bound_batches, id_filter, may_hold, small_batches, window_hashes, word_hashes

# fixed values: look-alikes outside Latin, then signs that stand for letters; i, l, 1, ! and | fold alike
LOOK_ALIKES = dict(zip("аеорсухіѕјԁӏԛɡαονρικ", "aeopcyxisjdlqgaovpik", strict=True))
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
# fixed values: harmless phrases around common insults
HARMLESS = ("trash can", "trash bin", "clown fish", "scum line", "idiot proof")
PREFIXES = range(4, 9)


class _Folding(dict):
    """Character table: folded letters stay, everything else parts words; filled as characters come."""

    def __missing__(self, code: int) -> str:
        out = "".join(
            STAND_INS.get(c, c) if c.isalnum() or c in STAND_INS else " "
            for base in unicodedata.normalize("NFKD", chr(code).lower())
            if not unicodedata.combining(base)
            for c in LOOK_ALIKES.get(base, base)
        )
        if unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf":
            out = ""
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Lower case, without accents and disguises; words are parted by spaces, one at each end."""
    return f" {' '.join((text or '').translate(_FOLDING).split())} "


@dataclass
class Lexicon:
    """Word beginnings with weights, exceptions, and how the score follows from the matches."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def _built(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(f" {entry}", (entry, weight))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (f"{phrase} ", None))
            self._automaton.make_automaton()
        return self._automaton

    def match(self, folded: str) -> tuple[float, float]:
        """Weight of the entries, each time one occurs, in all and per 100 words."""
        if not self.weights:
            return 0.0, 0.0
        hits, clear = [], []
        for end, (entry, weight) in self._built().iter(folded):
            span = (end - len(entry) + 1, end)
            (clear if weight is None else hits).append((span, entry, weight))
        if clear:
            # the furthest end of all exceptions that begin no later than a hit tells whether one holds it
            begins = sorted(span for span, _, _ in clear)
            ends = list(accumulate((end for _, end in begins), max))
            starts = [start for start, _ in begins]
            hits = [h for h in hits if not ((at := bisect_right(starts, h[0][0])) and ends[at - 1] >= h[0][1])]
        words = max(1, folded.count(" ") - 1)
        weight = sum(h[2] for h in hits)
        return weight, 100 * weight / words

    def features(self, text: str | None) -> tuple[float, float]:
        weight, density = self.match(fold(text))
        return float(np.log1p(weight)), float(np.log1p(density))

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        weight, density = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * weight + c * density, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _sketches(wanted):
    """Task function: for labelled texts, a hash that copies share.

    It is made of the least hash of three neighbouring words and the size of the text in steps of a half, so that a shared
    passage seldom makes texts copies; a text of fewer than six words has the hash of all its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            batch = batch.filter(may_hold(wanted.value, batch.column("doc_id")))
            words, edges = word_hashes(batch.column("text"))
            runs = window_hashes(words, 3)
            sketch = []
            for i, j in zip(edges, edges[1:], strict=False):
                if j - i < 6:
                    parts = words[i:j]
                else:
                    parts = np.array([runs[i : j - 2].min(), np.uint64(np.log(j - i) / np.log(1.5))])
                sketch.append(xxhash.xxh3_64_intdigest(parts.tobytes()) - 2**63)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sketch, pa.int64())], ["doc_id", "sketch"])

    return run


_COUNTS = ["clean", "toxic", "clean_times", "toxic_times"]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By class, the documents that hold each word or word beginning, and how often; summed up per task."""
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        numbers = np.array(list(counts.values()), np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), *(pa.array(numbers[:, i]) for i in range(4))], ["entry", *_COUNTS]
        )

    for batch in small_batches(batches, "text"):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            entries: Counter[str] = Counter()
            for word, times in Counter(fold(text).split()).items():
                entries[f"{word} "] += times
                for n in PREFIXES:
                    if len(word) >= n:
                        entries[word[:n]] += times
            for entry, times in entries.items():
                count = counts.setdefault(entry, [0, 0, 0, 0])
                count[toxic] += 1
                count[2 + toxic] += times
        if len(counts) > 100_000:
            yield out()
            counts = {}
    yield out()


def learn(
    documents: DataFrame, labels: DataFrame, sample: int = 20_000, evidence: float = 20.0, precision: float = 0.5
) -> Lexicon:
    """Learns a lexicon from labelled documents outside the held-out part.

    sample: learn from at most so many labelled texts, those with the lowest hash of doc_id, one of each group of copies;
    the bound holds what reaches the driver: entries and exceptions, which are words of the sample, and the rows of the final fit.  evidence: least log-likelihood
    ratio of an entry.  precision: least share of its occurrences that are in toxic documents.
    The shortest beginning that qualifies is kept.  Labels that are null or neither 0 nor 1 are left
    out, of several labels for a document the highest counts, and without a toxic row, a clean row or a telling word the
    lexicon is empty and scores every text below any threshold.
    """
    bound_batches(documents.sparkSession)
    marked = (
        labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int"))
        .where("doc_id is not null and toxic in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # copies of a text would make all its words look telling, so one of each group stays before the sample is drawn
    wanted = id_filter(marked, "doc_id")
    rows = (
        texts.mapInArrow(_sketches(wanted), "doc_id bigint, sketch bigint")
        .join(marked, "doc_id")
        .groupBy("toxic", "sketch").agg(F.min("doc_id").alias("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        .select("doc_id", "toxic")
    )
    # the sample's size bounds the broadcast
    chosen = cut_lineage(texts.join(F.broadcast(rows), "doc_id").select("text", "toxic"))
    wanted.unpersist()
    sizes = dict(chosen.groupBy("toxic").count().collect())
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon()
    base = n_toxic / (n_clean + n_toxic)
    spread = chosen.mapInArrow(_word_counts, f"entry string, {' bigint, '.join(_COUNTS)} bigint")
    held = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / held
    ratio = 2 * (
        F.col("toxic") * F.log(share / base)
        + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0)
    )
    counted = spread.groupBy("entry").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    strong = (
        counted.where((F.col("toxic") >= 3) & (share > base) & (ratio >= evidence))
        .where(F.col("toxic_times") >= precision * (F.col("toxic_times") + F.col("clean_times")))
        .select("entry", *_COUNTS).collect()
    )
    weights: dict[str, float] = {}
    for row in sorted(strong, key=lambda r: (len(r.entry), r.entry)):
        if not any(row.entry[:n] in weights for n in range(3, len(row.entry))):
            weight = np.log((row.toxic_times + 0.5) / (n_toxic + 1)) - np.log((row.clean_times + 0.5) / (n_clean + 1))
            if weight > 0:
                weights[row.entry] = float(weight)
    if not weights:
        return Lexicon()
    begins = F.regexp_extract("entry", f"^(?:{'|'.join(sorted(weights))})", 0) != ""
    harmless = counted.where(F.col("entry").endswith(" ") & begins & (F.col("clean") >= 2) & (share <= base))
    exceptions = [r.entry.strip() for r in harmless.select("entry").collect()]
    lexicon = Lexicon(weights, sorted({*exceptions, *(fold(p).strip() for p in HARMLESS)}))
    seen = chosen.mapInArrow(_features(lexicon), "weight double, density double, toxic int")
    lexicon.coefficients = _fit(np.array([tuple(r) for r in seen.collect()]))
    return lexicon


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0]), pa.array(found[:, 1]), batch.column("toxic")], ["weight", "density", "toxic"]
            )

    return run


def _fit(rows: np.ndarray, penalty: float = 0.01) -> tuple[float, float, float]:
    """Logistic regression by Newton steps on at most ``sample`` rows of two features."""
    x = np.column_stack([np.ones(len(rows)), rows[:, :2]])
    y = rows[:, 2]
    ridge = np.diag([1e-6, penalty, penalty]) * len(rows)
    at = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ at)
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in at)


def score(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row, from the whole text only.

    A null text counts as empty and gets the score of a text without matches; a null doc_id stays
    null and isn't held out; repeated rows are scored each.  Reads doc_id and text, nothing else.
    """

    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            scores = [lexicon.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, score double"
    )
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_clean(documents: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores below ``threshold``, with all their columns, whatever their names."""
    bound_batches(documents.sparkSession)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            keep = [lexicon.score(t) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
