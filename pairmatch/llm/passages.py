"""Repeated passages, with sparse suffix arrays over words.

Of all suffixes only those that begin at minimisers are kept: positions whose run of ``GRAM`` words has
the least hash among ``SPAN`` neighbours.  The choice depends on nothing but the words, so equal passages
choose equal positions, and every passage of ``min_words`` words has one among its first ``SPAN``.

Suffixes are brought together by their first min_words - SPAN + 1 words, their core; one whose core no
other has is dropped.  The rest are extended to the left, by each number of words up to SPAN - 1 for which the
position is the one chosen, and to the right to ``min_words`` words in all; what still has an equal is a
repeated passage.  Passages that overlap are joined to spans.  No pair of copies is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.lineage import cut_lineage
from pairmatch.llm.common import id_filter, may_hold, scramble, signed, small_batches, stored, window_hashes, word_hashes

GRAM = 8
SPAN = 32
_POSITION_BITS = 28


def chosen_positions(words: np.ndarray) -> np.ndarray:
    """For each run of SPAN neighbouring grams, the position of its minimiser, the first if several tie.

    The low bits of a hash give way to the position, so that one minimum finds both.
    """
    grams = scramble(window_hashes(words, GRAM))
    count = len(grams) - SPAN + 1
    if count <= 0:
        return np.empty(0, np.int64)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < SPAN:  # minima over 2, 4, ... neighbours
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (least & low).astype(np.int64)


def _cores(min_words: int):
    core = min_words - SPAN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows, places, keys = [], [], []
            words, edges = word_hashes(batch.column("text"))
            chosen, cores = chosen_positions(words), window_hashes(words, core)
            for row, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
                # the last passage that is whole begins min_words before the end
                at = chosen[start : max(start, end - min_words + 1)]
                at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
                rows.append(np.full(len(at), row))
                places.append(at - start)
                keys.append(cores[at])
            rows = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(rows), batch.column("version").take(rows),
                 pa.array(np.concatenate(places).astype(np.int32) if places else np.empty(0, np.int32)),
                 pa.array(signed(np.concatenate(keys)) if keys else np.empty(0, np.int64))],
                ["doc", "version", "at", "core"],
            )

    return run


def _extended(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows, places, keys = [], [], []
            positions = batch.column("positions")
            words, edges = word_hashes(batch.column("text"))
            chosen, runs = chosen_positions(words), window_hashes(words, min_words)
            wanted = np.zeros(len(words) + 1, bool)
            for row, (start, end) in enumerate(zip(edges, edges[1:], strict=False)):
                wanted[np.asarray(positions[row].values) + start] = True
                at = start + np.flatnonzero(wanted[chosen[start : max(start, end - min_words + 1)]])
                rows.append(np.full(len(at), row))
                places.append(at - start)
                keys.append(runs[at])
            rows = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(rows), batch.column("version").take(rows),
                 pa.array(np.concatenate(places).astype(np.int32) if places else np.empty(0, np.int32)),
                 pa.array(signed(np.concatenate(keys)) if keys else np.empty(0, np.int64))],
                ["doc", "version", "at", "passage"],
            )

    return run


def _spans(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc": [], "start_word": [], "n_words": [], "first_doc_id": [], "n_copies": []}
            for doc, found in zip(batch.column("doc").to_pylist(), batch.column("found"), strict=True):
                flat = found.values
                at, first, copies = (np.asarray(flat.field(f)) for f in ("at", "first", "copies"))
                order = np.argsort(at, kind="stable")
                at, first, copies = at[order], first[order], copies[order]
                starts = np.flatnonzero(np.diff(at, prepend=at[0] - min_words - 1) > min_words)
                ends = np.append(starts[1:], len(at)) - 1
                out["doc"] += [doc] * len(starts)
                out["start_word"] += at[starts].tolist()
                out["n_words"] += (at[ends] - at[starts] + min_words).tolist()
                out["first_doc_id"] += np.minimum.reduceat(first, starts).tolist()
                out["n_copies"] += np.maximum.reduceat(copies, starts).tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    return run


_NO_ID = -(2**63)


def repeated_passages(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """Rows (doc_id, start_word, n_words, first_doc_id, n_copies, first_copy): maximal spans of repeated text.

    A span is the union of all runs of ``min_words`` words that occur again, in another document or
    elsewhere in this one, joined where they touch.  first_doc_id is the smallest doc_id that holds a
    passage of the span, n_copies the most occurrences of one, and first_copy says whether the
    document is itself the first holder.  Words are what stands between ASCII white space, with A-Z in
    lower case.

    Null texts and texts of fewer words have no spans.  Rows that repeat doc_id and text are copies of
    each other and give one set of spans; texts that share a doc_id are told apart by a hash of the text.  Rows without doc_id take part,
    and come back with a null id.  Other columns are ignored.  Passages are told apart by 64-bit hashes.
    """
    if min_words < GRAM + SPAN - 1:
        raise ValueError(f"min_words must be at least {GRAM + SPAN - 1}")
    texts = documents.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("version"),
        F.col("text").cast("string").alias("text"),
    )

    # keys are mostly different, so a count is all that moves besides them
    suffixes = stored(texts.mapInArrow(_cores(min_words), "doc bigint, version bigint, at int, core bigint"))
    shared = suffixes.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    held = cut_lineage(
        suffixes.join(shared, "core").groupBy("doc", "version").agg(F.collect_list("at").alias("positions"))
    )
    wanted = id_filter(held, "doc")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(may_hold(wanted.value, batch.column("doc")))

    windows = stored(
        texts.mapInArrow(asked, texts.schema)
        .join(held, ["doc", "version"])
        .select("doc", "version", "text", "positions")
        .mapInArrow(_extended(min_words), "doc bigint, version bigint, at int, passage bigint")
    )
    again = (
        windows.groupBy("passage")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc").alias("first"))
        .where("copies > 1")
    )
    found = (
        windows.join(again, "passage")
        .groupBy("doc", "version")
        .agg(F.collect_list(F.struct(F.col("at").cast("bigint").alias("at"), "first", "copies")).alias("found"))
    )
    spans = found.select("doc", "found").mapInArrow(
        _spans(min_words), "doc bigint, start_word bigint, n_words bigint, first_doc_id bigint, n_copies bigint"
    )
    return spans.select(
        F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "start_word", "n_words",
        F.nullif("first_doc_id", F.lit(_NO_ID)).alias("first_doc_id"), "n_copies",
        (F.col("doc") == F.col("first_doc_id")).alias("first_copy"),
    )
