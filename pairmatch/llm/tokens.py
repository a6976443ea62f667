"""Token counts per section by offsets: a document is encoded once, whole.

Encoding sections apart would give other tokens at their edges.  Here the whole text is encoded,
each token keeps the span of characters it came from, and the spans are joined to the sections'
spans.  A token that crosses an edge goes to one section by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmatch.llm.common import small_batches

RULES = ("start", "end", "most")
# fixed value: how the byte-level vocabularies split a text before merging bytes
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def section_starts(text: str) -> np.ndarray:
    """First character of each section: sections are lines, each with its line break."""
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, np.int64)


def allocate(token_starts: np.ndarray, token_ends: np.ndarray, sections: np.ndarray, rule: str = "start") -> np.ndarray:
    """Section of each token, given the starts of the sections that tile the text.

    start: the section that holds the token's first character.  end: the one that holds its last.
    most: the one that holds most of its characters, the earlier one if two hold as many.
    """
    first = np.searchsorted(sections, token_starts, "right") - 1
    last = np.maximum(first, np.searchsorted(sections, np.maximum(token_ends - 1, token_starts), "right") - 1)
    if rule == "start":
        return first
    if rule == "end":
        return last
    if rule != "most":
        raise ValueError(f"rule must be one of {RULES}")
    out = first.copy()
    edges = np.append(sections, np.iinfo(np.int64).max)
    for i in np.flatnonzero(first != last):
        inside = range(first[i], last[i] + 1)
        out[i] = max(inside, key=lambda s: (min(edges[s + 1], token_ends[i]) - max(edges[s], token_starts[i]), -s))
    return out


class ByteTokenizer:
    """Byte-level BPE from a file of ranks; every token is a run of the text's bytes."""

    def __init__(self, ranks: bytes, split: str = SPLIT):
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self._encoding = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=merges, special_tokens={})
        self._bytes = np.zeros(max(merges.values()) + 1, np.int64)
        for token, rank in merges.items():
            self._bytes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token; tokens that share a character overlap in it."""
        ids = np.array(self._encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self._bytes[ids])
        begins = ends - self._bytes[ids]
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        return character[begins], character[ends - 1] + 1


_loaded: dict[int, ByteTokenizer] = {}


def _tokenizer(ranks: bytes, split: str) -> ByteTokenizer:
    key = hash((ranks, split))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteTokenizer(ranks, split)
    return _loaded[key]


def count_tokens(
    documents: DataFrame, ranks_file: str, rule: str = "start", text: str = "text", split: str = SPLIT
) -> DataFrame:
    """Rows (doc_id, section, start_char, n_chars, n_tokens, n_crossing), one per section of a text.

    ranks_file: a byte-level vocabulary as base64 tokens with ranks, on the driver; its one or two MB
    go to the executors by broadcast.  n_tokens sums up to the tokens of the whole text; n_crossing
    counts those of the section's tokens that also cover characters of another one.

    A null or empty text has one section without characters and tokens.  Null ids stay null,
    repeated rows are counted each, and other columns are ignored.  Texts are encoded whole.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(ranks_file, "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(ranks.value, split)
        for batch in small_batches(batches, "text", 2 << 20):
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for row, body in enumerate(batch.column("text").to_pylist()):
                body = body or ""
                sections = section_starts(body)
                begins, ends = tokenizer.spans(body)
                at = allocate(begins, ends, sections, rule)
                crossing = allocate(begins, ends, sections, "start") != allocate(begins, ends, sections, "end")
                parts = (
                    np.full(len(sections), row), np.arange(len(sections)), sections,
                    np.diff(np.append(sections, len(body))), np.bincount(at, minlength=len(sections)),
                    np.bincount(at[crossing], minlength=len(sections)),
                )
                for column, values in zip(columns, parts, strict=True):
                    column.append(values)
            rows, *values = (np.concatenate(c) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), *(pa.array(v, pa.int64()) for v in values)],
                ["doc_id", "section", "start_char", "n_chars", "n_tokens", "n_crossing"],
            )

    return documents.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, section bigint, start_char bigint, n_chars bigint, n_tokens bigint, n_crossing bigint"
    )
