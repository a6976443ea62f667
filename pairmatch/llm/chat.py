"""Chat formatting with typed content parts.

A conversation turn is a list of parts: text, image, audio or document.  A visitor flattens
them, in order, into one string in which attachments are numbered placeholders, and records
what each placeholder refers to and how many tokens it expands to.  The template marks turns;
control strings inside texts are escaped so that the formatted text can be read back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the template
START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
PLACEHOLDER = "<|{kind}:{number}|>"
PART = "struct<kind:string,text:string,uri:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
ATTACHMENT = "struct<number:bigint,kind:string,uri:string,tokens:bigint>"
TURNS = (
    f"conv_id bigint, turn bigint, role string, segment string, loss_start bigint, loss_chars bigint, "
    f"attachments array<{ATTACHMENT}>, expanded_tokens bigint"
)


def escape(text: str) -> str:
    """Without control strings; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


class Flattener:
    """Visits the parts of a turn; one method for each kind of part.

    patch: pixels that one image token covers each way; audio_rate: tokens a second;
    page_tokens: tokens a document page.  A part of unknown size counts as one token.
    """

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def flatten(self, parts: list[dict | None]) -> tuple[str, list[dict]]:
        self.pieces: list[str] = []
        self.texts: list[str] = []
        self.attachments: list[dict] = []
        for part in parts:
            if part is not None:
                getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_other)(part)
        self._end_text()
        return "".join(self.pieces), self.attachments

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def _end_text(self) -> None:
        # neighbouring texts are escaped as one, for a control string may begin in one and end in the next
        self.pieces.append(escape("".join(self.texts)))
        self.texts = []

    def visit_image(self, part: dict) -> None:
        wide, high = part.get("width") or 1, part.get("height") or 1
        self._attach(part, math.ceil(wide / self.patch) * math.ceil(high / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"unknown kind of content part: {part.get('kind')!r}")

    def _attach(self, part: dict, tokens: int) -> None:
        self._end_text()
        number = len(self.attachments) + 1
        self.pieces.append(PLACEHOLDER.format(kind=part["kind"], number=number))
        self.attachments.append(
            {"number": number, "kind": part["kind"], "uri": part.get("uri"), "tokens": max(1, tokens)}
        )


def format_turns(conversations: DataFrame, loss_role: str = "assistant", flattener: Flattener | None = None) -> DataFrame:
    """One formatted segment per turn; a conversation's text is its segments in order of ``turn``.

    Reads conv_id, turn, role, text and, where there is such a column, parts (an array of
    ``PART``); other columns are ignored.  ``loss_start`` and ``loss_chars`` mark, in code points of
    the segment, what the loss covers: the content of turns of ``loss_role``, nothing else.

    A null text is empty, a null role is the empty role, a turn with both text and parts has the
    text first.  Null ids and turns stay null and repeated rows are formatted each.  A part of an
    unknown kind is an error.  Formatting needs no other row, so nothing is shuffled.
    """
    flattener = flattener or Flattener()
    parts = F.col("parts") if "parts" in conversations.columns else F.lit(None)
    source = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"),
        F.col("text").cast("string"), parts.cast(f"array<{PART}>").alias("parts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                content, attached = flattener.flatten([{"text": row["text"]}, *(row["parts"] or [])])
                role = escape(row["role"] or "").replace("\n", "\\n")
                head = f"{START}{role}\n"
                learn = (row["role"] or "") == loss_role
                rows.append({
                    "conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"],
                    "segment": f"{head}{content}{END}\n",
                    "loss_start": len(head), "loss_chars": len(content) if learn else 0,
                    "attachments": attached, "expanded_tokens": sum(a["tokens"] for a in attached),
                })
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return source.mapInArrow(run, TURNS)


ARROW = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
    ("loss_start", pa.int64()), ("loss_chars", pa.int64()),
    ("attachments", pa.list_(pa.struct([
        ("number", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))),
    ("expanded_tokens", pa.int64()),
])


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.learnt = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int, length: int) -> None:
        role, content = SEGMENT.fullmatch(segment).groups()
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{unescape(role)}\n{unescape(content)}\n".encode())
        learnt = unescape(segment[start : start + length])
        self.learnt += len(learnt)
        self.loss.update(learnt.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(),
            "loss_chars": self.learnt, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
        }


def read_back(turns: DataFrame) -> DataFrame:
    """Digest of each formatted conversation, parsed from its segments.

    A SHA-256 over a conversation takes its turns one after the other, so each conversation is
    streamed, sorted, through one task; the task holds one segment at a time, however long the
    conversation is.  Turns with the same number are ordered by role and segment; rows without
    conv_id form one conversation.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(row["conv_id"])
                now.add(row["segment"], row["loss_start"], row["loss_chars"])
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=schema)

    return (
        turns.select("conv_id", "turn", "role", "segment", "loss_start", "loss_chars")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "segment")
        .mapInArrow(
            run,
            "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
            "formatted_chars bigint",
        )
    )
