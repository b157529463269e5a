"""Operator 3: chat formatting with typed content parts.

A turn's content is a list of typed parts.  A visitor with one method a type
flattens them in order: text becomes escaped text; image, audio and document
parts become a placeholder, and an attachment record (number, type, reference)
with the tokens it will expand to.  Turns are marked by control strings, and the
same strings inside texts, roles and references are broken by an escape sign, so
reading back (`read`) returns every part exactly.

``<|turn|>ROLE<|says|>TEXT<|end|>`` with ``<|image:K|>``, ``<|audio:K|>`` and
``<|document:K|>`` for the K-th attachment of the conversation.

Defined results: turns are ordered by number, then role, then content (null
first); null text and null role are empty; repeated rows are repeated turns;
rows without a conversation id form one conversation with a null id; unknown
part types raise ValueError; missing sizes of media count as one unit; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
SPANS = "array<struct<start: int, end: int>>"
ATTACHMENTS = "array<struct<number: int, type: string, ref: string, turn: int, place: int, tokens: bigint>>"
#: One token a patch of so many pixels square, so many a second of sound, so many a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256

#: Starts of control strings, of this template and of other common ones.
_CONTROL = re.compile(r"<(?=\||/?s>)|\[(?=/?INST\])")
_BROKEN = re.compile(r"\\(\\?)")
_MARK = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    """Backslashes doubled, and one put inside every control string."""
    return _CONTROL.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BROKEN.sub(lambda m: m.group(1), text) if "\\" in text else text


class Flattener:
    """Visitor of the parts of one conversation: collects output, attachments and expanded tokens."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def visit(self, part: dict, turn: int) -> None:
        kind = part["type"]
        method = getattr(self, f"visit_{kind}", None) if kind in ("text", "image", "audio", "document") else None
        if method is None:
            raise ValueError(f"unknown part type {kind!r}")
        method(part, turn)

    def visit_text(self, part: dict, turn: int) -> None:
        self.put(escape(part["text"] or ""))

    def visit_image(self, part: dict, turn: int) -> None:
        w, h = part["width"] or 1, part["height"] or 1
        self._attach(part, turn, math.ceil(w / PATCH) * math.ceil(h / PATCH))

    def visit_audio(self, part: dict, turn: int) -> None:
        self._attach(part, turn, math.ceil((part["seconds"] or 1.0) * PER_SECOND))

    def visit_document(self, part: dict, turn: int) -> None:
        self._attach(part, turn, (part["pages"] or 1) * PER_PAGE)

    def _attach(self, part: dict, turn: int, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append({"number": number, "type": part["type"], "ref": part["ref"], "turn": turn, "place": self.length, "tokens": tokens})
        self.put(f"<|{part['type']}:{number}|>")


def _formatter(learned: tuple[str, ...]):
    fields = pa.struct([("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("turn", pa.int32()), ("place", pa.int32()), ("tokens", pa.int64())])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                flat, spans = Flattener(), []
                for k, turn in enumerate(batch.column("turns")[row].as_py()):
                    role = turn["role"] or ""
                    flat.put(TURN + escape(role) + SAYS)
                    begin = flat.length
                    for part in turn["parts"] or []:
                        flat.visit(part, k)
                    if role in learned:
                        spans.append({"start": begin, "end": flat.length})
                    flat.put(END)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv").slice(row, 1), pa.array(["".join(flat.out)]), pa.array([spans], pa.list_(span)), pa.array([flat.attachments], pa.list_(fields)),
                     pa.array([sum(a["tokens"] for a in flat.attachments)], pa.int64())], names=["conv", "formatted", "loss", "attachments", "media_tokens"])
    return run


def text_part(text: Column) -> Column:
    """A list of one text part."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"),
                            none("double").alias("seconds"), none("int").alias("pages")))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                         learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, formatted, loss, attachments, media_tokens): one row a conversation.

    ``parts`` is array<PART>.  ``loss`` holds the spans of ``formatted`` (code
    points, end exclusive) that the learned roles say; the marks are outside.
    ``place`` of an attachment is that of its placeholder in ``formatted``.
    """
    own = rows.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(parts).cast(f"array<{PART}>").alias("parts")).alias("t"))
    grouped = own.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shape = f"conv {dict(own.dtypes)['conv']}, formatted string, loss {SPANS}, attachments {ATTACHMENTS}, media_tokens long"
    return grouped.mapInArrow(_formatter(learned), shape).withColumnRenamed("conv", conv)


def read(formatted: str) -> list[tuple[str, list[tuple[str, str | int]]]]:
    """(role, parts) of each turn; a part is ("text", text) or (type, number of the attachment)."""
    out = []
    for turn in formatted.split(TURN)[1:]:
        role, _, body = turn.partition(SAYS)
        body = body.removesuffix(END)
        parts, at = [], 0
        for m in _MARK.finditer(body):
            if m.start() > at:
                parts.append(("text", unescape(body[at:m.start()])))
            parts.append((m.group(1), int(m.group(2))))
            at = m.end()
        if at < len(body):
            parts.append(("text", unescape(body[at:])))
        out.append((unescape(role), parts))
    return out


def _reader():
    turn = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                whole = batch.column("formatted")[row].as_py() or ""
                turns = [{"role": role, "text": "".join(p[1] for p in parts if p[0] == "text")} for role, parts in read(whole)]
                learned = [unescape(whole[s["start"]:s["end"]]) for s in batch.column("loss")[row].as_py() or []]
                yield pa.RecordBatch.from_arrays([batch.column("conv").slice(row, 1), pa.array([turns], pa.list_(turn)), pa.array([learned], pa.list_(pa.string()))],
                                                 names=["conv", "turns", "learned"])
    return run


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turns, learned): roles and texts of the turns, and the texts under the loss mask, from formatted rows.

    Placeholders of attachments have no text.
    """
    own = formatted.select(F.col(conv).alias("conv"), "formatted", "loss")
    shape = f"conv {dict(own.dtypes)['conv']}, turns array<struct<role: string, text: string>>, learned array<string>"
    return own.mapInArrow(_reader(), shape).withColumnRenamed("conv", conv)
