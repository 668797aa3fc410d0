"""Chat formatting over typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens
them in order: text is escaped and written out, every other part becomes one placeholder,
and the attachment's reference, its kind and the number of tokens that the placeholder
stands for are recorded. A turn is written as

    <|turn|>role<|says|>content<|end|>

and the loss mask covers the content of assistant turns. Control strings (these markers,
the placeholders and those of other common templates) never occur inside a written role or
text: a backslash goes after their first character, and one more where backslashes are
there already, so :func:`unescape` gives back any text exactly.

A conversation is the segments of its turns in order, one row each, so a conversation of any
length passes through in bounded memory; :func:`read_back` reads the segments in a row.

Defined results: null text and null role are empty; turns go by ``turn`` (null first), ties
by role and text; repeated rows are turns of their own; rows without ``conv_id`` are one
conversation without an id; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strata.llm.tables import slices

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = (
    TURN, SAYS, END, *PLACEHOLDERS.values(),
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
)
TRAINED_ROLES = ("assistant",)
IMAGE_TILE, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 800
_PATTERN = re.compile(
    r"([<\[])(\\*)(" + "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True)) + ")"
)
_ESCAPED = re.compile(_PATTERN.pattern.replace(r"(\\*)", r"\\(\\*)"))


def escape(text: str) -> str:
    """The text without any control string; reversed by :func:`unescape`."""
    return _PATTERN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Visitor:
    """Flattens the parts of one turn; a kind of part is a method ``visit_<type>``."""

    def __init__(self) -> None:
        self.written: list[str] = []
        self.attachments: list[dict] = []
        self.texts: list[str] | None = None  # of the run of text parts that is being written

    def visit(self, part: dict) -> None:
        method: Callable[[dict], None] | None = getattr(self, f"visit_{part.get('type')}", None)
        if method is None:
            raise ValueError(f"unknown type of content part: {part.get('type')!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        """Neighbouring texts are escaped as one: a control string may begin in one of them."""
        if self.texts is None:
            self.texts = []
            self.written.append("")
        self.texts.append(part.get("text") or "")
        self.written[-1] = escape("".join(self.texts))

    def _attach(self, part: dict, tokens: int) -> None:
        self.texts = None
        self.written.append(PLACEHOLDERS[part["type"]])
        self.attachments.append({"type": part["type"], "ref": part.get("ref"), "tokens": max(1, tokens)})

    def visit_image(self, part: dict) -> None:
        tiles = (math.ceil((part.get(side) or 0) / IMAGE_TILE) for side in ("width", "height"))
        self._attach(part, math.prod(tiles))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * TOKENS_PER_PAGE)

    def content(self) -> str:
        return "".join(self.written)


def text_parts(text: str = "text") -> Column:
    """A text column as a list of one text part."""
    kinds = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *rest))


_SEGMENT = (
    "conv_id long, turn long, role string, segment string, loss_start int, loss_end int, "
    "attachments array<struct<type:string,ref:string,tokens:int>>"
)


def format_turns(turns: DataFrame) -> DataFrame:
    """Segments of (conv_id, turn, role, parts) rows, in any order.

    ``loss_start`` and ``loss_end`` (code points within the segment) are the loss mask.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "parts"):
            rows = []
            for row in batch.to_pylist():
                visitor = Visitor()
                for part in row["parts"] or []:
                    if part is not None:
                        visitor.visit(part)
                head = TURN + escape(row["role"] or "") + SAYS
                content = visitor.content()
                trained = row["role"] in TRAINED_ROLES
                rows.append(
                    {
                        "conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"], "segment": head + content + END,
                        "loss_start": len(head) if trained else None, "loss_end": len(head + content) if trained else None,
                        "attachments": visitor.attachments,
                    }
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = to_arrow_schema(StructType.fromDDL(_SEGMENT))
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "parts")
    return plain.mapInArrow(write, _SEGMENT)


def format_conversations(turns: DataFrame) -> DataFrame:
    """The segments with every conversation's in order, within one partition."""
    return format_turns(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")


def parse(segment: str) -> tuple[str, str]:
    """(role, content), unescaped; placeholders stay in the content."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError("a segment is one turn")
    role, says, content = segment[len(TURN) : -len(END)].partition(SAYS)
    if not says or any(mark in content or mark in role for mark in (TURN, SAYS, END)):
        raise ValueError("a segment is one turn")
    return unescape(role), unescape(content)


class _Reader:
    """Digests of one conversation, segment by segment."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def read(self, segment: str, start: int | None, end: int | None) -> None:
        role, content = parse(segment)
        self.turns.update(f"{role}\n{content}\n".encode())
        self.n_turns += 1
        self.formatted_chars += len(segment)
        if start is not None:
            trained = unescape(segment[start:end])
            self.loss.update(trained.encode())
            self.loss_chars += len(trained)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from its segments and loss masks alone.

    ``formatted`` comes from :func:`format_conversations`. A digest of a conversation has to
    see its segments one after the other; they are streamed, never held.
    """
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    kinds = [pa.string() if "sha" in n else pa.int64() for n in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            done = []
            for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv != current:
                    if reader is not None:
                        done.append(reader.row(current))
                    current, reader = conv, _Reader()
                reader.read(segment, start, end)
            if done:
                yield out(done)
        if reader is not None:
            yield out([reader.row(current)])

    return formatted.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(read, _DIGEST)
