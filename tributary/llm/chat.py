"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
flattens them in order: text is escaped, every other part becomes a placeholder
that is expanded to as many tokens as its size asks for, and its reference is
recorded. A turn is written ``<|im_start|>role\\ncontent<|im_end|>\\n``.

Escapes are reversible: in texts and roles a backslash is doubled, and a
backslash follows every ``<`` that a ``|`` follows, so no text holds a control
string; in roles a line break is written as backslash and n. The loss mask
covers what assistants say, as ranges of code points of the turn's string.

Turns are formatted row by row, wherever they lie. Whoever needs conversations
as a whole reads turns sorted by conversation and turn and keeps a running
state, so a conversation of any length needs no more memory than a batch.

Defined results: a null text or content is empty, a null role is the empty
role; rows with a null conversation are one conversation; turns that tie are
ordered by role and text; repeated rows are turns of their own; a null turn
comes first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.textkit import small_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Placeholder of each kind of attachment.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PATCH = 28
AUDIO_TOKENS_A_SECOND = 25
DOCUMENT_TOKENS_A_PAGE = 256

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escaped(text: str) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    # What stands before may end in "<".
    return "\\" + out if out.startswith("|") else out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


@dataclass
class Flattened:
    """What the visitor has gathered: strings in order, references and token counts."""

    pieces: list[str] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    expanded: int = 0


class PartVisitor:
    """Flattens typed parts; a part of an unknown type is text if it has one, else left out with a reference of 0 tokens."""

    def __init__(self) -> None:
        self.out = Flattened()

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.pieces.append(escaped(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, -(-(part.get(k) or PATCH) // PATCH)) for k in ("width", "height"))
        self.attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, round((part.get("seconds") or 0.0) * AUDIO_TOKENS_A_SECOND)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, part.get("pages") or 1) * DOCUMENT_TOKENS_A_PAGE)

    def visit_other(self, part: dict) -> None:
        if part.get("text"):
            self.visit_text(part)
        else:
            self.record(part.get("type") or "", part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.pieces.append(PLACEHOLDERS[kind])
        self.out.expanded += tokens
        self.record(kind, part, tokens)

    def record(self, kind: str, part: dict, tokens: int) -> None:
        self.out.refs.append({"position": len(self.out.refs), "type": kind, "ref": part.get("ref"), "tokens": tokens})


def format_turn(role: str, parts: list[dict]) -> tuple[str, tuple[int, int] | None, Flattened]:
    """The turn's string, its loss range if an assistant says it, and what the visitor gathered."""
    visitor = PartVisitor()
    for part in parts:
        visitor.visit(part)
    head, content = f"{START}{escaped_role(role)}\n", "".join(visitor.out.pieces)
    loss = (len(head), len(head) + len(content)) if role == "assistant" else None
    return f"{head}{content}{END}\n", loss, visitor.out


TURNS = "conv_id long, turn long, role string, sort_text string, formatted string, loss_start long, loss_end long, attachments array<struct<position: int, type: string, ref: string, tokens: long>>, expanded_tokens long"
REF = pa.list_(pa.struct([("position", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def format_turns(turns: DataFrame, content_col: str = "text", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row per turn with its formatted string; content is a text or a list of parts (PART)."""
    plain = dict(turns.dtypes)[content_col] == "string"
    content = F.col(content_col)
    order = F.col(content_col) if plain else F.to_json(F.struct(content))
    chosen = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), content.alias("content"), F.coalesce(order, F.lit("")).alias("sort_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for role, content in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts = [{"type": "text", "text": content}] if plain else [p for p in content or [] if p]
                rows.append(format_turn(role, parts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    batch.column(4),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] and r[1][0] for r in rows], pa.int64()),
                    pa.array([r[1] and r[1][1] for r in rows], pa.int64()),
                    pa.array([r[2].refs for r in rows], REF),
                    pa.array([r[2].expanded for r in rows], pa.int64()),
                ],
                names=[f.split()[0] for f in ("conv_id", "turn", "role", "sort_text", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens")],
            )

    return small_batches(chosen).mapInArrow(scan, TURNS)


def in_order(formatted: DataFrame) -> DataFrame:
    """Turns of a conversation one after another in one partition."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "sort_text")


TURN_STRING = re.compile(r"<\|im_start\|>(.*?)\n(.*)<\|im_end\|>\n", re.DOTALL)


class Reading:
    """Running digests of one conversation, read back from its formatted strings."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_attachments = self.expanded_tokens = 0

    def add(self, formatted: str, start: int | None, end: int | None, attached: int, expanded: int) -> None:
        role, content = TURN_STRING.fullmatch(formatted).groups()
        self.turns.update(f"{unescaped_role(role)}\n{unescaped(content)}\n".encode())
        self.n_turns += 1
        self.formatted_chars += len(formatted)
        self.n_attachments += attached
        self.expanded_tokens += expanded
        if start is not None:
            said = unescaped(formatted[start:end])
            self.loss.update(said.encode())
            self.loss_chars += len(said)

    def row(self, conv: int | None) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.n_attachments, self.expanded_tokens


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its formatted strings say, and its attachments and their tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reading = None, None
        for batch in batches:
            done = []
            for conv, string, start, end, attached, expanded in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if reading is None or conv != current:
                    if reading is not None:
                        done.append(reading.row(current))
                    current, reading = conv, Reading()
                reading.add(string, start, end, attached, expanded)
            yield from rows(done)
        if reading is not None:
            yield from rows([reading.row(current)])

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], names=[f.split()[0] for f in READ_BACK.split(", ")])

    counted = formatted.withColumn("attached", F.size("attachments").cast("long")).drop("attachments")
    return in_order(counted).select("conv_id", "formatted", "loss_start", "loss_end", "attached", "expanded_tokens").mapInArrow(scan, READ_BACK)
