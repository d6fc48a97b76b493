"""Chat formatting: conversations rendered by a compiled template, with a loss mask, and read back from the output.

The template marks turns with control strings; the `escape` filter makes texts free of them, reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import prepare
from flowmill.llm.template import Template

#: The control strings of the default template. A turn is HEAD role NEXT text END.
HEAD, NEXT, END = "### ", ":\n", "\n</turn>\n"
DEFAULT = (
    "{% for m in messages %}### {{ m.role | escape_role }}:\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% end %}"
    "{% else %}{{ m.text | escape }}{% end %}\n</turn>\n{% end %}"
)
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str | None) -> str:
    """A backslash before every backslash and before each control string: `###` and `</turn>` never stand bare."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text or "")


def escape_role(role: str | None) -> str:
    """As escape, and line breaks and colons too, so that a role ends at the first bare `:`."""
    return re.sub(r"[\n:]", lambda m: "\\" + m[0], escape(role))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS = {"escape": escape, "escape_role": escape_role}


def _bare(text: str, mark: str, at: int) -> int:
    """Where `mark` first stands at or after `at` without an odd number of backslashes before it; -1 if nowhere."""
    while (at := text.find(mark, at)) >= 0:
        back = at
        while back and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1
    return -1


class Reader:
    """Reads turns back from formatted text that arrives in pieces; keeps no more than the open turn."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self._text: list[str] = []
        self._mask: list[tuple[int, int]] = []
        self._at = 0

    def feed(self, pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str]]:
        for piece, trained in pieces:
            if trained:
                self._mask.append((self._at, self._at + len(piece)))
            self._text.append(piece)
            self._at += len(piece)
            self.chars += len(piece)
            if "</turn>" in piece:
                yield from self._closed()

    def _closed(self) -> Iterator[tuple[str, str]]:
        text, at = "".join(self._text), 0
        while (end := _bare(text, END, at)) >= 0:
            if not text.startswith(HEAD, at):
                raise ValueError("formatted text doesn't begin with a turn")
            cut = _bare(text, NEXT, at)
            role, body = unescape(text[at + len(HEAD) : cut]), unescape(text[cut + len(NEXT) : end])
            for x in (role, "\n", body, "\n"):
                self.turn_hash.update(x.encode("utf-8", "surrogatepass"))
            for a, b in self._mask:
                if a < end:
                    trained = unescape(text[a:b])
                    self.loss_chars += len(trained)
                    self.loss_hash.update(trained.encode("utf-8", "surrogatepass"))
            at, self.turns = end + len(END), self.turns + 1
            self._mask = [(a, b) for a, b in self._mask if a >= end]
            yield role, body
        self._text = [text[at:]]
        self._mask = [(a - at, b - at) for a, b in self._mask]
        self._at = len(text) - at


def format_one(messages: Iterable[dict], template: Template | None = None) -> tuple[str, list[tuple[int, int]]]:
    """One conversation's whole text and its loss spans."""
    return (template or Template(DEFAULT, FILTERS)).render(messages=messages)


@dataclass(frozen=True)
class Columns:
    conv: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"


def _turns(rows: DataFrame, c: Columns) -> DataFrame:
    """Rows of a conversation together and in order: by turn, nulls first, ties by role, then text."""
    picked = rows.select(F.col(c.conv).alias("conv"), F.col(c.turn).alias("turn"), F.col(c.role).alias("role"), F.col(c.text).alias("text"))
    return picked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation's id and a lazy iterator of its messages, across batch borders."""
    rows = ((k, {"role": r or "", "text": t or ""}) for b in batches for k, r, t in zip(*(x.to_pylist() for x in b.columns)))
    held = next(rows, None)
    while held is not None:
        key, waiting = held[0], True

        def messages() -> Iterator[dict]:
            nonlocal held, waiting
            while held is not None and held[0] == key:
                message = held[1]
                held = next(rows, None)
                yield message

        yield key, messages()
        while held is not None and held[0] == key:
            held = next(rows, None)


FORMATTED = "conv_id long, formatted string, loss_starts array<int>, loss_ends array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(rows: DataFrame, template: str = DEFAULT, columns: Columns = Columns()) -> DataFrame:
    """One row per conversation: its formatted text and the spans (code points) under the loss mask.

    Null role or text counts as empty; a null conversation id is a conversation of its own. Rows that tie on turn
    go by role, then text, and repeated rows are repeated turns. An empty table gives no row; other columns are ignored.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32()))])

    def run(batches):
        compiled = Template(template, FILTERS)
        for key, messages in _conversations(batches):
            text, spans = compiled.render(messages=messages)
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "formatted": text, "loss_starts": [a for a, _ in spans], "loss_ends": [b for _, b in spans]}], schema)

    prepare(rows.sparkSession)
    return _turns(rows, columns).mapInArrow(run, FORMATTED)


def read_back(rows: DataFrame, template: str = DEFAULT, columns: Columns = Columns()) -> DataFrame:
    """One row per conversation of what a reader gets from the formatted output (see DIGESTS).

    Rendering and reading are streams: a worker holds one open turn, however long the conversation is. The digests
    are over all of a conversation's turns in order, so one conversation is read by one task, a batch at a time.
    Edge cases are those of format_conversations.
    """
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    schema = pa.schema([(n, pa.string() if "sha256" in n else pa.int64()) for n in names])

    def run(batches):
        compiled, out = Template(template, FILTERS), []
        for key, messages in _conversations(batches):
            reader = Reader()
            for _ in reader.feed(compiled.stream(messages=messages)):
                pass
            out.append((key, reader.turns, reader.turn_hash.hexdigest(), reader.loss_chars, reader.loss_hash.hexdigest(), reader.chars))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    prepare(rows.sparkSession)
    return _turns(rows, columns).mapInArrow(run, DIGESTS)
