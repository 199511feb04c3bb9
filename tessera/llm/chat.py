"""Chat formatting with compiled templates.

``format_conversations`` renders every conversation to pieces of text with the spans of the loss mask; ``read_back`` parses
pieces into turns again.  Rows of a conversation are sorted by the shuffle, then streamed: a template's outer loop takes one turn
at a time, pieces are cut at ``PIECE`` characters, and reading keeps an unfinished turn only.  So a conversation of any number
of turns passes through without being held whole.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), role, text; repeated rows are turns
of their own; rows with a null ``conv_id`` are one conversation; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chat_template import END, LINE, TEMPLATE, TURN, Sink, Template, unescape
from tessera.llm.common import map_arrow

PIECE = 1 << 20
PIECES = "conv_id long, piece long, start long, text string, mask_starts array<long>, mask_ends array<long>, last boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Stream:
    """Consecutive rows of one conversation as messages, ending where the next conversation begins."""

    def __init__(self, parts: Iterator[pa.RecordBatch]):
        self.rows = (r for b in parts for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        self.held = next(self.rows, None)

    def messages(self) -> Iterator[dict]:
        conv = self.held[0]
        while self.held is not None and self.held[0] == conv:
            _, turn, role, text = self.held
            self.held = next(self.rows, None)
            yield {"role": role or "", "text": text or "", "turn": turn}


class _Pieces(Sink):
    """A sink whose text leaves in pieces."""

    def __init__(self, conv: int | None, size: int):
        super().__init__()
        self.conv, self.size, self.start, self.count = conv, size, 0, 0
        self.full: list[tuple] = []

    def write(self, x: str) -> None:
        super().write(x)
        if self.length - self.start >= self.size:
            self.leave(False)

    def leave(self, last: bool) -> None:
        spans = list(self.spans)
        if self.open_at is not None:  # a span that goes on is cut with the piece
            spans.append((self.open_at, self.length))
        text = "".join(self.parts)
        self.full.append((self.conv, self.count, self.start, text, [max(a, self.start) for a, b in spans], [b for a, b in spans], last))
        self.parts, self.spans, self.start, self.count = [], [], self.length, self.count + 1


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, piece: int = PIECE) -> DataFrame:
    """The columns of ``PIECES``; a conversation's pieces are consecutive rows of one partition, in order."""
    Template(template)  # a bad template fails here
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, stream, out, size = Template(template), _Stream(parts), [], 0
        while stream.held is not None:
            sink = _Pieces(stream.held[0], piece)
            compiled.render(stream.messages(), sink)
            sink.leave(True)
            for p in sink.full:
                out.append(p)
                size += len(p[3])
                if size >= 4 * piece or len(out) >= 1024:
                    yield _pieces_batch(out)
                    out, size = [], 0
        if out:
            yield _pieces_batch(out)

    return map_arrow(dealt, f, PIECES)


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "piece", "start", "text", "mask_starts", "mask_ends", "last"])


class Reader:
    """Parses what the built-in template writes, piece by piece."""

    def __init__(self):
        self.buffer, self.chars, self.turns, self.loss_chars = "", 0, 0, 0
        self.seen, self.loss, self.masked = hashlib.sha256(), hashlib.sha256(), ""

    def feed(self, text: str, start: int, spans: list[tuple[int, int]]) -> list[tuple[str, str]]:
        """The turns that this piece completes."""
        self.chars += len(text)
        for a, b in spans:
            self.masked += text[a - start : b - start]
        # a span may stop between an escape's two characters only where the piece does
        odd = len(self.masked) - len(self.masked.rstrip("\\"))
        done, self.masked = (self.masked[:-1], "\\") if odd % 2 else (self.masked, "")
        plain = unescape(done)
        self.loss_chars += len(plain)
        self.loss.update(plain.encode())
        out, at, self.buffer = [], 0, self.buffer + text
        while (end := self.buffer.find(END, at)) >= 0:
            if not self.buffer.startswith(TURN, at):
                raise ValueError(f"no turn at {at}")
            line = self.buffer.index(LINE, at)
            role, said = unescape(self.buffer[at + len(TURN) : line]), unescape(self.buffer[line + len(LINE) : end])
            self.turns += 1
            self.seen.update(f"{role}\n{said}\n".encode())
            out.append((role, said))
            at = end + len(END)
        self.buffer = self.buffer[at:]
        return out

    def digest(self) -> tuple:
        if self.buffer or self.masked:
            raise ValueError("the formatted text ends inside a turn")
        return self.turns, self.seen.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of ``READ``, from pieces as ``format_conversations`` leaves them."""

    def f(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for b in parts:
            out = []
            for conv, _, start, text, a, z, last in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                reader = reader or Reader()
                reader.feed(text, start, list(zip(a, z, strict=True)))
                if last:
                    out.append((conv, *reader.digest()))
                    reader = None
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    return map_arrow(formatted, f, READ)
