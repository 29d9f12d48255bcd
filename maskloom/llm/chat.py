"""Chat formatting by a template that is only called, never read.

The template is a function from turns, (role, text) pairs, to a string. It is called on successive prefixes of a
conversation; what a prefix adds to the one before it is its last turn's span, and a prefix that doesn't begin with the one
before it shows that the template rewrites history. Inside a span the text is located by calling the template once more
with a probe for the text: what stands before and behind the probe stands before and behind the text.

Rows come by conversation and turn, ties by role and text, and are taken as a stream. Every prefix is whole, so a conversation
of n turns is held by its task and costs n renderings of up to n turns. Only a template that is declared ``local``, as
``marked`` is, is spared that: what it writes for a turn depends on no other turn but the last ``context`` ones. Of its
conversations the prefixes of the first ``block`` turns are whole, and after that a new prefix begins with the last
``context`` turns, so each turn costs a bounded rendering and no conversation is gathered. Digests run over a conversation's
turns in order, so one conversation is one task's stream however long it is. Null texts and roles are empty, a null turn comes first, rows of null
conv_id are one conversation. No conversations give no rows. Only the four columns named are looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

_PROBE = "probe"
_ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"), ("\n", "\\n"))
_BACK = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":", "n": "\n"}


def escaped(text: str, pairs=_ESCAPES) -> str:
    """The text without any control string of the template, from which it can be told."""
    for a, b in pairs:
        text = text.replace(a, b)
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\hecn])", lambda m: _BACK[m[1]], text)


def marked(turns: list[Turn]) -> str:
    """The template of the query: ``### role: text </turn>`` a turn, control strings inside escaped."""
    return "".join(f"### {escaped(role, _ROLE_ESCAPES)}: {escaped(text)} </turn>\n" for role, text in turns)


def read_back(formatted: str) -> list[Turn]:
    """The turns of what ``marked`` wrote."""
    out = []
    for piece in formatted.split(" </turn>\n")[:-1]:
        role, _, text = piece.removeprefix("### ").partition(": ")
        out.append((unescaped(role), unescaped(text)))
    return out


class Span(NamedTuple):
    piece: str  # what the turn adds
    start: int  # of the piece in the whole output
    first: int  # of the text in the piece; -1 if it can't be told
    last: int
    rewritten: int | None  # the earliest turn that rendering this one changed


class Spans:
    """Spans of a conversation's turns, one after the other."""

    def __init__(self, template: Template, block: int, context: int, local: bool):
        self.template, self.block, self.context, self.local = template, block, context, local
        self.turns: list[Turn] = []
        self.before = template([])
        self.ends: list[int] = [len(self.before)]
        self.at, self.n = len(self.before), 0

    def add(self, turn: Turn) -> Span:
        if self.local and len(self.turns) >= self.block + self.context:
            self.turns = self.turns[-self.context :] if self.context else []
            self.ends = [len(self.template(self.turns[:i])) for i in range(len(self.turns) + 1)]
            self.before = self.template(self.turns)
        now = self.template([*self.turns, turn])
        rewritten, keep = None, len(self.before)
        if not now.startswith(self.before):
            keep = next((i for i, (a, b) in enumerate(zip(now, self.before, strict=False)) if a != b), min(len(now), len(self.before)))
            local = sum(e <= keep for e in self.ends) - 1
            rewritten = self.n - len(self.turns) + max(0, local)
        piece = now[keep:]
        probe = self.template([*self.turns, (turn[0], _PROBE)])[keep:]
        first = probe.find(_PROBE)
        last = len(piece) - (len(probe) - first - len(_PROBE)) if first >= 0 else -1
        out = Span(piece, self.at - (len(self.before) - keep), first, last, rewritten)
        self.turns.append(turn)
        self.ends.append(len(now))
        self.at += len(now) - len(self.before)
        self.before = now
        self.n += 1
        return out


def _ordered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    c = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)


def formatted(conversations: DataFrame, template: Template = marked, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn_from: str = "assistant", block: int = 64, context: int = 2, local: bool | None = None) -> DataFrame:
    """One row per turn: conv_id, n (0-based), turn, role, piece, start, text_first, text_last, in_loss, rewrites.

    The pieces of a conversation in order are its output (what the template says before any turn left out), unless rewrites
    (the earliest turn that this one changed) is set on some. text_first and text_last bound the text in the whole output, in
    code points; in_loss marks the texts to learn from. local is whether the template is; only ``marked`` is taken to be.
    """
    local = template is marked if local is None else local
    ordered = _ordered(conversations, conv_id, turn, role, text)
    kind = ordered.schema["conv_id"].dataType.simpleString(), ordered.schema["turn"].dataType.simpleString()
    names = ["conv_id", "n", "turn", "role", "piece", "start", "text_first", "text_last", "in_loss", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, last, new = None, None, True
        for b in batches:
            out: list[tuple] = []
            for c, t, r, x in _rows(iter([b])):
                if new or c != last:
                    spans, last, new = Spans(template, block, context, local), c, False
                s = spans.add((r, x))
                located = s.first >= 0
                out.append((c, spans.n - 1, t, r, s.piece, s.start, s.start + s.first if located else None, s.start + s.last if located else None, r == learn_from, s.rewritten))
            if out:
                kinds = [b.schema.field("conv_id").type, pa.int64(), b.schema.field("turn").type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return ordered.mapInArrow(run, f"conv_id {kind[0]}, n long, turn {kind[1]}, role string, piece string, start long, text_first long, text_last long, in_loss boolean, rewrites long")


def digests(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn_from: str = "assistant", block: int = 64, context: int = 2) -> DataFrame:
    """One row per conversation, read back from its output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_history."""
    ordered = _ordered(conversations, conv_id, turn, role, text)
    kind = ordered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, last, sums, type_ = None, None, None, None

        def row() -> tuple:
            n, turns, chars, loss, size, rewrites = sums
            return last, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            type_, out = b.schema.field("conv_id").type, []
            for c, _, r, x in _rows(iter([b])):
                if sums is None or c != last:
                    if sums is not None:
                        out.append(row())
                    spans, last = Spans(marked, block, context, True), c
                    sums = [0, hashlib.sha256(), 0, hashlib.sha256(), spans.at, False]
                s = spans.add((r, x))
                for back_role, back_text in read_back(s.piece):
                    sums[0] += 1
                    sums[1].update(f"{back_role}\n{back_text}\n".encode("utf-8", "surrogatepass"))
                    if back_role == learn_from:
                        under = unescaped(s.piece[s.first : s.last])
                        sums[2] += len(under)
                        sums[3].update(under.encode("utf-8", "surrogatepass"))
                sums[4] = spans.at
                sums[5] |= s.rewritten is not None
            if out:
                yield made(out)
        if sums is not None:
            yield made([row()])

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
