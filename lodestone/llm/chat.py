"""Chat formatting by incremental black-box rendering.

A template is any function from turns, (role, text) pairs, to a string. It is called with the first 1, 2, 3, ... turns;
what a rendering adds to the one before is the newest turn's span. If a rendering does not begin with the one before,
the template rewrites history: this is reported, and the turns touched have no span. Within a span the text is found by
rendering the turn twice more with other texts: what these share at both ends is the template's, the rest is the text's.

Conversations are streamed in order of their turns. Of a template declared local (render.local = True: a turn's piece
depends on no other turn but the few before it) only the last turns are held: after PREFIX turns the renderings start
anew from the last KEEP ones if the next turn comes out the same from either start. A long conversation thus takes
bounded memory and time in proportion to its length. Of any other template all prefixes are rendered, however many, so
a rewrite is found wherever it comes; whole says so, or the opposite, for one call. Output comes in blocks of about
BLOCK characters.

The template here marks turns and puts a backslash into control strings that occur in texts, and doubles backslashes;
unescape() undoes this.

Defined cases: null texts and roles are empty; turns with equal numbers go by role, then text; null turn numbers come
first; null conv_ids are one conversation. No rows: no result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import partitions, small_batches

START, END = "<|start|>", "<|end|>"
CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
PREFIX, KEEP, BLOCK = 64, 8, 1 << 20
ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
UNESCAPE = re.compile(r"\\(\\?)")

Turn = tuple[str, str]


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def template(turns: list[Turn]) -> str:
    return "".join(f"{START}{quote(role, safe=' ')}\n{escape(text)}{END}\n" for role, text in turns)


template.local = True


def parse(piece: str) -> Turn:
    """A turn from its whole piece of the template's output."""
    if not piece.startswith(START) or not piece.endswith(f"{END}\n"):
        raise ValueError("no turn")
    role, _, text = piece[len(START) : -len(END) - 1].partition("\n")
    return unquote(role), unescape(text)


def shared(a: str, b: str, back: bool = False) -> int:
    """Length of the common beginning (end) of a and b."""
    if back:
        a, b = a[::-1], b[::-1]
    return len(os.path.commonprefix([a, b]))


class Renderer:
    """Feed turns, take each one's piece of output and its text's span in the piece; None once history was rewritten."""

    def __init__(self, render: Callable[[list[Turn]], str], anew: bool = False):
        self.render, self.anew, self.turns, self.before = render, anew, [], render([])
        self.opening, self.n, self.rewritten_at = self.before, 0, []
        self.frames: dict[tuple[str, bool], tuple[str, str]] = {}

    def _span(self, role: str, piece: str) -> tuple[int, int] | None:
        key = role, not self.turns
        for fresh in (False, True):
            if fresh or key not in self.frames:
                base = len(self.render(self.turns))
                a, b = (self.render([*self.turns, (role, x)])[base:] for x in ("a", "b"))
                self.frames[key] = a[: shared(a, b)], a[len(a) - shared(a, b, True) :]
            head, tail = self.frames[key]
            if len(piece) >= len(head) + len(tail) and piece.startswith(head) and piece.endswith(tail):
                return len(head), len(piece) - len(tail)
        return None

    def feed(self, role: str, text: str) -> tuple[str, tuple[int, int] | None] | None:
        after = self.render([*self.turns, (role, text)])
        if not after.startswith(self.before):
            self.rewritten_at.append(self.n)
        self.n += 1
        if self.rewritten_at:
            self.turns.append((role, text))
            self.before = after
            return None
        piece = after[len(self.before) :]
        span = self._span(role, piece)
        if self.anew and len(self.turns) >= PREFIX:
            short = self.turns[-KEEP:]
            base = self.render(short)
            again = self.render([*short, (role, text)])
            if again.startswith(base) and again[len(base) :] == piece:
                self.turns, after = short, again
        self.turns.append((role, text))
        self.before = after
        if n := len(self.opening):
            piece, self.opening = self.opening + piece, ""
            span = span and (span[0] + n, span[1] + n)
        return piece, span


def render_all(render, turns: list[Turn]) -> tuple[str, list[int], list[tuple[int, int] | None], list[int]]:
    """One conversation: output, ends of the turns' pieces, the texts' spans, and where history was rewritten.

    After a rewrite there are no ends, and spans only of the texts before the first place that changed.
    """
    r, out, ends, spans = Renderer(render), "", [], []
    for role, text in turns:
        if got := r.feed(role, text):
            spans.append(got[1] and (got[1][0] + len(out), got[1][1] + len(out)))
            out += got[0]
            ends.append(len(out))
    if not r.rewritten_at:
        return out or render([]), ends, spans, []
    whole = render(turns)
    same = shared(out, whole)
    return whole, [], [s if s and s[1] <= same else None for s in spans] + [None] * (len(turns) - len(spans)), r.rewritten_at


SCHEMA = "conv_id long, block int, text string, turn_ends array<int>, loss array<struct<start: int, end: int>>, rewritten_at array<int>"
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
KIND = pa.schema([("conv_id", pa.int64()), ("block", pa.int32()), ("text", pa.string()), ("turn_ends", pa.list_(pa.int32())), ("loss", pa.list_(SPAN)), ("rewritten_at", pa.list_(pa.int32()))])


class Blocks:
    """One conversation's turns to rows of output."""

    def __init__(self, conv: int | None, render, trained: str, whole: bool):
        self.conv, self.render, self.trained, self.whole = conv, render, trained, whole
        self.held: list[Turn] = []
        self.stream: Renderer | None = None
        self.n = 0
        self._new()

    def _new(self):
        self.text, self.ends, self.loss, self.at = [], [], [], 0

    def _row(self, text, ends, loss, rewritten):
        self.n += 1
        return {"conv_id": self.conv, "block": self.n - 1, "text": text, "turn_ends": ends, "loss": [{"start": a, "end": b} for a, b in loss], "rewritten_at": rewritten}

    def _add(self, role: str, text: str) -> list[dict]:
        got = self.stream.feed(role, text)
        if got is None:
            raise ValueError(f"the template rewrites history after {PREFIX} turns; format with whole=True")
        piece, span = got
        if span and role == self.trained:
            self.loss.append((self.at + span[0], self.at + span[1]))
        self.text.append(piece)
        self.at += len(piece)
        self.ends.append(self.at)
        return self._flush() if self.at >= BLOCK else []

    def _flush(self) -> list[dict]:
        row = self._row("".join(self.text), self.ends, self.loss, [])
        self._new()
        return [row]

    def add(self, role: str, text: str) -> list[dict]:
        if self.stream is not None:
            return self._add(role, text)
        self.held.append((role, text))
        if self.whole or len(self.held) <= PREFIX:
            return []
        held, self.held, self.stream = self.held, [], Renderer(self.render, anew=True)
        return [row for turn in held for row in self._add(*turn)]

    def close(self) -> list[dict]:
        if self.stream is not None:
            return self._flush() if self.text else []
        text, ends, spans, rewritten = render_all(self.render, self.held)
        loss = [s for s, (role, _) in zip(spans, self.held, strict=True) if s and role == self.trained]
        return [self._row(text, ends, loss, rewritten)]


def _format(render, trained, whole):
    def run(it):
        now = None
        for batch in it:
            rows = []
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv != conv:
                    rows += now.close() if now else []
                    now = Blocks(conv, render, trained, whole)
                rows += now.add(role, text)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=KIND)
        if now:
            yield pa.RecordBatch.from_pylist(now.close(), schema=KIND)

    return run


def format_chats(rows: DataFrame, render: Callable[[list[Turn]], str] = template, trained: str = "assistant", whole: bool | None = None) -> DataFrame:
    """Blocks of every conversation's output: conv_id, block, text, turn_ends, loss (spans of the trained role's texts), rewritten_at."""
    spark = rows.sparkSession
    whole = not getattr(render, "local", False) if whole is None else whole
    small_batches(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    turns = turns.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.mapInArrow(_format(render, trained, whole), SCHEMA)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(it):
    """Blocks in order to a row for each conversation, read from the output alone."""
    now, rows = None, []

    def close():
        conv, n, turns, chars, loss, size = now
        rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for batch in it:
        for conv, text, ends, loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "turn_ends", "loss")), strict=True):
            if now is None or now[0] != conv:
                if now:
                    close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for a, b in zip([0, *ends], ends, strict=False):
                role, said = parse(text[a:b])
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for s in loss:
                said = unescape(text[s["start"] : s["end"]])
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(text)
        yield from _rows(rows)
    if now:
        close()
        yield from _rows(rows)


def _rows(rows):
    if rows:
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        rows.clear()


def read_back(blocks: DataFrame) -> DataFrame:
    """Digests of every conversation's turns and of its text under the loss mask, from blocks of template()'s output."""
    dealt = blocks.repartition(partitions(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block")
    return dealt.mapInArrow(_read, READ)
