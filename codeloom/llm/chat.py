"""Chat formatting with a grammar round trip.

A conversation becomes one text: for each turn OPEN role NEWLINE text CLOSE NEWLINE. A deterministic
parser reads that grammar back. A turn is rendered plainly first; if the parser doesn't give back just
that turn, or finds a control string in it, control strings are escaped (a backslash goes in after their first character; one that
looks escaped gets one more), and if that should still differ, every character that could begin one is. Parsing undoes
either form, so every text comes back as it was.

Turns are rendered one by one and sorted by (conv_id, turn) within a partition, so a conversation of any
length streams through with only its digests in memory. Null texts and roles are empty. Turns with
equal numbers are ordered by role and then text. Rows with a null conv_id form one conversation.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: What a text may not hold unescaped: this template's marks and those of common others.
CONTROL = (OPEN, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_RAW = re.compile("|".join(map(re.escape, CONTROL)))
_LOOSE = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))
#: Marks that the whole text is escaped character by character.
_DEEP = "\\deep:"


class Conflict(ValueError):
    """A text that the grammar doesn't allow."""


def escape(text: str, level: int) -> str:
    """Level 0: as it is; 1: control strings, or what looks like escaped ones; 2: every character that could begin one."""
    if level == 0:
        return text
    if level == 1:
        return _LOOSE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
    return _DEEP + re.sub(r"[<\[\\]", lambda m: f"\\{ord(m[0]):02x}", text)


def unescape(text: str) -> str:
    if text.startswith(_DEEP):
        return re.sub(r"\\([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), text[len(_DEEP) :])
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted text; start and end are where its escaped text stands. Raises Conflict on anything that render() doesn't make."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise Conflict(f"no turn begins at {at}")
        at += len(OPEN)
        line, end = rendered.find("\n", at), rendered.find(CLOSE, at)
        if line < 0 or end < line:
            raise Conflict(f"the turn at {at} has no role line or no end")
        role, body = rendered[at:line], rendered[line + 1 : end]
        if _RAW.search(role) or _RAW.search(body):
            raise Conflict(f"a control string inside the turn at {at}")
        out.append((unescape(role), unescape(body), line + 1, end))
        at = end + len(CLOSE)
        if not rendered.startswith("\n", at):
            raise Conflict(f"no new line ends the turn at {at}")
        at += 1
    return out


def render_turn(role: str | None, text: str | None) -> str:
    """The rendering of one turn: the least escaped one that parses back to it."""
    role, text = role or "", text or ""
    # A role is one line; a line break in it is written as an escape that level 2 undoes.
    roles = [escape(role, n) for n in (0, 1)] if "\n" not in role else []
    deep = escape(role, 2).replace("\n", "\\0a")
    for r in [*roles, deep]:
        for level in (0, 1, 2):
            rendered = f"{OPEN}{r}\n{escape(text, level)}{CLOSE}\n"
            try:
                if [x[:2] for x in parse(rendered)] == [(role, text)]:
                    return rendered
            except Conflict:
                continue
    raise Conflict("no escape makes this turn parse")


def render(turns: list[tuple[str | None, str | None]]) -> str:
    return "".join(render_turn(r, t) for r, t in turns)


def _sorted(conversations: DataFrame) -> DataFrame:
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, role, rendered, and mask_start and mask_end: which code points of `rendered` count for the loss (null: none). A conversation's text is its turns' renderings in order of (turn, role, text)."""
    _store.arrow(conversations.sparkSession)
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rendered = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            spans = [parse(x)[0][2:] if r in learned else (None, None) for r, x in zip(roles, rendered, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rendered, pa.string()), pa.array([a for a, _ in spans], pa.int32()), pa.array([b for _, b in spans], pa.int32())], ["conv_id", "turn", "role", "rendered", "mask_start", "mask_end"])

    return plain.mapInArrow(run, "conv_id long, turn long, role string, rendered string, mask_start int, mask_end int")


class _Digest:
    """What is read back from the renderings of one conversation, turn by turn."""

    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, rendered: str, start: int | None, end: int | None) -> None:
        for role, text, _, _ in parse(rendered):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        if start is not None:
            body = unescape(rendered[start:end])
            self.loss.update(body.encode())
            self.loss_chars += len(body)
        self.chars += len(rendered)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, from its formatted text alone."""
    _store.arrow(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(_row(now, state))
                    now, state = conv, _Digest()
                rendered = render_turn(role, text)
                state.add(rendered, *(parse(rendered)[0][2:] if role == "assistant" else (None, None)))
            yield _batch(out)
        if state is not None:
            yield _batch([_row(now, state)])

    return _sorted(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _row(conv: int | None, d: _Digest) -> tuple:
    return conv, d.n, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_DIGESTS)], schema=_DIGESTS)
