"""Chat formatting by event-sourced reconstruction.

A log holds events ``(conv_id, msg, seq, event, role, text)``.  It is partitioned by
conversation and sorted by message and sequence, and each message is folded:

* ``message``  the whole text of a message (replaces what it had);
* ``delta``    a streamed piece, appended;
* ``edit``     replaces the text so far;
* ``regenerate``  empties the message, and events of later messages that came before it in
  sequence are void (they answered the discarded text).

Sorting by message makes the fold a stream: it holds one message and the largest
regeneration so far, never a conversation, so a conversation with a third of all events
is folded in bounded memory.  Rendering writes ``<|im_start|>role\\ntext<|im_end|>\\n`` per
message into segments of bounded size, with the loss spans (code points) of the assistant
texts.  Inside texts every ``<``, backslashes, ``|`` gets one more backslash, so that no
control string can occur; ``unescape`` takes it away again.  ``read_back`` parses the
segments.

Cases: null text and role are empty; a null conversation, message or sequence number is a
value of its own, first in order; unknown events and messages without events are ignored;
equal (msg, seq) are ordered by event, role and text; a message left without text is a
turn with empty text; an empty log gives no rows; other columns of the log are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT_CHARS = 1 << 20
EVENTS = ("message", "delta", "edit", "regenerate")
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n<]", lambda m: _ROLE[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


def delta_events(messages: DataFrame, piece_chars: int = 512) -> DataFrame:
    """A log of streamed deltas from finished messages (conv_id, msg, role, text): pieces
    of ``piece_chars`` characters, at least one per message."""
    pieces = F.greatest(F.lit(1), F.ceil(F.length("text") / piece_chars)).cast("int")
    return messages.withColumn("seq", F.explode(F.sequence(F.lit(0), pieces - 1))).select(
        "conv_id", "msg", F.col("seq").cast("bigint").alias("seq"), F.lit("delta").alias("event"), "role",
        F.substr("text", F.col("seq") * piece_chars + 1, F.lit(piece_chars)).alias("text"))


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted events -> (conv_id, role, text) of each message that is left."""
    conv = msg = object()
    void_before = parts = role = alive = last_regen = None

    def rank(seq) -> tuple:
        return (seq is not None, seq or 0)

    for c, m, seq, event, r, text in rows:
        if c != conv or m != msg:
            if alive:
                yield conv, role, "".join(parts)
            if c != conv:
                void_before = None
            elif last_regen is not None and (void_before is None or last_regen > void_before):
                void_before = last_regen
            conv, msg, parts, role, alive, last_regen = c, m, [], "", False, None
        if event not in EVENTS or (void_before is not None and rank(seq) < void_before):
            continue
        alive = True
        role = r or role
        if event in ("message", "edit"):
            parts = [text or ""]
        elif event == "regenerate":
            parts, last_regen = [], rank(seq)
        else:
            parts.append(text or "")
    if alive:
        yield conv, role, "".join(parts)


def _render(messages: Iterator[tuple], segment_chars: int) -> Iterator[tuple]:
    """(conv_id, segment, formatted, loss spans), each segment of about ``segment_chars``."""
    conv, seg, held, size, spans = object(), 0, [], 0, []
    for c, role, text in messages:
        if held and (c != conv or size >= segment_chars):
            yield conv, seg, "".join(held), spans
            seg, held, size, spans = seg + 1, [], 0, []
        if c != conv:
            conv, seg = c, 0
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((size + len(head), size + len(head) + len(body)))
        held += [head, body, END, "\n"]
        size += len(head) + len(body) + len(END) + 1
    if held:
        yield conv, seg, "".join(held), spans


def render_conversations(events: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, segment, formatted, loss_start, loss_end): a conversation's text is its
    segments in order; the loss spans are code points inside the segment."""
    log = events.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("msg").cast("bigint").alias("msg"),
        F.col("seq").cast("bigint").alias("seq"), "event", "role", "text")
    laid = log.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "msg", "seq", "event", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        chars = 0
        for conv, seg, text, spans in _render(_fold(rows), segment_chars):
            out.append((conv, seg, text, [s for s, _ in spans], [e for _, e in spans]))
            chars += len(text)
            if chars >= segment_chars:
                yield _batch(out)
                out, chars = [], 0
        if out:
            yield _batch(out)

    return laid.mapInArrow(run, "conv_id bigint, segment int, formatted string, loss_start array<int>, loss_end array<int>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([
        pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()),
        pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.list_(pa.int32()))],
        ["conv_id", "segment", "formatted", "loss_start", "loss_end"])


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted segment, unescaped."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("not a formatted conversation")
        head = formatted.index("\n", at)
        end = formatted.index(END, head)
        yield unescape_role(formatted[at + len(START): head]), unescape(formatted[head + 1: end])
        at = end + len(END) + 1


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation parsed from ``render_conversations``' output, whose
    partitions hold a conversation's segments in order: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = object(), None, []
        for batch in batches:
            for c, text, starts, ends in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if c != conv or state is None:
                    if state is not None:
                        out.append((conv, *state))
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for s, e in zip(starts, ends):
                    body = unescape(text[s:e])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(out) >= 10_000:
                yield digests(out)
                out = []
        if state is not None:
            out.append((conv, *state))
        if out:
            yield digests(out)

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2].hexdigest() for r in rows]), pa.array([r[3] for r in rows], pa.int64()),
            pa.array([r[4].hexdigest() for r in rows]), pa.array([r[5] for r in rows], pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return segments.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def message_number(conv: str = "conv_id", *order: str) -> Column:
    """0-based place of a row in its conversation (a window that sorts and spills)."""
    from pyspark.sql import Window

    return (F.row_number().over(Window.partitionBy(conv).orderBy(*order)) - 1).cast("bigint")
