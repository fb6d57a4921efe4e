"""Chat formatting with typed content parts.

A message's content is an ordered list of parts: text, image, audio or document.  A
visitor walks them and writes one segment of formatted text per message: text parts are
escaped and written, other parts become ordered placeholders, their references and
expanded token counts recorded beside the segment.  Segments stand for themselves, so a
conversation of any length is rendered and read back message by message in parallel;
only digests over a whole conversation stream it in order, holding one running state.

Template: ``<s>[TURN role]text[/TURN]</s>`` for every message, placeholders
``[IMAGE 0]``, ``[AUDIO 1]``, ``[DOCUMENT 2]`` numbered in order within the message.  Inside texts and
roles a backslash is written before every backslash and every bracket that a control
string could begin or end with, and taken off again on reading.

Defined cases: null text or role is empty; messages are ordered by turn (nulls first),
then role and text; repeated rows are messages of their own; null conversation ids are
one conversation; a part of an unknown type raises.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[TURN ", "]", "[/TURN]</s>"
TRAINED_ROLE = "assistant"
SPECIAL = re.compile(r"[\\\[\]<>]")
ESCAPED = re.compile(r"\\(.)", re.S)
#: Expanded tokens: an image by its patches of 14 * 14 pixels, audio by the second, a document by the page.
PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 25, 1024

PARTS = "array<struct<type: string, text: string, ref: string, width: long, height: long, seconds: double, pages: long>>"
SEGMENT = "role string, segment string, loss_start long, loss_end long, attachments array<struct<ordinal: long, kind: string, ref: string, at: long, tokens: long>>, attachment_tokens long"


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visitor over a message's parts."""

    written: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        method = getattr(self, f"visit_{part['type']}", None)
        if method is None:
            raise ValueError(f"unknown content part: {part['type']!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self._write(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (-(-int(part.get(k) or 0) // PATCH) for k in ("width", "height"))
        self._attach("IMAGE", part, max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        self._attach("AUDIO", part, max(1, round((part.get("seconds") or 0.0) * AUDIO_TOKENS_A_SECOND)))

    def visit_document(self, part: dict) -> None:
        self._attach("DOCUMENT", part, max(1, int(part.get("pages") or 1)) * TOKENS_A_PAGE)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        ordinal = len(self.attachments)
        self.attachments.append({"ordinal": ordinal, "kind": kind.lower(), "ref": part.get("ref"), "at": self.length, "tokens": tokens})
        self._write(f"[{kind} {ordinal}]")

    def _write(self, text: str) -> None:
        self.written.append(text)
        self.length += len(text)


def render(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """(segment, loss start, loss end, attachments with places in the segment)."""
    head = OPEN + escape(role or "") + MIDDLE
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    body = "".join(flat.written)
    for a in flat.attachments:
        a["at"] += len(head)
    trained = role == TRAINED_ROLE
    return head + body + CLOSE, len(head), len(head) + len(body) if trained else len(head), flat.attachments


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every message of formatted text; placeholders stay as written."""
    found, at = [], 0
    while at < len(formatted):
        found.append(_read(formatted, at))
        at = found[-1][2]
    return [(role, text) for role, text, _ in found]


def _bare(text: str, mark: str, at: int) -> int:
    """The first place of an unescaped control string."""
    place = text.find(mark, at)
    while place >= 0:
        k = place
        while k > at and text[k - 1] == "\\":
            k -= 1
        if (place - k) % 2 == 0:
            return place
        place = text.find(mark, place + 1)
    raise ValueError("not formatted text")


def _read(formatted: str, at: int) -> tuple[str, str, int]:
    if not formatted.startswith(OPEN, at):
        raise ValueError("not formatted text")
    begin = at + len(OPEN)
    middle = _bare(formatted, MIDDLE, begin)
    close = _bare(formatted, CLOSE, middle + 1)
    return unescape(formatted[begin:middle]), unescape(formatted[middle + 1 : close]), close + len(CLOSE)


def text_parts(messages: DataFrame) -> DataFrame:
    """Messages whose content is plain ``text``: one text part each, never parsed."""
    part = F.named_struct(
        F.lit("type"), F.lit("text"), F.lit("text"), F.col("text"), F.lit("ref"), F.lit(None).cast("string"), F.lit("width"), F.lit(None).cast("long"),
        F.lit("height"), F.lit(None).cast("long"), F.lit("seconds"), F.lit(None).cast("double"), F.lit("pages"), F.lit(None).cast("long"),
    )
    return messages.withColumn("parts", F.array(part))


def format_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> conv_id, turn and the formatted segment of every message,
    its loss span, attachments and expanded attachment tokens.  A conversation's text is its
    segments in order of turn, role, segment."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for role, parts in zip(frame["role"], frame["parts"]):
                text, start, end, attached = render(role, [] if parts is None else [dict(p) for p in parts])
                rows.append((role or "", text, start, end, attached, sum(a["tokens"] for a in attached)))
            out = pd.DataFrame(rows, columns=["role", "segment", "loss_start", "loss_end", "attachments", "attachment_tokens"])
            out.insert(0, "turn", frame["turn"].to_numpy())
            out.insert(0, "conv_id", frame["conv_id"].to_numpy())
            yield out

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "parts").mapInPandas(run, f"conv_id long, turn long, {SEGMENT}")


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation from its formatted segments: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars.  Each partition is sorted and streamed with one running
    state, so a conversation may be longer than memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        of, state, done = None, None, []

        def closed() -> tuple:
            return (of, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for frame in frames:
            for conv, segment, start, end in zip(frame["conv_id"], frame["segment"], frame["loss_start"], frame["loss_end"]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != of:
                    if state is not None:
                        done.append(closed())
                    of, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                learned = unescape(segment[start:end])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(segment)
            if done:
                yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
                done = []
        if state is not None:
            yield pd.DataFrame([closed()], columns=names).astype({"conv_id": "Int64"})

    dealt = segments.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "segment")
    return dealt.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
