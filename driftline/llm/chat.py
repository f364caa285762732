"""Chat formatting with a grammar round trip.

A turn is rendered as ``<|im_start|>`` role newline text ``<|im_end|>`` newline. The parser reads control strings
as such wherever they stand, and takes one backslash off the look-alikes ``<|\\...im_start|>``. After rendering, the
text is parsed and compared with the source; turns that don't come back are escaped (one more backslash in each
control string and look-alike) and rendered again, until the whole comes back. One escape suffices for any text,
as it turns every control string into a look-alike and the parser undoes it exactly; turns that come back
unescaped stay as they are.

Turns go in order of turn, then role and text where turn ties; repeated rows are turns of their own. Null text or
role counts as empty; a null conv_id is a conversation of its own. A conversation is written in segments of whole
turns of about ``SEGMENT`` characters, so that one of any length streams through a task; its formatted text is its
segments, one after the other. The loss mask spans the texts of assistant turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<\|(\\*)(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\|\\(\\*)(im_start|im_end)\|>")
TURN = re.compile(re.escape(START) + r"(.*)\n", re.A)
SEGMENT = 1 << 20
Turn = tuple[str, str]


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return CONTROL.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<|\1\2|>", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[Turn], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and its loss mask."""
    out, mask, at = [], [], 0
    for i, (role, text) in enumerate(turns):
        body = escape(text) if i in escaped else text
        head = f"{START}{_escape_role(role)}\n"
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{END}\n"
        out.append(piece)
        at += len(piece)
    return "".join(out), mask


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted text; GrammarError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        head = TURN.match(formatted, at)
        if not head:
            raise GrammarError(f"no turn at {at}")
        end = formatted.find(END, head.end())
        if end < 0 or formatted.find(START, head.end(), end) >= 0 or formatted[end + len(END) : end + len(END) + 1] != "\n":
            raise GrammarError(f"turn at {at} isn't closed")
        turns.append((_unescape_role(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(END) + 1
    return turns


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """Render, parse back, escape what differs, until identical."""
    escaped: set[int] = set()
    while True:
        formatted, mask = render(turns, escaped)
        try:
            back = parse(formatted)
        except GrammarError:
            back = []
        if back == turns:
            return formatted, mask
        more = {i for i, (_, text) in enumerate(turns) if i not in escaped and CONTROL.search(text)}
        if not more:
            raise GrammarError("turns don't survive the round trip")
        escaped |= more


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


_MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment (from 0), formatted, mask; the segments of a conversation stand together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            formatted, mask = format_turns(turns)
            spans = pa.array([[{"start": a, "end": z} for a, z in mask]], _MASK)
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([number], pa.int32()), pa.array([formatted]), spans], ["conv_id", "segment", "formatted", "mask"])

        conv, number, turns, size, kind = None, 0, [], 0, pa.int64()
        for b in batches:
            kind = b.column("conv_id").type
            for c, role, text in _groups([b], ["conv_id", "role", "text"]):
                if turns and (c != conv or size >= segment):
                    yield made()
                    number, turns, size = number + 1, [], 0
                if c != conv:
                    number = 0
                conv = c
                turns.append((role or "", text or ""))
                size += len(text or "")
        if turns:
            yield made()

    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, segment int, formatted string, mask array<struct<start:bigint,end:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of format_conversations() says: turns and loss text, by parsing it; one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def made() -> pa.RecordBatch:
            values = [[conv], [n], [all_.hexdigest()], [chars], [loss.hexdigest()], [size]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

        open_, conv = False, None
        for b in batches:
            kind = b.column("conv_id").type
            for c, number, text, mask in _groups([b], ["conv_id", "segment", "formatted", "mask"]):
                if number == 0:
                    if open_:
                        yield made()
                    open_, conv, n, chars, size, all_, loss = True, c, 0, 0, 0, sha256(), sha256()
                for role, said in parse(text):
                    n += 1
                    all_.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                for span in mask:
                    said = unescape(text[span["start"] : span["end"]])
                    chars += len(said)
                    loss.update(said.encode("utf-8", "replace"))
                size += len(text)
        if open_:
            yield made()

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_probe(rows: DataFrame, conv_id: int, said: str) -> DataFrame:
    """``rows`` and a conversation of a user and an assistant row that both say ``said``."""
    probe = rows.sparkSession.createDataFrame([(conv_id, 0, "user", said), (conv_id, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe.select(*[F.col(n).cast(rows.schema[n].dataType) for n in probe.columns]))
