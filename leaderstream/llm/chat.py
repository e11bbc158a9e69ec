"""Conversations as training text with a loss mask, by columnar byte assembly.

A turn is ``<s>role``, a line break, the text, ``</s>`` and a line break. In roles and texts a backslash goes before each
``\\``, ``<`` and ``[``, so no control string can occur there, and in roles before line breaks; without it they are as they were.

All turns of an Arrow batch are put together at once: lengths of all segments, their cumulative offsets, and from
these the place of each byte, written into one buffer that becomes the column of formatted texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import text_or_empty

BEGIN, LINE, END = b"<s>", b"\n", b"</s>\n"
LEARNED = "assistant"

_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b"\\<[")] = True
_IN_ROLE = _ESCAPED.copy()
_IN_ROLE[ord("\n")] = True
_TURN = re.compile(rb"<s>((?:\\.|[^\\<\n])*+)\n((?:\\.|[^\\<])*+)</s>\n", re.DOTALL)
_MARK = re.compile(rb"\\(.)", re.DOTALL)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sizes(raw: np.ndarray, offsets: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes get a backslash, and the length of each text with them."""
    mark = marked[raw]
    marks = np.concatenate([[0], np.cumsum(mark)])
    return mark, np.diff(offsets) + np.diff(marks[offsets])


def _scatter(out: np.ndarray, begins: np.ndarray, raw: np.ndarray, offsets: np.ndarray, mark: np.ndarray) -> None:
    marks = np.cumsum(mark)
    before = np.concatenate([[0], marks])[offsets[:-1]]
    place = np.arange(len(raw)) + marks + np.repeat(begins - offsets[:-1] - before, np.diff(offsets))
    out[place] = raw
    out[place[mark] - 1] = ord("\\")


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn begins (one more entry than turns), and where its text begins and ends."""
    role, role_at = _bytes(roles)
    text, text_at = _bytes(texts)
    role_mark, role_size = _sizes(role, role_at, _IN_ROLE)
    text_mark, text_size = _sizes(text, text_at, _ESCAPED)
    sizes = len(BEGIN) + role_size + len(LINE) + text_size + len(END)
    turns = np.concatenate([[0], np.cumsum(sizes)])
    role_begins = turns[:-1] + len(BEGIN)
    lines = role_begins + role_size
    text_begins = lines + len(LINE)
    text_ends = text_begins + text_size
    out = np.empty(turns[-1], np.uint8)
    for piece, begins in ((BEGIN, turns[:-1]), (LINE, lines), (END, text_ends)):
        out[begins[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    _scatter(out, role_begins, role, role_at, role_mark)
    _scatter(out, text_begins, text, text_at, text_mark)
    return out, turns, text_begins, text_ends


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def whole(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids = _ids(rows)
        data, turns, begins, ends = assemble(rows.column("role").chunk(0), rows.column("text").chunk(0))
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        last = np.append(first[1:], len(ids))
        learned = np.flatnonzero(rows.column("role").to_numpy() == LEARNED)
        base = np.repeat(turns[first], last - first)
        spans = pa.array(np.searchsorted(learned, np.append(first, len(ids))).astype(np.int32))
        lists = lambda x: pa.ListArray.from_arrays(spans, pa.array((x - base)[learned].astype(np.int64)))
        offsets = pa.py_buffer(np.append(turns[first], turns[-1]).astype(np.int64))
        texts = pa.Array.from_buffers(pa.large_string(), len(first), [None, offsets, pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays(
            [
                rows.column("conv_id").chunk(0).take(pa.array(first)),
                pa.array((last - first).astype(np.int64)),
                texts.cast(pa.string()),
                lists(begins),
                lists(ends),
            ],
            names=["conv_id", "n_turns", "formatted", "loss_begins", "loss_ends"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        # The last conversation may go on in the next batch.
        ids = _ids(pa.Table.from_batches([batch]))
        new = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if held and ids[0] != _ids(pa.Table.from_batches([held[-1]]))[-1]:
            yield whole(pa.Table.from_batches(held))
            held = []
        if len(new):
            yield whole(pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))]))
            held = []
        held.append(batch.slice(int(new[-1]) if len(new) else 0))
    if held:
        yield whole(pa.Table.from_batches(held))


def _ids(rows: pa.Table) -> np.ndarray:
    """Ids to compare; NULL is an id like others."""
    return np.array([repr(x) for x in rows.column("conv_id").to_pylist()])


def formatted(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id``, ``n_turns``, ``formatted``, ``loss_begins`` and ``loss_ends``, a row for each conversation.

    Turns go by ``turn`` (NULL first), equal ones by role and text. A NULL role or text is empty, rows with a NULL
    ``conv_id`` are one conversation. The loss mask covers the texts of assistants and no mark around
    them; its spans are byte offsets in the UTF-8 of ``formatted``. A conversation is one value, so
    it has to fit in memory; a task holds one at a time. Other columns are ignored. No turns: no rows.
    """
    id_type = turns.schema[conv_id].dataType.simpleString()
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        text_or_empty(role).alias("role"),
        text_or_empty(text).alias("text"),
        F.col(turn).alias("turn"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {id_type}, n_turns bigint, formatted string, loss_begins array<bigint>, loss_ends array<bigint>"
    return rows.drop("turn").mapInArrow(_format, schema)


def parse(data: bytes) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; ``ValueError`` where it is none."""
    turns, at = [], 0
    for found in _TURN.finditer(data):
        if found.start() != at:
            break
        turns.append(tuple(_MARK.sub(rb"\1", part).decode() for part in found.groups()))
        at = found.end()
    if at != len(data):
        raise ValueError("not a formatted conversation")
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_turns, turns_sha, loss_chars, loss_sha, chars = [], [], [], [], []
        for text, begins, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            data = text.encode()
            turns = parse(data)
            learned = "".join(_MARK.sub(rb"\1", data[a:b]).decode() for a, b in zip(begins, ends, strict=True))
            n_turns.append(len(turns))
            turns_sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            loss_chars.append(len(learned))
            loss_sha.append(hashlib.sha256(learned.encode()).hexdigest())
            chars.append(len(text))
        columns = [
            batch.column(0),
            pa.array(n_turns, pa.int64()),
            pa.array(turns_sha, pa.string()),
            pa.array(loss_chars, pa.int64()),
            pa.array(loss_sha, pa.string()),
            pa.array(chars, pa.int64()),
        ]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def digest(conversations: DataFrame) -> DataFrame:
    """What the formatted texts and their masks say, read back: turns, learned text and lengths."""
    rows = conversations.select("conv_id", "formatted", "loss_begins", "loss_ends")
    id_type = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(
        _digest,
        f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
