"""Document fingerprints by locally consistent parsing.

A text is read as bytes and parsed into phrases, those into longer phrases, and so on. On
each level

1. a run of equal symbols becomes symbols for up to ``PIECE`` of them; if that makes more than
   one, each is a phrase of its own;
2. deterministic coin tossing gives each symbol a label: the lowest bit in which it differs
   from the symbol before it, and that bit's value. Neighbours keep different labels, and a
   few rounds leave fewer than eight labels;
3. a symbol whose label is larger than both its neighbours' opens a phrase;
4. a phrase is named by a hash of the symbols in it, and is a symbol of the next level.

Where phrases begin depends on a few symbols around that place only, so equal strings have
equal names inside, wherever they stand. The root is the name of all names of the first level.

The fingerprint is the root and a sketch: for each of ``LEVELS`` the least hashes of the
phrase names, one in each of ``SLOTS`` slots, 16 bits each. The second, third, ... phrase of one
name in a text count as names of their own, so repetitive texts are told apart by how much they repeat. A
text that a level leaves as a single phrase has one phrase on the levels above. The likeness of two fingerprints is the share
of slots that agree among those that either fills, and 1 for equal fingerprints.

Defined results: null and empty texts are equal and have no phrases, so their likeness to
other texts is 0; equal texts have equal fingerprints. The next document is the next row by id
(nulls first; equal ids by a hash of the text, equal rows in any order), after the last row
comes the first, so a single document follows itself. An empty table gives no rows. Columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.arrays import PART_BYTES, flat, mixed, parts, powers
from rowsmith.llm.common import col
from rowsmith.plans import durable

LEVELS = (2, 3)  # of the sketch: phrases of about 15 and 50 bytes
SLOTS = 32  # a level
PIECE = 4  # equal symbols in a row that are taken together
EDIT = 4  # one part in so many of a text is replaced
_EMPTY = 0xFFFF
_TOSSES = 4  # 64 bits, then 7, 4 and 3
_SALT = np.uint64(0x5851F42D4C957F2D)


def _tossed(names: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Labels below 8 that differ between neighbours of a text; ``opens`` marks first symbols."""
    label = names
    for _ in range(_TOSSES):
        d = np.empty_like(label)
        d[1:] = label[1:] ^ label[:-1]
        d[opens] = 1  # a first symbol tosses its lowest bit
        low = d & (~d + np.uint64(1))
        at = (low.astype(np.float64).view(np.int64) >> 52) - 1023
        label = at.astype(np.uint64) * np.uint64(2) + ((label & low) != 0)
    return label.astype(np.uint8)


def _byte_labels() -> np.ndarray:
    """The first toss of two neighbouring bytes, by table."""
    before, own = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    d = before ^ own
    low = d & -d
    at = np.log2(np.where(low == 0, 1, low)).astype(np.int64)
    return (at * 2 + ((own & low) != 0)).astype(np.uint8).reshape(-1)


_FIRST_TOSS = _byte_labels()
_NEXT_TOSS = _FIRST_TOSS.reshape(256, 256)[:16, :16].reshape(-1).copy()


def _tossed_bytes(symbols: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """As ``_tossed`` for bytes, which need three tosses."""
    pair = symbols.astype(np.uint16)
    pair[1:] |= symbols[:-1].astype(np.uint16) << np.uint16(8)
    label = _FIRST_TOSS[pair]
    label[opens] = symbols[opens] & 1
    for _ in range(2):
        pair = label.copy()
        pair[1:] |= label[:-1] << np.uint8(4)
        after = _NEXT_TOSS[pair]
        after[opens] = label[opens] & 1
        label = after
    return label


def _starts(row: np.ndarray) -> np.ndarray:
    """Where the symbols of a text begin; ``row`` is the text of each symbol."""
    out = np.ones(len(row), dtype=bool)
    out[1:] = row[1:] != row[:-1]
    return out


def _next_level(names: np.ndarray, row: np.ndarray, labels) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one level and their texts."""
    opens = _starts(row)
    fresh = opens.copy()
    fresh[1:] |= names[1:] != names[:-1]
    run = np.flatnonzero(fresh)
    length = np.diff(run, append=len(names))
    inside = np.arange(len(names)) - np.repeat(run, length)
    at = np.flatnonzero(inside % PIECE == 0)
    alone = np.repeat(length > PIECE, length)[at]
    length = np.diff(at, append=len(names))
    base, row, opens = names[at], row[at], opens[at]
    label = labels(base, opens | alone)
    name = mixed(base.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    runs = length > 1
    name[runs] = mixed(name[runs] + length[runs].astype(np.uint64) * _SALT)
    cut = opens | alone
    cut[1:] |= alone[:-1]
    cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~opens[2:]
    at = np.flatnonzero(cut)
    return _named(name, at), row[at]


def _numbered(names: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each name, how many equal ones its text has before it."""
    order = np.lexsort((names, row))
    name, text = names[order], row[order]
    fresh = np.ones(len(name), dtype=bool)
    fresh[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(fresh)
    out = np.empty(len(name), dtype=np.uint64)
    out[order] = np.arange(len(name)) - np.repeat(start, np.diff(start, append=len(name)))
    return out


def _named(name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One name for each stretch of names that begins at ``at``."""
    p, inverse = powers(len(name) + 1)
    sums = np.zeros(len(name) + 1, dtype=np.uint64)
    np.cumsum(name * p[: len(name)], out=sums[1:])
    end = np.append(at[1:], len(name))
    return mixed((sums[end] - sums[at]) * inverse[at] + (end - at).astype(np.uint64) * _SALT)


def phrases(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(names, text of each name)`` of level 1, 2, ... for texts that lie one after another."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    names, row = _next_level(data, row, _tossed_bytes)
    while True:
        yield names, row
        names, row = _next_level(names, row, _tossed)


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint of each text: 8 bytes of its root, then the slots as 16-bit numbers."""
    n = len(offsets) - 1
    out = np.full((n, 4 + len(LEVELS) * SLOTS), _EMPTY, dtype=np.uint16)
    root = np.zeros(n, dtype=">u8")
    if offsets[-1] > 0:
        for level, (names, row) in enumerate(phrases(data, offsets), 1):
            if level == 1:
                first = np.flatnonzero(_starts(row))
                root[row[first]] = _named(names, first)
            if level in LEVELS:
                h = mixed(mixed(names + _numbered(names, row) * _SALT) + np.uint64(level))
                slot = (h % np.uint64(SLOTS)).astype(np.int64)
                value = np.minimum(h >> np.uint64(48), _EMPTY - 1).astype(np.uint16)
                least = np.full(n * SLOTS, _EMPTY, dtype=np.uint16)
                np.minimum.at(least, row * SLOTS + slot, value)
                lo = 4 + LEVELS.index(level) * SLOTS
                out[:, lo : lo + SLOTS] = least.reshape(n, SLOTS)
            if level == LEVELS[-1]:
                break
    out[:, :4] = root.view(">u2").reshape(n, 4)
    return out


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """Fingerprints of a column of texts, worked off in parts of bounded size."""
    data, offsets = flat(column)
    out = [sketches(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in parts(offsets)]
    return np.concatenate(out) if out else np.zeros((0, 4 + len(LEVELS) * SLOTS), dtype=np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    x, y = a[:, 4:], b[:, 4:]
    filled = ((x != _EMPTY) | (y != _EMPTY)).sum(axis=1)
    agree = ((x == y) & (x != _EMPTY)).sum(axis=1)
    return np.where((a == b).all(axis=1), 1.0, agree / np.maximum(filled, 1))


def hex_of(fingerprints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in fingerprints.astype(">u2")]


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u2").astype(np.uint16)[None, :]


def edited_text(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by the beginning of the text that follows."""
    k = len(text) // EDIT
    return text[: len(text) - k] + following[:k]


_FOUND = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _facts(texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> list[pa.Array]:
    edited = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
    edited_prints = fingerprints_of(pa.array(edited, pa.large_string()))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array(sha, pa.string()),
        pa.array(hex_of(prints), pa.string()),
        pa.array(hex_of(edited_prints), pa.string()),
        pa.array(likeness(prints, edited_prints), pa.float64()),
        pa.array(likeness(prints, next_prints), pa.float64()),
    ]


_NAMES = [f.split()[0] for f in _FOUND.split(", ")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts in pieces of about ``PART_BYTES``."""
    for b in batches:
        _, offsets = flat(b.column("text"))
        for lo, hi in parts(offsets, PART_BYTES):
            yield b.column("id").slice(lo, hi - lo), b.column("text").slice(lo, hi - lo)


def _neighbours(id_type: pa.DataType):
    """Rows whose next row lies in the same task, and the task's first and last text for the others."""
    names = ["id", *_NAMES, "task", "edge", "text"]
    kinds = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def edge(kind: str, id: pa.Array, text: str, print_: np.ndarray) -> pa.RecordBatch:
            row = [id, [len(text)], [None], hex_of(print_), [None], [None], [None], [task], [kind], [text]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) if isinstance(v, list) else v for v, k in zip(row, kinds, strict=True)], names=names)

        last = None  # id, text and fingerprint of the row whose next one is not read yet
        for ids, column in _chunks(batches):
            texts, prints = [t or "" for t in column.to_pylist()], fingerprints_of(column)
            if last is None:
                yield edge("first", ids.slice(0, 1), texts[0], prints[:1])
            else:
                ids, texts, prints = pa.concat_arrays([last[0], ids]), [last[1], *texts], np.concatenate([last[2], prints])
            n = len(texts) - 1
            if n:
                found = _facts(texts[:n], prints[:n], texts[1:], prints[1:])
                nothing = [pa.nulls(n, k) for k in kinds[-2:]]
                yield pa.RecordBatch.from_arrays([ids.slice(0, n), *found, pa.array([task] * n, pa.int32()), *nothing], names=names)
            last = ids.slice(n, 1), texts[n], prints[n:]
        if last is not None:
            yield edge("last", *last)

    return run


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            text, following = one.column("text")[0].as_py(), one.column("next_text")[0].as_py()
            prints, after = (from_hex(one.column(c)[0].as_py()) for c in ("fingerprint", "next_fingerprint"))
            yield pa.RecordBatch.from_arrays([one.column("id"), *_facts([text], prints, [following], after)], names=["id", *_NAMES])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every document.

    Rows are range-partitioned and sorted by id, the one time that texts are moved. A task sees the
    next row of all its rows but the last; the first and last rows of the tasks, two a task, are
    put together afterwards.
    """
    kind = docs.select(col(id)).schema[0].dataType
    rows = docs.select(col(id).alias("id"), col(text).alias("text"))
    # Equal ids are told apart by the text's hash and equal rows by their place, so no id is one task's alone.
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("at", F.monotonically_increasing_id())
    order = ["id", "tie", "at"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    id_type = docs.select(col(id)).limit(0).toArrow().schema.field(0).type
    out = rows.mapInArrow(_neighbours(id_type), f"id {kind.simpleString()}, {_FOUND}, task int, edge string, text string")
    out = durable.written(out, "neighbours")
    inside = out.filter(F.col("edge").isNull()).select("id", *_NAMES)
    edges = out.filter(F.col("edge").isNotNull()).select("id", "fingerprint", "task", "edge", "text")
    # Task numbers only; the first task follows the last one.
    tasks = edges.filter(F.col("edge") == "last").select("task").distinct()
    everything = Window.orderBy("task")
    whole = Window.partitionBy(F.lit(0))
    tasks = tasks.withColumn("first_task", F.min("task").over(whole))
    tasks = tasks.select("task", F.coalesce(F.lead("task").over(everything), "first_task").alias("next_task"))
    ends = edges.filter(F.col("edge") == "last").drop("edge").join(tasks, "task")
    heads = edges.filter(F.col("edge") == "first").select(
        F.col("task").alias("next_task"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint")
    )
    ends = ends.join(heads, "next_task").select("id", "text", "fingerprint", "next_text", "next_fingerprint")
    return inside.unionByName(ends.mapInArrow(_at_edges, f"id {kind.simpleString()}, {_FOUND}")).withColumnRenamed("id", id)
