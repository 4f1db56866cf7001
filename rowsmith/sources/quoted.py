"""CSV records whose cells hold line ends, read by many tasks a file.

Whether a line end closes a record depends on all quotes before it. A line maps the state at
its start (a record begins, or a quoted cell goes on) to the state at its end, so a split of a
file is one such map of two states. The maps of all splits are composed file by file, one row a
split; then every split knows the state it starts in and cuts its lines into records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.plans import durable
from rowsmith.sources.numbering import MAX_BROADCAST_SPLITS, file_columns

_QUOTED_REST = r'[^"]*+(?:""[^"]*+)*+"[^,]*+'  # to the closing quote; what follows it up to the comma belongs to the cell
_CELL = rf'(?:"{_QUOTED_REST}|[^",][^,]*+|)'
_FROM_BEGIN = re.compile(rf"{_CELL}(?:,{_CELL})*+")
_FROM_QUOTED = re.compile(rf"{_QUOTED_REST}(?:,{_CELL})*+")

_SPLIT = "file string, _start bigint, open0 boolean, open1 boolean, n0 bigint, n1 bigint"
_PIECE = "split bigint, row_idx bigint, piece string"
_PIECE_ARROW = pa.schema([("split", pa.int64()), ("row_idx", pa.int64()), ("piece", pa.string())])


def open_after(line: str, is_open: bool) -> bool:
    """Whether a quoted cell is open at the end of ``line``, given that one was at its start."""
    if '"' not in line:
        return is_open
    return (_FROM_QUOTED if is_open else _FROM_BEGIN).fullmatch(line) is None


def _flat(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each line starts."""
    _, offsets, data = lines.buffers()
    kind = np.int64 if pa.types.is_large_string(lines.type) else np.int32
    at = np.frombuffer(offsets, kind)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


class _Batch:
    """The states around the lines of a batch, without a look at each line.

    A line with an odd number of quotes swaps the states, another one keeps them, as long as each quote
    that stands outside a quoted cell begins one: it follows a comma, another quote or nothing. The few
    lines with any other quote are strange and walked one by one; which are depends on the state at their start.
    """

    def __init__(self, lines: pa.Array):
        self.data, self.offsets = _flat(lines)
        size = np.diff(self.offsets)
        self.blank = size == 0
        one = np.flatnonzero(size == 1)
        self.blank[one] = self.data[self.offsets[one]] == ord("\r")
        quotes = np.flatnonzero(self.data == ord('"'))
        first = np.searchsorted(quotes, self.offsets)
        many = np.diff(first)
        line = np.repeat(np.arange(len(many)), many)
        rank = np.arange(len(quotes)) - first[line]
        before = self.data[quotes - 1]
        after_text = (quotes != self.offsets[line]) & (before != ord(",")) & (before != ord('"'))
        strange = np.zeros((2, len(many)), dtype=bool)  # by the state at the line's start
        strange[rank[after_text] % 2, line[after_text]] = True
        self.swapped = np.append(0, np.cumsum(many) % 2) == 1
        self.strange = [
            np.flatnonzero(np.where(self.swapped[:-1] != base, strange[1], strange[0])) for base in (False, True)
        ]

    def states(self, lo: int, hi: int, is_open: bool) -> np.ndarray:
        """The state before each of the lines ``lo`` to ``hi - 1`` and after the last."""
        out, at = np.empty(hi - lo + 1, dtype=bool), lo
        while True:
            base = bool(is_open != self.swapped[at])
            strange = self.strange[base]
            i = np.searchsorted(strange, at)
            stop = min(strange[i], hi) if i < len(strange) else hi
            out[at - lo : stop - lo + 1] = self.swapped[at : stop + 1] != base
            if stop == hi:
                return out
            line = self.data[self.offsets[stop] : self.offsets[stop + 1]].tobytes().decode("utf-8", "replace")
            is_open, at = open_after(line, bool(out[stop - lo])), stop + 1

    def begins(self, states: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Whether a record begins with each line; blank lines between records are none."""
        return ~states[:-1] & ~self.blank[lo:hi]


def _runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The runs of lines of one split, named by ``names``, in each batch, each after whether a split begins.

    Refuses any order but that of the file.
    """
    at = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        named, order = [batch.column(name) for name in names], batch.column("_at").to_numpy()
        other = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in named]
        borders = np.flatnonzero(np.logical_or.reduce(other)) + 1
        lines = _Batch(batch.column("line"))
        for lo, hi in pairwise([0, *borders.tolist(), batch.num_rows]):
            split = tuple(c[lo].as_py() for c in named)
            begins = split != at
            if (not begins and order[lo] <= last) or (np.diff(order[lo:hi]) <= 0).any():
                raise RuntimeError(f"lines of split {split} are out of order")
            at, last = split, order[hi - 1]
            yield begins, split, batch, lines, lo, hi


def _split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: for both states at its start, the state at its end and the records begun."""
    at, ends, begun = None, [False, True], [0, 0]

    def row():
        columns = [at[0]], [at[1]], [ends[0]], [ends[1]], [begun[0]], [begun[1]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["file", "_start", "open0", "open1", "n0", "n1"])

    for begins, split, _, lines, lo, hi in _runs(batches, "file", "_start"):
        if begins:
            if at:
                yield row()
            at, ends, begun = split, [False, True], [0, 0]
        merged = ends[0] == ends[1]
        for entry in (0, 1):
            if not (entry and merged):
                states = lines.states(lo, hi, ends[entry])
                many = int(lines.begins(states, lo, hi).sum())
            ends[entry] = bool(states[-1])
            begun[entry] += many
    if at:
        yield row()


def _packed(split: tuple, row_idx: np.ndarray, pieces: pa.Array) -> pa.RecordBatch:
    columns = [pa.repeat(split[0], len(pieces)), pa.array(row_idx, pa.int64()), pieces.view(pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_PIECE_ARROW)


def _pieces(batches: Iterator[pa.RecordBatch], inner: bool) -> Iterator[pa.RecordBatch]:
    """The records of each split.

    ``inner`` gives those that lie in one split and do not begin a file; else come the first record of
    each file and the pieces, one a split, of records that cross a split's border.
    """
    at, is_open, row_idx, entered = None, False, 0, False
    kept: list[bytes] = []  # of the record that a batch leaves open

    def left_open() -> Iterator[pa.RecordBatch]:
        if kept and not inner:
            yield _packed(at, np.array([row_idx]), pa.array([b"\n".join(kept)], pa.binary()))

    for begins, split, batch, lines, lo, hi in _runs(batches, "split"):
        if begins:
            yield from left_open()
            is_open = entered = batch.column("entry")[lo].as_py()
            at, kept, row_idx = split, [], batch.column("before")[lo].as_py()
        states = lines.states(lo, hi, is_open)
        begin = lines.begins(states, lo, hi)
        record = np.cumsum(begin) - (not is_open)  # of each line; the first may go on from before
        many = int(record[-1]) + 1
        if not many:
            continue
        number = row_idx + np.arange(many) + (not is_open)
        done = np.ones(many, dtype=bool)
        done[-1] = not states[-1]
        is_inner = number > 1
        is_inner[0] &= not entered
        give = done & (is_inner == inner)
        asked = give | ~done
        used = np.flatnonzero((states[:-1] | begin) & asked[record])
        cut = np.append(np.searchsorted(record[used], np.flatnonzero(asked)), len(used))
        taken = batch.column("line").slice(lo, hi - lo).cast(pa.binary()).take(pa.array(used))
        pieces = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), taken), b"\n")
        numbers = number[asked]
        if is_open:
            if asked[0]:
                kept.append(pieces[0].as_py())
                pieces, numbers = pieces[1:], numbers[1:]
            if give[0]:
                yield _packed(at, number[:1], pa.array([b"\n".join(kept)], pa.binary()))
            if done[0]:
                kept = []
        if not done[-1] and not (is_open and many == 1):
            kept = [pieces[-1].as_py()]
            pieces, numbers = pieces[:-1], numbers[:-1]
        if len(pieces):
            yield _packed(at, numbers, pieces)
        entered &= not done[0]
        is_open, row_idx = bool(states[-1]), int(number[-1])
    yield from left_open()


def _entries(maps: DataFrame) -> DataFrame:
    """``(file, _start, entry, before)``: the state a split starts in and the records begun before it.

    A map of two states is constant, the identity or the swap, so the state after a row of
    maps is that of the last constant one, swapped as often as swaps follow it.
    """
    by_start = Window.partitionBy("file").orderBy("_start")
    upto, earlier = by_start.rowsBetween(Window.unboundedPreceding, 0), by_start.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.col("open0") & ~F.col("open1")
    constant = F.col("open0") == F.col("open1")
    counted = maps.withColumn("_swaps", F.sum(swaps.cast("bigint")).over(upto))

    def last(value: Column) -> Column:
        return F.coalesce(F.last(F.when(constant, value), ignorenulls=True).over(earlier), F.lit(0))

    since = F.coalesce(F.lag("_swaps").over(by_start), F.lit(0)) - last(F.col("_swaps"))
    entry = (last(F.col("open0").cast("bigint")) + since) % 2 == 1
    begun = F.when(F.col("entry"), F.col("n1")).otherwise(F.col("n0"))
    return counted.withColumn("entry", entry).select(
        "file", "_start", "entry", F.coalesce(F.sum(begun).over(earlier), F.lit(0)).alias("before")
    )


def csv_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(first records, records), each ``(file, row_idx, line)``: ``line`` is a CSV record's text with the line ends of its cells.

    Lines end at ``\\n`` or ``\\r\\n``. ``row_idx`` counts the records of a file from 1, blank lines
    left out; the first frame holds the records of number 1. Lines are read for the states, for the pieces
    of records that cross a split's border (written; only they are shuffled) and for all other records.
    A quote that is never closed makes all that follows one record, which must fit in a task.
    """
    scan = spark.read.text(path, lineSep="\n").select(*file_columns(), F.col("value").alias("line"))
    scan = scan.select("file", "_start", "_at", "line")
    entries = _entries(scan.mapInArrow(_split_maps, _SPLIT)).withColumn("split", F.monotonically_increasing_id())
    entries = durable.written(entries, "splits")
    # Lines go to Python with the number of their split, which is far shorter than a file's name.
    if few := entries.count() <= MAX_BROADCAST_SPLITS:
        entries = F.broadcast(entries)
    placed = scan.join(entries, ["file", "_start"]).select("split", "_at", "line", "entry", "before")
    if not few:
        placed = placed.repartition("split").sortWithinPartitions("split", "_at")

    def pieces(inner: bool) -> DataFrame:
        return placed.mapInArrow(partial(_pieces, inner=inner), _PIECE).join(entries.select("split", "file", "_start"), "split")

    edges = durable.written(pieces(inner=False), "edges")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_start", "piece"))), lambda x: x["piece"])
    edges = edges.groupBy("file", "row_idx").agg(F.array_join(in_order, "\n").alias("line"))
    inner = pieces(inner=True).select("file", "row_idx", F.col("piece").alias("line"))
    line = F.when(F.endswith("line", F.lit("\r")), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")).alias("line")
    first = durable.written(edges.filter(F.col("row_idx") == 1).select("file", "row_idx", line), "first-records")
    return first, inner.unionByName(edges).select("file", "row_idx", line)
