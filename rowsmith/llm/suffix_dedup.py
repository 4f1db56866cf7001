"""Removal of repeated byte strings by a distributed, sparse suffix array.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too, in
the same text or another. Only suffixes that can be repeated are sorted:

1. Every string of ``length`` bytes (a window) names one anchor inside itself: the place of
   the least hash among its ``KGRAM``-byte pieces. Equal windows name the same place, so a
   window is worth a look only if its anchor's piece occurs twice in the corpus. Anchors
   are one in about 150 bytes.
2. An anchor that does is a row with the bytes around it: the suffix from the anchor on, and
   what stands before it as far as its windows reach. Spark's sampled splitters
   range-partition these rows by their leading bytes, and further by text, so equal suffixes
   may fill any number of buckets.
3. A bucket sorts the suffixes by multikey quicksort, eight bytes a key, and likewise the
   reversed bytes before the anchors. Both orders with their common-prefix lengths tell
   which windows are equal, byte by byte.
4. Suffixes that share their leading bytes with a bucket's first or last one may have equals
   across the boundary: a 128-bit print of each distinct window of them is compared between
   buckets.

Copies of a whole text are counted first; one stands for all. Windows that a task sees in
equal surroundings are settled there and go on once.

Defined results: a null text is an empty one, texts shorter than a window keep all bytes,
all bytes of repeated texts of a window or more go, repeated rows are copies, a null id is
an id, and empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.arrays import flat, mixed, parts, powers
from rowsmith.llm.common import col, sha256_hex, text_key
from rowsmith.plans import durable

LENGTH = 400  # bytes of a repeated string
KGRAM = 101  # bytes of an anchor's piece
LEAD = 32  # leading bytes that splitters see; sampled splitters stay small however long a window is
BUCKET_BYTES = 12 << 20  # of suffix rows that a task sorts
_BYTE = np.random.default_rng(400).integers(0, 2**64, (2, 256), dtype=np.uint64)  # two prints of a byte


def _prints(data: np.ndarray, which: int) -> np.ndarray:
    """Sums over prefixes; differences are prints of substrings."""
    p, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[which][data] * p[: len(data)], out=sums[1:])
    return sums


def _print_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, kgram: int) -> tuple[np.ndarray, ...]:
    """Of some texts: the row, place and piece hash of each anchor, and the places of its windows.

    The windows named by an anchor start at ``first`` to ``last``; all places are in ``data``.
    """
    n, wide = len(data), length - kgram + 1
    m = n - kgram + 1
    size = np.diff(offsets)
    many = np.maximum(size - length + 1, 0)
    if m < wide or not many.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = _prints(data, 0)
    at = np.arange(m)
    piece = _print_of(sums, at, at + kgram)
    # The hash's upper half, then the place: the least is the leftmost of equal pieces.
    key = (piece & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    full = -(-m // wide) * wide
    grid = np.concatenate([key, np.full(full - m, 2**64 - 1, np.uint64)]).reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    row = np.repeat(np.arange(len(size)), many)
    start = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + offsets[row]
    least = np.minimum(behind[start], ahead[start + wide - 1])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    opens = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    last = start[np.append(opens[1:], len(start)) - 1]
    return row[opens], place[opens], piece[place[opens]], start[opens], last


def _find_anchors(length: int, kgram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for lo, hi in parts(offsets):
                base = offsets[lo : hi + 1] - offsets[lo]
                row, place, piece, first, last = anchors(data[offsets[lo] : offsets[hi]], base, length, kgram)
                cut = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                where = base[:-1][row] if len(row) else row
                lists = [
                    pa.ListArray.from_arrays(cut, pa.array(values))
                    for values in (
                        piece.astype(np.uint64).view(np.int64),
                        (place - where).astype(np.int64),
                        (place - last).astype(np.int32),
                        (place - first).astype(np.int32),
                    )
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(lo, hi - lo), *lists], names=["key", "piece", "place", "least", "most"]
                )

    return run


_SUFFIX = "key binary, place long, least int, most int, lead binary, before binary"


def _suffix_rows(length: int):
    """Repeated anchors with the bytes around them; settled windows have no ``before``.

    Equal surroundings within a part are settled at once: all their windows are repeated.
    One of them goes on, to be found by others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            lists = batch.column("anchors")
            for lo, hi in parts(offsets):
                some = lists.slice(lo, hi - lo)
                many = np.diff(some.offsets.to_numpy())
                rows = some.flatten()
                if not len(rows):
                    continue
                place, least, most = (
                    rows.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("place", "least", "most")
                )
                row = np.repeat(np.arange(hi - lo), many)
                text = data[offsets[lo] : offsets[hi]]
                at = place + (offsets[lo : hi] - offsets[lo])[row]
                start, end = at - most, at + length - least
                around = [_print_of(_prints(text, k), start, end) for k in (0, 1)]
                order = np.lexsort((least, most, around[1], around[0]))
                same = np.zeros(len(order), dtype=bool)
                pairs = [a[order] for a in (around[0], around[1], least, most)]
                same[1:] = np.logical_and.reduce([a[1:] == a[:-1] for a in pairs])
                settled = np.zeros(len(order), dtype=bool)
                settled[order] = same | np.append(same[1:], False)
                goes_on = np.zeros(len(order), dtype=bool)
                goes_on[order] = ~same
                raw = text.tobytes()
                keys = batch.column("key").slice(lo, hi - lo).to_pylist()
                a, b = np.flatnonzero(goes_on), np.flatnonzero(settled)
                both = np.concatenate([a, b])
                lead = [raw[at[i] : end[i]] for i in a] + [keys[row[i]] for i in b]
                before = [raw[start[i] : at[i]] for i in a] + [None] * len(b)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[row[i]] for i in both], pa.binary()),
                        pa.array(place[both], pa.int64()),
                        pa.array(least[both], pa.int32()),
                        pa.array(most[both], pa.int32()),
                        pa.array(lead, pa.binary()),
                        pa.array(before, pa.binary()),
                    ],
                    names=["key", "place", "least", "most", "lead", "before"],
                )

    return run


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows of equal width, and each one's common bytes with the one before.

    Multikey quicksort by keys of eight bytes: rows that are equal so far are sorted by
    the next key, all other rows are left alone.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-max(width, 1) // 8) * 8), np.uint8)
    padded[:, :width] = rows
    keys = padded.view(">u8").astype(np.uint64)
    order, common = np.arange(n), np.full(n, width, dtype=np.int64)
    opens = np.zeros(n, dtype=bool)
    if n:
        opens[0], common[0] = True, 0
    for depth in range(keys.shape[1]):
        alone = opens & np.append(opens[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(opens)[tied]
        key = keys[order[tied], depth]
        by = np.lexsort((key, group))
        order[tied] = order[tied][by]
        key = key[by]
        new = np.flatnonzero(~opens[tied[1:]] & (key[1:] != key[:-1])) + 1
        differ = key[new] ^ key[new - 1]
        equal = np.zeros(len(new), dtype=np.int64)  # leading zero bytes
        for byte in range(1, 8):
            equal += differ < (np.uint64(1) << np.uint64(64 - 8 * byte))
        opens[tied[new]] = True
        common[tied[new]] = np.minimum(depth * 8 + equal, width)
    return order, common


def _matrix(column: pa.Array, width: int, reverse: bool = False) -> np.ndarray:
    data, offsets = flat(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    if reverse:
        at = np.repeat(size, size) - 1 - at
    out[row, at] = data
    return out


def _true_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of the runs of True in each row of a matrix."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, start, end


_FOUND = "kind int, key binary, start long, end long, f1 long, f2 long"
SPAN, OPEN, KNOWN = 0, 1, 2  # a repeated range; a window that may have equals elsewhere; one that has


def _found(kind, keys, start, end, f1=None, f2=None) -> pa.RecordBatch:
    zero = np.zeros(len(keys), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(keys), kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32)),
            pa.array(keys, pa.binary()),
            pa.array(np.asarray(start, np.int64)),
            pa.array(np.asarray(end, np.int64)),
            pa.array(zero if f1 is None else f1.view(np.int64)),
            pa.array(zero if f2 is None else f2.view(np.int64)),
        ],
        names=["kind", "key", "start", "end", "f1", "f2"],
    )


def _compare(length: int, kgram: int):
    """One bucket of suffix rows: its repeated ranges, and the windows open at its boundaries."""
    reach = length - kgram  # most bytes of a window before its anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        done = table.filter(pc.is_null(table.column("before")))
        if done.num_rows:
            place, least, most = (done.column(c).to_numpy().astype(np.int64) for c in ("place", "least", "most"))
            yield _found(SPAN, done.column("key").to_pylist(), place - most, place - least + length)
        table = table.filter(pc.is_valid(table.column("before"))).combine_chunks()
        if not table.num_rows:
            return
        keys = np.array(table.column("key").to_pylist(), dtype=object)
        place, least, most = (table.column(c).to_numpy().astype(np.int64) for c in ("place", "least", "most"))
        ahead = _matrix(table.column("lead"), length)
        behind = _matrix(table.column("before"), reach, reverse=True)
        order, common = multikey_sort(ahead)
        order_b, common_b = multikey_sort(behind)
        repeated = np.zeros((len(keys), reach + 1), dtype=bool)
        n = len(keys)
        run_of, class_of = np.empty(n, np.int64), np.empty(n, np.int64)
        open_rows, open_x, open_kind = [], [], []
        # Rows that share a whole piece with another one; others cannot be repeated here.
        twin = common >= kgram
        twin |= np.append(twin[1:], False)
        edge_run = np.cumsum(common < min(LEAD, kgram))
        at_edge = np.zeros(n, dtype=bool)
        at_edge[order] = (edge_run == edge_run[0]) | (edge_run == edge_run[-1])
        busy = np.zeros(n, dtype=bool)
        busy[order] = twin
        busy |= at_edge
        for x in range(reach + 1):
            rows = np.flatnonzero(busy & (least <= x) & (x <= most))
            if not len(rows):
                continue
            runs = np.cumsum(common < length - x)
            run_of[order] = runs
            class_of[order_b] = np.cumsum(common_b < x)
            pair = run_of[rows] * (n + 1) + class_of[rows]
            by = np.argsort(pair, kind="stable")
            same = np.zeros(len(by), dtype=bool)
            same[1:] = pair[by][1:] == pair[by][:-1]
            twice = same | np.append(same[1:], False)
            repeated[rows[by[twice]], x] = True
            one = np.flatnonzero(at_edge[rows[by]] & ~same)  # one row of each distinct window
            open_rows.append(rows[by[one]])
            open_x.append(np.full(len(one), x))
            open_kind.append(np.where(twice[one], KNOWN, OPEN))
        row, x_from, x_to = _true_runs(repeated)
        yield _found(SPAN, list(keys[row]), place[row] - (x_to - 1), place[row] - x_from + length)
        if open_rows:
            row, x, kind = np.concatenate(open_rows), np.concatenate(open_x), np.concatenate(open_kind)
            prints = [np.empty(len(row), np.uint64) for _ in range(2)]
            for some in np.array_split(np.arange(len(row)), max(1, len(row) // 20_000)):
                used, index = np.unique(row[some], return_inverse=True)
                whole = np.concatenate([behind[used][:, ::-1], ahead[used]], axis=1)
                p, inverse = powers(whole.shape[1] + 1)
                for k in (0, 1):
                    sums = np.zeros((len(used), whole.shape[1] + 1), np.uint64)
                    np.cumsum(_BYTE[k][whole] * p[:-1], axis=1, out=sums[:, 1:])
                    start = reach - x[some]
                    prints[k][some] = mixed((sums[index, start + length] - sums[index, start]) * inverse[start])
            yield _found(kind, list(keys[row]), place[row] - x, place[row] - x + length, *prints)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their repeated ranges to merged spans and what is left."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            merged: list = []
            for s in sorted((s["start"], s["end"]) for s in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            raw, at, left = text, 0, []
            for a, b in merged:
                left.append(raw[at:a])
                at = b
            left.append(raw[at:])
            kept = b"".join(left)
            out.append(([{"start": a, "length": b - a} for a, b in merged], hashlib.sha256(kept).hexdigest()))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string())],
            names=["key", "spans", "kept_sha256"],
        )


def repeats(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans ``(start, length)`` to remove, kept_sha256."""
    body = F.coalesce(col(text), F.lit("")).cast("binary")
    long = docs.select(text_key(col(text)).alias("key"), body.alias("text")).filter(F.octet_length("text") >= length)

    found = long.mapInArrow(
        _find_anchors(length, kgram), "key binary, piece array<long>, place array<long>, least array<int>, most array<int>"
    )
    lists = F.struct("piece", "place", "least", "most")
    texts = found.select("key", lists.alias("a")).groupBy("key").agg(F.count("*").alias("n"), F.first("a").alias("a"))
    texts = durable.written(texts, "anchors")
    zipped = F.arrays_zip("a.piece", "a.place", "a.least", "a.most")
    each = texts.select("key", F.explode(zipped).alias("z")).select("key", "z.*")
    # Both sides are tables, so that adaptive execution can split a piece that most texts share.
    shared = each.groupBy("piece").agg(F.count("*").alias("n")).filter("n > 1").select("piece")
    again = durable.written(each.join(durable.written(shared, "shared"), "piece", "left_semi"), "again")
    again = again.groupBy("key").agg(F.collect_list(F.struct("place", "least", "most")).alias("anchors"))
    again = durable.written(again, "repeated")
    rows = again.agg(F.sum(F.size("anchors"))).first()[0] or 0

    once = long.groupBy("key").agg(F.first("text").alias("text"))
    candidates = durable.written(once.join(again, "key"), "candidates")
    suffixes = candidates.mapInArrow(_suffix_rows(length), _SUFFIX)
    buckets = max(1, -(-rows * (length + length - kgram) // BUCKET_BYTES))
    token = F.substring("lead", 1, min(LEAD, kgram))
    suffixes = suffixes.repartitionByRange(buckets, token, "key", "place")
    compared = durable.written(suffixes.mapInArrow(_compare(length, kgram), _FOUND), "found")

    spans = compared.filter(F.col("kind") == SPAN).select("key", "start", "end")
    open_ = compared.filter(F.col("kind") != SPAN)
    met = open_.groupBy("f1", "f2").agg(F.count("*").alias("n")).filter("n > 1").select("f1", "f2")
    across = open_.filter(F.col("kind") == OPEN).join(met, ["f1", "f2"], "left_semi").select("key", "start", "end")
    spans = spans.unionByName(across).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    copies = texts.filter("n > 1").select("key")
    cleaned = candidates.select("key", "text").join(spans, "key").join(copies, "key", "left_anti")
    cleaned = cleaned.mapInArrow(_kept, "key binary, spans array<struct<start:long,length:long>>, kept_sha256 string")
    none = F.lit(None)
    outcome = cleaned.withColumn("whole", F.lit(False)).unionByName(
        copies.select("key", none.cast("array<struct<start:long,length:long>>").alias("spans"), none.cast("string").alias("kept_sha256"), F.lit(True).alias("whole"))
    )
    outcome = durable.written(outcome, "outcome")

    facts = docs.select(
        col(id).alias("id"),
        text_key(col(text)).alias("key"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        sha256_hex(body).alias("_sha"),
    )
    facts = durable.written(facts, "facts").join(outcome, "key", "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("length")))
    nothing = F.expr("cast(array() as array<struct<start:long,length:long>>)")
    return facts.select(
        F.col("id").alias(id),
        "n_bytes",
        F.when(F.col("whole"), all_of_it).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(F.col("whole"), sha256_hex(F.lit(""))).otherwise(F.coalesce("kept_sha256", "_sha")).alias("kept_sha256"),
    )
