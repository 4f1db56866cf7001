"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a bag of word shingles with weights ``(1 + ln tf) * idf``. Document frequencies
come from all texts, counted in a table of fixed width, less what chance adds to a cell;
idf runs from 1 (in every text) to ``1 + DAMPED`` (in one), a narrow range, as in a large
group of near copies the shingles that all share would else count for too little.
Consistent weighted samples agree with the probability of the weighted Jaccard
similarity; they are cut into bands.

Texts with the same bag are one node. Nodes that share a band of few nodes are all paired.
Those of larger bands are sorted by their other samples over the whole cluster, so like
ones are neighbours: each is paired with the few before it, the first of its band in the
partition and the band's text of most copies. Pairs are verified by exact weighted Jaccard
similarity: first each node's most promising one, then every other pair that still joins
two groups. In larger bands that then hold several groups, all nodes of different groups
are compared, block by block, so the outcome does not depend on which were neighbours.
Groups are connected components.

Nothing but the frequency table, which has a fixed size, reaches the driver.

Defined results: null, empty and wordless texts are groups of their own, a text of fewer
words than a shingle is one shingle, a null id sorts behind all others, rows equal in id and
text are copies of which one stays, empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.arrays import Words, mixed, word_parts
from rowsmith.llm.common import boxed, col, text_key, unboxed
from rowsmith.plans import durable

SHINGLE = 5  # words
THRESHOLD = 0.8  # weighted Jaccard similarity of a link
DAMPED = 0.25  # what the rarest shingle weighs more than one in every text
BANDS, ROWS = 9, 3  # a pair at the threshold is missed by all bands in 0.16 % of cases
CELLS = 1 << 20  # of the frequency table
BLOCKS = 64  # pieces in which it is summed up
NEIGHBOURS = 4  # rows before it, in the order of a band, that a text is compared with
WHOLE = 6  # nodes of a band up to which all its pairs are candidates
BLOCK = 1_024  # nodes of a block of a larger band; all pairs of two blocks are one task's work
BLOCK_BYTES = 8 << 20  # text of a block
COLUMNS = 2_048  # features multiplied at once
UNLIKELY = 0.45  # share of equal samples; a link has less in fewer than one of 100,000 cases
SEED = 81

_rng = np.random.default_rng(SEED)
_DRAWS = 1 << 16  # random draws are shared by shingles with the same 16 hash bits
_R = _rng.gamma(2.0, 1.0, _DRAWS).astype(np.float32)
_C = np.log(_rng.gamma(2.0, 1.0, _DRAWS)).astype(np.float32)
_B = _rng.random(_DRAWS).astype(np.float32)
_ODD = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted by text and hash: (text, shingle, count)."""
    h, first = words.hashes(), words.first
    n, many = len(h), np.diff(first)
    whole = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for i in range(size):
        whole += h[i : n - size + 1 + i] * _ODD[-1 - i] if len(whole) else whole
    row = np.repeat(np.arange(len(many)), many)
    inside = np.flatnonzero(row[: len(whole)] == row[size - 1 :]) if len(whole) else np.zeros(0, np.int64)
    short = np.flatnonzero((many > 0) & (many < size))
    extra = np.array([np.bitwise_xor.reduce(h[first[i] : first[i + 1]] * _ODD[-1 - np.arange(many[i])]) for i in short], np.uint64)
    text = np.concatenate([row[inside], short])
    value = mixed(np.concatenate([whole[inside], extra + np.uint64(1)]))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    opens = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])) if len(text) else order
    return text[opens], value[opens], np.diff(np.append(opens, len(text)))


def _cell(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(44)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by cell, summed over the task, in blocks."""
    total = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        for _, _, words in word_parts(batch.column("text")):
            total += np.bincount(_cell(shingles(words)[1]), minlength=CELLS)
    task = TaskContext.get().partitionId() % 256
    pieces = total.reshape(BLOCKS, -1)
    some = np.flatnonzero(pieces.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int64()), pa.array([task] * len(some), pa.int64()), pa.array([pieces[i].tobytes() for i in some], pa.binary())],
        names=["block", "part", "counts"],
    )


def _add_up(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS // BLOCKS, dtype=np.int64)
    for batch in batches:
        for raw in batch.column("counts").to_pylist():
            total += np.frombuffer(raw, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int64()), pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())],
        names=["block", "part", "counts"],
    )


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """idf by cell from all ``texts``; a table of fixed size."""
    schema = "block long, part long, counts binary"
    rows = texts.mapInArrow(_count_cells, schema)
    rows = rows.groupBy("block", "part").applyInArrow(_add_up, schema)
    rows = rows.groupBy("block").applyInArrow(_add_up, schema)
    counts = np.zeros((BLOCKS, CELLS // BLOCKS))
    for r in rows.collect():
        counts[r["block"]] = np.frombuffer(r["counts"], np.int64)
    counts = counts.ravel()
    n = max(texts.count(), 2)
    by_chance = (counts.sum() - counts) / (CELLS - 1)
    df = np.clip(counts - by_chance, 1, n)
    return (1 + DAMPED * np.log(n / df) / np.log(n)).astype(np.float32)


def _weights(shingle: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(count.astype(np.float32))) * idf[_cell(shingle)]


def samples(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and ``many`` consistent weighted samples of each."""
    opens = np.flatnonzero(np.diff(text, prepend=-1))
    sizes = np.diff(np.append(opens, len(text)))
    out = np.zeros((len(opens), many), dtype=np.uint64)
    if not len(opens):
        return text[opens], out
    log_w = np.log(weight)
    for i in range(many):
        k = ((shingle * _ODD[i]) >> np.uint64(48)).astype(np.int32)
        r, b = _R[k], _B[k]
        t = np.floor(log_w / r + b)
        a = _C[k] - r * (t - b + 1)
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, opens), sizes))
        least = least[np.searchsorted(least, opens)]  # the first of ties
        out[:, i] = mixed(shingle[least] ^ (t[least].astype(np.int64).view(np.uint64) * _ODD[100]))
    return text[opens], out


def _sign(idf):
    """Texts to their bag (a print of all shingles and counts) and samples; none without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            for lo, hi, words in word_parts(batch.column("text")):
                text, shingle, count = shingles(words)
                rows, drawn = samples(text, shingle, _weights(shingle, count, table), BANDS * ROWS)
                bags: list = [None] * (hi - lo)
                signs: list = [None] * (hi - lo)
                if len(rows):
                    opens = np.flatnonzero(np.diff(text, prepend=-1))
                    both = [np.add.reduceat(mixed(shingle * _ODD[200 + j] + count.astype(np.uint64)), opens) for j in (0, 1)]
                    bag = np.stack(both, axis=1)
                    for i, r in enumerate(rows.tolist()):
                        bags[r], signs[r] = bag[i].tobytes(), drawn[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in ("id", "key")] + [pa.array(bags, pa.binary()), pa.array(signs, pa.binary())],
                    names=["id", "key", "bag", "sign"],
                )

    return run


_PAIR = "kind int, part int, band int, hash binary, a binary, b binary, alike double, sign binary"
PAIR, FIRST, LAST = 0, 1, 2


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted band rows to pairs with the rows before and with the first row of the band in this partition.

    The partition's own first and last row are given too, to pair them across partitions.
    """
    part = TaskContext.get().partitionId()
    width = BANDS * ROWS

    def rows(kind, band, hash, a, b, alike, sign) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(band, pa.int32()), pa.array(hash, pa.binary()),
                pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(alike, pa.float64()), pa.array(sign, pa.binary()),
            ],
            names=["kind", "part", "band", "hash", "a", "b", "alike", "sign"],
        )

    tail: list = []  # (band, hash, bag, sign) of the last rows, and of the first one of their band
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = list(zip(*(batch.column(c).to_pylist() for c in ("band", "hash", "bag", "sign")), strict=True))
        if not tail:
            yield rows(FIRST, [new[0][0]], [new[0][1]], [new[0][2]], [None], [0.0], [new[0][3]])
        carried = ([head] if head is not None else []) + tail
        line, k = carried + new, len(carried)
        skip = len(carried) - len(tail)  # the carried first row stands apart
        drawn = np.frombuffer(b"".join(r[3] for r in line), np.uint64).reshape(-1, width)
        first = np.zeros(len(line), dtype=np.int64)
        for i in range(skip, len(line)):
            same = i > skip and line[i][:2] == line[i - 1][:2]
            joins_head = i == skip and skip and line[i][:2] == head[:2]
            first[i] = first[i - 1] if same else (0 if joins_head else i)
        index = np.arange(k, len(line))
        left, right = [first[index]], [index]
        for d in range(1, NEIGHBOURS + 1):
            near = index[(index - d >= skip) & (first[np.maximum(index - d, 0)] == first[index])]
            left.append(near - d)
            right.append(near)
        left, right = np.concatenate(left), np.concatenate(right)
        other = np.flatnonzero(left != right)
        left, right = np.unique(np.stack([left[other], right[other]]), axis=1) if len(other) else (left[:0], right[:0])
        alike = (drawn[left] == drawn[right]).mean(axis=1) if len(left) else np.zeros(0)
        keep = np.flatnonzero(alike >= UNLIKELY)
        if len(keep):
            a, b = [line[i][2] for i in left[keep]], [line[i][2] for i in right[keep]]
            yield rows(PAIR, [0] * len(keep), [None] * len(keep), a, b, alike[keep], [None] * len(keep))
        head, tail = line[first[-1]], line[skip:][-NEIGHBOURS:]
    if tail:
        last = tail[-1]
        yield rows(LAST, [last[0]], [last[1]], [last[2]], [None], [0.0], [last[3]])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the share of their samples that are equal, without unlikely ones."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BANDS * ROWS) for c in ("sign_a", "sign_b"))
        alike = (a == b).mean(axis=1)
        found = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike)], names=["a", "b", "alike"])
        yield found.filter(pa.array(alike >= UNLIKELY))


def shared_bands(signed: DataFrame) -> DataFrame:
    """``(band, hash, bag, many)``: the bands of every node that it shares, and their sizes."""
    step = 8 * ROWS
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.substring("sign", i * step + 1, step).alias("hash")) for i in range(BANDS)])
    rows = signed.select("bag", F.explode(bands).alias("x")).select("bag", "x.*")
    shared = rows.groupBy("band", "hash").agg(F.count("*").alias("many")).filter("many > 1")
    return durable.written(rows.join(shared, ["band", "hash"]).select("band", "hash", "bag", "many"), "bands")


def candidate_pairs(signed: DataFrame, bands: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b, alike)`` of nodes of ``signed`` (bag, sign, n) that share a band.

    All of bands of up to ``WHOLE`` nodes; of larger ones those likely to be links.
    """
    step = 8 * ROWS
    few = bands.filter(F.col("many") <= WHOLE).join(signed.select("bag", "sign"), "bag")
    few = few.groupBy("band", "hash").agg(F.sort_array(F.collect_list(F.struct("bag", "sign"))).alias("ms"))
    later = F.expr("transform(sequence(1, size(ms) - 1), i -> transform(slice(ms, 1, i), m -> struct(m as a, ms[i] as b)))")
    few = few.select(F.explode(F.flatten(later)).alias("p"))
    few = few.select(F.col("p.a.bag").alias("a"), F.col("p.b.bag").alias("b"), F.col("p.a.sign").alias("sign_a"), F.col("p.b.sign").alias("sign_b"))
    few = few.mapInArrow(_alike, "a binary, b binary, alike double")
    rows = bands.filter(F.col("many") > WHOLE).select("band", "hash", "bag")
    # The text of a band with the most copies is likely what the others were made from.
    centres = rows.join(signed.filter("n > 1").select("bag", "n"), "bag").groupBy("band", "hash").agg(F.max_by("bag", F.struct("n", "bag")).alias("centre"))
    spokes = rows.join(durable.written(centres, "centres"), ["band", "hash"])
    spokes = spokes.select(F.col("bag").alias("a"), F.col("centre").alias("b"), F.lit(UNLIKELY).alias("alike"))
    rows = rows.join(signed.select("bag", "sign"), "bag")
    rest = F.expr(f"concat(substring(sign, (band + 1) * {step} + 1), substring(sign, 1, band * {step}))")
    order = ["band", "hash", "rest", "bag"]
    rows = rows.withColumn("rest", rest).repartitionByRange(*order).sortWithinPartitions(*order).select("band", "hash", "bag", "sign")
    found = durable.written(rows.mapInArrow(_pairs, _PAIR), "pairs")
    ends = found.filter(F.col("kind") != PAIR)
    order = Window.orderBy("part", "kind")  # two rows a partition
    nxt = F.lead(F.struct("kind", "band", "hash", "a")).over(order)
    across = ends.withColumn("_next", nxt).filter(
        (F.col("kind") == LAST) & (F.col("_next.kind") == FIRST) & (F.col("_next.band") == F.col("band")) & (F.col("_next.hash") == F.col("hash"))
    )
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b", "alike")
    pairs = pairs.unionByName(across.select("a", F.col("_next.a").alias("b"), F.lit(1.0).alias("alike")))
    pairs = pairs.unionByName(spokes).unionByName(few)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "alike").filter("a != b")
    return pairs.groupBy("a", "b").agg(F.max("alike").alias("alike"))


def _similar(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = idf.value
        for batch in batches:
            both = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")])
            n = batch.num_rows
            found: tuple = ([], [], [])
            for lo, _, words in word_parts(both):
                text, shingle, count = shingles(words)
                found[0].append(text + lo)
                found[1].append(shingle)
                found[2].append(_weights(shingle, count, table))
            text, shingle, weight = (np.concatenate(x) for x in found)
            pair = text % n
            order = np.lexsort((shingle, pair))
            pair, shingle, weight = pair[order], shingle[order], weight[order].astype(np.float64)
            twin = np.flatnonzero((pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1]))
            common = np.bincount(pair[twin], np.minimum(weight[twin], weight[twin + 1]), n)
            total = np.bincount(pair, weight, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common / np.maximum(total - common, 1e-12))], names=["a", "b", "similarity"]
            )

    return run


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose texts reach the threshold: ``(a, b, similarity)``; ``texts`` is (bag, text)."""
    rows = pairs.select("a", "b")
    for side in ("a", "b"):
        rows = rows.join(texts.select(F.col("bag").alias(side), F.col("text").alias(f"text_{side}")), side)
    rows = rows.select("a", "b", "text_a", "text_b").mapInArrow(_similar(idf), "a binary, b binary, similarity double")
    return durable.written(rows.filter(F.col("similarity") >= threshold), "links")


def _features(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, weight): the weights of features that two texts share sum up to their common weight.

    A shingle that occurs c times is c features: the k-th weighs what the k-th occurrence adds.
    """
    found: tuple = ([], [], [])
    for lo, _, words in word_parts(column):
        text, shingle, count = shingles(words)
        at = np.repeat(np.arange(len(count)), count)
        k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        adds = np.where(k > 0, np.log1p(k) - np.log(np.maximum(k, 1)), 1.0)
        found[0].append(text[at] + lo)
        found[1].append(mixed(shingle[at] + k.astype(np.uint64) * _ODD[150]))
        found[2].append(adds * idf[_cell(shingle[at])])
    return tuple(np.concatenate(x) for x in found)


def _similarities(a: pa.Array, b: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every text of ``a`` with every one of ``b``."""
    (ta, fa, wa), (tb, fb, wb) = _features(a, idf), _features(b, idf)
    total = np.bincount(ta, wa, len(a))[:, None] + np.bincount(tb, wb, len(b))[None, :]
    both = np.intersect1d(fa, fb)
    lines = []
    for text, feature, weight in ((ta, fa, wa), (tb, fb, np.ones(len(fb)))):
        at = np.minimum(np.searchsorted(both, feature), max(len(both) - 1, 0))
        some = np.flatnonzero(both[at] == feature) if len(both) else at[:0]
        some = some[np.argsort(at[some], kind="stable")]
        lines.append((text[some], at[some], weight[some]))
    common = np.zeros(total.shape)
    for lo in range(0, len(both), COLUMNS):
        sides = []
        for (text, at, weight), n in zip(lines, total.shape, strict=True):
            i, j = np.searchsorted(at, [lo, lo + COLUMNS])
            side = np.zeros((n, min(COLUMNS, len(both) - lo)))
            side[text[i:j], at[i:j] - lo] = weight[i:j]
            sides.append(side)
        common += sides[0] @ sides[1].T
    return common / np.maximum(total - common, 1e-12)


def _joining(idf, threshold: float):
    """All pairs of two blocks (or within one) to links that join groups, as few as do."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("bag", "ascending")])
        side = np.array(table.column("side").to_pylist())
        n = int((side == 0).sum())
        left, right = table.slice(0, n), table.slice(n) if n < len(side) else table
        found: tuple = ([], [])
        if left.num_rows and right.num_rows:
            names: dict = {}
            la, lb = (np.array([names.setdefault(x, len(names)) for x in t.column("label").to_pylist()]) for t in (left, right))
            texts = [t.column("text").combine_chunks() for t in (left, right)]
            i, j = np.nonzero((_similarities(*texts, idf.value) >= threshold) & (la[:, None] != lb[None, :]))
            _, one = np.unique(la[i] * len(names) + lb[j], return_index=True)
            parent = list(range(len(names)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            bags = [t.column("bag").to_pylist() for t in (left, right)]
            for x, y in zip(i[one].tolist(), j[one].tolist(), strict=True):
                p, q = root(la[x]), root(lb[y])
                if p != q:
                    parent[p] = q
                    found[0].append(bags[0][x])
                    found[1].append(bags[1][y])
        return pa.table([pa.array(x, pa.binary()) for x in found], names=["a", "b"])

    return run


def remaining_links(bands: DataFrame, labels: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """Links ``(a, b)`` that join groups within bands of more than ``WHOLE`` nodes, from all pairs of different groups.

    A group that fills a block has blocks of its own, which are not compared with each other;
    the rest of a band is dealt to blocks by hash. ``labels`` is (node, label) of linked nodes.
    """
    key = ["band", "hash"]
    rows = bands.filter(F.col("many") > WHOLE).join(labels.withColumnRenamed("node", "bag"), "bag", "left")
    rows = rows.select(*key, "bag", F.coalesce("label", "bag").alias("label"))
    several = rows.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select(*key)
    rows = durable.written(rows.join(several, key, "left_semi"), "undecided")
    if rows.isEmpty():
        return rows.select(F.col("bag").alias("a"), F.col("bag").alias("b"))
    load = F.greatest(F.lit(1.0), F.col("size") * (BLOCK / BLOCK_BYTES))
    loads = rows.join(texts.select("bag", "size"), "bag").groupBy(*key, "label").agg(F.sum(load).alias("load"))
    loads = durable.written(loads.withColumn("own", F.when(F.col("load") >= BLOCK, F.col("label")).otherwise(F.lit(b""))), "loads")
    counts = loads.groupBy(*key, "own").agg(F.ceil(F.sum("load") / BLOCK).cast("int").alias("count"))
    counts = durable.written(counts, "counts")
    dealt = rows.join(loads.select(*key, "label", "own"), [*key, "label"]).join(counts, [*key, "own"])
    dealt = dealt.withColumn("block", F.struct("own", F.pmod(F.xxhash64("bag"), F.col("count")).cast("int").alias("nth")))
    blocks = counts.select(*key, "own", F.explode(F.expr("sequence(0, count - 1)")).alias("nth")).select(*key, F.struct("own", "nth").alias("block"))
    tasks = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), key)
    tasks = tasks.filter((F.col("x") <= F.col("y")) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.own") == F.lit(b""))))
    tasks = durable.written(tasks, "block-pairs")
    left = tasks.select("*", F.col("x").alias("block"), F.lit(0).alias("side"))
    right = tasks.filter("x != y").select("*", F.col("y").alias("block"), F.lit(1).alias("side"))
    placed = dealt.select(*key, "block", "bag", "label").join(left.unionByName(right), [*key, "block"])
    placed = placed.select(*key, "x", "y", "side", "bag", "label").join(texts.select("bag", "text"), "bag")
    found = placed.groupBy(*key, "x", "y").applyInArrow(_joining(idf, threshold), "a binary, b binary")
    return durable.written(found, "remaining")


def components(links: DataFrame) -> DataFrame:
    """``(node, label)``: the least node of the component, by least labels and pointer jumps."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable.written(both.distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = durable.written(labels, "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        new = durable.written(new, "labels")
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = new.join(jump, "label").select("node", "old", F.least("label", "root").alias("label"))
        new = durable.written(new, "labels")
        if new.filter("old != label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def groups(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, key, class_id (the least id of its group), class_size, kept."""
    spark = docs.sparkSession
    rows = docs.select(col(id).alias("id"), text_key(col(text)).alias("key"), col(text).alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(rows.select("text")))
    kind = rows.schema["id"].dataType.simpleString()
    signed = rows.mapInArrow(_sign(idf), f"id {kind}, key binary, bag binary, sign binary")
    signed = durable.written(signed, "signed")
    bags = signed.filter("bag is not null").groupBy("bag")
    nodes = bags.agg(F.min("key").alias("key"), F.first("sign").alias("sign"), F.min(F.struct(F.isnull("id"), "id", "key")).alias("least"), F.count("*").alias("n"))
    nodes = durable.written(nodes, "nodes")

    bands = shared_bands(nodes.select("bag", "sign"))
    pairs = durable.written(candidate_pairs(nodes.select("bag", "sign", "n"), bands), "candidates")
    ends = pairs.select(F.col("a").alias("bag")).unionByName(pairs.select(F.col("b").alias("bag")))
    ends = ends.unionByName(bands.filter(F.col("many") > WHOLE).select("bag")).distinct()
    wanted = durable.written(nodes.join(ends, "bag", "left_semi").select("bag", "key"), "wanted")
    once = rows.select("key", F.coalesce("text", F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    texts = durable.written(once.join(wanted, "key").select("bag", "text", F.octet_length("text").alias("size")), "texts")
    best = F.max_by(F.struct("a", "b"), F.struct("alike", "a"))
    first = pairs.groupBy(F.col("b").alias("_b")).agg(best.alias("p")).select("p.a", "p.b")
    links = verified(first, texts, idf, threshold)
    labels = components(links)
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    known_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(known, "a", "left").join(known_b, "b", "left")
    rest = rest.filter(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    more = verified(rest, texts, idf, threshold)
    links = links.unionByName(more).select("a", "b")
    if not more.isEmpty():
        labels = components(links)
    last = remaining_links(bands, labels, texts, idf, threshold)
    if not last.isEmpty():
        labels = components(links.unionByName(last))

    member = nodes.join(labels, nodes["bag"] == labels["node"], "left").withColumn("label", F.coalesce("label", "bag"))
    member = member.select("bag", "label", "least", "n")
    sizes = member.groupBy("label").agg(F.min("least").alias("least"), F.sum("n").alias("class_size")).filter("class_size > 1")
    member = member.select("bag", "label").join(sizes, "label")
    member = member.select("bag", F.col("least.id").alias("class_id"), F.col("least.key").alias("_keep"), "class_size")
    member = durable.written(member, "members")
    found = signed.groupBy("id", "key", "bag").agg(F.count("*").alias("copies"))
    found = durable.written(found, "rows").join(member, "bag", "left")
    alone = F.col("class_size").isNull()
    found = found.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first_one = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("_keep"))
    return found.select(
        "id",
        "key",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        ((F.col("_nth") == 1) & (alone | first_one)).alias("kept"),
    )


def survivors(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, with all columns."""
    kept = groups(docs, threshold, id, text).filter("kept").select(F.struct("id", "key").alias("_row")).distinct()
    named = boxed(docs, F.struct(col(id).alias("id"), text_key(col(text)).alias("key")).alias("_row"))
    return named.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*unboxed(docs))
