"""Spelling variants by finite-state composition.

Words and their counts come from one pass over all texts. Two words are near if one edit
(a code point inserted, deleted or replaced) turns one into the other. Such pairs are what
``A o E o A`` accepts: the minimised acceptor ``A`` of the vocabulary, composed with a
one-edit transducer ``E`` and with ``A`` again.

The composition is enumerated in parts. Let ``at`` be the length of what a pair has in common
at the start: the place of its edit. Every pair has one ``at`` and one length ``size`` of its
shorter word, and if ``low <= at < high`` both words begin with the same ``low`` code points and
end with the same ``size - high``. So all pairs of (size, low, high) with the same beginning and
end lie in one group, which is the composition started in the state that the beginning
leads to. A word is in four groups: edits in its first and in its second half, with words as
long as itself and with words one shorter. A group of more than ``GROUP`` words is cut in half
between ``low`` and ``high``, again and again, so its parts fix more of the words; with one
place left a group holds the fillings of at most two code points. No group is dropped.

A task builds the minimised acceptor of a group's middle parts from the sorted words, walks
it once from the initial state, and at each edit asks for the words that the two states
behind it have in common; those lists are kept per pair of states.

Defined results: null and empty texts have no words; a null id is read as an empty text;
repeated rows count again; ties of the most frequent near word go to the smallest in
code-point order; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import col
from rowsmith.plans import durable, skew

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP_ONE_OF = 31  # a run loses a code point if this divides its hash
MIN_LENGTH = 7
MIN_COUNT = 2
FACTOR = 10  # a form is this much more frequent than its variant
GROUP = 20_000  # words of a group that a task takes at once


def counted(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))
    key = F.coalesce(col(id).cast("string"), F.lit(""))
    rows = docs.select(key.alias("id"), F.explode(F.filter(runs, lambda w: F.length(w) >= MIN_LENGTH)).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DROP_ONE_OF == 0, cut).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _keyed(words: DataFrame) -> DataFrame:
    """``(word, n, size, low, high, key)``: key is what the words of a group begin and end with."""
    begin = F.substring(F.col("word"), F.lit(1), F.col("low"))
    after = F.greatest(F.col("size") - F.col("high"), F.lit(0))
    end = F.substring(F.col("word"), F.length("word") - after + 1, after)
    return words.withColumn("key", F.concat(begin, F.lit("|"), end))


def _halves(size: Column, low: Column, high: Column) -> Column:
    mid = F.floor((low + high) / 2).cast("int")
    parts = [F.struct(size.alias("size"), low.alias("low"), mid.alias("high")), F.struct(size.alias("size"), mid.alias("low"), high.alias("high"))]
    return F.explode(F.array(*parts))


def _grouped(words: DataFrame, group: int) -> DataFrame:
    """Words in all their groups, none of more than ``group`` words while it can be cut."""
    length = F.length("word")
    both = words.withColumn("size", F.explode(F.array(length, length - 1)))
    both = both.filter(F.col("size") >= MIN_LENGTH)
    halves = _halves(F.col("size"), F.lit(0), F.col("size") + 1)
    rows = durable.written(_keyed(both.select("word", "n", halves.alias("g")).select("word", "n", "g.*")), "groups")
    ids = ["size", "low", "high", "key"]
    fit = None
    while True:
        large = rows.groupBy(*ids).agg(F.count("*").alias("words"))
        large = durable.written(large.filter((F.col("words") > group) & (F.col("high") - F.col("low") > 1)).select(*ids), "large")
        if large.isEmpty():
            return rows if fit is None else fit.unionByName(rows)
        few = F.broadcast(large) if skew.is_small(large) else large
        rest = rows.join(few, ids, "left_anti")
        fit = rest if fit is None else fit.unionByName(rest)
        cut = rows.join(few, ids, "left_semi").select("word", "n", _halves(F.col("size"), F.col("low"), F.col("high")).alias("g"))
        rows = durable.written(_keyed(cut.select("word", "n", "g.*")), "groups")


class Acceptor:
    """The minimal acyclic automaton of sorted, distinct words; equal states are one.

    ``arcs[q]`` maps a symbol to the next state, ``final`` holds the accepting states, state 0 is
    the initial one.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: set[int] = set()
        self._seen: dict[tuple, int] = {}
        path, last = [0], ""
        for word in words:
            common = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                common += 1
            self._settle(path, last, common)
            for c in word[common:]:
                self.arcs.append({})
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final.add(path[-1])
            last = word
        self._settle(path, last, 0)

    def _settle(self, path: list[int], last: str, down_to: int) -> None:
        """States behind ``down_to`` get no more arcs: each becomes the equal one met before, if any."""
        while len(path) > down_to + 1:
            state = path.pop()
            form = (state in self.final, *self.arcs[state].items())
            known = self._seen.setdefault(form, state)
            if known != state:
                self.final.discard(state)
                self.arcs[path[-1]][last[len(path) - 1]] = known


def near_pairs(words: list[str], size: int, places: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart among sorted words, the shorter of ``size`` code points, edited at a place below ``places``."""
    fsa = Acceptor(words)
    arcs, final = fsa.arcs, fsa.final
    known: dict[tuple[int, int, int], list[str]] = {}

    def common(p: int, q: int, n: int) -> list[str]:
        """Words of ``n`` symbols that both states accept."""
        if n == 0:
            return [""] if p in final and q in final else []
        key = (p, q, n) if p <= q else (q, p, n)
        out = known.get(key)
        if out is None:
            here, there = arcs[p], arcs[q]
            if len(here) > len(there):
                here, there = there, here
            out = [c + s for c, r in here.items() if c in there for s in common(r, there[c], n - 1)]
            known[key] = out
        return out

    stack = [("", 0)]
    while stack:
        begin, state = stack.pop()
        at = len(begin)
        left = size - at  # of the shorter word
        out = list(arcs[state].items())
        if at + 1 < places:
            stack.extend((begin + c, q) for c, q in out)
        for i, (a, p) in enumerate(out):
            if left > 0:
                for b, q in out[i + 1 :]:
                    for s in common(p, q, left - 1):
                        yield begin + a + s, begin + b + s
            # ``a`` inserted here; the shorter word goes on with another symbol, or ends.
            if left == 0:
                if state in final and p in final:
                    yield begin, begin + a
                continue
            for c, r in out:
                if c != a and c in arcs[p]:
                    for s in common(r, arcs[p][c], left - 1):
                        yield begin + c + s, begin + a + c + s


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(word, n, n_near, best_n, best)`` of the words of whole groups, which come one after another."""
    out: tuple[list, ...] = ([], [], [], [], [])

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), *[pa.array(x, pa.int64()) for x in out[1:4]], pa.array(out[4], pa.string())],
            names=["word", "n", "n_near", "best_n", "best"],
        )
        for x in out:
            x.clear()
        return batch

    def solve(group: tuple[int, int, int, str], count: dict[str, int]) -> None:
        size, low, high, _ = group
        after = max(size - high, 0)
        inner = {w[low : len(w) - after]: w for w in count}
        near: dict[str, int] = {}
        best: dict[str, tuple[int, str]] = {}
        for u, v in near_pairs(sorted(inner), size - low - after, high - low):
            u, v = inner[u], inner[v]
            for w, o in ((u, v), (v, u)):
                near[w] = near.get(w, 0) + 1
                n, top = count[o], best.get(w)
                if top is None or n > top[0] or (n == top[0] and o < top[1]):
                    best[w] = (n, o)
        for w, n in near.items():
            for x, value in zip(out, (w, count[w], n, *best[w]), strict=True):
                x.append(value)

    group, count = None, {}
    for b in batches:
        for size, low, high, key, word, n in zip(*(b.column(c).to_pylist() for c in ("size", "low", "high", "key", "word", "n")), strict=True):
            if (size, low, high, key) != group:
                if len(count) > 1:
                    solve(group, count)
                group, count = (size, low, high, key), {}
                if len(out[0]) > 10_000:
                    yield flushed()
            count[word] = n
    if len(count) > 1:
        solve(group, count)
    if out[0]:
        yield flushed()


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``(word, n_near, form, form_n)``: how many near words each word has, and its most frequent one."""
    ids = ["size", "low", "high", "key"]
    rows = _grouped(words, group).repartition(*ids).sortWithinPartitions(*ids)
    found = rows.mapInArrow(_near, "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")
    )


def _roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form: every round doubles how far a word sees, and counts grow by ``FACTOR`` a step."""
    ends = links.select("word", F.col("form").alias("root"))
    while True:
        ends = durable.written(ends, "roots")
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = ends.join(further, "root", "left")
        if joined.filter(F.col("next").isNotNull()).isEmpty():
            return ends
        ends = joined.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` of every word of the vocabulary."""
    words = durable.written(counted(docs, id, text), "words")
    near = words.join(near_words(words, group), "word", "left")
    keeps = F.col("form_n") >= FACTOR * F.col("n")
    near = near.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(keeps, F.col("form")).alias("form"),
        F.when(keeps, F.col("form_n")).alias("form_n"),
    )
    near = durable.written(near, "near-words")
    roots = _roots(near.filter(F.col("form").isNotNull()))
    return near.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
