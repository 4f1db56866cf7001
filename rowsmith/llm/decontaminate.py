"""Benchmark decontamination by a broadcast hash set of normalised word windows.

Every window of ``n`` words of a benchmark item is hashed; the windows of each document
are hashed the same way, looked up, and compared word by word before they count.

The set is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows, so its size is
bounded whatever the benchmark holds; a larger benchmark takes one scan per block.

Defined results: null and empty texts have no words and no hits, an item without words
has no window, a null item id is left out of ``items``, rows with the same id and text
each get the same result, empty tables give empty or hitless results. Columns other
than those named are not read by ``contamination``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import boxed, col, text_key, unboxed
from rowsmith.plans import durable

WORDS = 13  # words of a window
RATE = 20  # a document is contaminated when RATE * hit words >= words
BLOCK_WINDOWS = 100_000  # windows broadcast at once: about 20 MB of text
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before A-Z is lower-cased


def words(text: Column) -> Column:
    """The lower-cased words of a text; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, n: int = WORDS, id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``(size, words, hash)``; items of fewer than ``n`` words are one window."""
    return item_windows(items, n, id, text).select("size", "window", "hash").distinct()


def item_windows(items: DataFrame, n: int = WORDS, id: str = "item_id", text: str = "text") -> DataFrame:
    """Every window of every item: ``(item, size, window, hash)``."""
    rows = items.select(col(id).alias("item"), words(col(text)).alias("_w")).filter(F.size("_w") > 0)
    size = F.least(F.size("_w"), F.lit(n))
    rows = rows.withColumn("size", size)
    starts = F.sequence(F.lit(1), F.size("_w") - F.col("size") + 1)
    rows = rows.select("item", "size", "_w", F.explode(starts).alias("_at"))
    rows = rows.select("item", "size", F.array_join(F.slice("_w", F.col("_at"), F.col("size")), " ").alias("window"))
    return rows.withColumn("hash", window_hash(F.split("window", " "), F.lit(1), F.col("size"))).distinct()


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def window_hash(ws: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(F.slice(word_hashes(ws), start, size))


def _hits(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Verified occurrences of windows of one size: ``(id, key, at, size, window)``, ``at`` from 0.

    ``windows`` is a block of bounded size.
    """
    rows = docs.select("id", "key", "words", word_hashes(F.col("words")).alias("_h"))
    starts = F.when(F.size("_h") >= size, F.sequence(F.lit(1), F.size("_h") - (size - 1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("_h"), i, F.lit(size))))
    rows = rows.select("id", "key", "words", hashes.alias("_hs"))
    rows = rows.select("id", "key", "words", F.posexplode_outer("_hs").alias("at", "hash"))  # outer: no filter that repeats the hashing
    rows = rows.join(F.broadcast(windows.select("hash", "window")), "hash")
    here = F.array_join(F.slice("words", F.col("at") + 1, F.lit(size)), " ")
    return rows.filter(here == F.col("window")).select("id", "key", "at", F.lit(size).alias("size"), "window")


def hits(
    docs: DataFrame, items: DataFrame, n: int = WORDS, id: str = "doc_id", text: str = "text", block: int = BLOCK_WINDOWS
) -> DataFrame:
    """Every verified occurrence of a window in a document, as ``(id, key, at, size, window)``."""
    found = durable.written(benchmark_windows(items, n, text=text), "windows")
    rows = docs.select(col(id).alias("id"), text_key(col(text)).alias("key"), words(col(text)).alias("words"))
    parts = []
    for size, count in sorted((r["size"], r["count"]) for r in found.groupBy("size").count().collect()):
        blocks = -(-count // block)
        for b in range(blocks):
            some = found.filter(F.col("size") == size)
            if blocks > 1:
                some = some.filter(F.pmod("hash", F.lit(blocks)) == b)
            parts.append(_hits(rows, some, size))
    if not parts:
        return rows.select("id", "key", F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("window")).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contamination(
    docs: DataFrame,
    items: DataFrame,
    n: int = WORDS,
    rate: int = RATE,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    block: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: id, key, n_words, n_hit, spans, items, contaminated.

    ``spans`` are the maximal runs of hit words as ``(start, length)`` in words, ``items``
    the ids of the items with an occurring window, sorted as strings. What a document
    gathers is bounded by its own words and by the benchmark.
    """
    found = durable.written(hits(docs, items, n, id, text, block), "hits")
    owners = item_windows(items, n, item_id, text).filter(F.col("item").isNotNull())
    owners = owners.groupBy("size", "window").agg(F.collect_set(F.col("item").cast("string")).alias("owners"))
    # Spans: a hit opens a new run when it starts behind the end of all hits before it.
    order = Window.partitionBy("id", "key").orderBy("at", "size")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    places = found.select("id", "key", "at", "size").distinct()
    places = places.withColumn("_reach", F.max(F.col("at") + F.col("size")).over(before))
    places = places.withColumn("_new", (F.col("_reach").isNull() | (F.col("at") > F.col("_reach"))).cast("int"))
    runs = places.withColumn("_run", F.sum("_new").over(upto)).groupBy("id", "key", "_run")
    runs = runs.agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("end"))
    runs = runs.select("id", "key", F.struct("start", (F.col("end") - F.col("start")).alias("length")).alias("span"))
    spans = runs.groupBy("id", "key").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    distinct = found.select("id", "key", "size", "window").distinct().join(owners, ["size", "window"])
    named = distinct.groupBy("id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("items"))
    facts = spans.withColumnsRenamed({"id": "_id", "key": "_key"})
    named = named.withColumnsRenamed({"id": "_id", "key": "_key"})

    base = docs.select(col(id).alias("id"), text_key(col(text)).alias("key"), F.size(words(col(text))).cast("long").alias("n_words"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    out = base.join(facts, same, "left").drop("_id", "_key").join(named, same, "left").drop("_id", "_key")
    n_hit = F.aggregate(F.coalesce("spans", F.array()), F.lit(0).cast("long"), lambda a, s: a + s["length"])
    out = out.withColumn("n_hit", F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(n_hit))
    out = out.withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(rate) * F.col("n_hit") >= F.col("n_words")))


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    remove: str = "documents",
    n: int = WORDS,
    rate: int = RATE,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without their hit words.

    With "spans" each run of hit words of a contaminated document goes, with the
    separators inside the run. Clean documents and all other columns stay as they are.
    """
    found = contamination(docs, items, n, rate, id, text, item_id).filter("contaminated")
    found = found.select(F.struct("id", "key").alias("_row"), F.col("spans").alias("spans_"))
    found = durable.written(found.dropDuplicates(["_row"]), "contaminated")
    named = boxed(docs, F.struct(col(id).alias("id"), text_key(col(text)).alias("key")).alias("_row"))
    if remove == "documents":
        return named.join(found, "_row", "left_anti").select(*unboxed(docs))
    joined = named.join(found, "_row", "left")
    whole = F.col("_doc").getField(text)
    token = F.regexp_extract_all(whole, F.lit(WORD_ANY_CASE), F.lit(0))
    gaps = F.split(whole, WORD_ANY_CASE)  # one more than there are words
    hit = lambda i: F.exists("spans_", lambda s: (i >= s["start"]) & (i < s["start"] + s["length"]))
    inner = lambda i: F.exists("spans_", lambda s: (i > s["start"]) & (i < s["start"] + s["length"]))
    word = F.transform(token, lambda w, i: F.when(hit(i), F.lit("")).otherwise(w))
    gap = F.transform(gaps, lambda g, i: F.when(inner(i), F.lit("")).otherwise(g))
    pieces = F.zip_with(gap, word, lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    rebuilt = F.array_join(pieces, "")
    return joined.select(
        *[F.when(F.col("spans_").isNull(), whole).otherwise(rebuilt).alias(c) if c == text else kept for c, kept in zip(docs.columns, unboxed(docs), strict=True)]
    )
