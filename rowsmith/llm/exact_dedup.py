"""Exact deduplication by recipes of content-defined chunks.

A text is cut where its own content says so, every distinct chunk gets one verified
identifier, and two texts are equal when their ordered identifier lists are. Chunk
texts cross the network once, pre-aggregated by the task that read them; a document
itself never does, however long it is.

Defined results: a null text is an empty one, an empty text has an empty recipe (all
empty texts are equal), a null id is larger than any other, rows with the same id and
equal texts are copies of which one stays, and an empty table gives an empty table.
Columns other than the id and the text are not read by ``duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import boxed, col, sha256_hex, unboxed
from rowsmith.plans import durable

MIN_CHARS = 1_024  # a chunk ends at the first cut after so many characters ...
MAX_CHARS = 16_384  # ... or here
CUT = "(?<=[aeiou][^aeiou ] )"  # behind a space that follows a vowel and one other character
CHUNK = f"(?s).{{{MIN_CHARS},{MAX_CHARS - 1}}}?{CUT}|.{{1,{MAX_CHARS}}}+"

# Gives what replacing every run of whitespace gives: a lone space is left as it is.
RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"

Naming = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """Every run of ASCII whitespace as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they give the text back."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def clashes(docs: DataFrame, text: str = "text", naming: Naming = F.xxhash64) -> DataFrame:
    """Chunks whose name a different chunk has too, as ``(name, chunk, nth)`` with ``nth`` from 1.

    Distinct chunks are told apart by all their bytes, so a name that is missing here
    stands for one content. With 64-bit names the table is as good as always empty.
    """
    parts = docs.select(F.explode_outer(chunks(normalised(col(text)))).alias("chunk")).filter("chunk is not null")
    distinct = parts.groupBy(naming(F.col("chunk")).alias("name"), "chunk").count().select("name", "chunk")
    shared = distinct.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    shared = durable.written(shared, "clashes")
    if shared.isEmpty():
        return docs.sparkSession.createDataFrame([], "name long, chunk string, nth int")
    few = distinct.join(shared, "name", "left_semi").groupBy("name").agg(F.sort_array(F.collect_list("chunk")).alias("all"))
    few = few.select("name", F.posexplode("all").alias("nth", "chunk"))
    return durable.written(few.select(F.col("name").cast("long"), "chunk", (F.col("nth") + 1).alias("nth")), "clashes")


def recipes(docs: DataFrame, id: str = "doc_id", text: str = "text", naming: Naming = F.xxhash64) -> DataFrame:
    """Distinct ``(id, text_sha256, recipe)`` with ``copies``, the number of rows that share them."""
    clashing = clashes(docs, text, naming)
    base = docs.select(col(id).alias("id"), normalised(col(text)).alias("_text"))
    base = base.select("id", sha256_hex(F.col("_text")).alias("text_sha256"), chunks(F.col("_text")).alias("_chunks"))
    names = F.transform("_chunks", lambda c: naming(c).cast("long"))
    plain = base.select("id", "text_sha256", names.alias("names"))
    if clashing.isEmpty():
        rows = plain.withColumn("marks", F.expr("cast(array() as array<struct<pos:int,nth:int>>)"))
    else:
        parts = base.select("id", "text_sha256", F.posexplode("_chunks").alias("pos", "chunk"))
        parts = parts.withColumn("name", naming(F.col("chunk")).cast("long")).join(clashing, ["name", "chunk"])
        marks = parts.groupBy("id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "nth"))).alias("marks"))
        marks = marks.select(F.col("id").alias("_id"), F.col("text_sha256").alias("_sha"), "marks")
        same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
        rows = plain.join(marks, same, "left").drop("_id", "_sha")
        rows = rows.withColumn("marks", F.coalesce("marks", F.expr("cast(array() as array<struct<pos:int,nth:int>>)")))
    rows = rows.select("id", "text_sha256", F.struct("names", "marks").alias("recipe"))
    return rows.groupBy("id", "text_sha256", "recipe").agg(F.count("*").alias("copies"))


def duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", naming: Naming = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``naming`` gives a chunk its name. Groups come from partial sums, so a third of all
    rows may be copies of one text; rows then find their group by a join which adaptive
    execution splits, and only groups of several rows take part in it.
    """
    known = durable.written(recipes(docs, id, text, naming), "recipes")
    groups = known.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = durable.written(groups.filter("group_size > 1"), "groups")
    found = known.join(groups, "recipe", "left")
    first = F.col("nth") == 0
    found = found.select(
        "id",
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "text_sha256",
        F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("nth"),
    )
    kept = first & F.col("id").eqNullSafe(F.col("keep_id"))
    return found.select(F.col("id").alias(id), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = duplicates(docs, id, text).filter("kept")
    kept = kept.select(F.struct(col(id).alias("id"), F.col("text_sha256").alias("sha")).alias("_row")).distinct()
    named = boxed(docs, F.struct(col(id).alias("id"), sha256_hex(normalised(col(text))).alias("sha")).alias("_row"))
    return named.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*unboxed(docs))
