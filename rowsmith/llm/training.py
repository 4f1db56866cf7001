"""Bounded samples of labelled documents for fitting small models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm.common import col, held_out, plain_name


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, dict[int, int]]:
    """``(id, text, label)`` of at most ``per_class`` documents a class, and the rows of each class.

    Only rows outside the held-out fold are read. The sample is the rows of least hash,
    the same on every run; class counts cover all rows. A repeated label row counts once
    and the smaller of two labels holds. The ids are a broadcast of at most
    ``2 * per_class`` rows; the texts stay distributed.
    """
    known = labels.select(col(id).alias("id"), col(label).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("id"), F.col("id")]
    few = known.filter("label = 0").orderBy(*order).limit(per_class)
    few = few.unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(col(id).alias("id"), col(text).alias("text"))
    return texts.join(F.broadcast(few), "id"), counts


def scoring_input(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.expr(plain_name(id)).alias("id"), F.expr(plain_name(text)).alias("text"))
