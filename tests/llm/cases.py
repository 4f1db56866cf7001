"""Documents with every odd case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("Shard", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def words(rng, n):
    return " ".join("".join(rng.choice("aeioubcdst") for _ in range(rng.randint(1, 8))) for _ in range(n))


def odd_texts(seed=5):
    rng = random.Random(seed)
    base = words(rng, 300)
    long = words(rng, 30_000)
    return [
        None, "", " ", "\t\n", "...", "x", "x", base, base, base.replace(" ", "  "), base + " tail", long, long, long[:90_000],
        "ünïcödé Ωμέγα 漢字 🙂 \x00 nul", base[50:] + base[:50], None, "", "A-Z a-z 0-9", base.upper(), "aaaa " * 500, "aaaa " * 400,
    ]


def odd_documents(spark, empty=False):
    rows = []
    for i, text in enumerate([] if empty else odd_texts()):
        rows.append((i, text, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(text or ""), "k", i, str(i), 0.5))
    if rows:
        rows.append(rows[7])  # a repeated row
        rows.append((None, rows[7][1], None, None, None, None, None, None, None))
        rows.append((7, "another text under the same id", "en", "a", 3, "k", 1, "1", 1.0))
    return spark.createDataFrame(rows, SCHEMA)


def labels_of(spark, docs, empty=False):
    rows = [] if empty else [(r.doc_id, int(bool(r.text) and len(r.text) > 20), int((r.doc_id or 0) % 3 == 0)) for r in docs.collect()]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
