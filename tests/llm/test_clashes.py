"""Input columns named like helper columns come back as they were."""

import pytest
from pyspark.sql import functions as F

from rowsmith.llm import decontaminate, exact_dedup, minhash, mixing, sharding

NAMES = ["_row", "_h", "_s", "_size", "spans_", "_block", "_bucket", "_doc", "_step", "_offset", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"some words {i % 7} that are long enough to make a text of their own {i % 7}", "ab"[i % 2], 5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    return df.withColumns({n: F.concat(F.lit(n + "="), F.col("doc_id")) for n in NAMES})


def intact(docs, out, least):
    rows = out.select(*[F.col(f"`{c}`") for c in docs.columns]).collect()
    assert len(rows) >= least
    for r in rows:
        assert [r[n] for n in NAMES] == [f"{n}={r['doc_id']}" for n in NAMES]
        assert r["text"].startswith("some words") and r["source"] in "ab" and r["n_chars"] == 5


def test_mixed(docs):
    intact(docs, mixing.mixed(docs), 40)


def test_shards(docs, monkeypatch):
    intact(docs, sharding.into_shards(docs), 40)
    again = docs.unionByName(docs).unionByName(docs.filter("doc_id = 3"))
    out = sharding.into_shards(again, bucket_bytes=300)  # equal rows are dealt to several buckets
    intact(docs, out, 81)
    assert out.select("shard", "slot").distinct().count() == 81


def test_deduplicated(docs):
    intact(docs, exact_dedup.deduplicated(docs), 7)


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontaminated(spark, docs, remove):
    items = spark.createDataFrame([("x", "words 3 that are long enough to make a text of their own 3")], "item_id string, text string")
    out = decontaminate.decontaminated(docs, items, remove=remove)
    if remove == "documents":
        intact(docs, out, 30)
    else:
        assert {r["_row"] for r in out.select("_row").collect()} == {f"_row={i}" for i in range(40)}
        assert {r.text for r in out.filter("doc_id = 3").collect()} == {"some "}


def test_survivors(docs):
    intact(docs, minhash.survivors(docs), 1)
