import math
import zlib

import pytest
from pyspark.sql import functions as F

from rowsmith.llm import mixing, sharding
from rowsmith.llm.common import table
from tests.llm.cases import odd_documents

FOLDER = "/root/testdata/sf0.001"


def tokens_by_source(rows):
    out = {}
    for r in rows:
        n = len([w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in r.text or "").split(" ") if w])
        out[r.source] = out.get(r.source, 0) + n
    return out


def exponent(shares, fits):
    """Plain bisection of the smallest exponent that fits."""
    low, high = 0.0, 1.0
    if fits(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def weights(shares, a):
    z = sum(s**a for s in shares.values())
    return {k: s**a / z for k, s in shares.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values())


@pytest.mark.parametrize("goal", [{"max_repetition": 1.5}, {"max_repetition": None, "entropy": 2.9}, {"max_repetition": 1.4, "budget": 60_000}])
def test_exponent_and_budgets(spark, goal):
    docs = table(spark, FOLDER, "documents")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 31 == 0, None).otherwise(F.col("source")))
    have = tokens_by_source(docs.collect())
    total = sum(have.values())
    shares = {k: v / total for k, v in have.items()}

    def budget(a):
        w = weights(shares, a)
        return goal["budget"] if "budget" in goal else total * max(shares[k] / w[k] for k in shares)

    def fits(a):
        w = weights(shares, a)
        if goal.get("entropy"):
            return entropy(w) <= goal["entropy"]
        return max(budget(a) * w[k] / have[k] for k in shares) <= goal["max_repetition"] * (1 + 1e-12)

    a = exponent(shares, fits)
    want = {k: budget(a) * w for k, w in weights(shares, a).items()}
    out = mixing.mixed(docs, block_tokens=500, **goal)
    got = tokens_by_source(out.collect())
    largest = max(len((r.text or "").split()) for r in docs.collect())
    for k in have:  # never over the budget, and short of it by less than one document
        assert want[k] - largest <= got.get(k, 0) <= want[k] + 1, k
    copies = out.groupBy("doc_id", "epoch").count()
    assert copies.agg(F.max("count")).first()[0] == 1
    if "budget" not in goal:
        assert out.select("doc_id").distinct().count() == docs.count()
    assert out.filter("progress < 0 or progress > 1").count() == 0


def test_mix_does_not_depend_on_partitions(spark):
    docs = table(spark, FOLDER, "documents")
    a = sorted(map(str, mixing.mixed(docs, block_tokens=500).collect()))
    assert a == sorted(map(str, mixing.mixed(docs.repartition(5), block_tokens=500).collect()))


def test_epochs_permute_blocks(spark):
    docs = table(spark, FOLDER, "documents").withColumn("source", F.when(F.col("doc_id") < 5, "small").otherwise("large"))
    out = mixing.mixed(docs, max_repetition=3.0, block_tokens=100)
    assert out.filter("source = 'small'").agg(F.max("epoch")).first()[0] >= 1
    one = out.filter("source = 'large' and epoch = 0").orderBy("progress").select("block").collect()
    blocks = [r.block for r in one]
    assert len([i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]]) == len(set(blocks)) - 1
    assert blocks != sorted(blocks)


def test_odd_mix(spark):
    docs = odd_documents(spark)
    out = mixing.mixed(docs.withColumn("epoch", F.lit("mine")))
    assert out.columns == [*docs.columns, "epoch", "epoch_", "block", "progress"]
    assert out.select("doc_id", "text").distinct().count() == docs.select("doc_id", "text").distinct().count()
    assert mixing.mixed(odd_documents(spark, empty=True)).count() == 0
    wordless = docs.filter("doc_id in (0, 1, 2)")
    assert mixing.mixed(wordless).count() == 3


def check_shards(rows, shards, n):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(i, [])) for i in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("bucket_bytes", [2_000, 1 << 20])
def test_shards_hold_every_row_once(spark, bucket_bytes):
    docs = table(spark, FOLDER, "documents")
    out = sharding.into_shards(docs, 24, bucket_bytes=bucket_bytes)
    rows = out.collect()
    check_shards(rows, 24, docs.count())
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())
    again = sharding.into_shards(docs.repartition(3), 24, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_repeated_rows_are_dealt_to_many_buckets(spark, monkeypatch):
    largest = spark.sparkContext.accumulator(0)
    plain = sharding._shuffled

    def counted(*args):
        run = plain(*args)

        def both(part):
            largest.add(part.num_rows**2)
            return run(part)

        return both

    monkeypatch.setattr(sharding, "_shuffled", counted)
    rows = [(None, "")] * 1_500 + [(i, "t") for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.into_shards(docs, 6, bucket_bytes=2_000).collect()
    assert largest.value < 1_500**2 / 2  # sum of squares: no group holds most of the repeated rows
    check_shards(out, 6, len(rows))
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in rows)
    again = sharding.into_shards(docs.repartition(3), 6, bucket_bytes=2_000).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_order_is_shuffled(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.into_shards(docs, 1, bucket_bytes=2_000).orderBy("slot").collect()
    ids = [r.doc_id for r in out]
    rising = sum(a < b for a, b in zip(ids, ids[1:], strict=False))
    assert 900 < rising < 1_100
    near = sum(abs(i - d) < 20 for i, d in enumerate(ids))
    assert near < 100


def test_odd_shards(spark, tmp_path):
    docs = odd_documents(spark)
    out = sharding.into_shards(docs, 5, bucket_bytes=50_000)
    assert out.columns == [*docs.columns, "shard_", "slot"]
    rows = [{"shard": r.shard_, "slot": r.slot} for r in out.collect()]
    check_shards(rows, 5, docs.count())
    assert sharding.into_shards(odd_documents(spark, empty=True)).count() == 0
    sharding.write_shards(out, str(tmp_path / "out"), "shard_")
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_digest_of_the_query(spark):
    from rowsmith.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in table(spark, FOLDER, "documents").collect()}
    rows = QUERIES["op5_sharding"](spark, FOLDER).collect()
    assert all(r["size"] == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    check_shards(rows, 24, len(docs))
