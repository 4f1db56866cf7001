import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rowsmith.llm import exact_dedup
from tests.llm.cases import odd_documents


def brute(rows):
    norm = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in rows]
    out, seen = [], set()
    for i, text in norm:
        ids = [j for j, t in norm if t == text]
        keep = min((j for j in ids if j is not None), default=None)
        first = i == keep and (i, text) not in seen
        seen.add((i, text))
        out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("naming", [F.xxhash64, lambda c: F.pmod(F.length(c), F.lit(3)).cast("long")])
def test_against_brute_force(spark, naming):
    docs = odd_documents(spark)
    got = sorted((tuple(r) for r in exact_dedup.duplicates(docs, naming=naming).collect()), key=str)
    assert got == brute(docs.collect())


def test_chunks_join_to_the_text(spark):
    docs = odd_documents(spark).select(exact_dedup.normalised(F.col("text")).alias("t"))
    rows = docs.select("t", exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == r.t for r in rows)
    assert max(len(c) for r in rows for c in r.c) <= exact_dedup.MAX_CHARS


def test_an_insertion_changes_few_chunks(spark):
    long = max((r.text or "" for r in odd_documents(spark).collect()), key=len)
    df = spark.createDataFrame([(long,), ("inserted words " + long,)], "t string")
    a, b = (set(r[0]) for r in df.select(exact_dedup.chunks(F.col("t"))).collect())
    assert len(a & b) > 0.8 * len(a)


def test_kept_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[3] for r in brute(docs.collect()))
    assert exact_dedup.duplicates(odd_documents(spark, empty=True)).count() == 0
