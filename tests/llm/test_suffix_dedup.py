import hashlib
import random

import numpy as np
import pytest

from rowsmith.llm import suffix_dedup
from tests.llm.cases import odd_documents


def brute(rows, length):
    where = {}
    for n, (_, text) in enumerate(rows):
        for i in range(len(text) - length + 1):
            where.setdefault(text[i : i + length], []).append((n, i))
    hit = [bytearray(len(t)) for _, t in rows]
    for places in where.values():
        if len(places) > 1:
            for n, i in places:
                hit[n][i : i + length] = b"\x01" * length
    out = []
    for (doc, text), h in zip(rows, hit, strict=True):
        kept = bytes(b for b, x in zip(text, h, strict=True) if not x)
        runs = sum(h[i] and (i == 0 or not h[i - 1]) for i in range(len(h)))
        out.append((doc, len(text), sum(h), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s["length"] for s in r.spans), len(r.spans), r.kept_sha256) for r in rows), key=str)


def corpus(seed):
    """Texts of shared passages of lengths around the limit, copies, near copies and periods."""
    rng = random.Random(seed)
    text = lambda n, letters="abcdefgh \x00": "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.choice([30, 39, 40, 41, 45, 60, 100, 200])) for _ in range(12)]
    docs = []
    for _ in range(120):
        docs.append("".join(rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(0, 60)) for _ in range(rng.randint(0, 6))))
    docs += [docs[3], docs[3], docs[5] + "x", "y" + docs[5], "ab" * 200, "ab" * 90, "a" * 77, passages[6], "é" * 50, "é" * 60, "", "z" * 39]
    hot = passages[7]
    docs += [text(15) + hot + text(15) for _ in range(80)]
    near = list(text(300))
    for _ in range(60):
        other = near[:]
        other[rng.randrange(len(other))] = "#"
        docs.append("".join(other))
    return docs


@pytest.mark.parametrize(("seed", "bucket"), [(1, 12 << 20), (2, 3_000), (3, 700)])
def test_against_brute_force(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(4)
    assert found(suffix_dedup.repeats(df, length=40, kgram=11)) == brute([(i, t.encode()) for i, t in enumerate(docs)], 40)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect() if len(r.text or "") < 20_000]
    small = docs.filter("text is null or length(text) < 20000")
    assert found(suffix_dedup.repeats(small)) == brute(rows, 400)
    assert found(suffix_dedup.repeats(docs.drop("key")))
    assert suffix_dedup.repeats(odd_documents(spark, empty=True)).count() == 0


def test_multikey_sort():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 3, (300, 21)).astype(np.uint8)
    rows[50:80] = rows[0]
    rows[80:120, :17] = rows[1, :17]
    order, common = suffix_dedup.multikey_sort(rows)
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(r.tobytes() for r in rows)
    for i in range(1, len(texts)):
        want = next((k for k in range(21) if texts[i][k] != texts[i - 1][k]), 21)
        assert common[i] == want
