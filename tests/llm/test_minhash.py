import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rowsmith.llm import minhash
from rowsmith.llm.common import table
from tests.llm.cases import odd_documents


def bag(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    size = min(5, len(w))
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else Counter()


def classes(rows, threshold, slack=0.0):
    """Components of all pairs at or above the threshold, by hand with exact document frequencies."""
    bags = [bag(t) for _, t in rows]
    n = max(len(rows), 2)
    df = Counter(s for b in bags for s in b)
    w = [{s: (1 + math.log(c)) * (1 + 0.25 * math.log(n / df[s]) / math.log(n)) for s, c in b.items()} for b in bags]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    close = 0
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j]:
                low = sum(min(v, w[j].get(s, 0)) for s, v in w[i].items())
                high = sum(w[i].values()) + sum(w[j].values()) - low
                close += abs(low / high - threshold) < 0.004
                if low / high >= threshold:
                    parent[root(i)] = root(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), set()).add(rows[i][0])
    return {frozenset(c) for c in out.values()}, close


def got_classes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.class_id if r.class_size > 1 else ("alone", r.id), set()).add(r.id)
    return {frozenset(c) for c in out.values()}


def near_corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdst") for _ in range(rng.randint(2, 7)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            other = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40])):
                other[rng.randrange(len(other))] = word()
            rows.append(" ".join(other))
    rows += ["one two", "one two", "Two one", "one", "", None, "!!"]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = near_corpus(seed)
    want, close = classes(rows, 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = got_classes(minhash.groups(df))
    assert len(got ^ want) <= 2 * close


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want, close = classes([(r.doc_id, r.text) for r in docs.collect()], 0.8)
    got = minhash.groups(docs)
    assert len(got_classes(got) ^ want) <= 2 * close
    kept = got.filter("kept").collect()
    assert len(kept) == len(want) and all(r.id == r.class_id for r in kept)
    assert minhash.survivors(docs).count() == len(want)


def test_samples_agree_as_often_as_similarity_says():
    rng = np.random.default_rng(0)
    shared, own = rng.integers(0, 2**64, 600, dtype=np.uint64), rng.integers(0, 2**64, 300, dtype=np.uint64)
    a, b = np.sort(np.concatenate([shared, own[:150]])), np.sort(np.concatenate([shared, own[150:]]))
    weight = lambda s: 1 + (s % np.uint64(7)).astype(np.float32) / 7
    _, x = minhash.samples(np.zeros(len(a), int), a, weight(a), 90)
    _, y = minhash.samples(np.zeros(len(b), int), b, weight(b), 90)
    want = weight(shared).sum() / (weight(a).sum() + weight(own[150:]).sum())
    assert abs((x == y).mean() - want) < 0.15


def test_odd_documents(spark):
    docs = odd_documents(spark)
    left = minhash.survivors(docs)
    assert left.columns == docs.columns
    got = minhash.groups(docs)
    assert got.count() == docs.count()
    same = {frozenset(map(str, c)) for c in got_classes(got)}
    assert frozenset(["7", "8", "9", "19", "None"]) <= next(c for c in same if "8" in c)
    assert all(frozenset([str(i)]) in same for i in (0, 1, 2, 3, 4, 16, 17))
    assert minhash.groups(odd_documents(spark, empty=True)).count() == 0
    assert minhash.survivors(odd_documents(spark, empty=True)).count() == 0


def star(rng, variants, words=110):
    """A text that occurs once and is like each of its variants, which are less like each other."""
    base = [f"w{rng.randrange(10**9)}" for _ in range(words)]
    rows = [" ".join(base)]
    for _ in range(variants):
        other = base[:]
        for half in (0, words // 2):  # far apart, so that each change spoils five shingles
            other[half + rng.randrange(5, words // 2 - 5)] = f"v{rng.randrange(10**9)}"
        rows.append(" ".join(other))
    return list(enumerate(rows))


def test_star_around_a_text_that_occurs_once(spark):
    rows = star(random.Random(4), 2_000)
    bags = [bag(t) for _, t in rows]
    df = Counter(s for b in bags for s in b)
    idf = {s: 1 + 0.25 * math.log(len(rows) / c) / math.log(len(rows)) for s, c in df.items()}
    like = lambda a, b: sum(idf[s] for s in a & b) / sum(idf[s] for s in a | b)
    assert min(like(bags[0].keys(), b.keys()) for b in bags) > 0.804
    among = [like(bags[i].keys(), bags[i + 1].keys()) for i in range(1, 500)]
    assert sum(x < 0.75 for x in among) > 0.95 * len(among)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = minhash.groups(docs).groupBy("class_id").count().collect()
    assert max(r["count"] for r in sizes) >= 0.99 * len(rows)


def test_groups_do_not_depend_on_partitions(spark):
    rows = star(random.Random(5), 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(got_classes(minhash.groups(docs.repartition(parts))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] and max(map(len, found[0])) >= 0.99 * len(rows)
