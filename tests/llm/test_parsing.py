import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from rowsmith.llm import parsing
from rowsmith.llm.arrays import flat, mixed
from tests.llm.cases import odd_documents, words

MASK = 2**64 - 1
SALT, BASE = int(parsing._SALT), 0x9E3779B97F4A7C15


def mix(h):
    return int(mixed(np.array([h & MASK], dtype=np.uint64))[0])


def toss(symbols, opens, rounds):
    label = list(symbols)
    for _ in range(rounds):
        new = []
        for i, x in enumerate(label):
            bit = 0 if opens[i] else ((x ^ label[i - 1]) & -(x ^ label[i - 1])).bit_length() - 1
            new.append(2 * bit + (x >> bit & 1))
        label = new
    return label


def level(symbols, tosses):
    """One level, symbol by symbol."""
    base, name, alone = [], [], []
    i = 0
    while i < len(symbols):
        j = i
        while j < len(symbols) and symbols[j] == symbols[i]:
            j += 1
        for k in range(i, j, 4):
            n = min(4, j - k)
            x = mix(2 * symbols[i] + 1)
            base.append(symbols[i])
            name.append(mix(x + n * SALT) if n > 1 else x)
            alone.append(j - i > 4)
        i = j
    label = toss(base, [i == 0 or alone[i] for i in range(len(base))], tosses)
    out, phrase = [], []
    for i in range(len(base)):
        peak = 0 < i < len(base) - 1 and label[i] > label[i - 1] and label[i] > label[i + 1]
        if phrase and (alone[i] or alone[i - 1] or peak):
            out.append(named(phrase))
            phrase = []
        phrase.append(name[i])
    return [*out, named(phrase)] if phrase else out


def named(symbols):
    return mix(sum(x * pow(BASE, i, 2**64) for i, x in enumerate(symbols)) + len(symbols) * SALT)


def fingerprint(text):
    symbols = list(text.encode())
    slots = [0xFFFF] * 64
    root = 0
    for n in (1, 2, 3):
        symbols = level(symbols, 3 if n == 1 else 4)
        if n == 1 and symbols:
            root = named(symbols)
        elif n > 1:
            met = {}
            for x in symbols:
                met[x] = met.get(x, -1) + 1
                h = mix(mix(x + met[x] * SALT) + n)
                at = 32 * (n - 2) + h % 32
                slots[at] = min(slots[at], h >> 48, 0xFFFE)
    return f"{root:016x}" + "".join(f"{s:04x}" for s in slots)


def like(a, b):
    if a == b:
        return 1.0
    x, y = ([f[i : i + 4] for i in range(16, len(f), 4)] for f in (a, b))
    either = [(p, q) for p, q in zip(x, y, strict=True) if (p, q) != ("ffff", "ffff")]
    return sum(p == q for p, q in either) / max(len(either), 1)


def brute(rows):
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        a, b, c = fingerprint(text), fingerprint(edited), fingerprint(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([0, 1, 3, 20, 80])) for _ in range(n)]
    texts += ["a" * 3, "a" * 400, "ab" * 300, "Ha Ha " * 100, "aabbb" * 40, "\x00\x00\x01", "é🙂" * 50, None, "", texts[3], texts[3]]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (2, 7)])
def test_against_symbol_by_symbol(spark, seed, partitions):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, task int, edge string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = sorted(tuple(r) for r in parsing.fingerprints(df.repartition(5)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == sorted(brute(rows))


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = docs.collect()
    found = parsing.fingerprints(docs).collect()
    assert sorted(len(r.text or "") for r in rows) == sorted(r.n_chars for r in found)
    prints = {}
    for r in found:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[7] | prints[8] == prints[8] | {fingerprint("another text under the same id")}  # copies agree
    assert prints[0] == prints[1] == {fingerprint("")}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert parsing.fingerprints(odd_documents(spark, empty=True)).collect() == []
    one = parsing.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


@pytest.mark.parametrize("level", [1, 2, 3])
def test_equal_strings_share_interior_names(level):
    rng = random.Random(9)
    shared = words(rng, 400)
    texts = [words(rng, n) + shared + words(rng, 30) for n in (0, 1, 2, 7, 50)]
    data, offsets = flat(pa.array(texts))
    for _, (names, row) in zip(range(level), parsing.phrases(data, offsets), strict=False):
        pass
    sets = [set(names[row == i].tolist()) for i in range(len(texts))]
    alone = next(x for i, x in enumerate(parsing.phrases(*flat(pa.array([shared])))) if i == level - 1)[0].tolist()
    inside = alone[6:-6]
    assert len(inside) > 5 and all(set(inside) <= s for s in sets)


def test_likeness_follows_what_is_shared():
    rng = random.Random(4)
    text, other = words(rng, 2000), words(rng, 2000)
    got = []
    for share in (1.0, 0.9, 0.75, 0.5, 0.0):
        cut = int(len(text) * share)
        a, b = (parsing.fingerprints_of(pa.array([t])) for t in (text, text[:cut] + other[cut : len(text)]))
        got.append(float(parsing.likeness(a, b)[0]))
    assert got == sorted(got, reverse=True) and got[0] == 1.0 and got[-1] < 0.1 and 0.45 < got[2] < 0.75
