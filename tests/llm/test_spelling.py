import random
import re
import zlib
from collections import Counter

import pytest

from rowsmith.llm import spelling
from tests.llm.cases import odd_documents


def vocabulary(docs):
    out = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(u, v):
    if abs(len(u) - len(v)) > 1 or u == v:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    short, long = sorted((u, v), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    count = vocabulary(docs)
    near = {w: [o for o in count if one_edit(w, o)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-count[o], o), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w], form[w] and count[form[w]], root(w)) for w, n in count.items())


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def typo(rng, word):
    i, c = rng.randrange(len(word) + 1), rng.choice("abéÿz")
    return rng.choice([word[:i] + c + word[i:], word[: max(i - 1, 0)] + word[i:], word[: max(i - 1, 0)] + c + word[i:]])


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 3, 40, 400])
        other = typo(rng, w)
        words += [other] * rng.choice([2, 3, 30]) + [typo(rng, other)] * 2
    rng.shuffle(words)
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words]
    texts = ["-".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "group", "texts"), [(1, 20_000, None), (2, 100, None), (3, 6, 8)])
def test_against_all_pairs(spark, seed, group, texts):
    docs = corpus(seed)[:texts]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    assert found(spelling.variants(df.repartition(3), group=group)) == brute(docs)


def test_chain_of_forms(spark):
    docs = [(0, "abcdefgh " * 3000), (1, "abcdefghi " * 200), (2, "abcdefghij " * 20), (3, "abcdefghijk " * 2)]
    rows = found(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert rows == brute(docs)
    assert len({r[-1] for r in rows}) < len(rows)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert found(spelling.variants(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.variants(odd_documents(spark, empty=True)).collect() == []


def test_acceptor_is_minimal():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops"})
    fsa = spelling.Acceptor(words)
    live, todo = set(), [0]
    while todo:
        q = todo.pop()
        if q not in live:
            live.add(q)
            todo += fsa.arcs[q].values()
    # initial, after s, t, {a,o}, p, s
    forms = {(q in fsa.final, tuple(sorted(fsa.arcs[q].items()))) for q in live}
    assert len(forms) == len(live)

    def accepts(w):
        q = 0
        for c in w:
            q = fsa.arcs[q].get(c, -1)
            if q < 0:
                return False
        return q in fsa.final

    assert all(accepts(w) for w in words) and not accepts("tp") and not accepts("stap")
