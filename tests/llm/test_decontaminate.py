import re

import pytest

from rowsmith.llm import decontaminate
from tests.llm.cases import odd_documents, odd_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    for r in docs:
        w, hit, found = words(r.text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((r.doc_id, len(w), len(hit), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def items(spark):
    base = odd_texts()[7].split()
    rows = [(1, " ".join(base[40:70])), (2, "X"), (3, ""), (4, None), (5, " ".join(base[100:108])), (1, " ".join(base[40:70])),
            (None, " ".join(base[10:30])), (6, "aaaa " * 20), (7, " ".join(base[60:90]).upper())]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block", [100_000, 3])
def test_against_brute_force(spark, block):
    docs, bench = odd_documents(spark), items(spark)
    found = decontaminate.contamination(docs, bench, block=block).select("id", "n_words", "n_hit", "items", "contaminated")
    want = brute(docs.collect(), [tuple(r) for r in bench.collect()], 13)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_removal(spark):
    docs, bench = odd_documents(spark), items(spark)
    bad = {(r[0], r[1]) for r in brute(docs.collect(), [tuple(r) for r in bench.collect()], 13) if r[4]}
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(tuple(r)) for r in left.collect()) == sorted(
        str(tuple(r)) for r in docs.collect() if (r.doc_id, len(words(r.text))) not in bad
    )
    cut = decontaminate.decontaminated(docs, bench, remove="spans")
    assert cut.count() == docs.count() and cut.columns == docs.columns
    assert decontaminate.contamination(cut.filter("text is not null"), bench).filter("n_hit > 0 and id not in (8)").count() <= 1


def test_empty_tables(spark):
    empty, bench = odd_documents(spark, empty=True), items(spark)
    assert decontaminate.contamination(empty, bench).count() == 0
    clean = decontaminate.contamination(odd_documents(spark), bench.limit(0)).collect()
    assert clean and not any(r.contaminated or r.n_hit for r in clean)
