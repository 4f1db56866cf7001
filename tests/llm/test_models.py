"""The three fitted operators: held-out accuracy on the given tables, odd cases, stable scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsmith.llm import langid, quality, toxicity
from rowsmith.llm.arrays import Words, word_hash
from rowsmith.llm.common import table
from tests.llm.cases import labels_of, odd_documents

FOLDER = "/root/testdata/sf0.1"


def accuracy(found, labels, name):
    rows = found.filter("held_out").join(labels.select("doc_id", F.col(name).alias("y")), "doc_id")
    r = rows.agg(
        F.count("*").alias("n"),
        F.avg((F.col("predicted") == F.col("y")).cast("int")).alias("right"),
        F.avg(F.when(F.col("y") == 1, F.col("predicted"))).alias("recall"),
        F.avg(F.when(F.col("y") == 0, F.col("predicted"))).alias("false"),
    ).first()
    assert r.n > 100
    return r


def test_quality_held_out(spark):
    labels = table(spark, FOLDER, "labels")
    found = quality.scores(table(spark, FOLDER, "documents"), labels)
    r = accuracy(found.withColumn("predicted", (F.col("score") >= 0.3).cast("int")), labels, "quality")
    assert r.right > 0.95


def test_toxicity_held_out(spark):
    labels = table(spark, FOLDER, "labels")
    found = toxicity.scores(table(spark, FOLDER, "documents"), labels)
    r = accuracy(found.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), labels, "toxic")
    # Of the toxic documents 6 % were overwritten by junk and hold no insult.
    assert r.recall > 0.9 and r.false < 0.01


def test_language_held_out(spark):
    docs = table(spark, FOLDER, "documents")
    found = langid.identify(docs, langid.fit(docs)).filter("held_out")
    rows = found.join(docs.select("doc_id", "lang"), "doc_id")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_documents(spark, operator):
    docs = odd_documents(spark)
    for labels in (labels_of(spark, docs), labels_of(spark, docs, empty=True)):
        got = operator.scores(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    assert operator.scores(odd_documents(spark, empty=True), labels_of(spark, docs)).count() == 0


def test_accepted_keeps_columns(spark):
    docs = odd_documents(spark)
    insult = docs.filter("doc_id = 12").withColumn("text", F.lit("you stupid worthless idiot"))
    insults = insult.withColumn("doc_id", F.explode(F.sequence(F.lit(90), F.lit(99)))).withColumn("doc_id", F.col("doc_id").cast("long"))
    left = toxicity.accepted(docs.unionByName(insults), labels_of(spark, docs, empty=True))
    assert left.columns == docs.columns
    assert left.filter("doc_id >= 90").count() == 0 and left.count() == docs.count()


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped = flipped.withColumn("quality", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    for operator in (quality, toxicity):
        a, b = (sorted(map(tuple, operator.scores(docs, some).collect())) for some in (labels, flipped))
        assert a == b


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = quality.AttentionModel()
    f, first, label = rng.normal(size=(12, quality.FEATURES)), np.array([0, 3, 4, 9, 12]), np.array([0.0, 1, 1, 0])

    def loss():
        y = model.forward(f, first)["y"]
        return -np.mean(label * np.log(y) + (1 - label) * np.log(1 - y))

    grad = model.gradients(first, model.forward(f, first), label)
    for name, g in grad.items():
        flat = model.p[name].reshape(-1)
        for k in range(0, len(flat), 7):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[k]) < 1e-5, name


def test_languages_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 3, 4))
    assert by[5].lang_pred in ("en", "de")
    assert langid.identify(docs, langid.fit(odd_documents(spark, empty=True))).filter("lang_pred != 'und'").count() == 0
    assert langid.identify(odd_documents(spark, empty=True), langid.fit(docs)).count() == 0


def test_spans_of_mixed_text(spark):
    docs = table(spark, FOLDER, "documents")
    model = langid.fit(docs)
    rows = {r.lang: r.text for r in docs.filter("length(text) between 900 and 1500").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    one, two = " ".join(rows["de"].split()[:60]), " ".join(rows["fr"].split()[:60])
    mixed = spark.createDataFrame([(1, one + " " + two)], "doc_id long, text string")
    spans = langid.identify(mixed, model).first().spans
    size = lambda g: sum(s.end - s.start for s in spans if s.lang == g)
    assert size("de") > 45 and size("fr") > 45 and len(spans) <= 8


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    from itertools import product

    sizes = [0, 1, 6, 3, 0, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.normal(size=(first[-1], 3)) * 3
    path = langid.viterbi(score, first, penalty=2.0)
    value = lambda p, s: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            best = max(value(p, score[a:b]) for p in product(range(3), repeat=b - a))
            assert abs(value(path[a:b].tolist(), score[a:b]) - best) < 1e-9


def test_words_and_hashes():
    text = ["Ab,c d", "", "éa-1", "b c"]
    raw = [t.encode() for t in text]
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = Words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    got = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == ["ab", "c", "d", "éa", "1", "b", "c"]
    assert np.diff(words.first).tolist() == [3, 0, 2, 2]
    assert words.hashes().tolist()[1] == word_hash("c") == words.hashes().tolist()[6]
