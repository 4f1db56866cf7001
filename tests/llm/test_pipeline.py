import corpus_pipeline
from pyspark.sql import functions as F

from rowsmith.llm import decontaminate, minhash, toxicity
from rowsmith.llm.common import table
from rowsmith.plans import durable
from tests.llm.cases import odd_documents

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_takes_effect(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, durable.written(stage(spark, docs, FOLDER), name)
        steps.append((name, before, docs))
        assert docs.columns[: len(columns)] == columns
    toxic, near, clean, mix, shards = steps
    scores = toxicity.scores(toxic[1], table(spark, FOLDER, "labels"))
    assert sorted(r[0] for r in scores.filter("score < 0.5").select("doc_id").collect()) == sorted(r.doc_id for r in toxic[2].collect())
    kept = minhash.groups(near[1]).filter("kept").select("id")
    assert sorted(r[0] for r in kept.collect()) == sorted(r.doc_id for r in near[2].collect())
    bad = decontaminate.contamination(clean[1], table(spark, FOLDER, "benchmark")).filter("not contaminated").select("id")
    assert sorted(r[0] for r in bad.collect()) == sorted(r.doc_id for r in clean[2].collect())
    assert mix[2].select("doc_id").distinct().count() == mix[1].count()
    assert shards[2].count() == mix[2].count()
    per = [r["count"] for r in shards[2].groupBy("shard").count().collect()]
    assert max(per) - min(per) <= 1
    assert corpus_pipeline.run(spark, FOLDER).count() == shards[2].count()


def test_odd_documents_pass_all_stages(spark):
    for empty in (False, True):
        docs = odd_documents(spark, empty=empty)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert (docs.count() == 0) == empty
        assert docs.filter(F.col("slot") < 0).count() == 0
