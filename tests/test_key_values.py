"""Whether a column can be the key is read from its values, not from cells built once a test."""

from pyspark.sql import functions as F

from rowsmith.functions import canon, text
from rowsmith.operators import contracts


def test_cells_are_built_once(spark):
    made = spark.createDataFrame([("a", "x"), ("b", " y"), ("c", ""), ("d", "x"), ("e", None)], "id string, name string")
    data = canon.as_map({"name": text.quote(F.col("name")), "body": text.quote(F.repeat("id", 100))})
    rows = made.select("id", data.alias("data"), F.lit(None).cast("timestamp").alias("deleted_at"))
    found = contracts.key_problems(rows, "name")
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in found.collect()) == ["a", "b", "c", "d", "e"]
