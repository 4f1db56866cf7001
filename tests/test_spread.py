"""Cells of a table that lies in one row group are made by many tasks."""

import pytest
from pyspark.sql import functions as F

from rowsmith.plans import inputs, q_cells, q_import, q_sources

EVENTS = """SELECT id AS event_id, timestamp'2024-01-01' AS ts, id % 9 AS user_id, 'view' AS event_type,
 1.5D AS value, '{"k": 1}' AS props FROM range(400)"""


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("one-group"))
    spark.sql(EVENTS).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("rows", [q_cells.mapped_dirty, q_sources._checked_bad, q_import.previewed])
def test_one_row_group_is_many_tasks(spark, folder, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = rows(spark, folder).select("row_idx", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(made) == 400 and len({r.row_idx for r in made}) == 400
    assert len({r.task for r in made}) > 1


def test_spread_rows_are_the_rows(spark, folder):
    plain, spread = inputs.load(spark, folder, inputs.DIRTY), inputs.load_spread(spark, folder, inputs.DIRTY, "event_id")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))
