"""Registered queries: extract, sync plan, apply, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions import canon
from rowsmith.operators import sync
from rowsmith.plans import durable, inputs
from rowsmith.plans.inputs import plain
from rowsmith.plans.registry import query

_MONEY = "CAST(CAST({0} AS DOUBLE) AS VARCHAR)"
# The three sides, joined by key, with what a record changes.
SIDES = f"""s AS ({plain(inputs.SERVER)}), f AS ({plain(inputs.FILE)}), p AS ({plain(inputs.PULLED)}),
 j AS (SELECT f.row_idx, f.row_key, f.seg_op, f.segment, f.balance, live.row_key IS NOT NULL AS exists_, live.segment AS s_segment, live.balance AS s_balance,
   live.rev AS server_rev, live.status AS s_status, p.rev AS your_rev, gone.row_key IS NOT NULL AS gone,
   coalesce(p.row_key IS NOT NULL AND f.seg_op = 'set' AND f.segment = p.segment AND f.balance = p.balance, false) AS untouched,
   CASE f.seg_op WHEN 'set' THEN f.segment WHEN 'keep' THEN live.segment END AS m_segment
  FROM f LEFT JOIN (SELECT * FROM s WHERE NOT deleted) live ON f.row_key = live.row_key LEFT JOIN p ON f.row_key = p.row_key
  LEFT JOIN (SELECT row_key FROM s WHERE deleted) gone ON f.row_key = gone.row_key),
 k AS (SELECT *, exists_ AND m_segment IS DISTINCT FROM s_segment AS seg_differs, balance IS DISTINCT FROM s_balance AS bal_differs FROM j),
 o AS (SELECT *, CASE WHEN NOT exists_ AND your_rev IS NOT NULL AND gone THEN 'deleted' WHEN NOT exists_ THEN 'create'
   WHEN untouched THEN CASE WHEN your_rev = server_rev THEN 'unchanged' ELSE 'server_newer' END
   WHEN NOT seg_differs AND NOT bal_differs THEN 'unchanged' WHEN your_rev IS DISTINCT FROM server_rev THEN 'conflict' ELSE 'update' END AS op FROM k)"""
FORCED = SIDES.replace("NOT exists_ AND your_rev IS NOT NULL AND gone", "false").replace(
    "your_rev IS DISTINCT FROM server_rev THEN 'conflict'", "false THEN 'conflict'"
)


def plan(spark: SparkSession, d: str, force: bool = False) -> DataFrame:
    return sync.plan_sync(
        inputs.file_records(spark, d), inputs.server_rows(spark, d), inputs.pulled_state(spark, d), inputs.SYNC_CONTRACT, force
    )


@query("m09_sync_plan", f"WITH {SIDES} SELECT row_idx, row_key, op FROM o")
def sync_plan(spark, d):
    return plan(spark, d).select("row_idx", "row_key", "op")


@query("m09_sync_plan_forced", f"WITH {FORCED} SELECT row_idx, row_key, op FROM o")
def sync_plan_forced(spark, d):
    return plan(spark, d, force=True).select("row_idx", "row_key", "op")


@query(
    "m10_field_merge",
    f"""WITH {SIDES} SELECT row_key, 'segment' AS field, to_json(CASE WHEN op <> 'create' THEN s_segment END)::VARCHAR AS before, to_json(m_segment)::VARCHAR AS after FROM o
     WHERE op IN ('update', 'conflict') AND seg_differs OR op = 'create' AND m_segment IS NOT NULL
    UNION ALL SELECT row_key, 'row_key', NULL, to_json(row_key)::VARCHAR FROM o WHERE op = 'create'
    UNION ALL SELECT row_key, 'balance', NULL, {_MONEY.format('balance')} FROM o WHERE op = 'create'""",
)
def field_merge(spark, d):
    fields = plan(spark, d).select("row_key", F.explode_outer("fields").alias("_f")).filter(F.col("_f").isNotNull())
    return fields.select("row_key", "_f.field", "_f.before", "_f.after")


@query("g04_sync_summary", f"""WITH {SIDES} SELECT op AS measure, count(*) AS n FROM o GROUP BY op UNION ALL SELECT 'error_entries', 0
 UNION ALL SELECT 'not_in_file', count(*) FROM s WHERE NOT deleted AND row_key NOT IN (SELECT row_key FROM f)""")
def sync_summary(spark, d):
    written = durable.written(plan(spark, d), "sync-summary")
    return sync.summary(written, inputs.server_rows(spark, d))


@query("j03_file_to_live", f"WITH {SIDES} SELECT row_key, CAST(server_rev AS BIGINT) AS server_rev FROM j")
def file_to_live(spark, d):
    return plan(spark, d).select("row_key", F.col("server_rev").cast("bigint").alias("server_rev"))


@query("j04_deleted_keys", f"WITH {SIDES} SELECT row_key FROM o WHERE op = 'deleted'")
def deleted_keys(spark, d):
    return durable.written(plan(spark, d).select("row_key", "op"), "deleted").filter(F.col("op") == "deleted").select("row_key")


@query("j05_not_in_file", f"WITH {SIDES} SELECT row_key FROM s WHERE NOT deleted AND row_key NOT IN (SELECT row_key FROM f)")
def not_in_file(spark, d):
    return sync.not_in_file(inputs.file_records(spark, d).select(F.expr("substring(rec['row_key'], 2, length(rec['row_key']) - 2)").alias("row_key")), inputs.server_rows(spark, d))


@query("j06_pull_state_lookup", f"WITH {SIDES} SELECT row_key, CAST(your_rev AS BIGINT) AS your_rev, CASE WHEN op = 'conflict' AND your_rev IS NULL THEN 'exists in the dataset; pull the rows first or use force' END AS reason FROM o")
def state_lookup(spark, d):
    return plan(spark, d).select("row_key", F.col("your_rev").cast("bigint").alias("your_rev"), "reason")


def _forced(spark, d):
    written = durable.written(plan(spark, d, force=True), "sync")
    rows = inputs.server_rows(spark, d)
    at = F.lit("2024-06-01").cast("timestamp")
    return written, sync.apply_sync(written, rows, inputs.SYNC_CONTRACT, "customers", "u1", at)


_LINE = f"""concat('{{"balance":', {_MONEY.format('balance')}, ',"row_key":', to_json(row_key), CASE WHEN segment IS NULL THEN '' ELSE concat(',"segment":', to_json(segment)) END, '}}')"""
_AFTER = f"""after AS (SELECT s.row_key, s.deleted, CASE WHEN o.op = 'update' THEN o.m_segment ELSE s.segment END AS segment, s.balance,
  s.rev + CASE WHEN o.op = 'update' THEN 1 ELSE 0 END AS rev, CASE WHEN o.op = 'update' AND s.status = 'approved' THEN 'needs_review' ELSE s.status END AS status
  FROM s LEFT JOIN o ON s.row_key = o.row_key AND NOT s.deleted
  UNION ALL SELECT row_key, false, m_segment, balance, 1, 'draft' FROM o WHERE op = 'create')"""


@query("m11_sync_apply", f"WITH {FORCED}, {_AFTER} SELECT row_key, deleted, rev, status, {_LINE} AS data FROM after")
def sync_apply(spark, d):
    _, result = _forced(spark, d)
    keys = inputs.SYNC_CONTRACT.active_keys
    return result.rows.select(
        "row_key", F.col("deleted_at").isNotNull().alias("deleted"), F.col("rev").cast("bigint").alias("rev"), "status",
        canon.object_text(canon.cells_of("data"), keys).alias("data"),
    )


@query("m11_sync_blocked", f"WITH {SIDES} SELECT row_key, rev, status FROM s")
def sync_blocked(spark, d):
    """Without force there are conflicts, so nothing is written."""
    written = durable.written(plan(spark, d), "blocked")
    result = sync.apply_sync(
        written, inputs.server_rows(spark, d), inputs.SYNC_CONTRACT, "customers", "u1", F.lit("2024-06-01").cast("timestamp")
    )
    return result.rows.select("row_key", F.col("rev").cast("bigint").alias("rev"), "status")


def _strange(spark: SparkSession, d: str) -> DataFrame:
    """The edited extract with a path the contract does not know in every 13th record."""
    records = inputs.file_records(spark, d)
    extra = F.when(F.col("row_idx") % 13 == 0, F.create_map(F.lit("extra.note"), F.lit('"x"'))).otherwise(F.create_map().cast("map<string,string>"))
    return records.withColumn("rec", F.map_concat("rec", extra))


def _strange_plan(spark, d, ignore: bool) -> DataFrame:
    planned = sync.plan_sync(
        _strange(spark, d), inputs.server_rows(spark, d), inputs.pulled_state(spark, d), inputs.SYNC_CONTRACT, True, ignore_unknown=ignore
    )
    return durable.written(planned, "strange")


_AT = "2024-06-01"


@query("m11_sync_unknown", f"WITH {FORCED} SELECT row_key, rev, status, (SELECT count(*) FROM f WHERE row_idx % 13 = 0) AS n_unknown FROM s")
def sync_unknown(spark, d):
    """Unknown paths block even a forced sync: nothing is written."""
    written = _strange_plan(spark, d, ignore=False)
    result = sync.apply_sync(written, inputs.server_rows(spark, d), inputs.SYNC_CONTRACT, "customers", "u1", F.lit(_AT).cast("timestamp"))
    found = sync.unknown_path_report(written).filter(F.col("reason") == sync.UNKNOWN_COLUMN)
    number = found.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).scalar()
    return result.rows.select("row_key", F.col("rev").cast("bigint").alias("rev"), "status", number.alias("n_unknown"))


@query("m11_sync_ignored", f"WITH {FORCED}, {_AFTER} SELECT row_key, deleted, rev, status, {_LINE} AS data FROM after")
def sync_ignored(spark, d):
    """The same file with unknown paths ignored is written as if they were not there."""
    written = _strange_plan(spark, d, ignore=True)
    result = sync.apply_sync(written, inputs.server_rows(spark, d), inputs.SYNC_CONTRACT, "customers", "u1", F.lit(_AT).cast("timestamp"))
    return result.rows.select(
        "row_key", F.col("deleted_at").isNotNull().alias("deleted"), F.col("rev").cast("bigint").alias("rev"), "status",
        canon.object_text(canon.cells_of("data"), inputs.SYNC_CONTRACT.active_keys).alias("data"),
    )


@query(
    "m11_sync_edits",
    f"""WITH {FORCED} SELECT concat('row-', row_key) AS row_id, 'segment' AS field, to_json(s_segment)::VARCHAR AS old_value, to_json(m_segment)::VARCHAR AS new_value FROM o WHERE op = 'update'
    UNION ALL SELECT concat('row-', row_key), 'status', '"approved"', '"needs_review"' FROM o WHERE op = 'update' AND s_status = 'approved'""",
)
def sync_edits(spark, d):
    return _forced(spark, d)[1].edits.select("row_id", "field", "old_value", "new_value")


_STATE = f"""st AS (SELECT row_key, rev, concat('sha256:', sha256({_LINE})) AS base_hash FROM after WHERE row_key IN (SELECT row_key FROM o WHERE op IN ('create', 'update', 'unchanged')) AND NOT deleted)"""


@query("m12_state_refresh", f"WITH {FORCED}, {_AFTER}, {_STATE} SELECT row_key, CAST(rev AS BIGINT) AS rev, base_hash FROM st")
def state_refresh(spark, d):
    return _forced(spark, d)[1].state.select("row_key", F.col("rev").cast("bigint").alias("rev"), "base_hash")


_OLD = f"""old AS (SELECT row_key, rev, concat('sha256:', sha256({_LINE})) AS base_hash FROM p)"""


@query("u05_state_overlay", f"""WITH {FORCED}, {_AFTER}, {_STATE}, {_OLD} SELECT coalesce(st.row_key, old.row_key) AS row_key, CAST(coalesce(st.rev, old.rev) AS BIGINT) AS rev,
 coalesce(st.base_hash, old.base_hash) AS base_hash FROM st FULL JOIN old ON st.row_key = old.row_key""")
def state_overlay(spark, d):
    new = _forced(spark, d)[1].state
    return sync.overlay_state(inputs.pulled_state(spark, d), new).select("row_key", F.col("rev").cast("bigint").alias("rev"), "base_hash")


@query("m13_local_edits", f"WITH {SIDES} SELECT row_key, op FROM o WHERE op IN ('create', 'update', 'conflict')")
def local_edits(spark, d):
    """What an overwrite of the extract would lose."""
    written = durable.written(plan(spark, d), "edits")
    assert sync.has_local_edits(written)
    return written.filter(F.col("op").isin("create", "update", "conflict")).select("row_key", "op")


@query("s18_pull_state", f"WITH s AS ({plain(inputs.SERVER)}) SELECT row_key, rev, concat('sha256:', sha256({_LINE})) AS base_hash FROM s WHERE NOT deleted")
def pull_state(spark, d):
    return sync.pull_state(inputs.server_rows(spark, d), inputs.SYNC_CONTRACT).select("row_key", F.col("rev").cast("bigint").alias("rev"), "base_hash")


@query("s17_editable_extract", f"""WITH s AS ({plain(inputs.SERVER)}) SELECT row_key, concat('{{"row_key":', to_json(row_key), ',"segment":', to_json(segment), ',"balance":', {_MONEY.format('balance')}, '}}') AS line FROM s WHERE NOT deleted""")
def editable_extract(spark, d):
    return sync.extract_rows(inputs.server_rows(spark, d), inputs.SYNC_CONTRACT).select("row_key", "line")
