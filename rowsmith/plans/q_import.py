"""Registered queries: import, preview, accounting and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.functions import canon, text
from rowsmith.operators import importing, versions
from rowsmith.operators.records import known_cell, known_cells
from rowsmith.plans import durable, inputs
from rowsmith.plans.inputs import load, plain
from rowsmith.plans.q_cells import MAPPED, REASONS, D, dirty, mapped_dirty
from rowsmith.plans.q_sources import _KIND
from rowsmith.plans.q_versions import R
from rowsmith.plans.registry import query
from rowsmith.sources import readers, store

LINE_CONTRACT = Contract.of(
    Field("id", "text", "Id", required=True, is_key=True), Field("props", "json", "Props", required=True)
)

_EXISTS = f"x AS ({plain(inputs.EXISTING)})"
# Rows that claim a key, the first claimant per key, then the key errors.
_CLAIMS = f"""{_EXISTS}, cl AS (SELECT row_idx, name FROM m WHERE {{skip}}), fi AS (SELECT name, min(row_idx) AS first_row FROM cl GROUP BY name),
 ke AS (SELECT cl.row_idx, 'name' AS "column", CASE WHEN cl.row_idx > fi.first_row THEN concat('duplicate key ''', cl.name, ''' in file (also row ', fi.first_row, ')')
   WHEN cl.name IN (SELECT row_key FROM x) THEN concat('key ''', cl.name, ''' already exists — use rows push to update') END AS reason
   FROM cl JOIN fi ON cl.name = fi.name)"""
_NO_SKIP = _CLAIMS.format(skip="true")
_SKIPPING = _CLAIMS.format(skip="row_idx % 100 <> 0")


def _rules(where: str, fixed: bool = False) -> str:
    parts = []
    for key, (_, reason) in REASONS.items():
        condition = f"{reason} IS NOT NULL AND {where}"
        if fixed and key == "as_of":
            condition += " AND row_idx % 70 <> 1"
        parts.append(f"SELECT row_idx, '{key}' AS \"column\", {reason} AS reason FROM m WHERE {condition}")
    return " UNION ALL ".join(parts) + " UNION ALL SELECT row_idx, \"column\", reason FROM ke WHERE reason IS NOT NULL"


def existing(spark, d) -> DataFrame:
    return load(spark, d, inputs.EXISTING)


def previewed(spark: SparkSession, d: str) -> DataFrame:
    return importing.check_rows(mapped_dirty(spark, d), inputs.DIRTY_CONTRACT, existing(spark, d))


def committed(spark: SparkSession, d: str) -> DataFrame:
    fixed = importing.apply_fixes(mapped_dirty(spark, d), load(spark, d, inputs.FIXES), inputs.DIRTY_CONTRACT)
    return importing.check_rows(fixed, inputs.DIRTY_CONTRACT, existing(spark, d), load(spark, d, inputs.SKIP))


@query("m07_import_preview", f"WITH {D}, {MAPPED}, {_NO_SKIP} {_rules('true')}")
def preview(spark, d):
    return importing.error_report(previewed(spark, d))


_COMMIT = f"WITH {D}, {MAPPED}, {_SKIPPING}, e AS ({_rules('row_idx % 100 <> 0', fixed=True)})"


@query("m06_import_commit", f"""{_COMMIT} SELECT m.row_idx, CASE WHEN m.row_idx % 100 = 0 THEN 'skipped' WHEN n.n > 0 THEN 'errored' ELSE 'created' END AS outcome, coalesce(n.n, 0) AS errors
 FROM m LEFT JOIN (SELECT row_idx, count(*) AS n FROM e GROUP BY row_idx) n ON m.row_idx = n.row_idx""")
def commit(spark, d):
    return committed(spark, d).select("row_idx", "outcome", F.size("errors").cast("bigint").alias("errors"))


@query("g01_import_counts", f"""{_COMMIT}, s AS (SELECT m.row_idx, CASE WHEN m.row_idx % 100 = 0 THEN 'skipped' WHEN m.row_idx IN (SELECT row_idx FROM e) THEN 'errored' ELSE 'created' END AS outcome FROM m)
 SELECT count(*) AS total, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'skipped') AS skipped,
 count(*) FILTER (outcome = 'errored') AS errored, (SELECT count(*) FROM e) AS errors FROM s""")
def counts(spark, d):
    return importing.accounting(committed(spark, d))


@query("v15_split", f"""{_COMMIT} SELECT row_idx, CASE WHEN row_idx IN (SELECT row_idx FROM e) THEN 'errored' ELSE 'created' END AS part FROM m WHERE row_idx % 100 <> 0""")
def split(spark, d):
    created, errored = importing.split(durable.written(committed(spark, d).select("row_idx", "outcome"), "split"))
    return created.unionByName(errored).select("row_idx", F.col("outcome").alias("part"))


@query("w01_first_claim", f"WITH {D}, {MAPPED}, {_SKIPPING} SELECT row_idx, reason FROM ke WHERE reason LIKE 'duplicate key%'")
def first_claim(spark, d):
    return importing.error_report(committed(spark, d)).filter(F.col("reason").startswith("duplicate key")).select("row_idx", "reason")


@query("j01_existing_keys", f"WITH {D}, {MAPPED}, {_NO_SKIP} SELECT row_idx, reason FROM ke WHERE reason LIKE '%already exists%'")
def existing_keys(spark, d):
    return importing.error_report(previewed(spark, d)).filter(F.col("reason").contains("already exists")).select("row_idx", "reason")


@query("f09_skip_list", f"WITH {D}, s AS ({plain(inputs.SKIP)}) SELECT row_idx, name FROM d WHERE row_idx NOT IN (SELECT row_idx FROM s)")
def skip_list(spark, d):
    return dirty(spark, d).join(load(spark, d, inputs.SKIP), "row_idx", "left_anti").select("row_idx", "name")


@query("l01_preview_sample", f"WITH {D} SELECT row_idx, name, kind, score FROM d ORDER BY row_idx LIMIT 20")
def preview_sample(spark, d):
    return importing.preview_sample(dirty(spark, d), ["name", "kind", "score"])


@query("m08_carry_skip", f"""{_COMMIT} SELECT row_idx FROM m WHERE row_idx % 100 = 0 OR row_idx NOT IN (SELECT row_idx FROM e)""")
def carry_skip(spark, d):
    done = durable.written(committed(spark, d).select("row_idx", "outcome"), "handled")
    return importing.carry_skip(done.filter(F.col("outcome") == "created"), load(spark, d, inputs.SKIP))


_DATA = """concat('{', array_to_string(list_filter([CASE WHEN row_idx % 70 = 1 THEN '"as_of":"2024-03-01"' WHEN c_as_of IS NOT NULL THEN concat('"as_of":', c_as_of) END,
 concat('"blob":', c_blob), CASE WHEN c_flagged IS NOT NULL THEN concat('"flagged":', c_flagged) END, concat('"kind":', c_kind), concat('"name":', c_name),
 CASE WHEN c_score IS NOT NULL THEN concat('"score":', c_score) END, CASE WHEN c_tags IS NOT NULL THEN concat('"tags":', c_tags) END], lambda x: x IS NOT NULL), ','), '}')"""


@query("u04_rows_after_import", f"""{_COMMIT} SELECT name AS row_key, 'draft' AS status, 1 AS rev, {_DATA} AS data FROM m WHERE row_idx % 100 <> 0 AND row_idx NOT IN (SELECT row_idx FROM e)
 UNION ALL SELECT row_key, 'approved', 3, '{{}}' FROM x""")
def rows_after_import(spark, d):
    """The new table is the old one and the created drafts."""
    old = existing(spark, d).select("row_key")
    keep = inputs._rows(
        old.withColumns({"status": F.lit("approved"), "rev": F.lit(3), "created_seq": F.lit(0)}),
        "events", F.create_map().cast("map<string,string>"), F.col("row_key"),
    )
    started = F.lit("2024-01-01").cast("timestamp")
    table, _, _ = importing.commit_import(committed(spark, d), inputs.DIRTY_CONTRACT, keep, "events", "u1", started)
    keys = inputs.DIRTY_CONTRACT.active_keys
    return table.select("row_key", "status", "rev", canon.object_text(canon.cells_of("data"), keys).alias("data"))


_LINES = f"""b AS ({plain(inputs.BAD)}), k AS (SELECT row_idx, line, {_KIND} AS problem FROM b)"""


@query(
    "m06_import_jsonl",
    f"""WITH {_LINES} SELECT row_idx, CASE WHEN problem IS NULL AND line LIKE '%"props"%' THEN 'created' ELSE 'errored' END AS outcome,
     CASE WHEN problem = 'invalid JSON' THEN concat('line ', row_idx, ': invalid JSON') WHEN problem IS NOT NULL THEN problem WHEN line NOT LIKE '%"props"%' THEN 'required' END AS reason,
     CASE WHEN problem IS NULL AND line LIKE '%"props"%' THEN (line->'$.props')::VARCHAR END AS props FROM k""",
)
def import_jsonl(spark, d):
    """JSON Lines records read, mapped and checked inside the engine."""
    lines = inputs.load_spread(spark, d, inputs.BAD, "event_id")
    read = known_cells(readers.check_lines(lines, F.col("line"), F.col("row_idx")), LINE_CONTRACT)
    mapped = importing.map_rows(read, {"id": "id", "props": "props"}, LINE_CONTRACT, known_cell, structured=True)
    checked = importing.check_rows(mapped, LINE_CONTRACT)
    kept = F.when(F.col("outcome") == "created", F.replace(F.col("`cell:props`"), F.lit(" "), F.lit("")))
    return checked.select("row_idx", "outcome", F.get("errors", F.lit(0))["reason"].alias("reason"), kept.alias("props"))


# --- Import of a folder ---------------------------------------------------

PER_IMPORTED_FILE = 700
_FOLDER = f"""e AS (SELECT event_id // {PER_IMPORTED_FILE} AS block, 1 + event_id % {PER_IMPORTED_FILE} AS row_idx, concat('k-', event_id % 3000) AS key,
  event_id % 100 = 13 AS skipped, event_id % 90 = 5 AS fixed FROM events),
 c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY concat('block=', block), row_idx) AS nth FROM e WHERE NOT skipped),
 lf AS (SELECT block, max(row_idx) AS last FROM c WHERE nth = 1 GROUP BY block),
 off AS (SELECT block, coalesce(sum(last) OVER (ORDER BY concat('block=', block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM lf)"""


@query(
    "m06_import_folder",
    f"""WITH {_FOLDER} SELECT e.block, e.row_idx, CASE WHEN e.skipped THEN 'skipped' WHEN c.nth = 1 THEN 'created' ELSE 'errored' END AS outcome,
     CASE WHEN c.nth = 1 THEN CAST(off.o + e.row_idx AS BIGINT) END AS position, CASE WHEN c.nth = 1 THEN 1 END AS ids,
     CASE WHEN e.fixed THEN '"fixed"' ELSE '"as sent"' END AS note
     FROM e LEFT JOIN c ON e.block = c.block AND e.row_idx = c.row_idx LEFT JOIN off ON e.block = off.block""",
)
def import_folder(spark, d):
    """Files whose rows are numbered from 1 each and repeat keys of one another."""
    from rowsmith.plans.q_sources import _block_of
    from rowsmith.plans.q_versions import folder_for

    contract = Contract.of(Field("key", "text", required=True, is_key=True), Field("note", "text"))
    events = load(spark, d, "SELECT event_id FROM {events}")
    n, per = F.col("event_id"), PER_IMPORTED_FILE
    line = F.concat(F.lit('{"key":"k-'), n % 3000, F.lit('","note":"as sent"}'))
    path = folder_for(spark, "import")
    placed = events.select(F.floor(n / per).alias("block"), n.alias("at"), line.alias("line")).repartition("block").sortWithinPartitions("block", "at")
    placed.select("block", "line").write.partitionBy("block").text(path)
    read = readers.read_jsonl(spark, path)
    lines = read.select("file", "row_idx")
    mapped = importing.map_rows(known_cells(read, contract), {"key": "key", "note": "note"}, contract, known_cell, structured=True)
    event = _block_of() * per + F.col("row_idx") - 1
    skip = lines.filter(event % 100 == 13)
    fixes = lines.filter(event % 90 == 5).withColumns({"key": F.lit("note"), "value": F.lit('"fixed"')})
    checked = durable.written(importing.check_rows(importing.apply_fixes(mapped, fixes, contract), contract, skip=skip), "folder")
    started = F.lit("2024-01-01").cast("timestamp")
    empty = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in importing.ROW_COLUMNS.items()))
    table, _, _ = importing.commit_import(checked, contract, empty, "events", "u1", started)
    made = table.groupBy("row_key").agg(
        (F.unix_micros(F.max("created_at")) - F.unix_micros(started)).alias("position"), F.count_distinct("id").cast("int").alias("ids")
    )
    key = text.unquote(F.col("`cell:key`"))
    rows = checked.select(_block_of().alias("block"), "row_idx", "outcome", key.alias("row_key"), F.col("`cell:note`").alias("note"))
    joined = rows.join(made, "row_key", "left")
    new = F.col("outcome") == "created"
    return joined.select(
        "block", "row_idx", "outcome", F.when(new, F.col("position")).alias("position"), F.when(new, F.col("ids")).alias("ids"), "note"
    )


# --- Preview ----------------------------------------------------------------


def _previewed(spark, d):
    source = inputs.load_spread(spark, d, inputs.DIRTY, "event_id").drop("blob").withColumnRenamed("name", "Name ")
    return importing.preview(source, ["Name ", "kind", "score", "flagged", "tags", "as_of", "unmapped"], inputs.DIRTY_CONTRACT, lambda c: F.col(f"`{c}`"), existing=existing(spark, d))


@query("m07_preview_sample", f"""WITH {D}, {MAPPED}, {_NO_SKIP}, er AS ({_rules('true')}) SELECT m.row_idx, CASE WHEN m.row_idx IN (SELECT row_idx FROM er) THEN 'errored' ELSE 'created' END AS outcome,
 concat('{{', array_to_string(list_filter([CASE WHEN c_as_of IS NOT NULL THEN concat('"as_of":', c_as_of) END, CASE WHEN c_flagged IS NOT NULL THEN concat('"flagged":', c_flagged) END, concat('"kind":', c_kind),
  concat('"name":', c_name), CASE WHEN c_score IS NOT NULL THEN concat('"score":', c_score) END, CASE WHEN c_tags IS NOT NULL THEN concat('"tags":', c_tags) END], lambda x: x IS NOT NULL), ','), '}}') AS cells
 FROM m ORDER BY m.row_idx LIMIT 20""")
def preview_typed(spark, d):
    """The first rows as the import would store them."""
    return _previewed(spark, d).sample.select("row_idx", "outcome", "cells")


@query("m07_preview_counts", f"""WITH {D}, {MAPPED}, {_NO_SKIP}, er AS ({_rules('true')}), q AS (SELECT count(*) AS total, count(*) FILTER (row_idx IN (SELECT row_idx FROM er)) AS errored FROM m)
 SELECT total, total - errored AS created, CAST(0 AS BIGINT) AS skipped, errored, (SELECT count(*) FROM er) AS errors, 'as_of=as_of,flagged=flagged,kind=kind,name=Name ,score=score,tags=tags' AS mapping FROM q""")
def preview_counts(spark, d):
    found = _previewed(spark, d)
    pairs = F.array_sort(F.collect_list(F.concat("key", F.lit("="), "source")))
    mapping = found.mapping.agg(F.array_join(pairs, ",").alias("mapping")).scalar()
    return found.counts.select("*", mapping.alias("mapping"))


# --- Flagship: import from files, cut two versions, diff them as stored ---


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """The rows of an import from files, with the status that reviewers gave them."""
    from rowsmith.plans.q_versions import folder_for

    contract = inputs.REVIEW_CONTRACT
    review = load(spark, d, inputs.REVIEW)
    names = ["id", "body", "lang", "source", "n_chars"]
    line = F.to_json(F.struct(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) if n != "n_chars" else F.col(n) for n in names]))
    path = folder_for(spark, "flagship")
    review.filter(~F.col("deleted")).select(line.alias("line")).write.text(path)
    read = known_cells(readers.read_jsonl(spark, path), contract)
    mapped = importing.map_rows(read, {k: k for k in contract.active_keys}, contract, known_cell, structured=True).drop("line")
    empty = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in importing.ROW_COLUMNS.items()))
    started = F.lit("2024-06-01").cast("timestamp")
    table, _, _ = importing.commit_import(importing.check_rows(mapped, contract), contract, empty, "docs", "u1", started)
    given = review.select(F.col("id").alias("row_key"), F.col("status").alias("_given"))
    return table.join(given, "row_key").withColumn("status", F.col("_given")).select(*table.columns)


def flagship_versions(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """(store, manifests) of version 1 with all rows and version 2 with the approved ones, after more were approved."""
    from rowsmith.plans.q_versions import folder_for

    contract, root = inputs.REVIEW_CONTRACT, folder_for(spark, "flagship-versions")
    rows = durable.written(_reviewed(spark, d), "flagship-rows")
    more = (F.col("status") == "draft") & (F.col("data")["n_chars"].cast("long") % 2 == 0)
    later = rows.withColumn("status", F.when(more, "approved").otherwise(F.col("status")))
    first = versions.cut_version(rows, contract, "docs", root, 1, "u1", include_unapproved=True)
    second = versions.cut_version(later, contract, "docs", root, 2, "u1")
    return root, first.unionByName(second)


_VALID = f"""WITH {R}, v AS (SELECT id, body, lang, source, n_chars, status, CASE WHEN status = 'draft' AND n_chars % 2 = 0 THEN 'approved' ELSE status END AS later
 FROM r WHERE NOT deleted AND trim(body) <> '' AND lang IN ('en', 'de', 'fr'))"""


@query(
    "flagship_import_cut_diff",
    f"""{_VALID} SELECT id, CASE WHEN later <> 'approved' THEN 'removed' ELSE 'modified' END AS change, status AS old_status,
     CASE WHEN later = 'approved' THEN later END AS new_status FROM v WHERE later <> 'approved' OR later <> status""",
)
def flagship(spark, d):
    root, _ = flagship_versions(spark, d)
    diff = versions.in_diff_order(versions.diff_published(spark, root, "docs", 1, 2))
    return diff.select(text.unquote(F.col("data")["id"]).alias("id"), "change", "old_status", "new_status")


@query("flagship_version_rows", f"{_VALID} SELECT 1 AS version, count(*) AS row_count, true AS matches FROM v UNION ALL SELECT 2, count(*) FILTER (later = 'approved'), true FROM v")
def flagship_rows(spark, d):
    """Row counts of both manifests, and whether the stored lines still give their hashes."""
    root, manifests = flagship_versions(spark, d)
    a, b = (store.read_version(spark, root, "docs", n) for n in (1, 2))
    hashes = versions.tree_hash(a).withColumn("version", F.lit(1)).unionByName(versions.tree_hash(b).withColumn("version", F.lit(2)))
    found = hashes.select("version", F.col("content_hash").alias("_now"))
    joined = manifests.select("version", "row_count", "content_hash").join(found, "version")
    return joined.select("version", "row_count", (F.col("content_hash") == F.col("_now")).alias("matches"))
