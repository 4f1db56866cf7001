"""Registered queries: coercion, projections and validation rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.functions import canon, checks, coerce, text
from rowsmith.operators import contracts, importing, options
from rowsmith.operators import records as record_ops
from rowsmith.plans import durable, inputs
from rowsmith.plans.inputs import load, plain
from rowsmith.plans.registry import query

WS = text.WHITESPACE
D = f"d AS ({plain(inputs.DIRTY)})"


def trim(c: str) -> str:
    return f"trim({c}, '{WS}')"


def blank(c: str) -> str:
    return f"({trim(c)} = '')"


# SQL for the JSON text a raw cell becomes (no blank rule).
NUMBER = (
    f"CASE WHEN regexp_full_match({trim('score')}, '[+-]?[0-9]+') THEN CAST(CAST({trim('score')} AS BIGINT) AS VARCHAR) "
    f"WHEN regexp_full_match({trim('score')}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN CAST(CAST({trim('score')} AS DOUBLE) AS VARCHAR) "
    "ELSE to_json(score)::VARCHAR END"
)
BOOLEAN = (
    f"CASE WHEN lower({trim('flagged')}) IN ('true','1','yes') THEN 'true' "
    f"WHEN lower({trim('flagged')}) IN ('false','0','no') THEN 'false' ELSE to_json(flagged)::VARCHAR END"
)
ITEMS = f"list_filter(list_transform(regexp_split_to_array(tags, '[,;]'), lambda x: trim(x, '{WS}')), lambda x: x <> '')"
MULTI = f"to_json({ITEMS})::VARCHAR"
SELECT = f"to_json({trim('kind')})::VARCHAR"
IS_DATE = f"(regexp_full_match({trim('as_of')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({trim('as_of')} AS DATE) IS NOT NULL)"
TIMED = f"(NOT {IS_DATE} AND regexp_matches({trim('as_of')}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]'))"
DATE = f"to_json(CASE WHEN {IS_DATE} THEN {trim('as_of')} ELSE as_of END)::VARCHAR"

# One row's mapped cells: NULL when the source cell is blank or refused.
MAPPED = f"""m AS (SELECT row_idx, name, to_json(name)::VARCHAR AS c_name, {SELECT} AS c_kind,
 CASE WHEN NOT {blank('score')} THEN {NUMBER} END AS c_score,
 CASE WHEN NOT {blank('flagged')} THEN {BOOLEAN} END AS c_flagged,
 CASE WHEN NOT {blank('tags')} THEN {MULTI} END AS c_tags, {ITEMS} AS items,
 CASE WHEN NOT {TIMED} THEN {DATE} END AS c_as_of,
 CASE WHEN {TIMED} THEN concat('''', {trim('as_of')}, ''' has a time component') END AS f_as_of, as_of,
 to_json(blob)::VARCHAR AS c_blob FROM d)"""
# (column, reason) of every rule error, in contract order.
REASONS = {
    "kind": (
        "kind_reason",
        "CASE WHEN c_kind NOT IN ('\"click\"','\"view\"','\"signup\"','\"purchase\"') THEN concat('''', trim(c_kind, '\"'), "
        "''' is not one of [''click'', ''view'', ''signup'', ''purchase'']') END",
    ),
    "score": ("score_reason", "CASE WHEN left(c_score, 1) = '\"' THEN 'expected a number, got str' END"),
    "flagged": ("flagged_reason", "CASE WHEN left(c_flagged, 1) = '\"' THEN 'expected a boolean, got str' END"),
    "tags": (
        "tags_reason",
        "CASE WHEN c_tags IS NOT NULL AND len(list_filter(items, lambda x: x NOT IN ('a', 'b'))) > 0 THEN "
        "concat('[', array_to_string(list_transform(list_filter(items, lambda x: x NOT IN ('a', 'b')), lambda x: concat('''', x, '''')), ', '), "
        "'] not in [''a'', ''b'']') END",
    ),
    "as_of": (
        "as_of_reason",
        "CASE WHEN f_as_of IS NOT NULL THEN f_as_of WHEN c_as_of IS NULL THEN 'required' "
        "WHEN NOT (regexp_full_match(c_as_of, '\"[0-9]{4}-[0-9]{2}-[0-9]{2}\"') AND try_cast(trim(c_as_of, '\"') AS DATE) IS NOT NULL) "
        "THEN concat('expected a date as YYYY-MM-DD, got ''', as_of, '''') END",
    ),
}
MAPPING = {k: k for k in ("name", "kind", "score", "flagged", "tags", "as_of", "blob")}


def dirty(spark, d) -> DataFrame:
    return load(spark, d, inputs.DIRTY)


def mapped_dirty(spark: SparkSession, d: str) -> DataFrame:
    return importing.map_rows(inputs.load_spread(spark, d, inputs.DIRTY, "event_id"), MAPPING, inputs.DIRTY_CONTRACT, F.col)


def reason_sql(key: str) -> str:
    return f"WITH {D}, {MAPPED} SELECT row_idx, {REASONS[key][1]} AS reason FROM m WHERE {REASONS[key][1]} IS NOT NULL"


def reasons(spark, d, key: str) -> DataFrame:
    """The rule errors of one column over every mapped row."""
    mapped = mapped_dirty(spark, d)
    field = inputs.DIRTY_CONTRACT.field(key)
    reason = checks.field_error(field, importing.mapped_cells(mapped)(key))
    return importing.report(mapped, "row_idx", errors=checks.one_error(key, reason)).select("row_idx", "reason")


# --- Projections and coercion ------------------------------------------


@query(
    "p01_apply_mapping",
    f"""WITH {D}, {MAPPED} SELECT row_idx, concat('{{', array_to_string(list_filter([
      CASE WHEN c_as_of IS NOT NULL THEN concat('"as_of":', c_as_of) END, concat('"blob":', c_blob),
      CASE WHEN c_flagged IS NOT NULL THEN concat('"flagged":', c_flagged) END, concat('"kind":', c_kind),
      concat('"name":', c_name), CASE WHEN c_score IS NOT NULL THEN concat('"score":', c_score) END,
      CASE WHEN c_tags IS NOT NULL THEN concat('"tags":', c_tags) END], lambda x: x IS NOT NULL), ','), '}}') AS data, f_as_of AS failure FROM m""",
)
def apply_mapping(spark, d):
    mapped = mapped_dirty(spark, d)
    cell = importing.mapped_cells(mapped)
    return mapped.select(
        "row_idx",
        canon.object_text(cell, inputs.DIRTY_CONTRACT.active_keys).alias("data"),
        F.get("failures", F.lit(0))["reason"].alias("failure"),
    )


@query("p04_to_number", f"WITH {D} SELECT row_idx, {NUMBER} AS value FROM d")
def to_number(spark, d):
    return dirty(spark, d).select("row_idx", coerce.to_number(F.col("score")).alias("value"))


@query("p05_to_boolean", f"WITH {D} SELECT row_idx, {BOOLEAN} AS value FROM d")
def to_boolean(spark, d):
    return dirty(spark, d).select("row_idx", coerce.to_boolean(F.col("flagged")).alias("value"))


@query("p06_to_multi_select", f"WITH {D} SELECT row_idx, {MULTI} AS value FROM d")
def to_multi(spark, d):
    return dirty(spark, d).select("row_idx", coerce.to_multi(F.col("tags")).alias("value"))


@query("p07_to_select", f"WITH {D} SELECT row_idx, {SELECT} AS value FROM d")
def to_select(spark, d):
    return dirty(spark, d).select("row_idx", coerce.to_select(F.col("kind")).alias("value"))


@query("p08_to_text", f"WITH {D} SELECT row_idx, to_json(kind)::VARCHAR AS kind, to_json(blob)::VARCHAR AS blob FROM d")
def to_text(spark, d):
    return dirty(spark, d).select("row_idx", coerce.as_is(F.col("kind")).alias("kind"), coerce.as_is(F.col("blob")).alias("blob"))


@query("p09_to_date", f"WITH {D} SELECT row_idx, CASE WHEN NOT {TIMED} THEN {DATE} END AS value, CASE WHEN {TIMED} THEN concat('''', {trim('as_of')}, ''' has a time component') END AS failure FROM d")
def to_date(spark, d):
    value, failure = coerce.text_cell(F.col("as_of"), "date")
    return dirty(spark, d).select("row_idx", value.alias("value"), failure.alias("failure"))


_NEED = "'map this to a json column'"
_KIND = "CASE WHEN left(v, 1) = '\"' THEN 's' WHEN left(v, 1) = '[' THEN 'l' WHEN left(v, 1) = '{' THEN 'o' WHEN v IN ('true','false') THEN 'b' ELSE 'n' END"


@query(
    "p10_coerce_typed",
    f"""WITH t AS ({plain(inputs.TYPED)}), k AS (SELECT row_idx, v, {_KIND} AS k FROM t)
    SELECT row_idx,
     CASE WHEN k = 's' THEN v WHEN k IN ('n', 'b') THEN concat('"', v, '"') END AS as_text,
     CASE WHEN k IN ('s', 'n', 'b') THEN v END AS as_number,
     CASE WHEN v = '"yes"' OR v IN ('1', 'true') THEN 'true' WHEN v = '0' THEN 'false' WHEN k IN ('s', 'n') THEN v END AS as_boolean,
     CASE WHEN k = 's' THEN concat('[', v, ']') WHEN k <> 'o' THEN v END AS as_multi,
     v AS as_json, CASE WHEN k = 's' THEN v END AS as_date,
     CASE WHEN k IN ('l', 'o') THEN {_NEED} END AS text_failure,
     CASE WHEN k IN ('l', 'o') THEN {_NEED} WHEN k IN ('n', 'b') THEN
       concat(CASE WHEN v = 'true' THEN 'True' ELSE v END, ' is a number, not a date (write YYYY-MM-DD)') END AS date_failure
    FROM k""",
)
def coerce_typed(spark, d):
    src = load(spark, d, inputs.TYPED)
    v = F.col("v")
    names = {"as_text": "text", "as_number": "number", "as_boolean": "boolean", "as_multi": "multi_select", "as_json": "json", "as_date": "date"}
    return src.select(
        "row_idx",
        *[coerce.coerce_typed(v, t).alias(n) for n, t in names.items()],
        coerce.typed_failure(v, "text").alias("text_failure"),
        coerce.typed_failure(v, "date").alias("date_failure"),
    )


@query("p12_empty_absent", f"WITH {D} SELECT row_idx, {blank('score')} AS no_score, {blank('tags')} AS no_tags FROM d")
def empty_absent(spark, d):
    mapped = mapped_dirty(spark, d)
    return mapped.select("row_idx", F.col("`cell:score`").isNull().alias("no_score"), F.col("`cell:tags`").isNull().alias("no_tags"))


N = f"n AS ({plain(inputs.NESTED)})"
_ENTRIES = """SELECT row_idx, 'id' AS path, json_extract(line, '$.id')::VARCHAR AS value FROM n
 UNION ALL SELECT row_idx, 'expected.turns', json_extract(line, '$.expected.turns')::VARCHAR FROM n
 UNION ALL SELECT row_idx, 'expected.flags.long', json_extract(line, '$.expected.flags.long')::VARCHAR FROM n
 UNION ALL SELECT row_idx, 'roles', json_extract(line, '$.roles')::VARCHAR FROM n
 UNION ALL SELECT row_idx, 'note', json_extract(line, '$.note')::VARCHAR FROM n"""


def nested_flat(spark, d) -> DataFrame:
    lines = load(spark, d, inputs.NESTED)
    return record_ops.flatten_records(lines, inputs.NESTED_CONTRACT.json_keys)


@query("p13_flatten", f"WITH {N} {_ENTRIES}")
def flatten(spark, d):
    return contracts.values_of(nested_flat(spark, d))


_SORTED_LINE = (
    """concat('{"expected":{"flags":{"long":', json_extract(line, '$.expected.flags.long')::VARCHAR, '},"turns":', """
    """json_extract(line, '$.expected.turns')::VARCHAR, '},"id":', json_extract(line, '$.id')::VARCHAR, ',"note":', """
    """json_extract(line, '$.note')::VARCHAR, ',"roles":', json_extract(line, '$.roles')::VARCHAR, '}')"""
)


@query("p14_nest", f"WITH {N} SELECT row_idx, {_SORTED_LINE} AS line FROM n")
def nest(spark, d):
    flat = nested_flat(spark, d)
    return flat.select("row_idx", canon.nested_text(canon.cells_of("rec"), inputs.NESTED_CONTRACT.active_keys).alias("line"))


@query("s15_export_nested", f"""WITH {N} SELECT concat('{{"data":', {_SORTED_LINE}, ',"id":', json_extract(line, '$.id')::VARCHAR, ',"status":"draft"}}') AS line FROM n""")
def export_nested(spark, d):
    from rowsmith.operators import versions
    from rowsmith.plans.q_versions import folder_for
    from rowsmith.sources import snapshots

    flat = nested_flat(spark, d)
    snap = flat.select(
        text.unquote(F.col("rec")["id"]).alias("id"), F.lit("draft").alias("status"), F.col("rec").alias("data"),
        F.timestamp_micros("row_idx").alias("created_at"),
    )
    path = folder_for(spark, "nested")
    snapshots.export_jsonl(versions.export_line(snap, inputs.NESTED_CONTRACT, "nested"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("p15_path_collision", f"""WITH c AS ({plain(inputs.CLASH)}) SELECT row_idx, CASE WHEN (row_idx - 1) % 13 = 0 THEN 'path ''a.b'' appears twice'
 ELSE 'invalid path ''a..b'': empty segment' END AS problem FROM c WHERE (row_idx - 1) % 13 = 0 OR (row_idx - 1) % 17 = 0""")
def path_collision(spark, d):
    flat = record_ops.flatten_records(load(spark, d, inputs.CLASH))
    return flat.filter(F.col("problem").isNotNull()).select("row_idx", "problem")


_OLD = "concat('\"', o_orderpriority, '\"')"


def _merge_input(spark, d) -> DataFrame:
    orders = inputs.table(spark, d, "orders")
    key = F.col("o_orderkey")
    old = canon.as_map({"a": text.quote(F.col("o_orderpriority")), "b": key.cast("string")})
    new = canon.as_map({"b": F.when(key % 3 == 0, "null").when(key % 3 == 1, "7"), "c": F.when(key % 2 == 0, "true")})
    return orders.select("o_orderkey", old.alias("old"), new.alias("new"))


@query(
    "p19_merge",
    f"""SELECT o_orderkey,
     concat('{{"a":', {_OLD}, ',"b":', CASE WHEN o_orderkey % 3 = 0 THEN 'null' WHEN o_orderkey % 3 = 1 THEN '7' ELSE o_orderkey::VARCHAR END,
       CASE WHEN o_orderkey % 2 = 0 THEN ',"c":true' ELSE '' END, '}}') AS patched,
     concat('{{"a":', {_OLD}, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN ',"b":7' ELSE concat(',"b":', o_orderkey) END,
       CASE WHEN o_orderkey % 2 = 0 THEN ',"c":true' ELSE '' END, '}}') AS synced FROM orders""",
)
def merge(spark, d):
    both = _merge_input(spark, d).select(
        "o_orderkey",
        canon.merge_patch(F.col("old"), F.col("new")).alias("p"),
        canon.merge_sync(F.col("old"), F.col("new")).alias("s"),
    )
    keys = ["a", "b", "c"]
    return both.select(
        "o_orderkey",
        canon.object_text(canon.cells_of("p"), keys).alias("patched"),
        canon.object_text(canon.cells_of("s"), keys).alias("synced"),
    )


@query(
    "p20_fix_overlay",
    f"""WITH {D}, {MAPPED} SELECT row_idx, CASE WHEN row_idx % 70 = 1 THEN '"2024-03-01"' ELSE c_as_of END AS as_of,
     CASE WHEN row_idx % 70 = 1 THEN NULL ELSE f_as_of END AS failure FROM m""",
)
def fix_overlay(spark, d):
    fixed = importing.apply_fixes(mapped_dirty(spark, d), load(spark, d, inputs.FIXES), inputs.DIRTY_CONTRACT)
    return fixed.select("row_idx", F.col("`cell:as_of`").alias("as_of"), F.get("failures", F.lit(0))["reason"].alias("failure"))


# --- Validation ---------------------------------------------------------

RD = f"r AS ({plain(inputs.REVIEW)})"


@query("v01_empty", f"WITH {D} SELECT row_idx, {blank('tags')} AS raw_blank, (len({ITEMS}) = 0) AS empty_list, {blank('score')} AS score_empty, false AS json_empty FROM d")
def empty(spark, d):
    src = dirty(spark, d)
    multi = coerce.to_multi(F.col("tags"))
    return src.select(
        "row_idx",
        checks.is_empty(text.quote(F.col("tags")), "text").alias("raw_blank"),
        checks.is_empty(multi, "multi_select").alias("empty_list"),
        checks.is_empty(F.when(text.strip(F.col("score")) != "", F.lit("1")), "number").alias("score_empty"),
        checks.is_empty(multi, "json").alias("json_empty"),
    )


@query("v02_required", f"WITH {D}, {MAPPED} SELECT row_idx, 'required' AS reason FROM m WHERE c_as_of IS NULL")
def required(spark, d):
    return reasons(spark, d, "as_of").filter(F.col("reason") == "required")


@query(
    "v03_text",
    f"""WITH t AS ({plain(inputs.TYPED)}) SELECT row_idx, concat('expected text, got ', CASE WHEN left(v, 1) = '[' THEN 'list' WHEN left(v, 1) = '{{' THEN 'dict'
     WHEN v = 'true' THEN 'bool' WHEN v = '4.5' THEN 'float' ELSE 'int' END) AS reason FROM t WHERE left(v, 1) <> '"'""",
)
def is_text(spark, d):
    field = Field("v", "text")
    errors = checks.one_error("v", checks.type_error(field, F.col("v")))
    return importing.report(load(spark, d, inputs.TYPED), "row_idx", errors=errors).select("row_idx", "reason")


@query("v04_number", reason_sql("score"))
def is_number(spark, d):
    return reasons(spark, d, "score")


@query("v05_boolean", reason_sql("flagged"))
def is_boolean(spark, d):
    return reasons(spark, d, "flagged")


@query("v06_select_options", reason_sql("kind"))
def select_options(spark, d):
    return reasons(spark, d, "kind")


@query("v07_multi_select_options", reason_sql("tags"))
def multi_options(spark, d):
    return reasons(spark, d, "tags")


# Each line picks one of the twenty options made for it, or one of five that were not; suppliers are tags.
_PICKS = """SELECT l_orderkey * 10 + l_linenumber AS row_idx, concat(l_orderkey, '-', l_linenumber, '-', 1 + min(l_partkey) % 25) AS pick,
 concat('s', min(l_suppkey)) AS one, concat('s', min(l_suppkey) * 2) AS two FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""
_PICK_OPTIONS = "SELECT l_orderkey, l_linenumber FROM {lineitem}"
OPTION_CONTRACT = Contract.of(Field("pick", "select", options_table=True, required=True), Field("tags", "multi_select", options_table=True))


@query(
    "v06_options_table",
    f"""WITH p AS ({plain(_PICKS)}), k AS (SELECT row_idx, pick, two, two NOT IN (SELECT concat('s', s_suppkey) FROM supplier) AS odd,
     CAST(split_part(pick, '-', 3) AS INT) > 20 AS off FROM p)
    SELECT row_idx, 'pick' AS "column", concat('''', pick, ''' is not one of the options') AS reason FROM k WHERE off
    UNION ALL SELECT row_idx, 'tags', concat('[''', two, '''] not in the options') FROM k WHERE odd""",
)
def options_table(spark, d):
    """Twenty times as many options as lines: more than a million from sf0.01 on."""
    line = F.when(F.coalesce("l_orderkey", "l_linenumber").isNotNull(), F.concat_ws("-", "l_orderkey", "l_linenumber"))
    own = load(spark, d, _PICK_OPTIONS).select(line.alias("line")).select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("n"), "line")
    allowed = own.select(F.lit("pick").alias("column"), F.concat_ws("-", "line", "n").alias("option"))
    tags = inputs.table(spark, d, "supplier").select(F.lit("tags").alias("column"), F.concat(F.lit("s"), "s_suppkey").alias("option"))
    rows = load(spark, d, _PICKS).select("row_idx", text.quote(F.col("pick")).alias("pick"), text.array_text(F.array("one", "two")).alias("tags"))
    with durable.briefly(rows, "picks") as rows:
        unknown = options.unknown_values(rows, F.col, OPTION_CONTRACT, allowed.unionByName(tags), ["row_idx"])
    return options.option_errors(unknown, OPTION_CONTRACT, ["row_idx"])


@query(
    "v08_json_cell_size",
    f"""WITH {RD} SELECT id, CAST(strlen(to_json([body])::VARCHAR) AS BIGINT) + 11 + strlen(source) AS bytes FROM r""",
)
def json_size(spark, d):
    rows = inputs.review_rows(spark, d)
    cell = F.concat(F.lit("["), F.col("data")["body"], F.lit(',{"s":'), F.col("data")["source"], F.lit("}]"))
    return rows.select("id", text.stored_size(cell).cast("bigint").alias("bytes"))


_CELL_LENGTH = "CASE WHEN event_id % 500 = 0 THEN 262138 + event_id % 6 ELSE event_id % 7 END"


@query("v08_json_cell_limit", f"SELECT event_id, CASE WHEN {_CELL_LENGTH} + 4 > 262144 THEN concat('value is ', {_CELL_LENGTH} + 4, ' bytes; the limit is 262144') END AS reason FROM events")
def json_limit(spark, d):
    """Cells around the size limit, checked by the rule of a json column."""
    sized = load(spark, d, f"SELECT event_id, CAST({_CELL_LENGTH} AS INT) AS n FROM {{events}}")
    cell = F.concat(F.lit('["'), F.repeat(F.lit("x"), F.col("n")), F.lit('"]'))
    return sized.select("event_id", checks.field_error(Field("j", "json"), cell).alias("reason"))


SCHEMA = '{"type":"object","properties":{"k":{"type":"integer","maximum":50}},"required":["k"],"additionalProperties":false}'


@query(
    "v09_json_schema",
    """SELECT event_id, CASE WHEN (props->>'$.k')::BIGINT > 50 THEN concat('k: ', props->>'$.k', ' is greater than the maximum of 50') END AS reason
     FROM events WHERE (props->>'$.k')::BIGINT > 50""",
)
def json_schema(spark, d):
    field = Field("blob", "json", json_schema=SCHEMA)
    events = inputs.table(spark, d, "events")
    errors = checks.one_error("blob", checks.type_error(field, F.col("props")))
    return importing.report(events, "event_id", errors=errors).select("event_id", "reason")


@query("v10_date", reason_sql("as_of") + " AND f_as_of IS NULL AND c_as_of IS NOT NULL")
def is_date(spark, d):
    return reasons(spark, d, "as_of").filter(F.col("reason") != "required")


@query("v11_key_trimmed", f"WITH {D} SELECT row_idx, 'key value must not have leading or trailing whitespace' AS reason FROM d WHERE kind <> {trim('kind')}")
def key_trimmed(spark, d):
    field = Field("kind", "text", required=True, is_key=True)
    src = dirty(spark, d)
    errors = checks.one_error("kind", checks.type_error(field, text.quote(F.col("kind"))))
    return importing.report(src, "row_idx", errors=errors).select("row_idx", "reason")


_ALL = " UNION ALL ".join(
    f"SELECT row_idx, '{k}' AS \"column\", {r[1]} AS reason FROM m WHERE {r[1]} IS NOT NULL" for k, r in REASONS.items()
)


@query(
    "v12_archived_unchecked",
    f"WITH {D}, {MAPPED}, e AS ({_ALL}) SELECT row_idx, \"column\", reason FROM e WHERE \"column\" NOT IN ('kind', 'score') AND reason NOT LIKE '%time component'"
    " UNION ALL SELECT row_idx, 'as_of', 'required' FROM m WHERE c_as_of IS NULL",
)
def archived_unchecked(spark, d):
    """``kind`` archived and ``score`` unknown: neither is checked."""
    from dataclasses import replace

    fields = [replace(f, archived=True) if f.key == "kind" else f for f in inputs.DIRTY_CONTRACT.fields if f.key != "score"]
    mapped = mapped_dirty(spark, d)
    cell = importing.mapped_cells(mapped)
    return importing.report(mapped, "row_idx", errors=checks.row_errors(cell, Contract(tuple(fields))))


_LIST = "concat_ws('|', " + ", ".join(f"CASE WHEN {r[1]} IS NOT NULL THEN concat('{k}: ', {r[1]}) END" for k, r in REASONS.items()) + ")"


def _with_failures(mapped: DataFrame) -> DataFrame:
    cell = importing.mapped_cells(mapped)
    failed = F.transform("failures", lambda e: e["column"])
    rules = F.filter(checks.row_errors(cell, inputs.DIRTY_CONTRACT), lambda e: ~F.array_contains(failed, e["column"]))
    return mapped.withColumn("errors", F.concat(rules, "failures"))


@query("v13_row_errors", f"WITH {D}, {MAPPED} SELECT row_idx, {_LIST} AS errors FROM m")
def row_errors(spark, d):
    joined = F.array_join(F.transform("errors", lambda e: F.concat(e["column"], F.lit(": "), e["reason"])), "|")
    return _with_failures(mapped_dirty(spark, d)).select("row_idx", joined.alias("errors"))


@query("v14_error_report", f"WITH {D}, {MAPPED} {_ALL}")
def error_report(spark, d):
    return importing.error_report(_with_failures(mapped_dirty(spark, d)))


_TARGET = "CASE c_custkey % 5 WHEN 0 THEN concat(lower(c_mktsegment), '@v', c_custkey) WHEN 1 THEN concat('v', c_nationkey) WHEN 2 THEN c_name WHEN 3 THEN concat('-bad@v', c_custkey) ELSE concat(lower(c_mktsegment), '_', c_custkey) END"


@query(
    "v17_target_syntax",
    f"""WITH t AS (SELECT c_custkey, {_TARGET} AS target FROM customer) SELECT c_custkey, target,
     regexp_full_match(target, '[a-z0-9][a-z0-9_-]{{0,99}}') AS valid_name,
     CASE WHEN regexp_full_match(target, '[a-z0-9][a-z0-9_-]{{0,99}}@v[0-9]+') THEN split_part(target, '@v', 1) END AS pin_name,
     CASE WHEN regexp_full_match(target, '[a-z0-9][a-z0-9_-]{{0,99}}@v[0-9]+') THEN split_part(target, '@v', 2)::BIGINT END AS pin_version,
     CASE WHEN regexp_full_match(target, 'v[0-9]+') THEN substr(target, 2)::BIGINT END AS version FROM t""",
)
def target_syntax(spark, d):
    targets = load(spark, d, f"SELECT c_custkey, {_TARGET} AS target FROM {{customer}}")
    return targets.select("c_custkey", "target", *[c.alias(n) for n, c in contracts.name_parts(F.col("target")).items()])


@query("w02_file_order", f"WITH {D} SELECT name, 1704067200000000 + row_idx AS created_micros FROM d")
def file_order(spark, d):
    """created_at is the start plus the row number in microseconds: no window."""
    started = F.timestamp_micros(F.lit(1_704_067_200_000_000))
    made = importing.new_rows(dirty(spark, d), F.create_map().cast("map<string,string>"), F.col("name"), "events", "u1", started)
    return made.select(F.col("row_key").alias("name"), F.unix_micros("created_at").alias("created_micros"))


