"""Registered queries: contracts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions import canon
from rowsmith.operators import contracts
from rowsmith.plans import inputs
from rowsmith.plans.inputs import load, plain
from rowsmith.plans.q_versions import R
from rowsmith.plans.registry import query

CAT = f"c AS ({plain(inputs.CATALOG)}), live AS (SELECT * FROM c WHERE NOT archived)"
AB = f"a AS ({plain(inputs.COLUMNS_A)}), b AS ({plain(inputs.COLUMNS_B)})"


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return inputs.columns_table(load(spark, d, inputs.CATALOG))


def pair(spark, d) -> tuple[DataFrame, DataFrame]:
    return tuple(inputs.columns_table(load(spark, d, sql)) for sql in (inputs.COLUMNS_A, inputs.COLUMNS_B))


_CLASH = """k AS (SELECT DISTINCT dataset, key FROM live), p AS (
 SELECT dataset, key, 'expected' AS prefix FROM k WHERE key IN ('expected.answer', 'expected.answer.text')
 UNION ALL SELECT dataset, key, 'expected.answer' FROM k WHERE key = 'expected.answer.text'),
 clash AS (SELECT p.dataset, p.prefix, p.key FROM p JOIN k ON p.dataset = k.dataset AND p.prefix = k.key)"""


@query("c06_prefix_clash", f"WITH {CAT}, {_CLASH} SELECT dataset, prefix, key FROM clash")
def prefix_clash(spark, d):
    return contracts.prefix_clashes(catalog(spark, d))


@query(
    "c05_lint",
    f"""WITH {CAT}, {_CLASH}
    SELECT dataset, key, 'select types require non-empty options' AS reason FROM live WHERE type IN ('select', 'multi_select') AND option_list IS NULL
    UNION ALL SELECT dataset, key, 'options are only allowed for select types' FROM live WHERE type NOT IN ('select', 'multi_select') AND option_list IS NOT NULL
    UNION ALL SELECT dataset, key, 'json_schema is only allowed for json columns' FROM live WHERE json_schema IS NOT NULL AND type <> 'json'
    UNION ALL SELECT dataset, key, 'json_schema may only use local $ref' FROM live WHERE type = 'json' AND json_schema LIKE '%"https:%'
    UNION ALL SELECT dataset, key, 'every ''.''-separated part must be non-empty' FROM live WHERE key = 'a..b'
    UNION ALL SELECT dataset, key, 'key column must be of type text' FROM live WHERE is_key AND type <> 'text'
    UNION ALL SELECT dataset, key, 'key column must be required' FROM live WHERE is_key AND NOT required
    UNION ALL SELECT dataset, key, 'duplicate column key' FROM live GROUP BY dataset, key HAVING count(*) > 1
    UNION ALL SELECT dataset, min(key), 'only one key column is allowed' FROM live WHERE is_key GROUP BY dataset HAVING count(*) > 1
    UNION ALL SELECT dataset, key, concat('clashes with ''', prefix, '''') FROM clash""",
)
def lint(spark, d):
    return contracts.lint_contracts(catalog(spark, d))


@query(
    "c07_replace_contract",
    f"""WITH {AB}, named AS (SELECT DISTINCT dataset FROM b)
    SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.key, b.key) AS key,
     CASE WHEN b.key IS NOT NULL THEN b.type ELSE a.type END AS type,
     CASE WHEN b.key IS NOT NULL THEN b.required ELSE a.required END AS required,
     CASE WHEN b.key IS NOT NULL THEN b.option_list ELSE a.option_list END AS option_list,
     CASE WHEN b.key IS NOT NULL THEN false ELSE a.archived OR named.dataset IS NOT NULL END AS archived,
     CASE WHEN b.key IS NOT NULL THEN b.is_key ELSE a.is_key AND named.dataset IS NULL END AS is_key
    FROM a FULL JOIN b ON a.dataset = b.dataset AND a.key = b.key LEFT JOIN named ON named.dataset = coalesce(a.dataset, b.dataset)""",
)
def replace_contract(spark, d):
    new = contracts.replace_contract(*pair(spark, d))
    return new.select("dataset", "key", "type", "required", F.array_join("options", ",").alias("option_list"), "archived", "is_key")


_CHANGED = "a.type <> b.type OR a.option_list IS DISTINCT FROM b.option_list OR a.required <> b.required"


@query(
    "c08_contract_diff",
    f"""WITH {AB}, x AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.key, b.key) AS key,
     CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' WHEN {_CHANGED} THEN 'changed' END AS change
     FROM a FULL JOIN b ON a.dataset = b.dataset AND a.key = b.key) SELECT * FROM x WHERE change IS NOT NULL""",
)
def contract_diff(spark, d):
    return contracts.diff_contract(*pair(spark, d))


@query(
    "c09_plan_contract_change",
    f"""WITH {AB}, x AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.key, b.key) AS key,
     CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'archived' WHEN {_CHANGED} THEN 'changed' END AS change
     FROM (SELECT * FROM a WHERE NOT archived) a FULL JOIN b ON a.dataset = b.dataset AND a.key = b.key) SELECT * FROM x WHERE change IS NOT NULL""",
)
def plan_change(spark, d):
    return contracts.plan_contract_change(*pair(spark, d))


_REQUIRED = "SELECT dataset, key FROM {0} WHERE required AND NOT archived"


@query("c10_drift", f"WITH {AB} {_REQUIRED.format('b')} EXCEPT {_REQUIRED.format('a')}")
def drift(spark, d):
    return contracts.contract_drift(*pair(spark, d))


@query("u03_required_difference", f"WITH {AB} {_REQUIRED.format('a')} EXCEPT {_REQUIRED.format('b')}")
def required_difference(spark, d):
    a, b = pair(spark, d)
    return contracts.contract_drift(b, a)


@query("u01_key_sets", f"""WITH {AB} SELECT dataset, key, 'added' AS side FROM (SELECT dataset, key FROM b EXCEPT SELECT dataset, key FROM a)
 UNION ALL SELECT dataset, key, 'removed' FROM (SELECT dataset, key FROM a EXCEPT SELECT dataset, key FROM b)
 UNION ALL SELECT dataset, key, 'common' FROM (SELECT dataset, key FROM a INTERSECT SELECT dataset, key FROM b)""")
def key_sets(spark, d):
    a, b = (c.select("dataset", "key") for c in pair(spark, d))
    sides = {"added": b.subtract(a), "removed": a.subtract(b), "common": contracts.common_keys(a, b)}
    first, *rest = [df.withColumn("side", F.lit(name)) for name, df in sides.items()]
    for df in rest:
        first = first.unionByName(df)
    return first


@query("c13_active_contract", f"WITH {CAT} SELECT dataset, key, ord FROM live")
def active(spark, d):
    return contracts.active(catalog(spark, d)).select("dataset", "key", "ord")


# Rows whose key column is checked: names repeat and some are padded or blank.
_KEYED = """SELECT concat('ev-', event_id) AS id, CASE WHEN event_id % 17 = 0 THEN ' ' WHEN event_id % 19 = 0 THEN concat(' k', event_id)
 WHEN event_id % 3 = 0 THEN 'hot' ELSE concat('k', event_id % 4000) END AS name, event_id % 23 = 0 AS deleted FROM {events}"""
KEYED = f"k AS ({plain(_KEYED)}), l AS (SELECT * FROM k WHERE NOT deleted)"
_PROBLEMS = """p AS (SELECT id, 'has no value' AS reason FROM l WHERE trim(name) = ''
 UNION ALL SELECT id, concat('''', name, ''' has leading or trailing whitespace') FROM l WHERE trim(name) <> '' AND name <> trim(name)
 UNION ALL SELECT id, concat('''', name, ''' is used by ', n, ' rows') FROM (SELECT id, name, count(*) OVER (PARTITION BY name) AS n
  FROM l WHERE trim(name) <> '' AND name = trim(name)) WHERE n > 1)"""


def keyed_rows(spark, d) -> DataFrame:
    from rowsmith.functions import text

    df = load(spark, d, _KEYED)
    data = canon.as_map({"name": text.quote(F.col("name"))})
    stamp = F.lit("2024-01-01").cast("timestamp")
    return df.select("id", data.alias("data"), F.when(F.col("deleted"), stamp).alias("deleted_at"), F.lit(None).cast("string").alias("row_key"))


@query("c11_key_audit", f"WITH {KEYED}, {_PROBLEMS} SELECT id, reason FROM p")
def key_audit(spark, d):
    return contracts.key_problems(keyed_rows(spark, d), "name")


@query("l06_problem_list", f"WITH {KEYED}, {_PROBLEMS} (SELECT id, reason FROM p ORDER BY id, reason LIMIT 20) UNION ALL SELECT '', concat('and ', count(*) - 20, ' more') FROM p HAVING count(*) > 20")
def problem_list(spark, d):
    return contracts.list_problems(contracts.key_problems(keyed_rows(spark, d), "name"))


@query("g05_duplicate_keys", f"WITH {KEYED} SELECT name, id, n FROM (SELECT name, id, count(*) OVER (PARTITION BY name) AS n FROM l) WHERE n > 1")
def duplicate_keys(spark, d):
    from rowsmith.operators.rows import shared_keys

    rows = keyed_rows(spark, d).withColumn("row_key", F.expr("substring(data['name'], 2, length(data['name']) - 2)"))
    return shared_keys(rows).select(F.col("row_key").alias("name"), "id", "n")


@query("c12_rekey", f"WITH {R} SELECT id, CASE WHEN deleted THEN id ELSE id END AS row_key FROM r")
def rekey(spark, d):
    return contracts.rekey(inputs.review_rows(spark, d), "id").select("id", "row_key")


_MAP = f"""h AS ({plain(inputs.HEADERS)}), s AS (SELECT file, pos, source, lower(trim(source)) AS norm FROM h),
 f AS (SELECT file, norm, min_by(source, pos) AS source FROM s GROUP BY file, norm)"""


def _mapping_columns(spark) -> DataFrame:
    from rowsmith.contract import Contract, Field

    return Contract(
        (Field("name", ord=0), Field("score", "number", ord=1), Field("as_of", "date", ord=2), Field("old", ord=3, archived=True))
    ).to_columns(spark, "x")


@query("p02_suggest_mapping", f"WITH {_MAP} SELECT file, source, norm AS key FROM f WHERE norm IN ('name', 'score', 'as_of')")
def suggest_mapping(spark, d):
    return contracts.suggest_mapping(load(spark, d, inputs.HEADERS), _mapping_columns(spark))


@query("w05_first_header", f"WITH {_MAP}, w AS (SELECT file, source, norm AS key, row_number() OVER (PARTITION BY file, norm ORDER BY pos) AS rn FROM s WHERE norm IN ('name', 'score', 'as_of')) SELECT file, source, key FROM w WHERE rn = 1")
def first_header(spark, d):
    return contracts.suggest_mapping(load(spark, d, inputs.HEADERS), _mapping_columns(spark))


@query("p03_check_mapping", f"""WITH {_MAP}, m AS (SELECT file, norm AS key FROM s)
 SELECT file, key, concat('''', key, ''' is not a schema column') AS reason FROM m WHERE key NOT IN ('name', 'score', 'as_of', 'old')
 UNION ALL SELECT file, key, concat(count(*), ' sources map to ''', key, '''') FROM m GROUP BY file, key HAVING count(*) > 1""")
def check_mapping(spark, d):
    mapping = load(spark, d, inputs.HEADERS).select("file", "source", F.lower(F.trim("source")).alias("key"))
    return contracts.check_mapping(mapping, _mapping_columns(spark))
