"""Inputs of the registered queries, derived from the given tables.

Each input is one SQL text that both engines run: Spark through
``spark.sql(text, **tables)`` and the checking engine with plain table names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.functions import canon, text

REVIEW = """
SELECT concat('doc-', d.doc_id) AS id, d.text AS body, d.lang AS lang, d.source AS source, d.n_chars AS n_chars,
       CASE WHEN l.doc_id IS NULL THEN 'draft' WHEN l.quality = 1 AND l.toxic = 0 THEN 'approved'
            ELSE 'needs_review' END AS status,
       CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE concat('u', d.doc_id % 5) END AS assignee,
       1 + d.doc_id % 3 AS rev, d.doc_id % 29 = 0 AS deleted, d.doc_id AS created_seq
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

DIRTY = """
SELECT event_id + 1 AS row_idx,
       concat('ev-', CASE WHEN event_id % 50 = 7 THEN event_id - 1 ELSE event_id END) AS name,
       CASE WHEN event_id % 6 = 0 THEN concat('  ', event_type, ' ') ELSE event_type END AS kind,
       CASE event_id % 11 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN ' 4 '
            ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS score,
       CASE event_id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'maybe' END AS flagged,
       CASE event_id % 4 WHEN 0 THEN 'a, b' WHEN 1 THEN 'a;c' WHEN 2 THEN ' ; ' ELSE '' END AS tags,
       CASE event_id % 7 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-01-02T03:04:05Z' WHEN 2 THEN '2024-2-3'
            ELSE CAST(CAST(ts AS DATE) AS STRING) END AS as_of,
       props AS blob
FROM {events}
"""
EXISTING = "SELECT concat('ev-', event_id) AS row_key FROM {events} WHERE event_id % 40 = 3"
SKIP = "SELECT event_id + 1 AS row_idx FROM {events} WHERE (event_id + 1) % 100 = 0"
FIXES = """
SELECT event_id + 1 AS row_idx, 'as_of' AS key, '"2024-03-01"' AS value FROM {events} WHERE (event_id + 1) % 70 = 1
"""

_V_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'needs_review' ELSE 'draft' END"
V1 = f"""
SELECT concat('ord-', o_orderkey) AS id, {_V_STATUS} AS status, o_orderpriority AS priority,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS total,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS as_of, o_orderkey AS created_seq
FROM {{orders}} WHERE o_orderkey % 23 <> 5
"""
# Every order, for what does not compare two versions.
V0 = V1.replace(" WHERE o_orderkey % 23 <> 5", "")
V2 = f"""
SELECT concat('ord-', o_orderkey) AS id,
       CASE WHEN o_orderkey % 19 = 0 THEN 'approved' ELSE {_V_STATUS} END AS status,
       CASE WHEN o_orderkey % 13 = 0 THEN '0-CHANGED' ELSE o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS total,
       CAST(CAST(o_orderdate AS DATE) AS STRING) AS as_of, o_orderkey AS created_seq
FROM {{orders}} WHERE o_orderkey % 17 <> 0
"""

SERVER = """
SELECT c_name AS row_key, c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) AS balance,
       1 + c_custkey % 3 AS rev, c_custkey % 37 = 0 AS deleted,
       CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'draft' END AS status, c_custkey AS created_seq FROM {customer}
"""
FILE = """
SELECT c_custkey AS row_idx,
       CASE WHEN c_custkey % 41 = 0 THEN concat('New#', c_custkey) ELSE c_name END AS row_key,
       CASE WHEN c_custkey % 7 = 0 THEN 'keep' WHEN c_custkey % 9 = 0 THEN 'clear' ELSE 'set' END AS seg_op,
       CASE WHEN c_custkey % 5 = 0 THEN 'EDITED' ELSE c_mktsegment END AS segment,
       CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) AS balance
FROM {customer} WHERE c_custkey % 11 <> 0
"""
PULLED = """
SELECT c_name AS row_key, CASE WHEN c_custkey % 8 = 0 THEN c_custkey % 3 ELSE 1 + c_custkey % 3 END AS rev,
       c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) AS balance
FROM {customer} WHERE c_custkey % 10 <> 1
"""

NESTED = """
SELECT conv_id + 1 AS row_idx,
       concat('{{"id":"c-', conv_id, '","expected":{{"turns":', count(*), ',"flags":{{"long":',
              CASE WHEN count(*) > 4 THEN 'true' ELSE 'false' END, '}}}},"roles":["user","assistant"],"note":',
              CASE WHEN conv_id % 3 = 0 THEN 'null' ELSE '"x"' END, '}}') AS line
FROM {conversations} GROUP BY conv_id
"""
BAD = """
SELECT event_id + 1 AS row_idx,
       CASE WHEN event_id % 19 = 0 THEN concat('{{"id":"e-', event_id, '"')
            WHEN event_id % 23 = 0 THEN concat('{{"id":"e-', event_id, '","id":"again"}}')
            WHEN event_id % 31 = 0 THEN '[1, 2]'
            WHEN event_id % 37 = 0 THEN concat('{{"id":"e-', event_id, '"}} x')
            ELSE concat('{{"id":"e-', event_id, '","props":', props, '}}') END AS line
FROM {events}
"""
TYPED = """
SELECT event_id + 1 AS row_idx,
       CASE event_id % 9 WHEN 0 THEN '5' WHEN 1 THEN '1' WHEN 2 THEN '0' WHEN 3 THEN 'true' WHEN 4 THEN '"yes"'
            WHEN 5 THEN '["a","b"]' WHEN 6 THEN '{{"k":1}}' WHEN 7 THEN '4.5'
            ELSE concat('"', CAST(CAST(ts AS DATE) AS STRING), '"') END AS v
FROM {events}
"""
CLASH = """
SELECT event_id + 1 AS row_idx,
       CASE WHEN event_id % 13 = 0 THEN concat('{{"a.b":', event_id, ',"a":{{"b":2}}}}')
            WHEN event_id % 17 = 0 THEN '{{"a..b":1}}'
            ELSE concat('{{"a":{{"b":', event_id, ',"c":{{}}}},"d.e":"', event_type, '"}}') END AS line
FROM {events}
"""
# Patches of every document: one each, and many of those that events name. ``k`` numbers a
# document's patches; every fourth is stale, some break the contract, the third mends the
# language. ``passes`` is what a reader of the rules expects, and the revs follow from it.
PATCHES = """
SELECT *, CASE WHEN k % 4 = 0 THEN 0
               ELSE 1 + doc_id % 3 + coalesce(sum(CAST(passes AS INT)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          END AS expected_rev
FROM (SELECT n.doc_id, concat('doc-', n.doc_id) AS id, n.seq, n.k,
             CASE WHEN k <> 3 AND k % 6 <> 5 AND k % 5 <> 1 THEN CASE WHEN seq % 2 = 0 THEN 'approved' ELSE 'draft' END END AS status,
             k % 7 = 2 AS set_assignee, CASE WHEN k % 7 = 2 AND k % 3 <> 0 THEN concat('u', k % 9) END AS assignee,
             CASE WHEN k = 3 THEN 'en' END AS lang, CASE WHEN k <> 3 AND k % 6 <> 5 AND k % 5 = 1 THEN concat('p', k) END AS source,
             k <> 3 AND k % 6 = 5 AS breaks, d.doc_id IS NOT NULL AND n.doc_id % 29 <> 0 AS known,
             d.doc_id IS NOT NULL AND n.doc_id % 29 <> 0 AND k % 4 <> 0 AND
             CASE WHEN k = 3 THEN trim(d.text) <> '' WHEN k % 6 = 5 THEN false
                  WHEN k % 5 = 1 THEN trim(d.text) <> '' AND (d.lang IN ('en', 'de', 'fr') OR k > 3) ELSE true END AS passes
      FROM (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k
            FROM (SELECT user_id AS doc_id, event_id AS seq FROM {events}
                  UNION ALL SELECT doc_id, 1000000000 + doc_id FROM {documents}) u) n
      LEFT JOIN {documents} d ON n.doc_id = d.doc_id) t
"""
STREAM = """
SELECT concat('doc-', doc_id) AS id, doc_id, seq, k, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 + doc_id % 3 + k - 1 - (k - 1 - (k - 1) % 4) / 4 END AS expected_rev,
       CASE WHEN k % 2 = 0 THEN 'approved' ELSE 'draft' END AS status
FROM (SELECT user_id AS doc_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {events}) n
"""
DOCS = """
SELECT concat('file-', o_orderkey) AS file,
       CASE o_orderkey % 6
            WHEN 0 THEN concat('[{{"k":', o_orderkey, '}},"{{oops",null,7,{{"k":2}}]')
            WHEN 1 THEN concat('{{"manifest":{{"n":1}},"other":[{{"z":1}}],"rows":[{{"k":', o_orderkey, '}}]}}')
            WHEN 2 THEN concat('{{"meta":1,"items":[{{"k":', o_orderkey, '}},{{"k":3}}],"names":["x"]}}')
            WHEN 3 THEN concat('{{"a":[{{"k":', o_orderkey, '}}],"b":[{{"k":2}}]}}')
            WHEN 4 THEN concat('{{"x":', o_orderkey, '}}')
            ELSE concat('"text ', o_orderkey, '"') END AS doc
FROM {orders}
"""

# Columns tables of many datasets: an order is a dataset, its lines are columns.
CATALOG = """
SELECT concat('ds-', l_orderkey) AS dataset,
       CASE l_partkey % 9 WHEN 0 THEN 'id' WHEN 1 THEN 'expected' WHEN 2 THEN 'expected.answer' WHEN 3 THEN 'lang'
            WHEN 4 THEN 'a..b' WHEN 5 THEN 'expected.answer.text' WHEN 6 THEN 'meta_data' WHEN 7 THEN 'score-total'
            ELSE concat('f', l_suppkey % 3) END AS key,
       CASE l_suppkey % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'long_text' WHEN 2 THEN 'select' WHEN 3 THEN 'multi_select'
            WHEN 4 THEN 'number' WHEN 5 THEN 'boolean' WHEN 6 THEN 'json' ELSE 'date' END AS type,
       CASE WHEN l_quantity > 20 AND l_suppkey % 8 IN (2, 3) THEN 'a,b' WHEN l_quantity > 45 THEN 'x' END AS option_list,
       l_quantity > 25 AS required, l_partkey % 9 IN (0, 3) AS is_key, l_linenumber AS ord,
       l_returnflag = 'R' AS archived,
       CASE WHEN l_partkey % 9 = 6 THEN CASE WHEN l_linenumber % 2 = 0 THEN '{{"$ref":"#/$defs/x"}}'
            ELSE '{{"items":{{"$ref":"https://example.org/s"}}}}' END END AS json_schema
FROM {lineitem}
"""
_COLUMN_FACTS = """
SELECT DISTINCT concat('ds-', l_orderkey) AS dataset, concat('k', l_partkey % 20) AS key,
       CASE WHEN ({bump}) THEN 'json' WHEN (l_orderkey + l_partkey % 20) % 3 = 0 THEN 'number'
            WHEN (l_orderkey + l_partkey % 20) % 3 = 1 THEN 'select' ELSE 'text' END AS type,
       CASE WHEN (l_orderkey + l_partkey % 20) % 3 = 1 AND NOT ({bump}) THEN 'a,b' END AS option_list,
       (l_orderkey + l_partkey % 20) % {need} = 0 AS required,
       concat('Label ', l_partkey % 20) AS label, l_partkey % 20 AS ord,
       (l_orderkey + l_partkey % 20) % 10 = 9 AS archived, (l_partkey % 20) = 4 AS is_key
FROM {{lineitem}} WHERE l_partkey % {left_out} <> 0
"""
COLUMNS_A = _COLUMN_FACTS.format(bump="1 = 0", need=4, left_out=7)
COLUMNS_B = _COLUMN_FACTS.format(bump="(l_orderkey + l_partkey % 20) % 13 = 0", need=3, left_out=11)

VERSIONS = """
SELECT DISTINCT concat('cust-', o_custkey) AS dataset, CAST(1 + o_orderkey % 5 AS INT) AS version,
       concat('u', (o_custkey + o_orderkey % 5) % 30) AS created_by
FROM {orders} WHERE o_custkey % 3 <> 0
"""
# Versions of every dataset; VERSIONS leaves some datasets without one.
ALL_VERSIONS = VERSIONS.replace(" WHERE o_custkey % 3 <> 0", "")
DATASETS = """
SELECT concat('cust-', c_custkey) AS dataset, lower(c_name) AS name, c_mktsegment AS feature_id FROM {customer}
"""
USERS = "SELECT concat('u', n_nationkey) AS id, concat(lower(n_name), '@example.org') AS email FROM {nation}"
HEADERS = """
SELECT concat('file-', l_orderkey) AS file, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS pos,
       CASE l_partkey % 6 WHEN 0 THEN ' Name ' WHEN 1 THEN 'NAME' WHEN 2 THEN 'Score' WHEN 3 THEN 'as_of'
            WHEN 4 THEN 'Old' ELSE concat('col', l_partkey % 50) END AS source
FROM {lineitem}
"""
COMMENTS = """
SELECT concat('doc-', user_id) AS row_id, event_id, concat('u', event_id % 5) AS user_id, event_type AS body, ts AS at
FROM {events}
"""

REVIEW_CONTRACT = Contract.of(
    Field("id", "text", "Id", required=True, is_key=True),
    Field("body", "long_text", "Body", required=True),
    Field("lang", "select", "Lang", options=("en", "de", "fr")),
    Field("source", "text", "Source"),
    Field("n_chars", "number", "N chars"),
)
DIRTY_CONTRACT = Contract.of(
    Field("name", "text", "Name", required=True, is_key=True),
    Field("kind", "select", "Kind", options=("click", "view", "signup", "purchase")),
    Field("score", "number", "Score"),
    Field("flagged", "boolean", "Flagged"),
    Field("tags", "multi_select", "Tags", options=("a", "b")),
    Field("as_of", "date", "As of", required=True),
    Field("blob", "json", "Blob"),
)
ORDER_CONTRACT = Contract.of(
    Field("priority", "text", "Priority"), Field("total", "number", "Total"), Field("as_of", "date", "As of")
)
SYNC_CONTRACT = Contract.of(
    Field("row_key", "text", "Row key", required=True, is_key=True),
    Field("segment", "text", "Segment"),
    Field("balance", "number", "Balance"),
)
NESTED_CONTRACT = Contract.of(
    Field("id", "text", "Id", required=True, is_key=True),
    Field("expected.turns", "number", "Turns"),
    Field("expected.flags.long", "boolean", "Long"),
    Field("roles", "multi_select", "Roles", options=("user", "assistant")),
    Field("note", "text", "Note"),
)

_TABLE = re.compile(r"(?<!\{)\{([a-z]+)\}(?!\})")


def plain(sql: str) -> str:
    """The text with plain table names."""
    return _TABLE.sub(r"\1", sql).replace("{{", "{").replace("}}", "}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    names = set(_TABLE.findall(sql))
    return spark.sql(sql, **{n: table(spark, folder, n) for n in names})


def load_spread(spark: SparkSession, folder: str, sql: str, key: str) -> DataFrame:
    """``load`` with the rows dealt out by ``key``, unique in each table that ``sql`` names.

    A row group of a given file is read by one task and may hold a million rows. The raw columns are
    shuffled, so that what is made of them is made by many tasks.
    """
    names = set(_TABLE.findall(sql))
    return spark.sql(sql, **{n: table(spark, folder, n).repartition(key) for n in names})


def _at(seq: Column) -> Column:
    return F.timestamp_micros(seq.cast("bigint"))


def _rows(df: DataFrame, dataset: str, data: Column, row_key: Column, assignee: Column | None = None) -> DataFrame:
    none = F.lit(None)
    deleted = F.col("deleted") if "deleted" in df.columns else F.lit(False)
    return df.select(
        F.col("id") if "id" in df.columns else F.concat(F.lit("row-"), F.col("row_key")).alias("id"),
        F.lit(dataset).alias("dataset"),
        data.alias("data"),
        "status",
        (none.cast("string") if assignee is None else assignee).alias("assignee"),
        row_key.alias("row_key"),
        (F.col("rev").cast("int") if "rev" in df.columns else F.lit(1)).alias("rev"),
        F.lit("loader").alias("updated_by"),
        _at(F.col("created_seq")).alias("created_at"),
        _at(F.col("created_seq")).alias("updated_at"),
        F.when(deleted, _at(F.col("created_seq"))).alias("deleted_at"),
        F.when(deleted, F.lit("loader")).alias("deleted_by"),
    )


def _money(c: str) -> Column:
    return text.number_text(F.col(c))


def review_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, REVIEW)
    data = canon.as_map(
        {
            "id": text.quote(F.col("id")),
            "body": text.quote(F.col("body")),
            "lang": text.quote(F.col("lang")),
            "source": text.quote(F.col("source")),
            "n_chars": F.col("n_chars").cast("string"),
        }
    )
    return _rows(df, "docs", data, F.col("id"), F.col("assignee"))


def order_rows(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """One version's rows: ``(id, status, data, created_at, line, ...)``."""
    df = load(spark, folder, sql).repartition("id")  # the given file is one split; its cells are made by many tasks
    data = canon.as_map(
        {"priority": text.quote(F.col("priority")), "total": _money("total"), "as_of": text.quote(F.col("as_of"))}
    )
    return _rows(df, "orders", data, F.lit(None).cast("string"))


def server_rows(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, SERVER)
    data = canon.as_map(
        {"row_key": text.quote(F.col("row_key")), "segment": text.quote(F.col("segment")), "balance": _money("balance")}
    )
    return _rows(df, "customers", data, F.col("row_key"))


def file_records(spark: SparkSession, folder: str) -> DataFrame:
    """The edited extract: absent, cleared or set segments."""
    df = load(spark, folder, FILE)
    segment = F.when(F.col("seg_op") == "clear", "null").when(F.col("seg_op") == "set", text.quote(F.col("segment")))
    rec = canon.as_map({"row_key": text.quote(F.col("row_key")), "segment": segment, "balance": _money("balance")})
    return df.select("row_idx", rec.alias("rec"), F.lit(None).cast("string").alias("problem"))


def pulled_state(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, PULLED)
    pairs = {"row_key": text.quote(F.col("row_key")), "segment": text.quote(F.col("segment")), "balance": _money("balance")}
    base = canon.row_hash(lambda k: pairs[k], list(pairs))
    return df.select("row_key", F.col("rev").cast("int").alias("rev"), base.alias("base_hash"))


def columns_table(df: DataFrame) -> DataFrame:
    """A columns table from an input with ``option_list``."""
    none = F.lit(None)
    return df.select(
        "dataset",
        "key",
        (F.col("label") if "label" in df.columns else none.cast("string")).alias("label"),
        "type",
        F.split("option_list", ",").alias("options"),
        "required",
        F.col("ord").cast("int").alias("ord"),
        "archived",
        (F.col("json_schema") if "json_schema" in df.columns else none.cast("string")).alias("json_schema"),
        "is_key",
    )


def patch_table(spark: SparkSession, folder: str) -> DataFrame:
    patches = load(spark, folder, PATCHES)
    data = canon.as_map(
        {
            "lang": text.quote(F.col("lang")),
            "n_chars": F.when(F.col("breaks"), '"many"'),
            "source": text.quote(F.col("source")),
        }
    )
    return patches.select(
        "id",
        F.col("seq").cast("bigint").alias("seq"),
        F.col("expected_rev").cast("int").alias("expected_rev"),
        F.when(F.size(data) > 0, data).alias("data"),
        "status",
        "set_assignee",
        "assignee",
    )
