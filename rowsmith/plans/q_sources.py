"""Registered queries: file scans, record location, inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions import text
from rowsmith.operators import contracts
from rowsmith.operators import records as record_ops
from rowsmith.plans import inputs
from rowsmith.plans.inputs import load, plain
from rowsmith.plans.q_cells import N, nested_flat
from rowsmith.plans.q_versions import folder_for
from rowsmith.plans.registry import query
from rowsmith.sources import readers

BAD = f"b AS ({plain(inputs.BAD)})"
_KIND = (
    "CASE WHEN NOT json_valid(line) THEN 'invalid JSON' WHEN json_type(line) <> 'OBJECT' THEN 'record is not an object' "
    "WHEN len(json_keys(line)) <> len(list_distinct(json_keys(line))) THEN 'duplicate key ''id''' END"
)
PER_FILE = 5_000  # records per written source file


def _files(df: DataFrame, path: str, number: str = "row_idx", suffix: str = "txt") -> str:
    """Write ``line`` as text, one file per block of ``PER_FILE`` numbers, in order."""
    block = F.floor((F.col(number) - 1) / F.lit(PER_FILE)).cast("bigint")
    placed = df.withColumn("block", block).repartition("block").sortWithinPartitions("block", number)
    placed.select("block", "line").write.partitionBy("block").option("lineSep", "\n").text(path)
    return path


def _block_of(file: str = "file"):
    return F.regexp_extract(F.col(file), r"block=([0-9]+)", 1).cast("bigint")


@query("s01_csv_scan", f"WITH d AS ({plain(inputs.DIRTY)}) SELECT name, kind, score, flagged, tags, as_of, blob FROM d")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    path = folder_for(spark, "csv")
    names = ["name", "kind", "score", "flagged", "tags", "as_of", "blob"]
    source = load(spark, d, inputs.DIRTY).select(*names)
    source.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    header, rows = readers.read_csv(spark, path)
    return rows.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(header)])


_LINED = r"""SELECT CAST(doc_id AS STRING) AS doc, source, replace(text, '. ', concat('.', chr(10), '"', chr(10), '",')) AS body FROM {documents}"""


@query("s01_csv_quoted_lines", f"WITH d AS ({plain(_LINED)}) SELECT doc, coalesce(source, '') AS source, coalesce(body, '') AS body FROM d")
def csv_quoted_lines(spark, d):
    path = folder_for(spark, "csv-lines")
    load(spark, d, _LINED).write.options(header=True, escape='"', quoteAll=True, nullValue="").option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    header, rows = readers.read_csv(spark, path, multi_line=True)
    return rows.select(*[F.col(f"_c{i}").alias(name) for i, name in enumerate(header)])


@query("s02_jsonl_scan", f"WITH {BAD} SELECT (row_idx - 1) // {PER_FILE} AS block, 1 + (row_idx - 1) % {PER_FILE} AS row_idx, line, {_KIND} AS problem FROM b")
def jsonl_scan(spark, d):
    path = _files(load(spark, d, inputs.BAD), folder_for(spark, "jsonl"))
    read = readers.read_jsonl(spark, path)
    return read.select(
        _block_of().alias("block"), "row_idx", "line", F.regexp_replace("problem", r"\Aline [0-9]+: ", "").alias("problem")
    )


def _documents(spark, d) -> DataFrame:
    """One JSON document per block of records: an object with one list of objects."""
    lines = load(spark, d, inputs.NESTED).withColumn("block", F.floor((F.col("row_idx") - 1) / 50))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), ",\n")
    return lines.groupBy("block").agg(F.concat(F.lit('{"suite":"s","records":[\n'), body, F.lit("]}")).alias("line"))


_DOC_ROWS = f"WITH {N} SELECT (row_idx - 1) // 50 AS block, 1 + (row_idx - 1) % 50 AS row_idx, "


@query("s03_json_documents", _DOC_ROWS + "line->>'$.id' AS id, (line->'$.expected'->>'$.turns')::BIGINT AS turns FROM n")
def json_documents(spark, d):
    path = folder_for(spark, "json-docs")
    _documents(spark, d).repartition("block").write.partitionBy("block").text(path)
    found = record_ops.locate_records(readers.read_json_docs(spark, path))
    parsed = F.from_json("line", "id string, expected struct<turns bigint>")
    return found.select(_block_of().alias("block"), "row_idx", parsed.alias("r")).select(
        "block", "row_idx", "r.id", F.col("r.expected.turns").alias("turns")
    )


@query(
    "s05_locate_records",
    """SELECT concat('file-', o_orderkey) AS file, CASE o_orderkey % 6 WHEN 1 THEN 'rows' WHEN 2 THEN 'items' END AS chosen,
     CASE o_orderkey % 6 WHEN 1 THEN 'manifest,other' WHEN 2 THEN 'meta,names' END AS ignored,
     CASE o_orderkey % 6 WHEN 3 THEN 'can''t tell which key holds the records — choose a records_key (lists found: a, b)'
       WHEN 4 THEN 'can''t tell which key holds the records — choose a records_key' WHEN 5 THEN 'expected a list of records, or an object containing one' END AS problem,
     CASE o_orderkey % 6 WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n_records, CASE o_orderkey % 6 WHEN 0 THEN 3 ELSE 0 END AS n_refused FROM orders""",
)
def locate(spark, d):
    docs = load(spark, d, inputs.DOCS).withColumn("problem", F.lit(None).cast("string"))
    located = record_ops.record_list(docs).select("file", "chosen", F.array_join("ignored", ",").alias("ignored"), "problem")
    counts = record_ops.locate_records(docs).groupBy("file").agg(
        F.count_if(F.col("row_idx") > 0).cast("int").alias("n_records"),
        F.count_if(F.col("problem") == "record is not an object").cast("int").alias("n_refused"),
    )
    return located.join(counts, "file").select("file", "chosen", "ignored", "problem", "n_records", "n_refused")


_EXPORTED = """SELECT concat('f', event_id // 200) AS file, 1 + event_id % 200 AS row_idx,
 CASE WHEN (event_id // 200) % 3 = 1 AND event_id % 200 = 7 THEN concat('{{"id":"e-', event_id, '","x":1}}')
 WHEN (event_id // 200) % 3 = 2 AND event_id % 200 = 7 THEN concat('{{"id":"e-', event_id, '","status":"draft","data":"{{oops"}}')
 ELSE concat('{{"id":"e-', event_id, '","status":"draft","data":', props, '}}') END AS line, props FROM {events}"""


def _exported(spark, d) -> DataFrame:
    sql = _EXPORTED.replace("event_id // 200", "event_id div 200")
    return readers.check_lines(load(spark, d, sql), F.col("line"), F.col("row_idx"))


@query("s06_unwrap_lines", f"WITH e AS ({plain(_EXPORTED)}) SELECT file, row_idx, CASE WHEN substr(file, 2)::BIGINT % 3 = 0 THEN (line->'$.data')::VARCHAR ELSE line END AS line FROM e")
def unwrap(spark, d):
    return record_ops.unwrap_lines(_exported(spark, d)).select("file", "row_idx", "line")


@query("g10_all_export_lines", f"WITH e AS ({plain(_EXPORTED)}) SELECT file, count(*) AS records, substr(file, 2)::BIGINT % 3 = 0 AS all_lines FROM e GROUP BY file")
def all_export_lines(spark, d):
    return record_ops.export_files(_exported(spark, d))


def _checked_bad(spark, d) -> DataFrame:
    return readers.check_lines(inputs.load_spread(spark, d, inputs.BAD, "event_id"), F.col("line"), F.col("row_idx"))


@query("s07_duplicate_keys", f"WITH {BAD} SELECT row_idx, {_KIND} AS problem FROM b WHERE {_KIND} LIKE 'duplicate key%'")
def duplicate_keys(spark, d):
    return _checked_bad(spark, d).select("row_idx", "problem").filter(F.col("problem").startswith("duplicate key"))


@query("s08_non_objects", f"WITH {BAD} SELECT row_idx, line FROM b WHERE {_KIND} = 'record is not an object'")
def non_objects(spark, d):
    return _checked_bad(spark, d).filter(F.col("problem") == "record is not an object").select("row_idx", "line")


@query("s09_record_numbers", f"SELECT concat('event ', event_id) AS line, event_id // {PER_FILE} AS block, 1 + event_id % {PER_FILE} AS row_idx FROM events")
def record_numbers(spark, d):
    from rowsmith.sources.numbering import file_columns, with_row_idx

    events = load(spark, d, "SELECT event_id + 1 AS row_idx, concat('event ', event_id) AS line FROM {events}")
    path = _files(events, folder_for(spark, "numbers"))
    scan = spark.read.text(path).select(F.col("value").alias("line"), *file_columns())
    return with_row_idx(scan).select("line", _block_of().alias("block"), "row_idx")


@query("s10_header_discovery", f"WITH {N}, m AS (SELECT min(row_idx) AS first_row FROM n) SELECT u.path, m.first_row, CAST(u.position AS BIGINT) AS position FROM m, (VALUES ('id', 0), ('expected.turns', 1), ('expected.flags.long', 2), ('roles', 3), ('note', 4)) AS u(path, position)")
def header_discovery(spark, d):
    return record_ops.discover_paths(nested_flat(spark, d))


@query("s11_file_gates", f"""WITH {BAD}, f AS (SELECT (row_idx - 1) // {PER_FILE} AS block, CAST(sum(strlen(line) + 1) AS BIGINT) AS length FROM b GROUP BY 1)
 SELECT block, length, CASE WHEN length > 100000 THEN 'file is larger than 100000 bytes' END AS reason FROM f""")
def file_gates(spark, d):
    path = _files(load(spark, d, inputs.BAD), folder_for(spark, "gates"))
    gates = readers.gate_files(spark, f"{path}/*/*.txt", max_bytes=100_000)
    return gates.select(_block_of().alias("block"), "length", "reason")


# --- Inference ----------------------------------------------------------

_INFERRED = f"""WITH {N}, c AS (SELECT count(*) AS n, count(CASE WHEN (row_idx - 1) % 3 <> 0 THEN 1 END) AS notes FROM n)
 SELECT u.path, u.label, u.type, CASE WHEN u.path = 'note' THEN c.notes ELSE c.n END AS n_values FROM c, (VALUES ('id', 'Id', 'text'),
 ('expected.turns', 'Turns', 'number'), ('expected.flags.long', 'Long', 'boolean'), ('roles', 'Roles', 'multi_select'), ('note', 'Note', 'text')) AS u(path, label, type)"""


@query("c01_infer_types", _INFERRED)
def infer_types(spark, d):
    return contracts.infer_types(nested_flat(spark, d)).select("path", "label", "type", "n_values")


_TV = f"t AS ({plain(inputs.TYPED)})"


def _typed_flat(spark, d) -> DataFrame:
    typed = load(spark, d, inputs.TYPED)
    name = F.concat(F.lit("p"), (F.col("row_idx") - 1) % 9, F.lit(".some_value"))
    return typed.select("row_idx", F.create_map(name, F.col("v")).alias("rec"))


@query("g07_type_lattice", f"""WITH {_TV} SELECT concat('p', (row_idx - 1) % 9, '.some_value') AS path, count(*) AS n_values,
 CASE (row_idx - 1) % 9 WHEN 3 THEN 'boolean' WHEN 4 THEN 'text' WHEN 5 THEN 'multi_select' WHEN 6 THEN 'json' WHEN 8 THEN 'date' ELSE 'number' END AS type,
 'Some value' AS label FROM t GROUP BY (row_idx - 1) % 9""")
def type_lattice(spark, d):
    return contracts.infer_types(_typed_flat(spark, d)).select("path", "n_values", "type", "label")


@query("c02_infer_options", f"""WITH c AS (SELECT conv_id, turn, role FROM conversations), p AS (SELECT concat('r', conv_id % 7) AS path, role FROM c)
 SELECT DISTINCT path, role AS option FROM p""")
def infer_options(spark, d):
    turns = inputs.table(spark, d, "conversations")
    path = F.concat(F.lit("r"), F.col("conv_id") % 7)
    flat = turns.select(F.col("conv_id").alias("row_idx"), F.create_map(path, text.array_text(F.array("role"))).alias("rec"))
    return contracts.infer_options(flat)


@query("g06_distinct_options", "SELECT concat('lang', doc_id % 3) AS path, source AS option FROM documents GROUP BY ALL")
def distinct_options(spark, d):
    docs = inputs.table(spark, d, "documents")
    path = F.concat(F.lit("lang"), F.col("doc_id") % 3)
    flat = docs.select(F.col("doc_id").alias("row_idx"), F.create_map(path, text.array_text(F.array("source"))).alias("rec"))
    return contracts.infer_options(flat)


@query("c03_key_candidates", f"""WITH {N}, v AS (SELECT 'id' AS path, (line->'$.id')::VARCHAR AS x FROM n UNION ALL SELECT 'note', (line->'$.note')::VARCHAR FROM n
 UNION ALL SELECT 'roles', (line->'$.roles')::VARCHAR FROM n UNION ALL SELECT 'expected.turns', (line->'$.expected'->'$.turns')::VARCHAR FROM n
 UNION ALL SELECT 'expected.flags.long', (line->'$.expected'->'$.flags'->'$.long')::VARCHAR FROM n)
 SELECT path, count(*) AS present, count(DISTINCT x) AS distinct_values, path = 'id' AS usable FROM v WHERE x <> 'null' GROUP BY path""")
def key_candidates(spark, d):
    return contracts.key_candidates(nested_flat(spark, d))


_PATH = "concat(lower(p_type), '.', lower(replace(p_brand, '#', '-_')), '__x')"


@query("c04_label", f"""SELECT p_partkey, upper(substr(w, 1, 1)) || substr(w, 2) AS label FROM
 (SELECT p_partkey, regexp_replace(concat(lower(replace(p_brand, '#', '-_')), '__x'), '[_-]+', ' ', 'g') AS w FROM part)""")
def label(spark, d):
    return load(spark, d, f"SELECT p_partkey, {_PATH} AS path FROM {{part}}").select(
        "p_partkey", contracts.label_of(F.col("path")).alias("label")
    )


@query("f10_usable_keys", f"WITH {BAD} SELECT row_idx, line->>'$.id' AS row_key FROM b WHERE {_KIND} IS NULL")
def usable_keys(spark, d):
    return record_ops.usable_keys(_checked_bad(spark, d), "id")


@query("u02_unknown_paths", f"WITH {N}, m AS (SELECT min(row_idx) AS r FROM n) SELECT u.path FROM m, (VALUES ('roles'), ('note')) AS u(path) WHERE m.r > 0")
def unknown_paths(spark, d):
    known = ["id", "expected.turns", "expected.flags.long"]
    return record_ops.unknown_paths(nested_flat(spark, d), known).select("path")
