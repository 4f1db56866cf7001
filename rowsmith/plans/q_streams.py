"""Registered queries: the two streaming jobs, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.plans import durable, inputs
from rowsmith.plans.inputs import load, plain
from rowsmith.plans.q_import import LINE_CONTRACT
from rowsmith.plans.q_sources import _KIND, BAD, _block_of, _files
from rowsmith.plans.q_versions import R, folder_for
from rowsmith.plans.registry import query
from rowsmith.streaming import imports, patches

@query(
    "t01_stream_import",
    f"""WITH {BAD}, k AS (SELECT line, CASE WHEN {_KIND} IS NOT NULL THEN '' WHEN line NOT LIKE '%"props"%' THEN 'props' END AS "column",
     CASE WHEN {_KIND} IS NOT NULL THEN {_KIND} WHEN line NOT LIKE '%"props"%' THEN 'required' END AS reason FROM b)
    SELECT line, "column", reason FROM k""",
)
def stream_import(spark: SparkSession, d: str) -> DataFrame:
    """Valid rows have no reason; quarantined lines name theirs."""
    source = _files(load(spark, d, inputs.BAD), folder_for(spark, "stream-in"))
    good, bad, state = (folder_for(spark, n) for n in ("stream-good", "stream-bad", "stream-state"))
    imports.start_import(spark, f"{source}/*", LINE_CONTRACT, good, bad, state, {"availableNow": True}).awaitTermination()
    none = F.lit(None).cast("string")
    valid = spark.read.parquet(good).select("line", none.alias("column"), none.alias("reason"))
    return valid.unionByName(spark.read.parquet(bad).select("line", "column", "reason"))


PER_STREAMED_FILE = 2_000
# A third of all lines has one key; of the others two share theirs, half of all files apart.
_KEY = "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE concat('k-', event_id % (1 + last // 2)) END"


@query(
    "t01_stream_claims",
    f"""WITH l AS (SELECT max(event_id) AS last FROM events), e AS (SELECT event_id // {PER_STREAMED_FILE} AS block, CAST(1 + event_id % {PER_STREAMED_FILE} AS BIGINT) AS line_number, {_KEY} AS key FROM events, l),
     h AS (SELECT *, block % 2 AS half, concat('block=', block) AS file FROM e),
     f AS (SELECT *, row_number() OVER w AS nth, first_value(file) OVER w AS first_file, first_value(line_number) OVER w AS first_line FROM h WINDOW w AS (PARTITION BY key ORDER BY half, file, line_number)),
     x AS (SELECT concat('k-', event_id) AS key FROM events WHERE event_id % 7 = 0)
     SELECT f.block, f.line_number, CASE WHEN nth > 1 THEN concat('duplicate key ''', f.key, ''' in file (also row ', first_line, CASE WHEN first_file <> file THEN concat(' of ', first_file) ELSE '' END, ')')
       WHEN x.key IS NOT NULL THEN concat('key ''', f.key, ''' already exists — use rows push to update') END AS reason
     FROM f LEFT JOIN x ON f.key = x.key""",
)
def stream_claims(spark: SparkSession, d: str) -> DataFrame:
    """Keys claimed over two runs of the import: files of even blocks come first, those of odd ones after a restart."""
    contract = Contract.of(Field("key", "text", required=True, is_key=True))
    source, good, bad, state = (folder_for(spark, n) for n in ("claims-in", "claims-good", "claims-bad", "claims-state"))
    events = load(spark, d, "SELECT event_id FROM {events}")
    n = F.col("event_id")
    last = events.agg(F.max(n)).first()[0] or 0
    key = F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("k-"), n % (1 + last // 2)))
    placed = events.select(F.floor(n / PER_STREAMED_FILE).alias("block"), n.alias("at"), F.to_json(F.struct(key.alias("key"))).alias("line"))
    taken = events.filter(n % 7 == 0).select(F.concat(F.lit("k-"), n).alias("row_key"))
    for half in (0, 1):
        part = placed.filter(F.col("block") % 2 == half).repartition("block").sortWithinPartitions("block", "at")
        part.select("block", "line").write.mode("append").partitionBy("block").text(source)
        imports.start_import(spark, f"{source}/*", contract, good, bad, state, {"availableNow": True}, taken).awaitTermination()
    valid = spark.read.parquet(good).select("file", "line_number", F.lit(None).cast("string").alias("reason"))
    rows = valid.unionByName(spark.read.parquet(bad).select("file", "line_number", "reason"))
    named = F.regexp_replace("reason", r" of [^)]*/(block=[0-9]+)/[^)]*\)", r" of $1)")
    return rows.select(_block_of().alias("block"), "line_number", named.alias("reason"))


@query(
    "t02_stream_patches",
    f"""WITH {R}, p AS ({plain(inputs.STREAM)}) SELECT p.id, CAST(p.seq AS BIGINT) AS seq, r.id IS NOT NULL AND NOT r.deleted AND p.k % 4 <> 0 AS accepted FROM p LEFT JOIN r ON p.id = r.id""",
)
def stream_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches that arrive in two micro-batches, with the revs kept in the state store in between."""
    source, sink, progress = (folder_for(spark, n) for n in ("patch-in", "patch-out", "patch-progress"))
    batch = load(spark, d, inputs.STREAM).select(
        "id", F.col("seq").cast("bigint").alias("seq"), F.col("expected_rev").cast("int").alias("expected_rev"), "status"
    )
    batch = durable.written(batch, "stream-patches")
    middle = batch.agg(F.max("seq")).first()[0] // 2
    rows = inputs.review_rows(spark, d).filter(F.col("deleted_at").isNull()).select("id", "rev")
    rows = durable.written(rows, "stream-rows")
    for half in (F.col("seq") <= middle, F.col("seq") > middle):
        batch.filter(half).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch.schema).parquet(source)
        patches.start_patches(stream, rows, sink, progress, {"availableNow": True}).awaitTermination()
    return spark.read.parquet(sink).select("id", "seq", "accepted")
