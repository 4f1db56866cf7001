"""Continuous import: JSON Lines files dropped in a folder, checked as they arrive.

The outcomes are those of one batch import of the same files in the order in which they arrived: a
key belongs to its first row, in an earlier micro-batch or a later one, before a restart or after.
Who holds a key is kept by a streaming aggregate in the session's state store, one value a key; a
micro-batch reads and writes the state of the keys that it brings and of no others.
``spark.sql.streaming.stateStore.providerClass`` set to RocksDB keeps it on disk for many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowsmith.contract import Contract
from rowsmith.functions import checks, records, text
from rowsmith.operators.importing import also_at, data_of, map_rows, mapped_cells
from rowsmith.operators.records import known_cell, known_cells
from rowsmith.plans import durable
from rowsmith.plans.skew import attach_by_key
from rowsmith.sources.numbering import with_row_idx
from rowsmith.sources.readers import BOM_AT_START

CLAIMS = "_batch bigint, file string, row_idx bigint, _claim string"


def _checked(lines: DataFrame, contract: Contract) -> DataFrame:
    """``check_stream`` with ``_claim``, the key that a row without a problem claims."""
    kept = lines.filter(text.strip(F.col("line")) != "")
    marked = kept.withColumn("problem", records.line_problem(F.col("line"), F.lit(0)))
    mapping = {k: k for k in contract.active_keys}
    mapped = map_rows(known_cells(marked, contract), mapping, contract, known_cell, structured=True)
    cell, key = mapped_cells(mapped), contract.key_field
    failed = F.transform("failures", lambda e: e["column"])
    rules = F.filter(checks.row_errors(cell, contract), lambda e: ~F.array_contains(failed, e["column"]))
    problem = F.regexp_replace("problem", r"\Aline 0: ", "")
    whole = F.array(F.struct(F.lit("").alias("column"), problem.alias("reason"))).cast(checks.ERRORS_TYPE)
    errors = F.when(F.col("problem").isNotNull(), whole).otherwise(F.concat("failures", rules))
    value = F.lit(None).cast("string") if key is None else text.unquote(cell(key.key))
    claim = F.when(F.col("problem").isNull() & (text.strip(value) != ""), value)
    return mapped.select(*lines.columns, data_of(mapped).alias("data"), errors.alias("errors"), claim.alias("_claim"))


def check_stream(lines: DataFrame, contract: Contract) -> DataFrame:
    """``lines(line, ...)`` to ``(..., line, data, errors)``; stateless, so it runs on any stream."""
    return _checked(lines, contract).drop("_claim")


def hold_keys(spark: SparkSession, work: str, batch_id: int) -> DataFrame:
    """``(_claim, first_at, taken, claimants)`` of the keys of micro-batch ``batch_id`` that are not its own alone.

    Runs the aggregate over the claims that lie in ``work`` and were not counted yet. A micro-batch that is tried
    again finds its claims counted, and their outcome where the first try has written it.
    """
    claims = spark.readStream.schema(CLAIMS).parquet(f"{work}/checked/*").filter(F.col("_claim").isNotNull())
    held = claims.groupBy("_claim").agg(
        F.min(F.when(F.col("_batch") >= 0, F.struct("_batch", "file", "row_idx"))).alias("first_at"),
        F.max(F.col("_batch") < 0).alias("taken"),
        F.max("_batch").alias("last"),
        F.count("*").alias("claimants"),
    )
    found = f"{work}/held/{batch_id}"

    def keep(facts: DataFrame, _: int) -> None:
        shared = (F.col("last") >= 0) & ((F.col("claimants") > 1) | F.col("taken"))
        facts.filter(shared).drop("last").write.mode("overwrite").parquet(found)

    run = held.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{work}/keys")
    run.trigger(availableNow=True).start().awaitTermination()
    place = "struct<_batch:bigint,file:string,row_idx:bigint>"
    return spark.read.schema(f"_claim string, first_at {place}, taken boolean, claimants bigint").parquet(found)


def key_error(rows: DataFrame) -> Column:
    """Why a row does not get its key, from the facts of ``hold_keys``."""
    later = F.struct("_batch", "file", "row_idx") > F.col("first_at")
    repeated = F.concat(F.lit("duplicate key '"), F.col("_claim"), F.lit("' in file ("), also_at(rows), F.lit(")"))
    taken = F.concat(F.lit("key '"), F.col("_claim"), F.lit("' already exists — use rows push to update"))
    return F.when(later, repeated).when(F.col("taken"), taken)


def start_import(
    spark: SparkSession, folder: str, contract: Contract, good: str, quarantine: str, checkpoint: str,
    trigger: dict | None = None, existing: DataFrame | None = None, files_per_batch: int | None = None,
) -> StreamingQuery:
    """Valid rows and quarantined lines in two Parquet tables.

    Each micro-batch is one sub-folder per table, overwritten when a batch is retried, so
    both tables hold every line exactly once. Both keep the file a line came from and its
    number among the lines of that file. ``trigger`` is what ``DataStreamWriter.trigger``
    takes; by default the import runs on. Keys of live rows of ``existing`` are taken; it is
    read once, when the import first starts. What a micro-batch needs besides its outputs
    lies under ``checkpoint`` and is deleted when the next one starts.
    """
    work, key = f"{checkpoint.rstrip('/')}/import", contract.key_field
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start")]
    source = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    lines = source.text(folder).select(F.col("value").alias("line"), *place)
    if key is not None and existing is not None and not durable.exists(spark, f"{work}/checked/existing/_SUCCESS"):
        live = existing.filter(F.col("deleted_at").isNull()) if "deleted_at" in existing.columns else existing
        none = [F.lit(-1).cast("bigint").alias("_batch"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("row_idx")]
        live.select(*none, F.col("row_key").alias("_claim")).write.mode("overwrite").parquet(f"{work}/checked/existing")

    def check(batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch's checked lines, written once: the claims of a batch must not change once they are counted."""
        path = f"{work}/checked/{batch_id}"
        if not durable.exists(spark, f"{path}/_SUCCESS"):
            scan = batch.withColumn("_at", F.monotonically_increasing_id())
            numbered = with_row_idx(scan, keep=text.strip(F.col("line")) != "", line_number="line_number")
            unmarked = F.when(F.col("line_number") == 1, F.regexp_replace("line", BOM_AT_START, "")).otherwise(F.col("line"))
            checked = _checked(numbered.withColumn("line", unmarked), contract)
            checked.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        for name in ("checked", "held"):
            durable.delete(spark, f"{work}/{name}/{batch_id - 1}")
        with durable.scope(spark):
            rows = check(batch, batch_id)
            if key is not None:
                rows = attach_by_key(rows, hold_keys(spark, work, batch_id), "_claim", "claimants", F.col("row_idx"))
                errors = F.concat("errors", checks.collect([checks.error_entry(key.key, key_error(rows))])).alias("errors")
                # Both tables read these rows: they meet their keys once.
                rows = durable.written(rows.select("file", "line_number", "line", "data", errors), "judged-lines")
            valid = rows.filter(F.size("errors") == 0).select("file", "line_number", "line", "data")
            valid.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
            bad = rows.filter(F.size("errors") > 0).select("file", "line_number", "line", F.explode("errors").alias("_e"))
            bad.select("file", "line_number", "line", "_e.column", "_e.reason").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
