"""Import: mapping, coercion, fixes, key claims, validation, outcome."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.contract import Contract
from rowsmith.functions import canon, checks, coerce, text
from rowsmith.operators.options import with_option_errors
from rowsmith.plans import durable
from rowsmith.plans.fence import fenced
from rowsmith.plans.skew import attach_by_key

# Fixed value: rows shown by a preview.
SAMPLE_SIZE = 20
ROW_COLUMNS = {
    "id": "string",
    "dataset": "string",
    "data": "map<string,string>",
    "status": "string",
    "assignee": "string",
    "row_key": "string",
    "rev": "int",
    "updated_by": "string",
    "created_at": "timestamp",
    "updated_at": "timestamp",
    "deleted_at": "timestamp",
    "deleted_by": "string",
}
Cell = Callable[[str], Column]
CELL = "cell:"


def map_rows(
    src: DataFrame, mapping: dict[str, str], contract: Contract, cell: Cell, structured: bool = False, typed: Cell | None = None
) -> DataFrame:
    """Add one ``cell:<key>`` column of JSON text per mapped key, and ``failures``.

    ``cell`` reads a source column: a raw string, or with ``structured`` a JSON
    text. ``typed`` is what json columns read when it differs.
    """
    known = {f.key for f in contract.fields}
    targets = list(mapping.values())
    for key in targets:
        if key not in known:
            raise ValueError(f"mapping: '{key}' is not a schema column")
        if targets.count(key) > 1:
            raise ValueError(f"mapping: several source columns map to '{key}'")
    raw, strings, trims, values, failures = {}, {}, {}, {}, []
    for source, key in mapping.items():
        type_ = contract.field(key).type
        c, s, t = (F.col(f"`{mark}:{key}`") for mark in ("raw", "string", "trim"))
        from_json = structured and type_ == "json"
        raw[f"raw:{key}"] = typed(source) if from_json and typed is not None else cell(source)
        if structured and type_ in coerce.TRIMMED_TYPES:
            strings[f"string:{key}"] = text.unquote(c)
            trims[f"trim:{key}"] = text.strip(s)
            value, failure = coerce.typed_cell(c, type_, s, t)
        elif structured:
            value, failure = coerce.typed_cell(c, type_)
        elif type_ in coerce.TRIMMED_TYPES:
            trims[f"trim:{key}"] = text.strip(c)
            value, failure = coerce.text_cell(c, type_, t)
        else:
            value, failure = coerce.text_cell(c, type_)
        values[CELL + key] = value
        if type_ == "date" or structured:
            failures.append(checks.error_entry(key, failure))
    # One projection per step: each later step reads the earlier one's columns
    # instead of repeating its expressions.
    staged = src
    for step in (raw, strings, trims, {**values, "failures": checks.collect(failures)}):
        staged = staged.withColumns(step) if step else staged
    return staged.drop(*raw, *strings, *trims)


def mapped_keys(mapped: DataFrame) -> list[str]:
    return [c[len(CELL):] for c in mapped.columns if c.startswith(CELL)]


def mapped_cells(mapped: DataFrame) -> canon.Cells:
    """Read cells of a mapped table; a key that was not mapped is absent.

    Cells are plain columns, not fields of a struct: the optimizer would copy a
    struct field's whole coercion into every rule that reads it.
    """
    present = set(mapped_keys(mapped))

    def cell(key: str) -> Column:
        return F.col(f"`{CELL}{key}`") if key in present else F.lit(None).cast("string")

    return cell


def place(df: DataFrame) -> list[str]:
    """The columns that name a source row: its number, and its file where several were read."""
    return ["file", "row_idx"] if "file" in df.columns else ["row_idx"]


def _same_place(rows: DataFrame, named: DataFrame, what: str) -> list[str]:
    """The place columns by which ``named`` rows meet the source; a folder import needs the file."""
    on = place(rows)
    if any(c not in named.columns for c in on):
        raise ValueError(f"{what} must name the file of each row: the source has several files")
    return on


def apply_fixes(mapped: DataFrame, fixes: DataFrame, contract: Contract) -> DataFrame:
    """``fixes([file,] row_idx, key, value[, seq])`` replace source values and cancel failures.

    Values are JSON texts; a date fix follows the date rules, others are taken as they
    are. Of several fixes of a cell the last by ``seq`` holds; without ``seq`` differing
    ones are an error of that cell, as is a fix of a key the contract does not have.
    """
    on = _same_place(mapped, fixes, "fixes")
    value = F.coalesce("value", F.lit("null"))
    if "seq" in fixes.columns:
        one = fixes.groupBy(*on, "key").agg(F.max_by(value, "seq").alias("value"), F.lit(1).alias("n"))
    else:
        one = fixes.groupBy(*on, "key").agg(F.max(value).alias("value"), F.count_distinct(value).alias("n"))
    known = [f.key for f in contract.fields]
    wrong = F.when(~F.col("key").isin(known), "not a schema column").when(F.col("n") > 1, "several different fixes")
    one = one.withColumn("reason", wrong)
    pair, entry = F.struct("key", "value"), F.struct(F.col("key").alias("column"), "reason")
    per_row = one.groupBy(*on).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("reason").isNull(), pair))).alias("_fix"),
        F.collect_list(F.when(F.col("reason").isNotNull(), entry)).cast(checks.ERRORS_TYPE).alias("_wrong"),
    )
    joined = mapped.join(durable.written(per_row, "fixes"), on, "left")
    cell = mapped_cells(mapped)
    values, failures = {}, []
    for f in contract.fields:
        fix = F.col("_fix").getItem(f.key)
        if f.type == "date":
            fixed, failure = coerce.typed_cell(fix, "date")
            fixed = F.when(fix == "null", fix).otherwise(fixed)
            failures.append(checks.error_entry(f.key, failure))
        else:
            fixed = fix
        values[CELL + f.key] = F.when(fix.isNotNull(), fixed).otherwise(cell(f.key))
    kept = F.when(
        F.col("_fix").isNull(), F.col("failures")
    ).otherwise(F.filter("failures", lambda e: ~F.map_contains_key(F.col("_fix"), e["column"])))
    none = F.array().cast(checks.ERRORS_TYPE)
    found = F.concat(kept, checks.collect(failures), F.coalesce("_wrong", none))
    return joined.withColumns({**values, "failures": found}).drop("_fix", "_wrong")


def claims(rows: DataFrame, claim: str, existing: DataFrame | None) -> DataFrame:
    """Per claimed key: its first row (and file), its row count, whether the dataset has it.

    Partial aggregation shrinks a hot key to one row per task before the shuffle. Of a
    rows table as ``existing`` only live rows count.
    """
    found = rows.filter(F.col(claim).isNotNull()).groupBy(claim).agg(
        F.min(F.struct(*place(rows))).alias("first_at"), F.count("*").alias("claimants")
    )
    if existing is None:
        return found.withColumn("taken", F.lit(False))
    if "deleted_at" in existing.columns:
        existing = existing.filter(F.col("deleted_at").isNull())
    taken = existing.select(F.col("row_key").alias(claim)).filter(F.col(claim).isNotNull()).distinct()
    return found.join(taken.withColumn("_taken", F.lit(True)), claim, "left").withColumn(
        "taken", F.col("_taken").isNotNull()
    ).drop("_taken")


def is_later(rows: DataFrame) -> Column:
    """Behind the first row that claims the same key, in file and row order."""
    return F.struct(*[F.col(c) for c in place(rows)]) > F.col("first_at")


def also_at(rows: DataFrame) -> Column:
    """Where the first claimant is, as reports name it."""
    row = F.concat(F.lit("also row "), F.col("first_at.row_idx").cast("string"))
    if "file" not in rows.columns:
        return row
    other = F.when(F.col("first_at.file") != F.col("file"), F.concat(F.lit(" of "), F.col("first_at.file")))
    return F.concat(row, F.coalesce(other, F.lit("")))


def check_rows(
    mapped: DataFrame, contract: Contract, existing: DataFrame | None = None, skip: DataFrame | None = None,
    options: DataFrame | None = None,
) -> DataFrame:
    """Add ``errors`` and ``outcome`` (created, skipped or errored) to every row.

    ``options(column, option)`` holds the options of fields that keep them in a table.

    Skipped and problem rows claim no key; rows with other errors do. A repeated key is
    reported against its first row - of the first file, where several files are read -
    and not also as existing.

    With a key column the source is read twice: the claim pass only maps the key. Records that
    were parsed, which costs more than a table does, are written first. What the claim pass
    finds - keys that are repeated or taken - comes back to the rows by broadcast when it is
    measured to be small, else by a salted join. Rows are not shuffled then.
    """
    cell = mapped_cells(mapped)
    has_problem = F.col("problem").isNotNull() if "problem" in mapped.columns else F.lit(False)
    if contract.key_field is not None and "problem" in mapped.columns:
        mapped = durable.written(mapped, "mapped")
    rows = mapped
    if skip is not None:
        on = _same_place(mapped, skip, "a skip list")
        marks = durable.written(skip.select(*on).distinct().withColumn("_skip", F.lit(True)), "skip")
        rows = rows.join(marks, on, "left").withColumn("_skip", F.col("_skip").isNotNull())
    else:
        rows = rows.withColumn("_skip", F.lit(False))
    key = contract.key_field
    key_error = F.lit(None).cast("string")
    if key is not None:
        usable = ~F.col("_skip") & ~has_problem & (text.strip(F.col("_key")) != "")
        rows = rows.withColumn("_key", text.unquote(cell(key.key))).withColumn("_claim", F.when(usable, F.col("_key")))
        claimed = fenced(rows.select(*place(rows), "_claim"), ["_claim"])
        facts = claims(claimed, "_claim", existing).filter((F.col("claimants") > 1) | F.col("taken"))
        rows = attach_by_key(rows, facts, "_claim", "claimants", F.col("row_idx"))
        key_error = F.when(
            is_later(rows),
            F.concat(F.lit("duplicate key '"), F.col("_claim"), F.lit("' in file ("), also_at(rows), F.lit(")")),
        ).when(
            F.col("taken"),
            F.concat(F.lit("key '"), F.col("_claim"), F.lit("' already exists — use rows push to update")),
        )
    failed = F.transform("failures", lambda e: e["column"])
    rule_errors = checks.row_errors(cell, contract)
    rule_errors = F.when(F.size("failures") == 0, rule_errors).otherwise(
        F.filter(rule_errors, lambda e: ~F.array_contains(failed, e["column"]))
    )
    none = F.array().cast(checks.ERRORS_TYPE)
    if options is not None:  # among the rules, so that reports keep the contract's order
        checked = F.when(~F.col("_skip") & ~has_problem, F.lit(True))
        rows = rows.withColumns({"errors": rule_errors, "_checked": checked})
        rows = with_option_errors(rows, lambda k: F.when(F.col("_checked"), cell(k)), contract, options, place(rows)).drop("_checked")
        rule_errors = F.col("errors")
    found = F.concat(F.col("failures"), rule_errors)
    if key is not None:
        found = F.concat(found, checks.collect([checks.error_entry(key.key, key_error)]))
    if "problem" in mapped.columns:
        whole = F.array(F.struct(F.lit("").alias("column"), F.col("problem").alias("reason")))
        found = F.when(has_problem, whole.cast(checks.ERRORS_TYPE)).otherwise(found)
    rows = rows.withColumn("errors", F.when(F.col("_skip"), none).otherwise(found))
    outcome = F.when(F.col("_skip"), "skipped").when(F.size("errors") > 0, "errored").otherwise("created")
    return rows.withColumn("outcome", outcome).drop("_skip", "_key", "_claim", "first_at", "claimants", "taken")


def report(df: DataFrame, *keys: str, errors: Column | str = "errors") -> DataFrame:
    """One line per (row, column, reason).

    The outer explode keeps the test for errors above it: as a plain filter it
    would be pushed below and compute every rule a second time.
    """
    source = F.col(errors) if isinstance(errors, str) else errors
    return df.select(*keys, F.explode_outer(source).alias("_e")).filter(F.col("_e").isNotNull()).select(
        *keys, "_e.column", "_e.reason"
    )


def error_report(checked: DataFrame) -> DataFrame:
    return report(checked, *place(checked))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(created, errored) rows of one checked table."""
    return checked.filter(F.col("outcome") == "created"), checked.filter(F.col("outcome") == "errored")


def accounting(checked: DataFrame) -> DataFrame:
    """Every source row is counted in exactly one of created, skipped, errored."""
    return checked.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "errored").alias("errored"),
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("errors"),
    )


def data_of(checked: DataFrame) -> Column:
    cell = mapped_cells(checked)
    return canon.as_map({k: cell(k) for k in mapped_keys(checked)})


def row_id(dataset: str, started: Column, *position: Column) -> Column:
    """A stable id: a retried task gives a row the same id again."""
    digest = F.sha2(F.concat_ws("|", F.lit(dataset), started.cast("string"), *[p.cast("string") for p in position]), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def fixed_time(spark: SparkSession, at: Column) -> Column:
    """``at`` as a literal, taken once: ids and times then agree between all outputs."""
    return F.lit(spark.range(1).select(at.cast("timestamp").cast("string").alias("t")).first().t).cast("timestamp")


def with_position(created: DataFrame) -> DataFrame:
    """Add ``position``, the row's number among all files in file order.

    Files get offsets from one count each; a file may hold any share of the rows.
    """
    if "file" not in created.columns:
        return created.withColumn("position", F.col("row_idx").cast("bigint"))
    counts = created.groupBy("file").agg(F.max("row_idx").alias("last"), F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = counts.select("file", "n", F.coalesce(F.sum("last").over(before), F.lit(0)).alias("_offset"))
    placed = attach_by_key(created, offsets, "file", "n", F.col("row_idx"))
    return placed.withColumn("position", F.col("_offset") + F.col("row_idx")).drop("n", "_offset")


def new_rows(
    created: DataFrame, data: Column, row_key: Column, dataset: str, user: str, started: Column
) -> DataFrame:
    """Draft rows at rev 1; created_at is ``started`` plus the row's position in microseconds."""
    at = started + F.make_dt_interval(secs=F.col("position") / F.lit(1_000_000).cast("decimal(18,6)"))
    return with_position(created).select(
        row_id(dataset, started, *[F.col(c) for c in place(created)]).alias("id"),
        F.lit(dataset).alias("dataset"),
        data.alias("data"),
        F.lit("draft").alias("status"),
        F.lit(None).cast("string").alias("assignee"),
        row_key.alias("row_key"),
        F.lit(1).alias("rev"),
        F.lit(user).alias("updated_by"),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit(None).cast("string").alias("deleted_by"),
    )


def created_rows(checked: DataFrame, contract: Contract, dataset: str, user: str, started: Column) -> DataFrame:
    created, _ = split(checked)
    key = contract.key_field
    cell = mapped_cells(checked)
    row_key = F.lit(None).cast("string") if key is None else text.unquote(cell(key.key))
    return new_rows(created, data_of(checked), row_key, dataset, user, started)


def commit_import(
    checked: DataFrame, contract: Contract, rows: DataFrame, dataset: str, user: str, started: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new rows table, error report, accounting); create-only.

    The checked rows are written once, without their source columns, so the outputs
    agree with each other and a lost executor never re-reads the source.
    """
    names = [*place(checked), *[CELL + k for k in mapped_keys(checked)], "errors", "outcome"]
    done = durable.written(checked.select(*[F.col(f"`{n}`") for n in names]), "import")
    created = created_rows(done, contract, dataset, user, fixed_time(checked.sparkSession, started))
    return rows.unionByName(created), error_report(done), accounting(done)


@dataclass
class Preview:
    """What a preview shows of a source."""

    mapping: DataFrame
    sample: DataFrame
    errors: DataFrame
    counts: DataFrame


def preview(
    source: DataFrame, header: list[str], contract: Contract, cell: Cell, structured: bool = False,
    existing: DataFrame | None = None, limit: int = SAMPLE_SIZE,
) -> Preview:
    """A dry import: the suggested mapping, the first rows typed, all errors, the counts.

    ``header`` names the source columns in file order; ``cell`` reads one of them. The
    sample holds the first ``limit`` rows as JSON texts of their mapped cells, with the
    problem of a row that could not be read.
    """
    from rowsmith.operators.contracts import suggest_mapping

    spark = source.sparkSession
    names = spark.createDataFrame([("", i, h) for i, h in enumerate(header)], "file string, pos int, source string")
    mapping = suggest_mapping(names, contract.to_columns(spark, "")).select("source", "key")
    chosen = {r.source: r.key for r in mapping.collect()}  # at most one entry a contract column
    checked = check_rows(map_rows(source, chosen, contract, cell, structured), contract, existing)
    problem = F.col("problem") if "problem" in checked.columns else F.lit(None).cast("string")
    keys = sorted(mapped_keys(checked))
    cells = canon.object_text(mapped_cells(checked), keys) if keys else F.lit("{}")
    first = checked.orderBy(*place(checked)).limit(limit)
    sample = first.select(*place(checked), problem.alias("problem"), cells.alias("cells"), "outcome")
    return Preview(mapping, sample, error_report(checked), accounting(checked))


def preview_sample(src: DataFrame, columns: list[str], limit: int = SAMPLE_SIZE) -> DataFrame:
    """The first source rows in file order."""
    return src.select(*place(src), *columns).orderBy(*place(src)).limit(limit)


def carry_skip(handled: DataFrame, skip: DataFrame) -> DataFrame:
    """Rows imported or skipped in earlier rounds join the next skip list."""
    on = _same_place(handled, skip, "a skip list")
    return handled.select(*on).union(skip.select(*on)).distinct()
