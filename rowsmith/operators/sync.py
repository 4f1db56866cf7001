"""Merging an edited extract back by key, with three-way conflict detection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.contract import Contract
from rowsmith.functions import canon, checks, text
from rowsmith.operators.importing import also_at, claims, fixed_time, is_later, map_rows, mapped_cells, new_rows, place
from rowsmith.operators.records import known_cell
from rowsmith.operators.rows import live
from rowsmith.plans import durable
from rowsmith.plans.skew import attach_by_key

FIELDS_TYPE = "array<struct<field:string,before:string,after:string>>"
UNKNOWN_COLUMN = "the contract has no column with this path (correct it, or pass ignore_unknown)"
IGNORED = "ignored: the contract has no column with this path"
NEVER_PULLED = "exists in the dataset; pull the rows first or use force"


@dataclass
class SyncResult:
    rows: DataFrame
    edits: DataFrame
    state: DataFrame
    applied: bool


def read_records(source: DataFrame, contract: Contract, paths: list[str] | None = None) -> DataFrame:
    """``source(row_idx, rec, problem)`` to keyed records.

    A source read with ``records.known_cells`` needs no ``rec``.

    Adds ``row_key``, ``cells``, ``cleared`` (explicit nulls), ``failures`` and
    ``reason``: a problem record, a missing key, or a key an earlier record has.
    Records are written once, as claims are found in a first pass over them.
    """
    key = contract.key_field
    if key is None:
        raise ValueError("dataset has no key column; mark one in the schema first")
    wanted = [k for k in contract.active_keys if paths is None or k in paths]
    sent = (lambda k: F.col("rec")[k]) if "rec" in source.columns else known_cell
    mapped = map_rows(source, {k: k for k in wanted}, contract, sent, structured=True)
    cell = mapped_cells(mapped)
    cleared = F.array_compact(F.array(*[F.when(sent(k) == "null", F.lit(k)) for k in wanted]))
    usable = F.col("problem").isNull() & (text.strip(F.col("_key")) != "")
    named = mapped.withColumns({"_key": text.unquote(cell(key.key)), "cleared": cleared, "unknown": _unknown_of(source, contract)})
    keyed = durable.written(named.withColumn("row_key", F.when(usable, F.col("_key"))).drop("_key"), "records")
    first = claims(keyed, "row_key", None).filter(F.col("claimants") > 1)
    joined = attach_by_key(keyed, first, "row_key", "claimants", F.col("row_idx"))
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("row_key").isNull(), "missing key value")
        .when(
            is_later(joined),
            F.concat(F.lit("duplicate key in file ("), also_at(joined), F.lit(")")),
        )
    )
    return joined.withColumn("reason", reason).drop("first_at", "claimants", "taken")


def _unknown_of(source: DataFrame, contract: Contract) -> Column:
    """The paths of a record that the contract does not know, in source order."""
    if "unknown" in source.columns:
        return F.coalesce("unknown", F.array().cast("array<string>"))
    there = F.col("paths") if "paths" in source.columns else F.map_keys("rec")
    return F.coalesce(F.filter(there, lambda p: ~p.isin(contract.active_keys)), F.array().cast("array<string>"))


def plan_sync(
    source: DataFrame,
    rows: DataFrame,
    state: DataFrame,
    contract: Contract,
    force: bool = False,
    paths: list[str] | None = None,
    ignore_unknown: bool = False,
) -> DataFrame:
    """One row per file record with its ``op``.

    A path of the file that the contract does not know is an error of every record that
    has it, and so blocks the sync; with ``ignore_unknown`` it is listed in ``ignored``.

    ``op`` is create, update, unchanged, server_newer, conflict, deleted (pulled,
    then deleted on the server) or error. ``fields`` lists what differs and
    ``errors`` what blocks the sync. Live rows, pull state and deleted keys meet
    the file on the key, all shuffled by it once.
    """
    records = read_records(source, contract, paths)
    # Refused records match nothing: a throw-away key each keeps them spread.
    own = F.when(F.col("reason").isNull(), F.col("row_key"))
    spot = F.concat_ws("|", *[F.col(c).cast("string") for c in place(records)])
    records = records.withColumn("_join", F.coalesce(own, F.concat(F.lit("\u0000"), spot)))
    keyed = F.col("row_key").isNotNull()
    current = live(rows).filter(keyed).select(
        F.col("row_key").alias("_join"),
        F.col("id").alias("row_id"),
        F.col("rev").alias("server_rev"),
        F.col("status").alias("server_status"),
        F.col("data").alias("server_data"),
    )
    pulled = state.select(
        F.col("row_key").alias("_join"), F.col("rev").alias("your_rev"), F.col("base_hash").alias("your_base")
    )
    gone = rows.filter(F.col("deleted_at").isNotNull() & keyed).select(F.col("row_key").alias("_join")).distinct()
    joined = (
        records.join(current, "_join", "left")
        .join(pulled, "_join", "left")
        .join(gone.withColumn("_gone", F.lit(True)), "_join", "left")
    )

    keys = contract.active_keys
    sent_cell = mapped_cells(joined)
    server = F.col("server_data")
    exists = F.col("server_rev").isNotNull()
    staged = joined.withColumns(
        {f"old:{k}": canon.absent(server[k]) for k in keys}
        | {f"sent:{k}": F.coalesce(sent_cell(k), F.when(F.array_contains("cleared", k), "null")) for k in keys}
        | {"_sent_hash": canon.row_hash(sent_cell, keys)}
    )
    old, sent = (lambda k: F.col(f"`old:{k}`")), (lambda k: F.col(f"`sent:{k}`"))
    staged = staged.withColumns({f"new:{k}": canon.absent(F.coalesce(sent(k), old(k))) for k in keys})

    def merged(k: str) -> Column:
        return F.col(f"`new:{k}`")

    differing = [
        F.when(
            sent(k).isNotNull() & ~old(k).eqNullSafe(merged(k)),
            F.struct(F.lit(k).alias("field"), old(k).alias("before"), merged(k).alias("after")),
        )
        for k in sorted(keys)
    ]
    fields = F.array_compact(F.array(*differing)).cast(FIELDS_TYPE)
    # Fields the contract no longer has stay as they are.
    retired = F.map_filter(server, lambda k, _: ~k.isin(keys))
    # A field the file does not mention stays as it is stored, an explicit null included.
    current_fields = canon.as_map({k: F.coalesce(merged(k), F.when(sent(k).isNull(), server[k])) for k in keys})
    data = F.when(exists, F.map_concat(retired, current_fields)).otherwise(current_fields)
    untouched = F.coalesce(F.col("your_base") == F.col("_sent_hash"), F.lit(False))
    same_rev = F.coalesce(F.col("your_rev") == F.col("server_rev"), F.lit(False))
    skip_deleted = F.lit(not force) & ~exists & F.col("your_rev").isNotNull() & F.col("_gone").isNotNull()

    planned = staged.withColumns({"fields": fields, "_rules": checks.row_errors(merged, contract)})
    strange = (F.size("unknown") > 0) & F.lit(not ignore_unknown)
    op = (
        F.when(F.col("reason").isNotNull() | strange, "error")
        .when(skip_deleted, "deleted")
        .when(~exists, F.when(F.size("_rules") > 0, "error").otherwise("create"))
        .when(untouched, F.when(same_rev, "unchanged").otherwise("server_newer"))
        .when(F.size("fields") == 0, "unchanged")
        .when(~same_rev & F.lit(not force), "conflict")
        .when(F.size("_rules") > 0, "error")
        .otherwise("update")
    )
    planned = planned.withColumn("op", op)
    shown = F.col("op").isin("create", "update", "conflict")
    refused = F.col("reason").isNotNull()
    entry = F.struct(
        F.when(F.col("problem").isNotNull(), F.lit("")).otherwise(F.lit(contract.key_field.key)).alias("column"),
        F.col("reason").alias("reason"),
    )
    no_fields, no_errors = F.array().cast(FIELDS_TYPE), F.array().cast(checks.ERRORS_TYPE)
    paths_unknown = F.transform("unknown", lambda p: F.struct(p.alias("column"), F.lit(UNKNOWN_COLUMN).alias("reason")))
    errors = F.when(refused, F.array(entry).cast(checks.ERRORS_TYPE)).otherwise(
        F.concat(
            F.col("failures"),
            F.when(strange, paths_unknown.cast(checks.ERRORS_TYPE)).otherwise(no_errors),
            F.when((F.col("op") == "error") & ~strange, F.col("_rules")).otherwise(no_errors),
        )
    )
    never_pulled = F.when((F.col("op") == "conflict") & F.col("your_rev").isNull(), NEVER_PULLED)

    def unless_refused(c: Column) -> Column:
        return F.when(~refused, c)

    return planned.select(
        *place(planned),
        "row_key",
        "op",
        F.when(shown, F.col("fields")).otherwise(no_fields).alias("fields"),
        errors.alias("errors"),
        F.coalesce(F.col("reason"), never_pulled).alias("reason"),
        *[unless_refused(F.col(c)).alias(c) for c in ("row_id", "server_rev", "your_rev", "server_status")],
        F.when(F.col("op").isin("create", "update"), data).when(F.col("op") == "unchanged", server).alias("data"),
        F.when(F.lit(ignore_unknown) & ~refused, F.col("unknown")).otherwise(F.array().cast("array<string>")).alias("ignored"),
    )


def unknown_path_report(plan: DataFrame) -> DataFrame:
    """``(path, reason, records)``: unknown paths that block the sync, or that it ignores."""
    blocking = plan.select(F.explode("errors").alias("e")).filter(F.col("e.reason") == UNKNOWN_COLUMN)
    blocking = blocking.select(F.col("e.column").alias("path"), F.lit(UNKNOWN_COLUMN).alias("reason"))
    ignored = plan.select(F.explode("ignored").alias("path")).select("path", F.lit(IGNORED).alias("reason"))
    return blocking.unionByName(ignored).groupBy("path", "reason").agg(F.count("*").alias("records"))


def not_in_file(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Live keyed rows that the file does not mention (sync never deletes them)."""
    keyed = live(rows).filter(F.col("row_key").isNotNull()).select("row_key")
    return keyed.join(plan.filter(F.col("row_key").isNotNull()).select("row_key").distinct(), "row_key", "left_anti")


def summary(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """``(measure, n)``: records per op, error entries, live rows not in the file."""
    ops = plan.groupBy(F.col("op").alias("measure")).agg(F.count("*").alias("n"))
    errors = plan.agg(F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("n")).select(F.lit("error_entries").alias("measure"), "n")
    absent = not_in_file(plan, rows).agg(F.count("*").alias("n")).select(F.lit("not_in_file").alias("measure"), "n")
    return ops.unionByName(errors).unionByName(absent)


def has_local_edits(plan: DataFrame) -> bool:
    """Would overwriting the extract lose a change, a conflict or an error?"""
    mine = F.col("op").isin("create", "update", "conflict") | (F.size("errors") > 0)
    return not plan.filter(mine).isEmpty()


def is_blocked(plan: DataFrame) -> bool:
    return not plan.filter((F.col("op") == "conflict") | (F.size("errors") > 0)).isEmpty()


def updated_rows(plan: DataFrame, rows: DataFrame, user: str, at: Column) -> DataFrame:
    """The rows table after the plan's updates; an approved row goes back to review.

    The updates are written first: their measured size decides whether the rows
    table has to be shuffled at all.
    """
    updates = plan.filter(F.col("op") == "update").select(F.col("row_id").alias("id"), F.col("data").alias("_data"))
    updates = durable.written(updates, "updates")
    joined = rows.join(updates, "id", "left")
    hit = F.col("_data").isNotNull()
    out = {
        "data": F.coalesce("_data", "data"),
        "status": F.when(hit & (F.col("status") == "approved"), "needs_review").otherwise(F.col("status")),
        "rev": F.when(hit, F.col("rev") + 1).otherwise(F.col("rev")),
        "updated_by": F.when(hit, F.lit(user)).otherwise(F.col("updated_by")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in rows.columns])


def plan_edits(plan: DataFrame, user: str, at: Column) -> DataFrame:
    """Audit rows of the plan's updates, the status fall-back included."""
    status = F.when(
        F.col("server_status") == "approved",
        F.struct(F.lit("status").alias("field"), F.lit('"approved"').alias("before"), F.lit('"needs_review"').alias("after")),
    )
    entries = F.concat(F.col("fields"), F.array_compact(F.array(status)).cast(FIELDS_TYPE))
    return plan.filter(F.col("op") == "update").select("row_id", F.explode(entries).alias("_e")).select(
        "row_id",
        "_e.field",
        F.col("_e.before").alias("old_value"),
        F.col("_e.after").alias("new_value"),
        F.lit(user).alias("user_id"),
        at.alias("at"),
    )


def refreshed_state(plan: DataFrame, contract: Contract) -> DataFrame:
    """``(row_key, rev, base_hash)`` for created, updated and unchanged records."""
    rev = (
        F.when(F.col("op") == "create", F.lit(1))
        .when(F.col("op") == "update", F.col("server_rev") + 1)
        .otherwise(F.col("server_rev"))
    )
    done = plan.filter(F.col("op").isin("create", "update", "unchanged"))
    return done.select("row_key", rev.alias("rev"), canon.row_hash(canon.cells_of("data"), contract.active_keys).alias("base_hash"))


def apply_sync(
    plan: DataFrame, rows: DataFrame, contract: Contract, dataset: str, user: str, at: Column,
    dry_run: bool = False, edits: DataFrame | None = None,
) -> SyncResult:
    """All or nothing: a conflict, an error or a dry run writes nothing.

    Pass a plan written with ``plans.durable`` so the gate and the write see the
    same plan.
    """
    at = fixed_time(rows.sparkSession, at)
    log = plan_edits(plan, user, at)
    state = refreshed_state(plan, contract)
    if dry_run or is_blocked(plan):
        kept = log.limit(0) if edits is None else edits
        return SyncResult(rows, kept, state.limit(0), False)
    created = new_rows(plan.filter(F.col("op") == "create"), F.col("data"), F.col("row_key"), dataset, user, at)
    table = updated_rows(plan, rows, user, at).unionByName(created)
    return SyncResult(table, log if edits is None else edits.unionByName(log), state, True)


def overlay_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """New entries replace old ones, the rest stays."""
    a = old.select("row_key", F.struct("rev", "base_hash").alias("_a"))
    b = new.select("row_key", F.struct("rev", "base_hash").alias("_b"))
    return a.join(b, "row_key", "full_outer").select("row_key", F.coalesce("_b", "_a").alias("_s")).select(
        "row_key", "_s.rev", "_s.base_hash"
    )


def forget_keys(state: DataFrame, deleted: DataFrame) -> DataFrame:
    """Drop deleted keys, so a later push creates them afresh."""
    return state.join(deleted.select("row_key").distinct(), "row_key", "left_anti")


def pull_state(rows: DataFrame, contract: Contract) -> DataFrame:
    """``(row_key, rev, base_hash)`` of every extracted row."""
    return live(rows).filter(F.col("row_key").isNotNull()).select(
        "row_key", "rev", canon.row_hash(canon.cells_of("data"), contract.active_keys).alias("base_hash")
    )


def extract_rows(rows: DataFrame, contract: Contract) -> DataFrame:
    """Editable records: key column first, then contract order, empties dropped, nested."""
    key = contract.key_field.key
    order = [key] + [k for k in contract.active_keys if k != key]
    line = canon.nested_text(canon.cells_of("data"), order, drop_null=True, ordered=True)
    return live(rows).select("row_key", "created_at", "id", line.alias("line"))
