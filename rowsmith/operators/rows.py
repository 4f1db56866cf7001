"""Row tables: views, filters, creation, deletion, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.contract import TEXT_TYPES, Contract
from rowsmith.functions import canon, checks, text
from rowsmith.operators.importing import new_rows
from rowsmith.plans import durable
from rowsmith.plans.skew import attach_by_key

EDITS_SCHEMA = "row_id string, field string, old_value string, new_value string, user_id string, at timestamp"


def live(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("deleted_at").isNull())


def by_status(rows: DataFrame, status: str) -> DataFrame:
    return rows.filter(F.col("status") == status)


def by_assignee(rows: DataFrame, assignee: str, me: str | None = None) -> DataFrame:
    """``me`` stands for the caller."""
    return rows.filter(F.col("assignee") == (me if assignee == "me" else assignee))


def text_search(rows: DataFrame, contract: Contract, query: str) -> DataFrame:
    """Case-insensitive substring over all text columns, archived ones too.

    ``%`` and ``_`` act as wildcards; an empty query filters nothing and a
    contract without text columns matches nothing.
    """
    if not query:
        return rows
    hit = F.lit(False)
    for f in contract.fields:
        if f.type in TEXT_TYPES:
            shown = F.col("data").getItem(f.key)
            hit = hit | F.coalesce(F.coalesce(text.unquote(shown), shown).ilike(f"%{query}%"), F.lit(False))
    return rows.filter(hit)


def missing_required(rows: DataFrame, contract: Contract) -> DataFrame:
    return rows.filter(checks.missing_required(canon.cells_of("data"), contract))


def view(
    rows: DataFrame,
    contract: Contract,
    status: str | None = None,
    assignee: str | None = None,
    q: str | None = None,
    missing: bool = False,
    me: str | None = None,
) -> DataFrame:
    """Live rows under an AND-combination of filters."""
    found = live(rows)
    if status is not None:
        found = by_status(found, status)
    if assignee is not None:
        found = by_assignee(found, assignee, me)
    if q:
        found = text_search(found, contract, q)
    return missing_required(found, contract) if missing else found


# The four built-in views.
NAMED_VIEWS = {
    "all": {},
    "my_queue": {"assignee": "me"},
    "needs_review": {"status": "needs_review"},
    "missing_required": {"missing": True},
}


def named_view(rows: DataFrame, contract: Contract, name: str, me: str | None = None) -> DataFrame:
    return view(rows, contract, me=me, **NAMED_VIEWS[name])


def listing(rows: DataFrame) -> DataFrame:
    return live(rows).orderBy("created_at", "id")


def typed_view(rows: DataFrame, contract: Contract) -> DataFrame:
    """The wide typed form for analytics: ``row_id``, ``row_status``, then a struct ``data`` of the columns.

    In a struct of its own a column may be called anything a contract allows, also ``id``.
    """
    types = {"number": "double", "boolean": "boolean"}
    out = []
    for f in contract.active:
        t = F.col("data").getItem(f.key)
        if f.type in types:
            value = canon.absent(t).try_cast(types[f.type])
        elif f.type == "multi_select":
            value = text.string_array(t)
        elif f.type == "json":
            value = F.try_parse_json(t)
        elif f.type == "date":
            value = text.unquote(t).try_cast("date")
        else:
            value = text.unquote(t)
        out.append(value.alias(f.key))
    return rows.select(F.col("id").alias("row_id"), F.col("status").alias("row_status"), F.struct(*out).alias("data"))


def key_conflicts(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """``wanted(id, row_key)`` whose key another live row already uses.

    Keys of live rows are unique, so at most one partner matches.
    """
    taken = live(rows).filter(F.col("row_key").isNotNull()).select("row_key", F.col("id").alias("other_id"))
    hit = wanted.join(taken, "row_key")
    return hit.filter(F.col("id").isNull() | (F.col("id") != F.col("other_id"))).select("id", "row_key", "other_id")


def shared_keys(rows: DataFrame) -> DataFrame:
    """Every live row whose key value other live rows share: ``(row_key, id, n)``.

    One line per row, so a value shared by any number of rows is never gathered.
    """
    keyed = live(rows).filter(F.col("row_key").isNotNull()).select("row_key", "id")
    shared = keyed.groupBy("row_key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return attach_by_key(keyed, shared, "row_key", "n", F.col("id"), "inner")


def create_rows(
    rows: DataFrame, new: DataFrame, contract: Contract, dataset: str, user: str, started: Column
) -> tuple[DataFrame, DataFrame]:
    """(new rows table, rejected) for ``new(row_idx, data)``.

    A row is refused for its first rule error, or for a key that a live row or an
    earlier new row holds. Rule results are written once: the claims, the accepted
    and the rejected rows all read them.
    """
    from rowsmith.operators.importing import claims, is_later
    key = contract.key_field
    error = checks.first_error(canon.cells_of("data"), contract)
    checked = durable.written(new.withColumn("reason", error), "new-rows")
    row_key = F.lit(None).cast("string")
    if key is not None:
        row_key = text.unquote(F.col("data").getItem(key.key))
        checked = checked.withColumn("_claim", F.when(F.col("reason").isNull(), row_key))
        facts = claims(checked, "_claim", live(rows)).filter((F.col("claimants") > 1) | F.col("taken"))
        checked = attach_by_key(checked, facts, "_claim", "claimants", F.col("row_idx"))
        used = F.col("taken") | is_later(checked)
        checked = checked.withColumn(
            "reason",
            F.coalesce(F.col("reason"), F.when(used, F.concat(F.lit("key '"), F.col("_claim"), F.lit("' already exists")))),
        ).drop("_claim", "first_at", "claimants", "taken")
    good = checked.filter(F.col("reason").isNull())
    made = new_rows(good, F.col("data"), row_key, dataset, user, started)
    return rows.unionByName(made), checked.filter(F.col("reason").isNotNull()).select("row_idx", "reason")


def edits_of(before: DataFrame, after: DataFrame, user: str, at: Column, strict: bool = False) -> DataFrame:
    """One audit row per changed field, status and assignee between two row states.

    Patches compare loosely (1, 1.0 and true are equal); sync compares strictly.
    """
    old = before.select("id", F.struct("data", "status", "assignee", "deleted_at").alias("_a"))
    new = after.select("id", F.struct("data", "status", "assignee", "deleted_at").alias("_b"))
    both = old.join(new, "id")
    fields = canon.changed_fields(F.col("_a.data"), F.col("_b.data"), strict)

    def system(name: str, a: Column, b: Column) -> Column:
        return F.when(~a.eqNullSafe(b), F.struct(F.lit(name).alias("field"), a.alias("old"), b.alias("new")))

    def quoted(side: str, name: str) -> Column:
        return text.quote(F.col(f"{side}.{name}"))

    def deleted(side: str) -> Column:
        return F.col(f"{side}.deleted_at").isNotNull().cast("string")

    extra = F.array_compact(
        F.array(
            system("status", quoted("_a", "status"), quoted("_b", "status")),
            system("assignee", quoted("_a", "assignee"), quoted("_b", "assignee")),
            system("deleted", deleted("_a"), deleted("_b")),
        )
    )
    return both.select("id", F.explode(F.concat(fields, extra)).alias("_e")).select(
        F.col("id").alias("row_id"),
        "_e.field",
        F.col("_e.old").alias("old_value"),
        F.col("_e.new").alias("new_value"),
        F.lit(user).alias("user_id"),
        at.alias("at"),
    )


def soft_delete(rows: DataFrame, requests: DataFrame, user: str, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new rows table, outcome, edits) for ``requests(id, seq, expected_rev)``, ``seq`` the arrival.

    Every request gets an outcome: the first with the right rev deletes the row, those
    before it are conflicts (or rev_required), those after it find no row. Which one
    that is comes from a map-side minimum, so a row may have any number of requests.
    """
    current = live(rows).select("id", F.col("rev").alias("server_rev"))
    asked = requests.join(current, "id", "left")
    hits = F.when(F.col("expected_rev") == F.col("server_rev"), F.col("seq"))
    first = asked.groupBy("id").agg(F.min(hits).alias("_first"), F.count("*").alias("_n")).filter("_first is not null")
    outcome = attach_by_key(asked, first, "id", "_n", F.col("seq")).withColumn(
        "outcome",
        F.when(F.col("server_rev").isNull() | (F.col("seq") > F.col("_first")), "not_found")
        .when(F.col("expected_rev").isNull(), "rev_required")
        .when(F.col("seq") == F.col("_first"), "deleted")
        .otherwise("conflict"),
    ).drop("_first", "_n")
    outcome = durable.written(outcome, "deletions")
    gone = outcome.filter(F.col("outcome") == "deleted").select("id")
    return mark_deleted(rows, gone, user, at), outcome, deletion_edits(gone, user, at)


def mark_deleted(rows: DataFrame, gone: DataFrame, user: str, at: Column) -> DataFrame:
    """Set the deletion columns and raise the rev of the rows in ``gone(id)``."""
    marked = rows.join(gone.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    hit = F.col("_gone").isNotNull()
    out = {
        "deleted_at": F.when(hit, at).otherwise(F.col("deleted_at")),
        "deleted_by": F.when(hit, F.lit(user)).otherwise(F.col("deleted_by")),
        "rev": F.when(hit, F.col("rev") + 1).otherwise(F.col("rev")),
        "updated_by": F.when(hit, F.lit(user)).otherwise(F.col("updated_by")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }
    return marked.select(*[out[c].alias(c) if c in out else F.col(c) for c in rows.columns])


def deletion_edits(gone: DataFrame, user: str, at: Column) -> DataFrame:
    return gone.select(
        F.col("id").alias("row_id"),
        F.lit("deleted").alias("field"),
        F.lit("false").alias("old_value"),
        F.lit("true").alias("new_value"),
        F.lit(user).alias("user_id"),
        at.alias("at"),
    )


def not_found(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Requested ids or keys without a live row."""
    return wanted.select(column).distinct().join(live(rows).select(column), column, "left_anti")


def bulk_delete(
    rows: DataFrame, user: str, at: Column, ids: DataFrame | None = None, keys: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, not found, edits), all or nothing: anything not found deletes nothing."""
    if (ids is None) == (keys is None):
        raise ValueError("give exactly one of ids and keys")
    column, wanted = ("id", ids) if ids is not None else ("row_key", keys)
    missing = not_found(rows, wanted, column)
    if not missing.isEmpty():
        return rows, missing, deletion_edits(rows.select("id").limit(0), user, at)
    gone = live(rows).join(wanted.select(column).distinct(), column, "left_semi").select("id")
    return mark_deleted(rows, gone, user, at), missing, deletion_edits(gone, user, at)


def history(rows: DataFrame, events: DataFrame, at: str = "at") -> DataFrame:
    """Edits or comments of a row set in time order.

    The row set is the unique side, so a row with a great many events only makes
    its event partition large, which the adaptive skew join splits.
    """
    return events.join(rows.select(F.col("id").alias("row_id")).distinct(), "row_id", "left_semi").orderBy(at, "row_id")
