"""Operators over columns tables: inference, lint, replacement, diffs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.contract import OPTION_TYPES, Contract, Field
from rowsmith.functions import coerce, text
from rowsmith.plans import durable

# Fixed values.
LONG_TEXT_CHARS = 200
NULLS_ONLY = "only nulls seen - check type"
MAX_LISTED = 20
MOST_OPTIONS = 10_000  # that a contract lists itself
VERSION_FIELDS = ("type", "options", "required", "label")
PUSH_FIELDS = ("label", "type", "options", "required", "is_key", "json_schema")
OPTION_SEPARATOR = "\u001f"


def values_of(flat: DataFrame) -> DataFrame:
    """One row per (record, path): ``(row_idx, path, value)``, null values kept."""
    return flat.select("row_idx", F.explode("rec").alias("path", "value"))


def label_of(path: Column) -> Column:
    """Last segment, ``_`` and ``-`` runs as spaces, first letter upper."""
    words = text.strip(F.regexp_replace(F.element_at(F.split(path, r"\."), -1), "[_-]+", " "))
    return F.when(words == "", path).otherwise(
        F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))
    )


def infer_types(flat: DataFrame) -> DataFrame:
    """The narrowest column type per path: ``(path, label, type, n_values, note)``.

    One grouping on the path with map-side partial aggregates, so a path present
    in every record costs one small row per task.
    """
    t = F.col("value")
    string = text.unquote(t)
    some = t != "null"
    string_list = t.rlike(text.STRING_LIST)

    def every(condition: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(some, condition)), F.lit(False))

    stats = values_of(flat).groupBy("path").agg(
        F.count_if(some).alias("n_values"),
        every(t.isin("true", "false")).alias("_bool"),
        every(text.is_number(t)).alias("_number"),
        every(text.is_string(t)).alias("_string"),
        every(F.coalesce(string.rlike(coerce.DATE_SHAPE), F.lit(False))).alias("_date"),
        F.coalesce(
            F.bool_or(F.coalesce(string.contains("\n") | (F.length(string) > LONG_TEXT_CHARS), F.lit(False))),
            F.lit(False),
        ).alias("_long"),
        every(string_list).alias("_lists"),
        F.coalesce(F.bool_or(some & (t != "[]")), F.lit(False)).alias("_item"),
    )
    type_ = (
        F.when(F.col("n_values") == 0, "text")
        .when(F.col("_bool"), "boolean")
        .when(F.col("_number"), "number")
        .when(F.col("_string") & F.col("_date"), "date")
        .when(F.col("_string") & F.col("_long"), "long_text")
        .when(F.col("_string"), "text")
        .when(F.col("_lists") & F.col("_item"), "multi_select")
        .otherwise("json")
    )
    return stats.select(
        "path",
        label_of(F.col("path")).alias("label"),
        type_.alias("type"),
        "n_values",
        F.when(F.col("n_values") == 0, NULLS_ONLY).alias("note"),
    )


def infer_options(flat: DataFrame) -> DataFrame:
    """Distinct list items of every multi_select path, one row each."""
    lists = infer_types(flat).filter(F.col("type") == "multi_select").select("path")
    items = values_of(flat).filter(F.col("value").startswith("[")).select(
        "path", F.explode(text.string_array(F.col("value"))).alias("option")
    ).distinct()
    return items.join(lists, "path", "left_semi")


def key_candidates(flat: DataFrame) -> DataFrame:
    """Paths usable as key: a non-empty, trimmed, unique string in every record."""
    total = flat.filter(F.col("rec").isNotNull()).agg(F.count("*").alias("total"))
    t = F.col("value")
    string = text.unquote(t)
    good = F.coalesce((string == text.strip(string)) & (string != ""), F.lit(False))
    # Long values are counted by digest, which keeps the shuffle narrow.
    identity = F.when(F.length(t) > 64, F.sha2(t, 256)).otherwise(t)
    stats = values_of(flat).filter(t != "null").groupBy("path").agg(
        F.count("*").alias("present"),
        F.countDistinct(identity).alias("distinct_values"),
        F.bool_and(good).alias("_good"),
    )
    everywhere = F.col("present") == total.scalar()
    unique = F.col("distinct_values") == F.col("present")
    return stats.select("path", "present", "distinct_values", (F.col("_good") & everywhere & unique).alias("usable"))


def draft_contract(flat: DataFrame, key: str | None = None) -> tuple[Contract, list[str]]:
    """A contract for the records, in first-seen order, with its options listed, and warnings.

    Up to ``MOST_OPTIONS`` options become driver-side metadata; more are refused and belong
    in a table (``draft_with_options``).
    """
    contract, options, warnings = draft_with_options(flat, key)
    found: dict[str, list[str]] = {}
    rows = options.orderBy("column", "option").limit(MOST_OPTIONS + 1).collect()
    if len(rows) > MOST_OPTIONS:
        raise ValueError(f"more than {MOST_OPTIONS} options: keep them as rows, see draft_with_options")
    for r in rows:
        found.setdefault(r["column"], []).append(r["option"])
    fields = [replace(f, options=tuple(found.get(f.key, ())), options_table=False) if f.options_table else f for f in contract.fields]
    return Contract(tuple(fields)), warnings


def draft_with_options(flat: DataFrame, key: str | None = None) -> tuple[Contract, DataFrame, list[str]]:
    """A contract for the records, its options as rows ``(column, option)``, and warnings.

    Only paths and types come to the driver; the options are a written table of any size. The
    records are written once and read by each step.
    """
    from rowsmith.operators.records import discover_paths

    flat = durable.written(flat.select("row_idx", "rec", "paths"), "flat")
    order = [r.path for r in discover_paths(flat).collect()]
    types = {r.path: r for r in infer_types(flat).collect()}
    usable = {r.path for r in key_candidates(flat).filter("usable").select("path").collect()}
    options = durable.written(infer_options(flat).select(F.col("path").alias("column"), "option"), "options")
    warnings = []
    if key is not None and key not in types:
        raise ValueError(f"key '{key}' is not a field in the file")
    if key is not None and key not in usable:
        raise ValueError(f"key '{key}' must be a non-empty, unique text value in every record")
    if key is None and "id" in usable:
        key = "id"
    if key is None:
        warnings.append("no key column found: sync needs one")
    fields = [
        Field(
            key=p,
            label=types[p].label,
            type="text" if p == key else types[p].type,
            options_table=p != key and types[p].type == "multi_select",
            required=p == key,
            is_key=p == key,
        )
        for p in order
    ]
    warnings += [f"{p}: {NULLS_ONLY}" for p in order if types[p].note]
    return Contract.of(*fields), options, warnings


def empty_segment(key: Column) -> Column:
    return key.rlike(r"(\A|\.)(\.|\z)")


def prefix_clashes(columns: DataFrame) -> DataFrame:
    """Keys that are a proper dotted prefix of another key of the dataset.

    Every key lists its own prefixes, which then meet the keys by equality.
    """
    keys = columns.filter(~F.col("archived")).select("dataset", "key").distinct()
    parts = F.split("key", r"\.")
    prefixes = keys.filter(F.size(parts) > 1).select(
        "dataset",
        "key",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
            )
        ).alias("prefix"),
    )
    return prefixes.join(keys.withColumnRenamed("key", "prefix"), ["dataset", "prefix"], "left_semi").select(
        "dataset", "prefix", "key"
    )


def lint_contracts(columns: DataFrame) -> DataFrame:
    """``(dataset, key, reason)`` for every broken contract rule."""
    live = columns.filter(~F.col("archived"))
    chooses = F.col("type").isin(*OPTION_TYPES)
    remote_ref = F.col("json_schema").rlike(r'"\$(?:ref|dynamicRef)"\s*:\s*"(?!#)')
    rules = [
        F.when(chooses & (F.coalesce(F.size("options"), F.lit(0)) <= 0), "select types require non-empty options"),
        F.when(~chooses & F.col("options").isNotNull(), "options are only allowed for select types"),
        F.when(F.col("json_schema").isNotNull() & (F.col("type") != "json"), "json_schema is only allowed for json columns"),
        F.when((F.col("type") == "json") & remote_ref, "json_schema may only use local $ref"),
        F.when(empty_segment(F.col("key")), "every '.'-separated part must be non-empty"),
        F.when(F.col("is_key") & (F.col("type") != "text"), "key column must be of type text"),
        F.when(F.col("is_key") & ~F.col("required"), "key column must be required"),
    ]
    per_column = live.select("dataset", "key", F.explode(F.array_compact(F.array(*rules))).alias("reason"))
    repeated = (
        live.groupBy("dataset", "key").count().filter(F.col("count") > 1)
        .select("dataset", "key", F.lit("duplicate column key").alias("reason"))
    )
    several_keys = (
        live.filter("is_key").groupBy("dataset").agg(F.count("*").alias("_n"), F.min("key").alias("key"))
        .filter(F.col("_n") > 1)
        .select("dataset", "key", F.lit("only one key column is allowed").alias("reason"))
    )
    clashes = prefix_clashes(columns).select(
        "dataset", "key", F.concat(F.lit("clashes with '"), F.col("prefix"), F.lit("'")).alias("reason")
    )
    return per_column.unionByName(repeated).unionByName(several_keys).unionByName(clashes)


def replace_contract(columns: DataFrame, new: DataFrame) -> DataFrame:
    """Present keys are upserted and un-archived, absent ones archived.

    ``new`` lists every column of the datasets it names; ``ord`` is its position.
    """
    named = new.select("dataset").distinct()
    old = columns.select(*[F.col(c).alias(f"_{c}") if c not in ("dataset", "key") else F.col(c) for c in columns.columns])
    both = old.join(new.withColumn("_new", F.lit(True)), ["dataset", "key"], "full_outer").join(
        named.withColumn("_named", F.lit(True)), "dataset", "left"
    )
    fresh = F.col("_new").isNotNull()
    touched = F.col("_named").isNotNull()
    options = F.when(F.col("type").isin(*OPTION_TYPES), F.col("options"))

    def pick(name: str, value: Column | None = None) -> Column:
        return F.when(fresh, F.col(name) if value is None else value).otherwise(F.col(f"_{name}")).alias(name)

    return both.select(
        "dataset",
        "key",
        pick("label"),
        pick("type"),
        pick("options", options),
        pick("required"),
        pick("ord"),
        F.when(fresh, F.lit(False)).otherwise(F.col("_archived") | touched).alias("archived"),
        pick("json_schema"),
        F.when(fresh, F.col("is_key")).otherwise(F.col("_is_key") & ~touched).alias("is_key"),
    )


def diff_contract(a: DataFrame, b: DataFrame, fields: tuple[str, ...] = VERSION_FIELDS) -> DataFrame:
    """``(dataset, key, change)`` with change added, removed or changed."""
    left = a.select("dataset", "key", F.struct(*fields).alias("_a"))
    right = b.select("dataset", "key", F.struct(*fields).alias("_b"))
    both = left.join(right, ["dataset", "key"], "full_outer")
    change = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    return both.select("dataset", "key", change.alias("change")).filter(F.col("change").isNotNull())


def plan_contract_change(current: DataFrame, new: DataFrame) -> DataFrame:
    """What a contract push would do, applying nothing: added, changed, archived."""
    live = current.filter(~F.col("archived"))
    plan = diff_contract(live, new, PUSH_FIELDS)
    return plan.withColumn("change", F.when(F.col("change") == "removed", "archived").otherwise(F.col("change")))


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("dataset", "key").intersect(b.select("dataset", "key"))


def contract_drift(version: DataFrame, current: DataFrame) -> DataFrame:
    """Columns required now that were not required in the pulled version."""
    now = current.filter(F.col("required") & ~F.col("archived")).select("dataset", "key")
    then = version.filter(F.col("required") & ~F.col("archived")).select("dataset", "key")
    return now.subtract(then)


def active(columns: DataFrame) -> DataFrame:
    return columns.filter(~F.col("archived")).orderBy("dataset", "ord", "key")


def name_parts(target: Column) -> dict[str, Column]:
    """Syntax of ``name``, ``name@vN`` and ``vN``."""
    name = r"[a-z0-9][a-z0-9_-]{0,99}"
    pinned = rf"\A({name})@v([0-9]+)\z"
    return {
        "valid_name": target.rlike(rf"\A{name}\z"),
        "pin_name": F.when(target.rlike(pinned), F.regexp_extract(target, pinned, 1)),
        "pin_version": F.when(target.rlike(pinned), F.regexp_extract(target, pinned, 2).try_cast("bigint")),
        "version": F.when(
            target.rlike(r"\Av[0-9]+\z"), F.regexp_extract(target, r"\Av([0-9]+)\z", 1).try_cast("bigint")
        ),
    }


def suggest_mapping(headers: DataFrame, columns: DataFrame) -> DataFrame:
    """``headers(file, pos, source)`` to ``(file, source, key)``; first header wins.

    The first position is a map-side aggregate, so no header list is sorted.
    """
    keys = columns.filter(~F.col("archived")).groupBy(F.lower("key").alias("_norm")).agg(F.max_by("key", "ord").alias("key"))
    named = headers.withColumn("_norm", F.lower(text.strip(F.col("source"))))
    first = named.groupBy("file", "_norm").agg(F.min_by("source", "pos").alias("source"))
    return first.join(keys, "_norm").select("file", "source", "key")


def check_mapping(mapping: DataFrame, columns: DataFrame) -> DataFrame:
    """``mapping(file, source, key)`` problems: unknown keys and doubled keys."""
    keys = columns.select("key").distinct()
    unknown = mapping.join(keys, "key", "left_anti").select(
        "file", "key", F.concat(F.lit("'"), F.col("key"), F.lit("' is not a schema column")).alias("reason")
    )
    doubled = (
        mapping.groupBy("file", "key").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
        .select("file", "key", F.concat(F.col("_n").cast("string"), F.lit(" sources map to '"), F.col("key"), F.lit("'")).alias("reason"))
    )
    return unknown.unionByName(doubled)


def key_problems(rows: DataFrame, key: str) -> DataFrame:
    """``(id, reason)`` for live rows that ``key`` cannot identify.

    Missing and untrimmed values are row predicates; a shared value names each of
    its rows, joined back with salting so one value may hold any share of them.

    The values are written once: filters would be moved below the projection that makes them
    and build each row's cells again for every test.
    """
    from rowsmith.plans.skew import attach_by_key

    live = rows.filter(F.col("deleted_at").isNull())
    value = text.unquote(F.col("data").getItem(key))
    keyed = durable.written(live.select("id", value.alias("_value")), "key-values")
    missing = F.col("_value").isNull() | (text.strip(F.col("_value")) == "")
    padded = F.col("_value") != text.strip(F.col("_value"))
    flagged = keyed.select(
        "id",
        F.when(missing, F.lit("has no value"))
        .when(padded, F.concat(text.shown(F.col("_value")), F.lit(" has leading or trailing whitespace")))
        .alias("reason"),
    ).filter(F.col("reason").isNotNull())
    sound = keyed.filter(~F.coalesce(missing | padded, F.lit(True)))
    shared = sound.groupBy("_value").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
    doubled = attach_by_key(sound, shared, "_value", "_n", F.col("id"), "inner").select(
        "id",
        F.concat(text.shown(F.col("_value")), F.lit(" is used by "), F.col("_n").cast("string"), F.lit(" rows")).alias("reason"),
    )
    return flagged.unionByName(doubled)


def list_problems(problems: DataFrame, limit: int = MAX_LISTED) -> DataFrame:
    """The first ``limit`` problems by id, and one row counting the rest."""
    problems = durable.written(problems, "problems")
    listed = problems.orderBy("id", "reason").limit(limit)
    more = problems.agg((F.count("*") - limit).alias("_more")).filter(F.col("_more") > 0)
    return listed.unionByName(
        more.select(F.lit("").alias("id"), F.concat(F.lit("and "), F.col("_more").cast("string"), F.lit(" more")).alias("reason"))
    )


def rekey(rows: DataFrame, key: str | None) -> DataFrame:
    """Clear and refill ``row_key`` of live rows after the key column changed."""
    if key is not None and not key_problems(rows, key).isEmpty():
        raise ValueError(f"can't make '{key}' the key column: some rows have no usable or a shared value")
    value = F.lit(None).cast("string") if key is None else text.unquote(F.col("data").getItem(key))
    return rows.withColumn("row_key", F.when(F.col("deleted_at").isNull(), value).otherwise(F.col("row_key")))
