"""Select options that grow with the data: kept as rows, checked by joins.

An options table has the columns ``(column, option)``. A contract field with ``options_table``
allows the values that the table lists for it. The values of the rows are made distinct before
they meet the options, whatever their number; what comes back to the rows are only the values
that no option allows. Options may be many times as many as the values, so only those that pass a
sieve of the values are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.contract import OPTION_TYPES, Contract, Field
from rowsmith.functions import checks, text
from rowsmith.functions.canon import Cells
from rowsmith.plans import durable, sieve, skew

SCHEMA = "column string, option string"
VALUE = ["column", "value"]


def open_fields(contract: Contract) -> list[Field]:
    """Active fields whose options are rows of a table."""
    return [f for f in contract.active if f.options_table and f.type in OPTION_TYPES]


def listed(spark: SparkSession, contract: Contract) -> DataFrame:
    """The options that a contract lists itself, as rows."""
    return spark.createDataFrame([(f.key, o) for f in contract.active for o in f.options or ()], SCHEMA)


def _values(field: Field, t: Column) -> Column:
    """The values of a cell that need an option; null where the cell breaks other rules."""
    if field.type == "select":
        value = F.array(text.unquote(t))
        shaped = text.is_string(t)
    else:
        plain = F.split(F.substring(t, F.lit(3), F.length(t) - 4), '","')  # without escapes, quotes only end strings
        plain = F.when(t == "[]", F.array().cast("array<string>")).otherwise(plain)
        value = F.when(F.contains(t, F.lit("\\")), text.string_array(t)).otherwise(plain)
        shaped = t.rlike(text.STRING_LIST)
    filled = ~checks.is_empty(t, field.type) & shaped
    return F.when(F.coalesce(filled, F.lit(False)), value)


def _pair(value: str) -> Column:
    """Column and value in one text; the length keeps apart pairs that run together alike."""
    return F.concat(F.length("column"), F.lit(":"), "column", value)


def _missing(distinct: DataFrame, options: DataFrame) -> DataFrame:
    """``distinct`` values that no option allows, with their ``pair``; ``distinct`` is a written table."""
    count = distinct.count()
    # Both sides are sorted by one number, as texts of one column begin alike; the texts are compared where it agrees.
    pair = _pair("value")
    same = (F.xxhash64(pair) == F.xxhash64("_option")) & pair.between(F.col("_option"), F.col("_option"))
    of = sieve.parts(count)
    found = []
    for at in range(of):
        values = sieve.part(distinct, VALUE, at, of)
        near = sieve.part(options.select("column", "option"), ["column", "option"], at, of)
        near = sieve.passed(near, ["column", "option"], sieve.made(values, VALUE, count // of))
        # Options made by an explode are estimated far too small, so the planner must not broadcast them.
        allowed = near.select(_pair("option").alias("_option")).hint("merge")
        missing = values.join(allowed, same, "left_anti").withColumn("pair", pair)
        found.append(missing if of == 1 else durable.written(missing, "missing-values", lean=True))
    return reduce(DataFrame.unionByName, found)


def unknown_values(rows: DataFrame, cells: Cells, contract: Contract, options: DataFrame, place: list[str]) -> DataFrame:
    """``(*place, column, values)``: the values of each cell that are no option, in their order."""
    fields = open_fields(contract)
    used = F.array(*[F.struct(F.lit(f.key).alias("column"), _values(f, cells(f.key)).alias("values")) for f in fields])
    asked = rows.select(*place, F.explode(used).alias("_v"))
    asked = asked.select(*place, "_v.column", F.posexplode("_v.values").alias("at", "value"))
    asked = durable.written(asked, "option-values", lean=True)
    with durable.briefly(asked.groupBy(*VALUE).agg(F.count("*").alias("_n")), "distinct-values") as distinct:
        # The facts bring column and value back, so that the rows are shuffled with the pair alone.
        asked = asked.select(*place, "at", _pair("value").alias("pair"))
        bad = skew.attach_by_key(asked, _missing(distinct, options), "pair", "_n", F.xxhash64(*place), how="inner", sift=True)
    found = bad.groupBy(*place, "column").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_b"))
    return found.select(*place, "column", F.col("_b.value").alias("values"))


def option_errors(unknown: DataFrame, contract: Contract, place: list[str]) -> DataFrame:
    """``(*place, column, reason)`` for the report."""
    single = F.col("column").isin([f.key for f in open_fields(contract) if f.type == "select"])
    one = F.concat(F.lit("'"), F.col("values")[0], F.lit("' is not one of the options"))
    many = F.concat(text.shown_list(F.col("values")), F.lit(" not in the options"))
    return unknown.select(*place, "column", F.when(single, one).otherwise(many).alias("reason"))


def with_option_errors(rows: DataFrame, cells: Cells, contract: Contract, options: DataFrame, place: list[str]) -> DataFrame:
    """``rows`` with the option errors added to ``errors``, in contract order. ``place`` is unique.

    Rows are shuffled only if the cells with unknown values are too many to broadcast.
    """
    if not open_fields(contract):
        return rows
    found = option_errors(unknown_values(rows, cells, contract, options, place), contract, place)
    found = found.groupBy(*place).agg(F.collect_list(F.struct("column", "reason")).alias("_options"))
    found = durable.written(found, "option-errors")
    joined = rows.join(F.broadcast(found) if skew.is_small(found) else found, place, "left")
    both = F.concat("errors", F.coalesce("_options", F.array().cast(checks.ERRORS_TYPE)))
    keys = [f.key for f in contract.active]

    def of(key: str) -> Column:
        return F.filter(both, lambda e: e["column"] == key)

    ordered = [of(k) for k in keys]
    other = F.filter(both, lambda e: ~e["column"].isin(keys))
    return joined.withColumn("errors", F.when(F.col("_options").isNull(), F.col("errors")).otherwise(F.concat(other, *ordered))).drop("_options")
