"""Joins and scans that hold when one key carries a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.plans import durable, sieve

ROWS_PER_TASK = 100_000  # rows of one key that stay together
BROADCAST_ROWS = 200_000  # facts up to this count ...
BROADCAST_BYTES = 16 * 1024 * 1024  # ... and this many bytes, all columns counted, are broadcast


def is_small(facts: DataFrame) -> bool:
    """Measured over whole rows, not estimated; costs one job over a written table."""
    bytes_ = F.octet_length(F.to_json(F.struct(*facts.columns)))
    size = facts.agg(F.count("*").alias("n"), F.coalesce(F.sum(bytes_), F.lit(0)).alias("b")).first()
    return size.n <= BROADCAST_ROWS and size.b <= BROADCAST_BYTES


def join_by_key(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the rows: shuffled, never broadcast.

    The files of a written table of ids are a tenth of its rows, so that the planner takes a large one for small and
    sends it through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def attach_by_key(
    rows: DataFrame, facts: DataFrame, key: str, weight: str, spread: Column, how: str = "left", sift: bool = False
) -> DataFrame:
    """Join ``facts`` (one short row per key, ``weight`` = rows of that key) onto ``rows``.

    The facts are written first and measured. A small set is broadcast, and the
    rows are not shuffled at all. A larger one is joined by key with its heavy
    keys salted, which holds when one key has any share of the rows. ``sift`` is for inner
    joins that few rows outlast: rows that meet no fact are left out before the shuffle.
    """
    facts = durable.written(facts, "facts", lean=True) if sift else durable.written(facts, "facts")
    if is_small(facts):
        return rows.join(F.broadcast(facts), key, how)
    if sift:
        rows = sieve.sifted(rows, facts, key)
    return attach_salted(rows, facts, key, weight, spread, how)


def attach_salted(
    rows: DataFrame, facts: DataFrame, key: str, weight: str, spread: Column, how: str = "left", per_task: int | None = None
) -> DataFrame:
    """The join of ``attach_by_key`` for facts of any size.

    Every key with more than ``per_task`` rows is salted: its rows go to as many
    tasks as its weight asks for, and its single fact is repeated once per task.
    There are at most (rows / per_task) such keys, and they are broadcast only when
    measured to be small; past that adaptive execution splits the join. Rows without
    a key meet no fact and are not shuffled. No row is dropped or capped.
    """
    per_task = per_task or ROWS_PER_TASK
    copies = F.ceil(F.col(weight) / F.lit(per_task)).cast("int")
    heavy = facts.filter(F.col(weight) > per_task).select(F.col(key).alias("_hot"), copies.alias("_copies"))
    heavy = durable.written(heavy, "heavy")
    present = rows.filter(F.col(key).isNotNull())
    if is_small(heavy):
        salt = F.pmod(F.xxhash64(spread), F.coalesce("_copies", F.lit(1))).cast("int")
        salted = present.join(F.broadcast(heavy), F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt)
        each = F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1))
        joined = join_by_key(salted.drop("_hot", "_copies"), facts.withColumn("_salt", each), [key, "_salt"], how).drop("_salt")
    else:
        joined = join_by_key(present, facts, key, how)
    if how != "left":
        return joined
    return joined.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def previous_in_group(
    df: DataFrame, group: list[str], order: str, value: str, out: str, width: int = 65_536
) -> DataFrame:
    """``lag(value)`` per group in ``order``, without one task per group.

    ``order`` is an integer unique within a group. It is cut into blocks of
    ``width``; inside a block a window suffices, and a block's first row takes
    the last value of the block before it, looked up among one row per block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(width)))
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    ends = blocked.groupBy(*group, "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_end"))
    ends = ends.select(
        *group, "_block", F.lag(F.col("_end")).over(Window.partitionBy(*group).orderBy("_block")).alias("_carried")
    )
    ends = ends.filter(F.col("_carried").isNotNull())
    return (
        blocked.withColumn("_prev", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .join(ends, [*group, "_block"], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_prev")))
        .drop("_block", "_prev", "_first", "_carried")
    )


def last_before(df: DataFrame, group: list[str], order: str, value: str, out: str, width: int = 65_536) -> DataFrame:
    """The last non-null ``value`` of rows of the group that come earlier, cut into blocks as ``previous_in_group``."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(width)))
    inside = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = blocked.filter(F.col(value).isNotNull()).groupBy(*group, "_block").agg(F.max_by(value, order).alias("_end"))
    there = join_by_key(blocked.select(*group, "_block").distinct(), ends, [*group, "_block"], "left")
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = there.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    rows = blocked.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
    rows = join_by_key(rows, carried.filter(F.col("_carried").isNotNull()), [*group, "_block"], "left")
    return rows.withColumn(out, F.coalesce("_own", "_carried")).drop("_block", "_own", "_carried")
