"""Temperature mixing of sources, realised as budgeted block permutations.

A source with the token share ``s`` gets the weight ``s**a``, normalised. The exponent
``a`` in [0, 1] is bisected: the flattest mix that repeats no source more often than
allowed, or the one that reaches a target entropy. Weights times a token budget say how
many tokens each source gives. It gives them in epochs: every epoch is a new permutation
of the source's blocks, the last one ends where the budget does, inside a block if need be.

Which rows a partial epoch takes follows from hashes and from sums over (source, block),
so no row is looked up and any source may hold most of the rows. Without a budget the
smallest one is taken that spends every source once; no row is left out then.

The blocks of a source are put in order by one task an epoch: one short row for every ``block_tokens`` tokens.

Defined results: null sources are one source, a source without tokens gives each row once,
rows without tokens go with their block, rows equal in id and text are taken together, an
empty table gives no rows, and a clashing column name gets an underscore for the new one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import boxed, col, free_name, unboxed
from rowsmith.plans import durable
from rowsmith.plans.skew import is_small

MAX_REPETITION = 2.0  # epochs of a source at most
BLOCK_TOKENS = 1_000_000
SEED = 4_711
POINTS, ROUNDS = 32, 8  # the exponent's interval shrinks 32-fold a round: five bisections in one pass


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII whitespace."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def _measures(shares: DataFrame, exponents: list[float], budget_share: float | None) -> dict[float, tuple[float, float]]:
    """Per exponent: the entropy of the weights and the largest repetition."""
    grid = shares.withColumn("a", F.explode(F.array(*[F.lit(a) for a in exponents])))
    power = F.pow("share", F.col("a"))
    rows = grid.groupBy("a").agg(
        F.sum(power).alias("z"),
        F.sum(power * F.log(power)).alias("e"),
        F.max(F.pow("share", 1 - F.col("a"))).alias("most"),
        F.max(F.pow("share", F.col("a") - 1)).alias("rarest"),
    )
    out = {}
    for r in rows.collect():
        budget = r["most"] * r["z"] if budget_share is None else budget_share
        out[r["a"]] = (math.log(r["z"]) - r["e"] / r["z"], budget * r["rarest"] / r["z"])
    return out


def find_exponent(
    shares: DataFrame, max_repetition: float | None, entropy: float | None, budget_share: float | None = None
) -> float:
    """The smallest exponent in [0, 1] that keeps within ``max_repetition`` or ``entropy``; else 1."""

    def fits(measure: tuple[float, float]) -> bool:
        return measure[0] <= entropy if entropy is not None else measure[1] <= max_repetition * (1 + 1e-12)

    low, high = 0.0, 1.0
    if fits(_measures(shares, [0.0], budget_share)[0.0]):
        return 0.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / POINTS for i in range(1, POINTS)]
        got = _measures(shares, points, budget_share)
        high = next((a for a in points if fits(got[a])), high)
        below = [a for a in points if a < high]
        low = below[-1] if below else low
    return high


def plan(
    docs: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    entropy: float | None = None,
    budget: int | None = None,
    seed: int = SEED,
    block_tokens: int = BLOCK_TOKENS,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Sources ``(_s, tokens, share, weight, budget, epochs, _blocks)`` and block copies.

    A block copy ``(_s, _block, _epoch, _rank, _cut)`` is a block in an epoch; rows whose
    hash is above ``_cut`` are beyond the budget.
    """
    rows = docs.select(
        source_key(col(source)).alias("_s"), _row_hash(docs, seed, id, text).alias("_h"), token_count(col(text)).alias("n")
    )
    rows = durable.written(rows, "tokens")
    sources = rows.groupBy("_s").agg(F.sum("n").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = sources.withColumn("share", F.col("tokens") / F.lit(max(total, 1)))
    sources = durable.written(sources, "sources")
    shares = sources.filter("tokens > 0").select("share")
    a = find_exponent(shares, max_repetition, entropy, budget / total if budget is not None and total else None) if total else 1.0
    power = F.pow("share", F.lit(a))
    facts = shares.agg(F.sum(power).alias("z"), F.max(F.pow("share", F.lit(1 - a))).alias("most")).first()
    z, most = facts["z"] or 1.0, facts["most"] or 1.0
    tokens = budget if budget is not None else total * most * z
    weight = F.when(F.col("tokens") > 0, power / F.lit(z)).otherwise(F.lit(0.0))
    sources = sources.withColumn("weight", weight).withColumn("exponent", F.lit(a))
    spend = F.floor(F.col("weight") * F.lit(float(tokens)) + F.lit(1e-3)).cast("long")
    sources = sources.withColumn("budget", spend)
    once = F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens")).otherwise(F.lit(1.0))
    sources = sources.withColumn("epochs", once)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("int")
    sources = durable.written(sources.withColumn("_blocks", blocks), "mix")

    few = sources.select("_s", "tokens", "budget", "epochs", "_blocks")
    hashed = rows.join(_broadcast_if_small(few), "_s")
    hashed = hashed.withColumn("_block", F.pmod("_h", F.col("_blocks")).cast("int"))
    sizes = hashed.groupBy("_s", "_block").agg(F.sum("n").alias("size"))
    full = F.floor("epochs").cast("int")
    left = F.when(F.col("tokens") > 0, F.col("budget") - full * F.col("tokens")).otherwise(F.lit(0))
    copies = sizes.join(few, "_s").withColumn("_left", left)
    copies = copies.withColumn("_full", full)
    last = F.when(F.col("_left") > 0, F.col("_full")).otherwise(F.col("_full") - 1)
    copies = copies.withColumn("_epoch", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    by = Window.partitionBy("_s", "_epoch").orderBy(F.xxhash64(F.lit(seed), "_s", "_epoch", "_block"), "_block")
    copies = copies.withColumn("_rank", F.row_number().over(by) - 1).withColumn("_upto", F.sum("size").over(by))
    copies = copies.withColumn("_room", F.col("_left") - (F.col("_upto") - F.col("size")))
    partial = F.col("_epoch") == F.col("_full")
    copies = copies.filter(~partial | (F.col("_room") > 0))
    copies = copies.withColumn("_split", partial & (F.col("size") > F.col("_room")))
    copies = durable.written(copies.select("_s", "_block", "_epoch", "_rank", "_split", "_room"), "copies")
    # At most one block a source is split: its rows of least hash are taken while they fit.
    split = copies.filter("_split").select("_s", "_block", "_room")
    inside = hashed.select("_s", "_block", "_h", "n").join(_broadcast_if_small(split), ["_s", "_block"])
    inside = inside.groupBy("_s", "_block", "_room", "_h").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_s", "_block").orderBy("_h"))
    cuts = inside.withColumn("_sum", upto).filter("_sum <= _room").groupBy("_s", "_block").agg(F.max("_h").alias("_cut"))
    cuts = cuts.withColumn("_split", F.lit(True))
    none, every = -(2**63), 2**63 - 1
    copies = copies.join(cuts, ["_s", "_block", "_split"], "left")
    cut = F.when(F.col("_split"), F.coalesce("_cut", F.lit(none))).otherwise(F.lit(every))
    copies = copies.select("_s", "_block", "_epoch", "_rank", cut.alias("_cut"))
    return sources, durable.written(copies, "plan")


def _row_hash(docs: DataFrame, seed: int, id: str, text: str) -> Column:
    return F.xxhash64(F.lit(seed), col(id), col(text))


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    """Measured in rows and bytes; ``df`` reads a written table."""
    return F.broadcast(df) if is_small(df) else df


def mixed(
    docs: DataFrame,
    max_repetition: float | None = MAX_REPETITION,
    entropy: float | None = None,
    budget: int | None = None,
    seed: int = SEED,
    block_tokens: int = BLOCK_TOKENS,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The mix: rows of ``docs`` as often as their source's budget says.

    Adds ``epoch``, ``block`` and ``progress`` in [0, 1]: the share of its source's budget
    given before the row. Ordered by progress, every stretch of the mix has the weights.
    """
    sources, copies = plan(docs, max_repetition, entropy, budget, seed, block_tokens, id, source, text)
    epoch, block, progress = (free_name(docs, n) for n in ("epoch", "block", "progress"))
    facts = sources.select("_s", "epochs", "_blocks")
    rows = boxed(docs, source_key(col(source)).alias("_s"), _row_hash(docs, seed, id, text).alias("_h"))
    rows = rows.join(_broadcast_if_small(facts), "_s")
    rows = rows.withColumn("_block", F.pmod("_h", F.col("_blocks")).cast("int"))
    # A row meets its block once an epoch.
    rows = rows.join(_broadcast_if_small(copies), ["_s", "_block"]).filter("_h <= _cut")
    inside = F.pmod("_h", F.lit(1 << 20)) / F.lit(float(1 << 20))
    done = (F.col("_epoch") + (F.col("_rank") + inside) / F.col("_blocks")) / F.col("epochs")
    return rows.select(
        *unboxed(docs),
        F.col("_epoch").alias(epoch),
        F.col("_block").alias(block),
        F.least(done, F.lit(1.0)).alias(progress),
    )
