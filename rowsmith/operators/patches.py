"""Revision-checked patches, applied in arrival order, with an audit log.

A patch is accepted when its expected rev is the rev the previous accepted patch
of that row left, the merged row keeps the contract, its new key is free at that moment
and its assignee exists. The patches of one row form a chain. A row with few patches is
folded at once; the chain of a row with many is cut into blocks of arrival numbers:

1. every block says which state it turns each state it knows into;
2. neighbouring blocks are composed, level by level, up to the whole chain, and the states
   that enter each block come back down: joins on (row, node, state), a level at a time;
3. every block folds forward from its entering state and marks its patches.

Steps 1 and 3 are bounded folds inside the JVM. A state is ``2 * rev + clean``; a row
that breaks the contract is not clean until an accepted patch covers all its broken fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.contract import Contract
from rowsmith.functions import canon, checks, text
from rowsmith.operators import handover
from rowsmith.operators.rows import live
from rowsmith.plans import durable
from rowsmith.plans.skew import attach_by_key, join_by_key, previous_in_group

BLOCK = 64  # arrival numbers per block of a long chain
AT_ONCE = 512  # patches of a row that are folded at once; the fold copies what it has seen
STEP = "struct<seq:bigint,expected:bigint,ok:boolean,has_data:boolean,covers:boolean>"
SEEN = "array<struct<seq:bigint,accepted:boolean,rev:bigint,clean:bigint>>"


def _next_state(state: Column, step: Column) -> tuple[Column, Column]:
    """(accepted, state after) of one patch."""
    rev, clean = F.floor(state / 2).cast("bigint"), F.pmod(state, F.lit(2)).cast("bigint")
    fits = ~step["has_data"] | (clean == 1) | step["covers"]
    accepted = F.coalesce((rev == step["expected"]) & step["ok"] & fits, F.lit(False))
    after = (rev + 1) * 2 + F.when(step["has_data"], F.lit(1).cast("bigint")).otherwise(clean)
    return accepted, F.when(accepted, after).otherwise(state)


def _leaving(steps: Column, entering: Column) -> Column:
    return F.aggregate(steps, entering, lambda state, step: _next_state(state, step)[1])


def _seen_in(steps: Column, entering: Column) -> Column:
    """Each patch of a block with whether it is accepted and the state it met."""
    start = F.struct(entering.alias("state"), F.array().cast(SEEN).alias("seen"))

    def forward(acc: Column, step: Column) -> Column:
        accepted, after = _next_state(acc["state"], step)
        rev, clean = F.floor(acc["state"] / 2).cast("bigint"), F.pmod(acc["state"], F.lit(2)).cast("bigint")
        one = F.struct(step["seq"].alias("seq"), accepted.alias("accepted"), rev.alias("rev"), clean.alias("clean"))
        return F.struct(after.alias("state"), F.concat(acc["seen"], F.array(one)).cast(SEEN).alias("seen"))

    return F.aggregate(steps, start, forward, lambda acc: acc["seen"])


def _moves(blocks: DataFrame) -> DataFrame:
    """``(id, node, frm, to)``: the states that a block changes."""
    both = F.flatten(F.transform("steps", lambda s: F.array(s["expected"] * 2, s["expected"] * 2 + 1)))
    pairs = F.transform(F.array_distinct(both), lambda x: F.struct(x.alias("frm"), _leaving(F.col("steps"), x).alias("to")))
    rows = blocks.select("id", F.col("block").alias("node"), F.explode_outer(pairs).alias("p"))
    return rows.select("id", "node", "p.frm", "p.to").filter(F.col("frm") != F.col("to"))


def _entering(blocks: DataFrame, start: DataFrame) -> DataFrame:
    """``(id, block, entering)`` of every block of long chains."""
    levels = [durable.written(_moves(blocks), "moves")]
    top = blocks.agg(F.max("block")).first()[0] or 0
    parent, odd = F.floor(F.col("node") / 2).cast("bigint"), F.pmod(F.col("node"), F.lit(2)) == 1
    while top > 0:
        moves = levels[-1]
        left = moves.filter(~odd).select("id", parent.alias("node"), "frm", F.col("to").alias("mid"))
        right = moves.filter(odd).select("id", parent.alias("node"), F.col("frm").alias("mid"), "to")
        through = left.join(right, ["id", "node", "mid"], "left").select("id", "node", "frm", F.coalesce("to", "mid").alias("to"))
        past = right.withColumnRenamed("mid", "frm").join(left.select("id", "node", "frm"), ["id", "node", "frm"], "left_anti")
        levels.append(durable.written(through.unionByName(past.select("id", "node", "frm", "to")), "moves"))
        top //= 2
    # Down again: the left child gets what enters the parent, the right one what leaves the left.
    states = start.select("id", F.lit(0).cast("bigint").alias("node"), F.col("start").alias("entering"))
    there = blocks.select("id", F.col("block").alias("node")).distinct()
    for depth in range(len(levels) - 2, -1, -1):
        needed = there.select("id", F.floor(F.col("node") / F.lit(1 << depth)).cast("bigint").alias("node")).distinct()
        children = states.select("id", F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"), "entering")
        children = children.join(needed, ["id", "node"], "left_semi")
        before = levels[depth].select("id", (F.col("node") + 1).alias("node"), F.col("frm").alias("entering"), "to").filter(
            F.pmod(F.col("node"), F.lit(2)) == 1
        )
        states = children.join(before, ["id", "node", "entering"], "left").select(
            "id", "node", F.coalesce("to", "entering").alias("entering")
        )
        states = durable.written(states, "entering")
    return states.withColumnRenamed("node", "block")


def accept_patches(patches: DataFrame, start: DataFrame, width: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """Add ``accepted``, and ``met_rev`` and ``met_clean`` (the state met), to
    ``patches(id, seq, expected_rev, ok, has_data, covers)``.

    ``start(id, rev, clean)`` is the state of each row; ``(id, seq)`` is unique; ``patches`` is read
    more than once, so it should be a written table. Patches without an expected rev or of no known row meet nothing.
    """
    step = F.struct(
        F.col("seq").cast("bigint").alias("seq"),
        F.col("expected_rev").cast("bigint").alias("expected"),
        F.col("ok").alias("ok"),
        F.col("has_data").alias("has_data"),
        F.col("covers").alias("covers"),
    ).cast(STEP)
    state = (F.col("rev").cast("bigint") * 2 + F.col("clean").cast("bigint")).alias("start")
    steps = patches.filter(F.col("expected_rev").isNotNull()).select("id", "seq", step.alias("step"))
    counts = join_by_key(steps.groupBy("id").agg(F.count("*").alias("n")), start.select("id", state), "id")
    counts = durable.written(counts, "chains")
    chain = F.array_sort(F.collect_list("step")).alias("steps")
    few = counts.filter(F.col("n") <= at_once).select("id", "start")
    seen = join_by_key(steps, few, "id").groupBy("id", "start").agg(chain).select("id", _seen_in(F.col("steps"), F.col("start")).alias("_s"))
    many = counts.filter(F.col("n") > at_once).select("id", "start")
    if not many.isEmpty():
        long = steps.join(F.broadcast(many.select("id")) if many.count() <= 100_000 else many.select("id"), "id")
        low = long.agg(F.min("seq")).first()[0]
        block = F.floor((F.col("seq") - low) / F.lit(width)).cast("bigint").alias("block")
        blocks = durable.written(long.groupBy("id", block).agg(chain), "blocks")
        placed = blocks.join(_entering(blocks, many), ["id", "block"])
        seen = seen.unionByName(placed.select("id", _seen_in(F.col("steps"), F.col("entering")).alias("_s")))
    met = seen.select("id", F.explode("_s").alias("_m")).select(
        "id", "_m.seq", F.col("_m.accepted").alias("_yes"), F.col("_m.rev").alias("met_rev"), F.col("_m.clean").alias("met_clean")
    )
    joined = join_by_key(patches, met, ["id", "seq"], "left")
    return joined.withColumn("accepted", F.coalesce("_yes", F.lit(False))).drop("_yes")


def _known_users(patches: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``known_user``; patches that set no assignee are not shuffled."""
    asked = patches.filter("set_assignee").groupBy("assignee").agg(F.count("*").alias("_n"))
    known = asked.join(users.select(F.col("id").alias("assignee")).distinct(), "assignee").withColumn("_known", F.lit(True))
    joined = attach_by_key(patches, known, "assignee", "_n", F.col("seq"))
    fine = ~F.col("set_assignee") | F.col("assignee").isNull() | F.col("_known").isNotNull()
    return joined.withColumn("known_user", fine).drop("_known", "_n")


def judge_patches(
    rows: DataFrame, patches: DataFrame, contract: Contract, users: DataFrame | None = None, width: int = BLOCK,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Every patch with its ``outcome``: accepted, not_found, rev_required, conflict,
    invalid, key_taken or unknown_user, the first that applies; ``met_rev`` is the rev met.

    ``patches(id, seq, expected_rev, data, status, set_assignee, assignee)``; ``seq``
    is the arrival number, unique in the batch. Keys change hands within a batch: a claim
    meets whoever holds the key at its turn (``handover``). The result is a written table, as
    rows, edits and reports all read it.
    """
    current = live(rows).select("id", "rev", F.col("data").alias("row_data"), "row_key")
    cells = canon.cells_of("row_data")
    broken = F.filter(
        F.array(*[F.when(checks.field_error(f, cells(f.key)).isNotNull(), F.lit(f.key)) for f in contract.active]),
        lambda k: k.isNotNull(),
    )
    start = current.select("id", "rev", broken.alias("broken"))
    own = canon.cells_of("data")
    bad = checks.collect(
        [
            checks.error_entry(f.key, F.when(F.map_contains_key("data", f.key), checks.field_error(f, own(f.key))))
            for f in contract.active
        ]
    )
    judged = join_by_key(patches, start, "id", "left")
    has_data = F.col("data").isNotNull()
    bad = F.when(has_data, bad).otherwise(F.array().cast(checks.ERRORS_TYPE))
    judged = judged.withColumns({"errors": bad, "has_data": has_data, "known_user": F.lit(True)})
    if users is not None:
        judged = _known_users(judged, users)
    covers = F.size(F.array_except(F.col("broken"), F.map_keys("data"))) == 0
    judged = judged.withColumn("covers", F.coalesce(covers, F.lit(False)))
    wanted = F.lit(None).cast("string")
    if contract.key_field is not None:
        wanted = text.unquote(F.col("data").getItem(contract.key_field.key))
    ready = durable.written(judged.withColumn("wanted", wanted), "patches")
    states = ready.groupBy("id").agg(
        F.first("rev", ignorenulls=True).alias("rev"), F.first(F.size("broken") == 0, ignorenulls=True).cast("int").alias("clean")
    ).filter(F.col("rev").isNotNull())
    sound = ready.withColumn("ok", (F.size("errors") == 0) & F.col("known_user"))
    alone = contract.key_field is None or sound.filter(F.col("wanted").isNotNull()).isEmpty()
    holders = current.filter(F.col("row_key").isNotNull()).select("id", F.col("row_key").alias("key"))
    settled = None if alone else handover.settled_claims(sound, durable.written(states, "states"), holders)
    if settled is None:
        done = accept_patches(sound, states, width, at_once).withColumn("key_free", F.lit(True))
    else:
        rest = join_by_key(sound, settled.select("id").distinct(), "id", "left_anti")
        done = accept_patches(rest, states, width, at_once).withColumn("key_free", F.lit(True))
        done = done.unionByName(join_by_key(sound, settled, ["id", "seq"]).select(*done.columns))
    breaks = (F.size("errors") > 0) | (F.col("has_data") & (F.col("met_clean") == 0) & ~F.col("covers"))
    outcome = (
        F.when(F.col("rev").isNull(), "not_found")
        .when(F.col("expected_rev").isNull(), "rev_required")
        .when(F.col("accepted"), "accepted")
        .when(F.col("met_rev") != F.col("expected_rev"), "conflict")
        .when(breaks, "invalid")
        .when(~F.col("key_free"), "key_taken")
        .otherwise("unknown_user")
    )
    judged = done.withColumn("outcome", outcome).drop("broken", "known_user", "key_free", "ok", "covers", "wanted", "met_clean")
    return durable.written(judged, "judged")


def accepted_fields(judged: DataFrame) -> DataFrame:
    """``(id, seq, field, new_value)`` of the accepted patches, system fields included."""
    took = judged.filter(F.col("outcome") == "accepted")
    status = F.when(
        F.col("status").isNotNull(), F.struct(F.lit("status").alias("field"), text.quote(F.col("status")).alias("value"))
    )
    assignee = F.when(
        F.col("set_assignee"), F.struct(F.lit("assignee").alias("field"), text.quote(F.col("assignee")).alias("value"))
    )
    data = F.transform(
        F.map_entries(F.coalesce("data", F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.concat(F.lit("data."), e["key"]).alias("field"), e["value"].alias("value")),
    )
    fields = F.concat(data, F.array_compact(F.array(status, assignee)))
    return took.select("id", "seq", F.explode(fields).alias("_f")).select(
        "id", "seq", "_f.field", F.col("_f.value").alias("new_value")
    )


def apply_patches(rows: DataFrame, judged: DataFrame, contract: Contract, user: str, at: Column) -> DataFrame:
    """The rows table after the accepted patches.

    The last accepted value per (row, field) and the count of accepted patches
    are map-side aggregates, so a heavily patched row costs no more than others.
    """
    took = accepted_fields(judged)
    last = took.groupBy("id", "field").agg(F.max_by(F.struct(F.col("new_value").alias("v")), "seq").alias("_last"))
    pairs = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "_last"))).alias("_set"))
    bumps = judged.filter(F.col("outcome") == "accepted").groupBy("id").agg(F.count("*").cast("int").alias("_bumps"))
    joined = rows.join(bumps.join(pairs, "id", "left"), "id", "left")
    fields = F.map_filter("_set", lambda k, _: k.startswith("data."))
    fields = F.transform_keys(fields, lambda k, _: F.substring(k, F.lit(6), F.length(k)))
    fields = F.transform_values(fields, lambda _, v: v["v"])
    data = F.when(F.col("_set").isNull(), F.col("data")).otherwise(canon.merge_patch(F.col("data"), fields))
    status = F.col("_set").getItem("status")
    assignee = F.col("_set").getItem("assignee")
    hit = F.col("_bumps").isNotNull()
    out = {
        "data": data,
        "status": F.coalesce(text.unquote(status["v"]), F.col("status")),
        "assignee": F.when(assignee.isNotNull(), text.unquote(assignee["v"])).otherwise(F.col("assignee")),
        "rev": F.col("rev") + F.coalesce("_bumps", F.lit(0)),
        "updated_by": F.when(hit, F.lit(user)).otherwise(F.col("updated_by")),
        "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
    }
    if contract.key_field is not None:
        changed = F.when(hit & F.col("_set").isNotNull(), text.unquote(data.getItem(contract.key_field.key)))
        out["row_key"] = F.coalesce(changed, F.col("row_key"))
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in rows.columns])


def patch_edits(rows: DataFrame, judged: DataFrame, user: str, at: Column) -> DataFrame:
    """One audit row per field an accepted patch really changed (loose comparison).

    The value before is what the previous accepted patch of that field set, or
    the stored value for the first one.
    """
    took = accepted_fields(judged)
    known = previous_in_group(took, ["id", "field"], "seq", "new_value", "_before")
    stored = live(rows).select("id", F.col("data").alias("_data"), F.col("status").alias("_s"), F.col("assignee").alias("_u"))
    joined = known.join(stored, "id")
    name = F.regexp_replace("field", r"\Adata\.", "")
    initial = (
        F.when(F.col("field") == "status", text.quote(F.col("_s")))
        .when(F.col("field") == "assignee", text.quote(F.col("_u")))
        .otherwise(F.col("_data")[name])
    )
    old = F.when(F.col("_before").isNotNull(), F.col("_before.v")).otherwise(initial)
    changes = joined.withColumn("_old", old).filter(text.loosely_differ(canon.absent(F.col("_old")), canon.absent(F.col("new_value"))))
    return changes.select(
        F.col("id").alias("row_id"),
        "seq",
        name.alias("field"),
        F.col("_old").alias("old_value"),
        "new_value",
        F.lit(user).alias("user_id"),
        at.alias("at"),
    )
