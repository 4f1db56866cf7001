"""Keys that change hands within a batch of patches.

A claim is a patch that sets its row's key. It meets whoever holds the key at its turn: another
holder refuses it; once accepted, its row gives back the key it held. So whether a claim
passes may depend on earlier claims, those on others, and so on. Nothing is guessed and redone:

1. A key is *contested* if a row asks for it that is not alone in asking for or holding it. All
   other claims find their key free and need no ordering between rows.
2. A *simple* row has a single patch, a claim, and holds no contested key; it never gives anything
   back. Between two other events of its key at most the first sound one of such claims can pass, so
   that one stands for all of them, however many rows ask for one key.
3. What is left is cut into components of rows and keys that share claims. A component is settled
   once, in the order of arrival, by a fold that keeps a rev a row and a holder a key.

A component of rows that each claim several contested keys in turns is sequential by its nature: it streams
through one task in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.plans import durable
from rowsmith.plans.components import components
from rowsmith.plans.skew import attach_by_key, join_by_key, last_before

TOGETHER = 100_000  # patches up to this count are one component without looking for smaller ones
_OUT = "id string, seq bigint, accepted boolean, met_rev bigint, met_clean bigint, key_free boolean"


def _contested(claims: DataFrame, holders: DataFrame) -> DataFrame:
    """``(key, n, holder)`` of keys whose claims depend on more than one row."""
    asked = claims.groupBy(F.col("wanted").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b"))
    held = join_by_key(asked, holders.select("key", F.col("id").alias("holder")), "key", "left")
    return held.filter((F.col("a") != F.col("b")) | (F.col("holder") != F.col("a"))).select("key", "n", "holder")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patches in (component, seq) order, each judged by the revs and holders that the ones before it left."""
    names = ("component", "id", "seq", "expected_rev", "ok", "has_data", "covers", "wanted", "rev", "clean", "own", "holder")
    component, state, key_of, owner = None, {}, {}, {}
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for at, id, seq, expected, ok, has_data, covers, wanted, rev, clean, own, holder in zip(
            *(b.column(n).to_pylist() for n in names), strict=True
        ):
            if at != component:
                component, state, key_of, owner = at, {}, {}, {}
            if id not in state:
                state[id], key_of[id] = (rev, clean), own
                if own is not None:
                    owner.setdefault(own, id)
            if wanted is not None:
                owner.setdefault(wanted, holder)
            free = wanted is None or owner[wanted] is None or owner[wanted] == id
            met = state[id]
            known = met[0] is not None and expected is not None
            accepted = bool(known and met[0] == expected and ok and free and (not has_data or met[1] == 1 or covers))
            if accepted:
                state[id] = (met[0] + 1, 1 if has_data else met[1])
                if wanted is not None and key_of[id] != wanted:
                    if key_of[id] is not None and owner.get(key_of[id]) == id:
                        owner[key_of[id]] = None
                    key_of[id], owner[wanted] = wanted, id
            for x, value in zip(out, (id, seq, accepted, met[0] if known else None, met[1] if known else None, free), strict=True):
                x.append(value)
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_())
        columns = [n.split()[0] for n in _OUT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=columns)


def _with_components(rows: DataFrame) -> DataFrame:
    """``rows`` with ``component``: rows and keys that share claims, also through keys rows hold, get the same one."""
    if rows.limit(TOGETHER + 1).count() <= TOGETHER:
        return rows.withColumn("component", F.lit(""))
    node = F.concat(F.lit("r"), "id").alias("u")
    shared = rows.filter("shares").select(node, F.concat(F.lit("k"), "wanted").alias("v"))
    kept = rows.filter("keeps").select(node, F.concat(F.lit("k"), "own").alias("v"))
    found = components(shared.unionByName(kept)).filter(F.col("node").startswith("r"))
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    facts = join_by_key(sizes, found.select(F.substring("node", 2, 1 << 30).alias("id"), "component"), "id", "left")
    facts = facts.select("id", "n", F.coalesce("component", F.concat(F.lit("r"), "id")).alias("component"))
    return attach_by_key(rows, facts, "id", "n", F.col("seq")).drop("n")


def settled_claims(patches: DataFrame, states: DataFrame, holders: DataFrame) -> DataFrame | None:
    """``(id, seq, accepted, met_rev, met_clean, key_free)`` of all patches of rows that contest a key.

    ``patches(id, seq, expected_rev, ok, has_data, covers, wanted)``, ``states(id, rev, clean)`` and
    ``holders(id, key)`` before the batch. None if no key is contested; patches of other rows depend on
    their own row only.
    """
    claims = patches.filter(F.col("wanted").isNotNull()).select("id", "seq", "wanted")
    contested = durable.written(_contested(claims, holders), "contested")
    if contested.isEmpty():
        return None
    keys = contested.select(F.col("key").alias("wanted"), "n", "holder")
    shared = attach_by_key(claims, keys, "wanted", "n", F.col("seq"), how="inner")
    shared = durable.written(shared.select("id", "seq", "wanted", "holder"), "shared-claims")
    held = join_by_key(holders, contested.select("key"), "key", "left_semi").select("id", F.col("key").alias("kept"))
    # Rows that claim a contested key, and those that may give one back.
    movers = join_by_key(held, claims.select("id").distinct(), "id", "left_semi").select("id")
    concerned = durable.written(shared.select("id").unionByName(movers).distinct(), "concerned")
    slim = patches.select("id", F.col("seq").cast("bigint").alias("seq"), F.col("expected_rev").cast("bigint").alias("expected_rev"), "ok", "has_data", "covers", "wanted")
    known = states.select("id", F.col("rev").cast("bigint").alias("rev"), F.col("clean").cast("bigint").alias("clean"))
    rows = join_by_key(join_by_key(slim, concerned, "id", "left_semi"), known, "id", "left")
    rows = join_by_key(join_by_key(rows, holders.select("id", F.col("key").alias("own")), "id", "left"), held, "id", "left")
    rows = join_by_key(rows, shared.select("id", "seq", "holder", F.lit(True).alias("_shares")), ["id", "seq"], "left")
    rows = rows.withColumns({"shares": F.coalesce("_shares", F.lit(False)), "keeps": F.col("kept").isNotNull()}).drop("_shares", "kept")
    counts = rows.groupBy("id").agg(F.count("*").alias("_n"))
    rows = attach_by_key(rows, counts, "id", "_n", F.col("seq"))
    rows = durable.written(rows.withColumn("simple", (F.col("_n") == 1) & F.col("shares") & ~F.col("keeps")).drop("_n"), "concerned-patches")

    simple, others = rows.filter("simple"), rows.filter("not simple")
    # Events of a key that are no simple claims: claims of other rows, and any patch with which a holder may leave.
    came = others.filter("shares").select(F.col("wanted").alias("key"), "seq")
    claiming = others.filter(F.col("wanted").isNotNull())
    took = others.filter("shares").select("id", F.col("wanted").alias("key"))
    took = took.unionByName(others.filter("keeps").select("id", F.col("own").alias("key"))).distinct()
    went = join_by_key(claiming.select("id", "seq", "wanted"), took, "id").filter(F.col("key") != F.col("wanted")).select("key", "seq")
    events = came.unionByName(went).distinct().select("key", F.col("seq").alias("at"), F.col("seq").alias("event"))
    none = F.lit(None).cast("bigint")
    asked = simple.select(F.col("wanted").alias("key"), F.col("seq").alias("at"), none.alias("event"))
    placed = last_before(events.unionByName(asked), ["key"], "at", "event", "after").filter(F.col("event").isNull())
    placed = placed.select(F.col("key").alias("wanted"), F.col("at").alias("seq"), F.coalesce("after", F.lit(-1)).alias("after"))
    simple = durable.written(join_by_key(simple, placed, ["wanted", "seq"]), "simple-claims")
    fits = (F.col("rev") == F.col("expected_rev")) & F.col("ok") & (~F.col("has_data") | (F.col("clean") == 1) | F.col("covers"))
    sound = F.coalesce(fits, F.lit(False))
    chosen = simple.groupBy("wanted", "after").agg(
        F.coalesce(F.min(F.when(sound, F.col("seq"))), F.min("seq")).alias("first"), F.count("*").alias("n")
    )
    chosen = durable.written(chosen.withColumn("stretch", F.concat_ws(":", "after", "wanted")), "stretches")
    first = join_by_key(simple, chosen.select("wanted", F.col("first").alias("seq")), ["wanted", "seq"], "left_semi").drop("after")

    folded = _with_components(others.unionByName(first)).repartition("component").sortWithinPartitions("component", "seq")
    found = durable.written(folded.drop("shares", "keeps", "simple").mapInArrow(_fold, _OUT), "folded")
    ahead = join_by_key(chosen, found.select(F.col("seq").alias("first"), "accepted", "key_free"), "first")
    late = simple.withColumn("stretch", F.concat_ws(":", "after", "wanted")).drop("n")
    late = attach_by_key(late, ahead.select("stretch", "n", "first", "accepted", "key_free"), "stretch", "n", F.col("seq"))
    late = late.filter(F.col("seq") != F.col("first"))
    free = F.col("key_free") & ((F.col("seq") < F.col("first")) | ~F.col("accepted"))
    known = F.col("rev").isNotNull() & F.col("expected_rev").isNotNull()
    late = late.select("id", "seq", F.lit(False).alias("accepted"), F.when(known, F.col("rev")).alias("met_rev"), F.when(known, F.col("clean")).alias("met_clean"), free.alias("key_free"))
    return durable.written(found.unionByName(late), "settled")
