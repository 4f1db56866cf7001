"""Patches, deletion, creation and skew helpers against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.functions import checks
from rowsmith.operators import contracts, patches, rows
from rowsmith.operators.importing import ROW_COLUMNS
from rowsmith.plans.skew import attach_by_key, attach_salted, previous_in_group

CONTRACT = Contract.of(Field("id", required=True, is_key=True), Field("q", required=True), Field("n", "number"))
SCHEMA = ", ".join(f"{k} {v}" for k, v in ROW_COLUMNS.items())
PATCH = "id string, seq bigint, expected_rev int, data map<string,string>, status string, set_assignee boolean, assignee string"


def at():
    return F.lit("2024-01-01").cast("timestamp")


def table(spark, items):
    """items: (id, data, status, rev, deleted)."""
    out = [
        (i, "d", data, status, None, data.get("id", "").strip('"') or None, rev, "u", None, None, None, None) for i, data, status, rev, _ in items
    ]
    df = spark.createDataFrame(out, SCHEMA)
    gone = [i for i, *_, deleted in items if deleted]
    return df.withColumn("deleted_at", F.when(F.col("id").isin(gone), at())).withColumn("created_at", at())


def patch(id_, seq, rev, data=None, status=None, set_assignee=False, assignee=None):
    return (id_, seq, rev, data, status, set_assignee, assignee)


def brute(state, batch):
    """Sequential acceptance, one patch at a time."""
    ok = {}
    for id_, seq, expected, *_ in sorted(batch, key=lambda p: (p[0], p[1])):
        if expected is not None and state[id_] == expected:
            state[id_] += 1
            ok[id_, seq] = True
    return ok


@pytest.mark.parametrize("width", [1, 3, 7, 512])
def test_acceptance_matches_brute_force(spark, width):
    rng = random.Random(width)
    ids = ["hot"] * 200 + [f"r{i}" for i in range(20)] * 4
    items = [(i, {"id": f'"{i}"', "q": '"x"'}, "draft", 1 + k % 3, False) for k, i in enumerate(dict.fromkeys(ids))]
    start = {i: rev for i, _, _, rev, _ in items}
    batch = [patch(i, s, rng.choice([None, *range(1, 12)]) if i != "hot" else rng.randrange(1, 60), status="approved") for s, i in enumerate(ids)]
    want = brute(dict(start), batch)
    judged = patches.judge_patches(table(spark, items), spark.createDataFrame(batch, PATCH), CONTRACT, width=width, at_once=12)
    got = {(r.id, r.seq) for r in judged.filter("outcome = 'accepted'").collect()}
    assert got == set(want)
    after = patches.apply_patches(table(spark, items), judged, CONTRACT, "u", at())
    assert {r.id: r.rev for r in after.collect()} == {i: start[i] + sum(1 for k in want if k[0] == i) for i in start}


def test_unclean_rows_need_a_covering_patch(spark):
    items = [("a", {"id": '"a"', "n": '"bad"'}, "draft", 1, False)]
    batch = [
        patch("a", 1, 1, {"n": "5"}),  # q is still missing
        patch("a", 2, 1, {"n": "5", "q": '"ok"'}),
        patch("a", 3, 2, {"n": "6"}),
        patch("a", 4, 3, {"q": "null"}),  # would empty a required column
        patch("a", 5, 3, None, "approved"),
    ]
    for width in (2, 512):
        judged = patches.judge_patches(table(spark, items), spark.createDataFrame(batch, PATCH), CONTRACT, width=width)
        got = {r.seq: r.outcome for r in judged.collect()}
        assert got == {1: "invalid", 2: "accepted", 3: "accepted", 4: "invalid", 5: "accepted"}
        row = patches.apply_patches(table(spark, items), judged, CONTRACT, "u", at()).first()
        assert (row.rev, row.status, row.data) == (4, "approved", {"id": '"a"', "n": "6", "q": '"ok"'})


def keyed_by_hand(items, batch):
    """Outcomes one patch at a time, with keys that change hands."""
    state = {i: {"rev": rev, "key": data["id"].strip('"')} for i, data, _, rev, gone in items if not gone}
    out = {}
    for id_, seq, expected, data, *_ in sorted(batch, key=lambda p: p[1]):
        row = state.get(id_)
        if row is None:
            out[seq] = "not_found"
        elif expected != row["rev"]:
            out[seq] = "conflict"
        elif data["id"] == '""':
            out[seq] = "invalid"
        elif any(r["key"] == data["id"].strip('"') for i, r in state.items() if i != id_):
            out[seq] = "key_taken"
        else:
            out[seq] = "accepted"
            row["rev"], row["key"] = row["rev"] + 1, data["id"].strip('"')
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_keys_change_hands_within_a_batch(spark, seed):
    rng = random.Random(seed)
    items = [(f"r{i}", {"id": f'"k{i}"', "q": '"x"'}, "draft", 1, i == 5) for i in range(12)]
    revs = {f"r{i}": 1 for i in range(12)}
    batch = []
    for seq in range(60):
        i = f"r{rng.randrange(12)}"
        batch.append(patch(i, seq, revs[i] if rng.random() < 0.8 else 1, {"id": rng.choice([f'"k{rng.randrange(14)}"', '""'] if seq % 9 == 0 else [f'"k{rng.randrange(14)}"'])}))
        if keyed_by_hand(items, batch)[seq] == "accepted":
            revs[i] += 1
    judged = patches.judge_patches(table(spark, items), spark.createDataFrame(batch, PATCH), CONTRACT)
    assert {r.seq: r.outcome for r in judged.collect()} == keyed_by_hand(items, batch)
    after = patches.apply_patches(table(spark, items), judged, CONTRACT, "u", at()).filter("deleted_at is null")
    keys = [r.row_key for r in after.collect()]
    assert len(set(keys)) == len(keys)


def test_every_delete_request_gets_an_outcome(spark):
    items = [("a", {"id": '"a"'}, "draft", 3, False), ("b", {"id": '"b"'}, "draft", 1, True)]
    asked = [("a", 1, 2), ("a", 2, None), ("a", 3, 3), ("a", 4, 3), ("b", 5, 1), ("c", 6, 1)]
    after, outcome, log = rows.soft_delete(table(spark, items), spark.createDataFrame(asked, "id string, seq long, expected_rev int"), "u", at())
    assert {r.seq: r.outcome for r in outcome.collect()} == {
        1: "conflict", 2: "rev_required", 3: "deleted", 4: "not_found", 5: "not_found", 6: "not_found",
    }
    assert log.count() == 1 and after.filter("deleted_at is null").count() == 0


def test_outcomes_and_audit(spark):
    items = [
        ("a", {"id": '"a"', "q": '"x"', "n": "1"}, "draft", 1, False),
        ("b", {"id": '"b"', "q": '"x"'}, "draft", 2, False),
        ("z", {"id": '"z"', "q": '"x"'}, "draft", 1, True),
    ]
    users = spark.createDataFrame([("u1",)], "id string")
    batch = [
        patch("a", 1, 1, {"n": "1.0"}),  # accepted, rev moves, no audit row
        patch("a", 2, 2, {"n": "2", "q": '"y"'}, "approved"),
        patch("a", 3, 3, {"n": "3"}, "draft", True, "u1"),
        patch("a", 4, 3, {"n": "4"}),  # stale
        patch("b", 5, None, {"n": "4"}),
        patch("b", 6, 2, None, None, True, "nobody"),
        patch("b", 7, 2, {"id": '"a"'}),
        patch("b", 8, 2, {"n": "null"}),
        patch("z", 9, 1, {"n": "1"}),
    ]
    judged = patches.judge_patches(table(spark, items), spark.createDataFrame(batch, PATCH), CONTRACT, users)
    assert {r.seq: r.outcome for r in judged.collect()} == {
        1: "accepted", 2: "accepted", 3: "accepted", 4: "conflict", 5: "rev_required", 6: "unknown_user", 7: "key_taken", 8: "accepted", 9: "not_found",
    }
    log = patches.patch_edits(table(spark, items), judged, "u", at()).collect()
    assert sorted((r.seq, r.field, r.old_value, r.new_value) for r in log) == [
        (2, "n", "1.0", "2"), (2, "q", '"x"', '"y"'), (2, "status", '"draft"', '"approved"'),
        (3, "assignee", None, '"u1"'), (3, "n", "2", "3"), (3, "status", '"approved"', '"draft"'),
    ]
    after = {r.id: r for r in patches.apply_patches(table(spark, items), judged, CONTRACT, "u", at()).collect()}
    assert (after["a"].rev, after["a"].status, after["a"].assignee, after["a"].data["n"]) == (4, "draft", "u1", "3")
    assert after["b"].data == {"id": '"b"', "q": '"x"', "n": "null"}  # a patch stores an explicit null


def test_bulk_delete_is_all_or_nothing(spark):
    items = [(i, {"id": f'"{i}"', "q": '"x"'}, "draft", 1, i == "c") for i in "abc"]
    t = table(spark, items)
    keys = spark.createDataFrame([("a",), ("c",)], "row_key string")
    after, missing, log = rows.bulk_delete(t, "u", at(), keys=keys)
    assert [r.row_key for r in missing.collect()] == ["c"] and log.count() == 0
    assert after.filter("deleted_at IS NULL").count() == 2
    after, missing, log = rows.bulk_delete(t, "u", at(), ids=spark.createDataFrame([("a",), ("a",)], "id string"))
    assert missing.count() == 0 and log.count() == 1
    assert {r.id: r.rev for r in after.collect()} == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        rows.bulk_delete(t, "u", at())


def test_edits_between_states(spark):
    before = table(spark, [("a", {"id": '"a"', "n": "1"}, "draft", 1, False)])
    after = table(spark, [("a", {"id": '"a"', "n": "1.0", "q": '"x"'}, "approved", 2, True)])
    loose = {(r.field, r.old_value, r.new_value) for r in rows.edits_of(before, after, "u", at()).collect()}
    assert loose == {("q", None, '"x"'), ("status", '"draft"', '"approved"'), ("deleted", "false", "true")}
    strict = rows.edits_of(before, after, "u", at(), strict=True).filter("field = 'n'").collect()
    assert [(r.old_value, r.new_value) for r in strict] == [("1", "1.0")]


def test_audit_log_only_grows(spark, tmp_path):
    from rowsmith.sources.snapshots import append_edits

    before = table(spark, [("a", {"id": '"a"'}, "draft", 1, False)])
    after = table(spark, [("a", {"id": '"a"'}, "approved", 2, False)])
    path = str(tmp_path / "edits")
    for old, new in ((before, after), (after, before)):
        append_edits(rows.edits_of(old, new, "u", at()), path)
    log = spark.read.parquet(path).collect()
    assert sorted((r.field, r.old_value, r.new_value) for r in log) == [
        ("status", '"approved"', '"draft"'), ("status", '"draft"', '"approved"'),
    ]


def test_text_search_escapes_nothing(spark):
    t = table(spark, [("a", {"id": '"a"', "q": '"50% off"'}, "draft", 1, False), ("b", {"id": '"b"', "q": '"Half_off"'}, "draft", 1, False)])
    assert [r.id for r in rows.text_search(t, CONTRACT, "HALF_").collect()] == ["b"]
    assert rows.text_search(t, CONTRACT, "%").count() == 2
    assert rows.text_search(t, CONTRACT, "").count() == 2
    assert rows.text_search(t, Contract.of(Field("n", "number")), "x").count() == 0


def test_attach_by_key_keeps_every_row(spark):
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 100)).alias("k")
    )
    facts = df.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    for attach in (attach_by_key, attach_salted):
        joined = attach(df, facts, "k", "n", F.col("id"))
        assert joined.count() == 20_000
        assert joined.filter("k = 'hot'").select("n").distinct().collect()[0].n == facts.filter("k = 'hot'").first().n
        assert joined.filter("k IS NULL AND n IS NOT NULL").count() == 0
        assert attach(df, facts, "k", "n", F.col("id"), "inner").count() == df.filter("k IS NOT NULL").count()


def test_salting_spreads_a_hot_key(spark):
    df = spark.range(4_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    facts = df.groupBy("k").agg(F.count("*").alias("n"))
    salted = attach_salted(df, facts.filter("n > 1"), "k", "n", F.col("id"))
    assert salted.filter("n IS NOT NULL").count() == df.filter("k = 'hot'").count()


def test_two_hundred_heavy_keys(spark):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 200)).alias("k"))
    facts = df.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    joined = attach_salted(df, facts, "k", "n", F.col("id"), per_task=50)
    assert joined.count() == 60_000 and joined.select("id").distinct().count() == 60_000
    want = {r.k: r.n for r in facts.collect()}
    assert joined.filter("k IS NOT NULL").groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("c")).filter("n <> c").count() == 0
    assert len(want) == 200 and joined.filter("k IS NULL AND n IS NOT NULL").count() == 0


def test_large_fact_sets_are_not_broadcast(spark, monkeypatch):
    from rowsmith.plans import skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    df = spark.range(300).select("id", F.concat(F.lit("k"), F.col("id") % 100).alias("k"))
    facts = df.groupBy("k").agg(F.count("*").alias("n"))
    assert not skew.is_small(facts)
    assert attach_by_key(df, facts, "k", "n", F.col("id")).filter("n = 3").count() == 300


def test_facts_past_the_bound_stay_off_the_driver(spark):
    from rowsmith.plans import durable

    df = spark.range(300).select("id", F.concat(F.lit("k"), F.col("id") % 100).alias("k"))
    facts = durable.written(df.groupBy("k").agg(F.count("*").alias("n")), "facts")
    joined = attach_salted(df, facts, "k", "n", F.col("id"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan  # the heavy keys alone are broadcast
    assert joined.filter("n = 3").count() == 300


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_previous_in_group(spark, width):
    rng = random.Random(width)
    data = [(g, s, rng.choice([None, "x", "y"])) for g in "ab" for s in rng.sample(range(200), 60)]
    df = spark.createDataFrame(data, "g string, s bigint, v string")
    got = {(r.g, r.s): r.p for r in previous_in_group(df, ["g"], "s", "v", "p", width).collect()}
    for g in "ab":
        before = None
        for _, s, v in sorted((x for x in data if x[0] == g), key=lambda x: x[1]):
            assert (got[g, s] is None) == (before is None)
            assert before is None or got[g, s].v == before[0]
            before = (v,)


def test_create_rows_and_rekey(spark):
    items = [("a", {"id": '"a"', "q": '"x"'}, "draft", 1, False), ("c", {"id": '"c"', "q": '"x"'}, "draft", 1, True)]
    new = spark.createDataFrame(
        [(1, {"id": '"a"', "q": '"x"'}), (2, {"id": '"c"', "q": '"x"'}), (3, {"id": '"c"', "q": '"y"'}), (4, {"q": '"x"'})],
        "row_idx bigint, data map<string,string>",
    )
    after, rejected = rows.create_rows(table(spark, items), new, CONTRACT, "d", "me", at())
    made = after.filter("updated_by = 'me'").collect()
    assert [(r.row_key, r.rev, r.status) for r in made] == [("c", 1, "draft")]
    assert {r.row_idx: r.reason for r in rejected.collect()} == {
        1: "key 'a' already exists", 3: "key 'c' already exists", 4: "column 'id': required",
    }
    with pytest.raises(ValueError):
        contracts.rekey(after, "q")
    again = rows.create_rows(table(spark, items), new, CONTRACT, "d", "me", at())[0].filter("updated_by = 'me'").first().id
    assert again == made[0].id
    assert checks.options_text(Field("x", "select", options=("a",))) == "['a']"
