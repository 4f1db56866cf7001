"""Merging an edited extract back, against the same rules worked out row by row in Python.

Stored rows come from the given part table; the extract is edited at random.
"""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.operators import records as ops
from rowsmith.operators import sync
from rowsmith.plans import durable
from rowsmith.sources import readers
from tests.test_changes import table

CONTRACT = Contract.of(
    Field("part", required=True, is_key=True), Field("maker.name", required=True), Field("maker.since", "date"),
    Field("size", "number"), Field("box", "json"),
)


def at():
    return F.lit("2024-01-01").cast("timestamp")


def stored():
    """Live, approved, deleted and oddly stored rows, one per part."""
    parts = duckdb.sql("SELECT p_partkey, p_brand, CAST(p_size AS INT), p_name FROM '/root/testdata/sf0.001/part.parquet' ORDER BY 1").fetchall()
    out = {}
    for key, maker, size, box in parts[:120]:
        data = {"part": json.dumps(f"P{key}"), "maker.name": json.dumps(maker), "size": str(size), "box": json.dumps({"kind": box}, separators=(",", ":"))}
        if key % 6 == 0:
            data["maker.since"] = "null"  # an explicit null, as a patch may leave it
        if key % 10 == 0:
            data["retired"] = "true"  # a column the contract no longer has
        out[f"P{key}"] = {"data": data, "rev": 1 + key % 3, "status": "approved" if key % 2 else "draft", "deleted": key % 17 == 0}
    return out


def edited(rows, seed):
    """(records, pull state): records keep, change, clear or drop fields; some are new or odd."""
    rng = random.Random(seed)
    records, state = [], {}
    for key, row in rows.items():
        if rng.random() < 0.85:
            state[key] = row["rev"] if rng.random() < 0.8 else row["rev"] - 1
        if rng.random() < 0.15:
            continue
        r = {"part": key}
        if rng.random() < 0.8:
            r["maker"] = {"name": json.loads(row["data"]["maker.name"]) if rng.random() < 0.7 else rng.choice(["New", None])}
        if rng.random() < 0.2:
            r.setdefault("maker", {})["since"] = rng.choice(["2024-05-06", "soon", None])
        if rng.random() < 0.6:
            size = json.loads(row["data"]["size"])
            r["size"] = rng.choice([size, size, float(size), None, size + 1])
        if rng.random() < 0.4:
            r["box"] = rng.choice([json.loads(row["data"]["box"]), {"b": [1.50, "x"], "a": None}, None, "text"])
        records.append(r)
    records += [{"part": "N1", "maker": {"name": "m"}}, {"part": "N2"}, {"part": "N1", "size": 4}, {"size": 3}, [1], {"part": "  "}]
    return records, state


CANON = {"sort_keys": True, "separators": (",", ":"), "ensure_ascii": False}
FIELDS = ["part", "maker.name", "maker.since", "size", "box"]


def flat(record):
    out = {}
    for k, v in record.items():
        if k == "maker" and isinstance(v, dict):
            out.update({f"maker.{x}": y for x, y in v.items()})
        else:
            out[k] = v
    return out


def valid_date(v):
    return v == "2024-05-06"


def expected(records, rows, state, force=False):
    """(op, changed fields) per record number, and the live rows afterwards."""
    ops_, fields, after, seen = {}, {}, {k: dict(r["data"]) for k, r in rows.items() if not r["deleted"]}, set()
    for i, record in enumerate(records, 1):
        sent = flat(record) if isinstance(record, dict) else None
        key = sent.get("part") if sent else None
        if sent is None or not isinstance(key, str) or not key.strip() or key in seen:
            ops_[i] = "error"
            continue
        seen.add(key)
        texts = {k: json.dumps(v, **CANON) for k, v in sent.items()}
        row = rows.get(key)
        live = row and not row["deleted"]
        old = {k: v for k, v in (row["data"] if live else {}).items() if v != "null"}
        merged = {k: texts.get(k, old.get(k)) for k in FIELDS}
        merged = {k: v for k, v in merged.items() if v not in (None, "null")}
        broken = "maker.name" not in merged or ("maker.since" in merged and not valid_date(json.loads(merged["maker.since"])))
        differ = [k for k in sorted(FIELDS) if k in texts and old.get(k) != merged.get(k)]
        if not live and row and not force and key in state:
            ops_[i] = "deleted"
        elif not live:
            ops_[i] = "error" if broken else "create"
        elif not differ:
            ops_[i] = "unchanged"
        elif state.get(key) != row["rev"] and not force:
            ops_[i] = "conflict"
        else:
            ops_[i] = "error" if broken else "update"
        if ops_[i] in ("create", "update", "conflict"):
            fields[i] = [(k, old.get(k), merged.get(k)) for k in differ]
        if ops_[i] in ("create", "update"):
            kept = {k: v for k, v in (row["data"] if live else {}).items() if k not in texts}
            after[key] = kept | {k: v for k, v in merged.items() if k in texts}
    return ops_, fields, after


def rows_table(spark, rows):
    return table(spark, [(f"id-{k}", r["data"] | {"id": json.dumps(k)}, r["status"], r["rev"], r["deleted"]) for k, r in rows.items()]).withColumn(
        "data", F.map_filter("data", lambda k, _: k != "id")
    )


def state_table(spark, state):
    return spark.createDataFrame([(k, v, None) for k, v in state.items()], "row_key string, rev int, base_hash string")


def read(spark, records, how):
    lines = [(i, json.dumps(r)) for i, r in enumerate(records, 1)]
    df = spark.createDataFrame(lines, "row_idx bigint, line string")
    if how == "known":
        return ops.known_cells(readers.check_lines(df, F.col("line"), F.col("row_idx")), CONTRACT)
    return ops.flatten_records(df, CONTRACT.json_keys)


@pytest.mark.parametrize(("seed", "force", "how"), [(1, False, "flat"), (2, True, "known"), (3, False, "known")])
def test_plan_against_python(spark, seed, force, how):
    rows = stored()
    records, state = edited(rows, seed)
    plan = sync.plan_sync(read(spark, records, how), rows_table(spark, rows), state_table(spark, state), CONTRACT, force)
    want_ops, want_fields, _ = expected(records, rows, state, force)
    got = {r.row_idx: r for r in plan.collect()}
    assert {i: r.op for i, r in got.items()} == want_ops
    assert {i: [tuple(f) for f in r.fields] for i, r in got.items() if r.fields} == {i: f for i, f in want_fields.items() if f}


def test_apply_writes_all_or_nothing(spark):
    rows = stored()
    records, state = edited(rows, 4)
    ops_, _, _ = expected(records, rows, state, True)
    good = [r for i, r in enumerate(records, 1) if ops_[i] != "error"]
    before = rows_table(spark, rows)
    for batch, applied in ((records, False), (good, True)):
        plan = durable.written(sync.plan_sync(read(spark, batch, "flat"), before, state_table(spark, state), CONTRACT, True), "plan")
        result = sync.apply_sync(plan, before, CONTRACT, "d", "u", at())
        assert result.applied == applied
        live = {r.row_key: dict(r.data) for r in result.rows.filter("deleted_at is null").collect()}
        want = expected(batch, rows, state, True)[2] if applied else {k: r["data"] for k, r in rows.items() if not r["deleted"]}
        assert live == want
    changed = plan.filter("op = 'update'").select("row_key").collect()
    revs = {r.row_key: (r.rev, r.status) for r in result.rows.filter("deleted_at is null").collect()}
    assert all(revs[r.row_key] == (rows[r.row_key]["rev"] + 1, "needs_review" if rows[r.row_key]["status"] == "approved" else "draft") for r in changed)
    dry = sync.apply_sync(plan, before, CONTRACT, "d", "u", at(), dry_run=True)
    assert not dry.applied and dry.state.count() == 0


def test_unknown_paths_block_unless_ignored(spark):
    rows = stored()
    key = next(k for k, r in rows.items() if not r["deleted"])
    records = [{"part": key, "size": 99, "colour": "red", "maker": {"town": "X"}}, {"part": "N", "maker": {"name": "m"}}]
    for how in ("flat", "known"):
        source, before = read(spark, records, how), rows_table(spark, rows)
        plan = durable.written(sync.plan_sync(source, before, state_table(spark, {}), CONTRACT, True), "plan")
        assert sync.is_blocked(plan) and not sync.apply_sync(plan, before, CONTRACT, "d", "u", at()).applied
        found = {(r.path, r.records) for r in sync.unknown_path_report(plan).collect()}
        assert found == {("colour", 1), ("maker.town", 1)}
        plan = durable.written(sync.plan_sync(source, before, state_table(spark, {}), CONTRACT, True, ignore_unknown=True), "plan")
        assert sync.apply_sync(plan, before, CONTRACT, "d", "u", at()).applied
        assert {r.reason for r in sync.unknown_path_report(plan).collect()} == {sync.IGNORED}


def test_an_extract_sent_back_changes_nothing(spark):
    before = rows_table(spark, stored())
    lines = [json.loads(r.line) for r in sync.extract_rows(before, CONTRACT).orderBy("row_key").collect()]
    plan = sync.plan_sync(read(spark, lines, "known"), before, sync.pull_state(before, CONTRACT), CONTRACT)
    assert {r.op for r in plan.collect()} == {"unchanged"}
    assert all(list(line)[0] == "part" for line in lines)


def test_only_the_server_moved(spark):
    rows = stored()
    before = rows_table(spark, rows)
    pulled = sync.pull_state(before, CONTRACT)
    moved = before.withColumn("rev", F.col("rev") + 1).withColumn("data", F.map_concat(F.map_filter("data", lambda k, _: k != "size"), F.create_map(F.lit("size"), F.lit("7"))))
    lines = [json.loads(r.line) for r in sync.extract_rows(before, CONTRACT).collect()]
    plan = durable.written(sync.plan_sync(read(spark, lines, "flat"), moved, pulled, CONTRACT), "plan")
    assert {r.op for r in plan.collect()} <= {"server_newer", "unchanged"} and not sync.has_local_edits(plan)


def test_not_in_file_and_summary(spark):
    rows = stored()
    records, state = edited(rows, 5)
    before = rows_table(spark, rows)
    plan = durable.written(sync.plan_sync(read(spark, records, "flat"), before, state_table(spark, state), CONTRACT), "plan")
    sent = {r.get("part") for r in records if isinstance(r, dict)}
    absent = {k for k, r in rows.items() if not r["deleted"]} - sent
    assert {r.row_key for r in sync.not_in_file(plan, before).collect()} == absent
    counts = {r.measure: r.n for r in sync.summary(plan, before).collect()}
    ops_ = list(expected(records, rows, state)[0].values())
    assert counts["not_in_file"] == len(absent) and all(counts[o] == ops_.count(o) for o in set(ops_))


def test_state_tables(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "row_key string, rev int, base_hash string")
    new = spark.createDataFrame([("b", 2, None), ("c", 1, "z")], "row_key string, rev int, base_hash string")
    got = {r.row_key: (r.rev, r.base_hash) for r in sync.overlay_state(old, new).collect()}
    assert got == {"a": (1, "x"), "b": (2, None), "c": (1, "z")}
    assert [r.row_key for r in sync.forget_keys(old, new).collect()] == ["a"]
