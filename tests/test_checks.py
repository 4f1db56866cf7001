"""Coercion and validation tables with literal inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.functions import canon, checks, jsonrules
from rowsmith.operators import importing
from rowsmith.operators import records as ops

ORDER = Contract.of(
    Field("code"), Field("total", "number"), Field("paid", "boolean"), Field("labels", "multi_select", options=("new", "big")),
    Field("extra", "json"), Field("grade", "select", options=("A", "7")), Field("due", "date"),
)


def imported(spark, records, contract=ORDER, **kw):
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records, 1)], "row_idx bigint, line string")
    flat = ops.flatten_records(lines, contract.json_keys)
    mapping = {k: k for k in contract.active_keys}
    mapped = importing.map_rows(flat, mapping, contract, lambda k: F.col("rec")[k], structured=True)
    return importing.check_rows(mapped, contract, **kw)


# (column, source value, stored text, reason): one record each.
TYPED = [
    ("code", 12, "12", None),
    ("code", 1.50, "1.5", None),
    ("code", False, "false", None),
    ("code", [[0]], None, "map this to a json column"),
    ("total", " 3.0 ", 3.0, None),
    ("total", "-1e2", -100.0, None),
    ("total", "lots", "lots", "expected a number, got str"),
    ("total", [1], None, "map this to a json column"),
    ("paid", "YES", True, None),
    ("paid", 0, False, None),
    ("paid", 3, 3, "expected a boolean, got int"),
    ("labels", "new, big", ["new", "big"], None),
    ("labels", ["big", "old"], ["big", "old"], "['old'] not in ['new', 'big']"),
    ("extra", [2, {"b": 1.0, "a": None}], [2, {"a": None, "b": 1.0}], None),
    ("extra", "plain", "plain", None),
    ("grade", 7, "7", None),
    ("grade", "B", "B", "'B' is not one of ['A', '7']"),
    ("due", "\t2024-12-31\n", "2024-12-31", None),
    ("due", "31.12.2024", "31.12.2024", "expected a date as YYYY-MM-DD, got '31.12.2024'"),
    ("due", "2024-12-31 10:00", None, "'2024-12-31 10:00' has a time component"),
    ("due", 2024, None, "2024 is a number, not a date (write YYYY-MM-DD)"),
]


def test_typed_cells(spark):
    checked = imported(spark, [{column: value} for column, value, _, _ in TYPED])
    data = {r.row_idx: r.data for r in checked.select("row_idx", importing.data_of(checked).alias("data")).collect()}
    errors = {r.row_idx: (r.column, r.reason) for r in importing.error_report(checked).collect()}
    for i, (column, value, stored, reason) in enumerate(TYPED, 1):
        assert errors.get(i) == (None if reason is None else (column, reason)), value
        if stored is not None:
            assert data[i] == {column: json.dumps(stored, separators=(",", ":"))}, value


KEYED = Contract.of(Field("id", required=True, is_key=True), Field("n", "number", required=True))


def test_claims_skips_fixes_and_accounting(spark):
    records = [
        {"id": "a", "n": 1},  # taken
        {"id": "b", "n": "x"},  # invalid, still claims
        {"id": "b", "n": 2},  # duplicate of 2
        {"id": "c", "n": 3},  # skipped: claims nothing
        {"id": "c", "n": 4},  # created
        {"id": "a", "n": 5},  # duplicate of 1, not also existing
        {"id": " ", "n": 6},
        {"id": " d", "n": 7},
        7,
    ]
    existing = spark.createDataFrame([("a",), (None,)], "row_key string")
    skip = spark.createDataFrame([(4,)], "row_idx bigint")
    checked = imported(spark, records, KEYED, existing=existing, skip=skip)
    got = {}
    for r in importing.error_report(checked).collect():
        got.setdefault(r.row_idx, []).append((r.column, r.reason))
    assert got == {
        1: [("id", "key 'a' already exists — use rows push to update")],
        2: [("n", "expected a number, got str")],
        3: [("id", "duplicate key 'b' in file (also row 2)")],
        6: [("id", "duplicate key 'a' in file (also row 1)")],
        7: [("id", "required")],
        8: [("id", "key value must not have leading or trailing whitespace")],
        9: [("", "record is not an object")],
    }
    assert importing.accounting(checked).first().asDict() == {"total": 9, "created": 1, "skipped": 1, "errored": 7, "errors": 7}


def test_rows_of_several_files(spark):
    """Numbers repeat from file to file; claims, skips, fixes, ids and times tell the rows apart."""
    rows = [("f1", 1, "a", "1"), ("f1", 2, "b", "1"), ("f1", 3, "s", "1"), ("f2", 1, "a", "1"), ("f2", 2, "c", "x"), ("f2", 3, "d", "1"), ("f10", 1, "b", "1")]
    df = spark.createDataFrame(rows, "file string, row_idx bigint, id string, n string")
    mapped = importing.map_rows(df, {"id": "id", "n": "n"}, KEYED, F.col)
    skip = spark.createDataFrame([("f1", 3)], "file string, row_idx bigint")
    fixes = spark.createDataFrame([("f2", 2, "n", "7", 1), ("f2", 2, "n", "8", 2), ("f2", 3, "m", "1", 1)], "file string, row_idx bigint, key string, value string, seq int")
    checked = importing.check_rows(importing.apply_fixes(mapped, fixes, KEYED), KEYED, skip=skip)
    errors = {(r.file, r.row_idx): r.reason for r in importing.error_report(checked).collect()}
    assert errors == {
        ("f2", 1): "duplicate key 'a' in file (also row 1 of f1)",
        ("f10", 1): "duplicate key 'b' in file (also row 2 of f1)",
        ("f2", 3): "not a schema column",
    }
    empty = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in importing.ROW_COLUMNS.items()))
    table, _, counts = importing.commit_import(checked, KEYED, empty, "d", "u", F.current_timestamp())
    made = table.orderBy("created_at").collect()
    assert [r.row_key for r in made] == ["a", "b", "c"] and len({r.id for r in made}) == 3 and len({r.created_at for r in made}) == 3
    assert made[2].data["n"] == "8" and [r.id for r in table.orderBy("created_at").collect()] == [r.id for r in made]
    assert counts.first().skipped == 1
    with pytest.raises(ValueError):
        importing.check_rows(mapped, KEYED, skip=skip.select("row_idx"))
    unordered = spark.createDataFrame([("f2", 2, "n", "7"), ("f2", 2, "n", "8")], "file string, row_idx bigint, key string, value string")
    again = importing.check_rows(importing.apply_fixes(mapped, unordered, KEYED), KEYED)
    assert ("f2", 2, "n", "several different fixes") in [tuple(r) for r in importing.error_report(again).collect()]


def test_only_live_rows_hold_keys(spark):
    from tests.test_changes import table

    rows = table(spark, [("1", {"id": '"a"'}, "draft", 1, True), ("2", {"id": '"b"'}, "draft", 1, False)])
    checked = imported(spark, [{"id": "a", "n": 1}, {"id": "b", "n": 1}], KEYED, existing=rows)
    assert [r.row_idx for r in importing.error_report(checked).collect()] == [2]


def test_preview(spark):
    df = spark.createDataFrame([(1, " a ", "5", "z"), (2, "b", "many", "z"), (3, "b", "1", "z")], "row_idx bigint, ID string, n string, other string")
    found = importing.preview(df, ["ID", "n", "other"], KEYED, F.col, limit=2)
    assert {(r.source, r.key) for r in found.mapping.collect()} == {("ID", "id"), ("n", "n")}
    assert [(r.row_idx, r.cells, r.outcome) for r in found.sample.collect()] == [(1, '{"id":" a ","n":5}', "errored"), (2, '{"id":"b","n":"many"}', "errored")]
    assert found.counts.first().asDict() == {"total": 3, "created": 0, "skipped": 0, "errored": 3, "errors": 3}


def test_fixes_cancel_failures(spark):
    lines = spark.createDataFrame([(1, "2024-01-02T03:00"), (2, "2024-01-02T03:00"), (3, "x")], "row_idx bigint, day string")
    contract = Contract.of(Field("day", "date", required=True))
    mapped = importing.map_rows(lines, {"day": "day"}, contract, F.col)
    fixes = spark.createDataFrame([(1, "day", '" 2024-05-06 "'), (2, "day", "5"), (3, "day", None)], "row_idx bigint, key string, value string")
    checked = importing.check_rows(importing.apply_fixes(mapped, fixes, contract), contract)
    errors = {r.row_idx: r.reason for r in importing.error_report(checked).collect()}
    assert errors == {2: "5 is a number, not a date (write YYYY-MM-DD)", 3: "required"}


def test_hot_key_import_is_whole(spark):
    """A third of the rows share one key; every one of them is reported."""
    n = 30_000
    df = spark.range(1, n + 1).select(
        F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("id"), F.lit("1").alias("n")
    )
    mapped = importing.map_rows(df, {"id": "id", "n": "n"}, KEYED, F.col)
    checked = importing.check_rows(mapped, KEYED)
    assert importing.accounting(checked).first().errored == n // 3 - 1
    assert importing.error_report(checked).filter("reason = \"duplicate key 'hot' in file (also row 3)\"").count() == n // 3 - 1


def test_empty_rules(spark):
    cases = [('""', "text", True), ('" \\n"', "text", True), ("[]", "multi_select", True), ("[]", "json", False), ('""', "json", False),
             ("null", "json", True), ("0", "number", False), ("{}", "json", False), ('"　"', "select", True)]
    rows = [
        spark.createDataFrame([(t,)], "t string").select(checks.is_empty(F.col("t"), type_).alias("e")).first().e for t, type_, _ in cases
    ]
    assert rows == [c[2] for c in cases]


def test_json_cell_cap(spark):
    field = Field("j", "json")
    near = '["' + "x" * (checks.JSON_CELL_MAX_BYTES - 4) + '"]'
    over = '["' + "x" * (checks.JSON_CELL_MAX_BYTES - 5) + '",1]'
    rows = spark.createDataFrame([(near,), (over,)], "t string").select(checks.type_error(field, F.col("t")).alias("e")).collect()
    assert rows[0].e is None
    assert rows[1].e == f"value is {len(over) + 1} bytes; the limit is {checks.JSON_CELL_MAX_BYTES}"


CALLS = {
    "type": "array",
    "items": {"$ref": "#/$defs/call"},
    "$defs": {
        "call": {
            "type": "object", "required": ["name"], "additionalProperties": False,
            "properties": {"name": {"type": "string", "minLength": 1, "pattern": "^[a-z]+$"}, "args": {"anyOf": [{"type": "null"}, {"type": "object"}]}, "n": {"type": "integer", "minimum": 1, "exclusiveMaximum": 5}},
        }
    },
}


@pytest.mark.parametrize(
    "value, error",
    [
        ([], None),
        ([{"name": "a", "args": {"x": 1}, "n": 4}, {"name": "b", "args": None, "n": 1.0}], None),
        ({"name": "a"}, "is not of type 'array'"),
        ([{"name": "a"}, {"args": {}}], "[1]: 'name' is a required property"),
        ([{"name": "A"}], "[0].name: \"A\" does not match"),
        ([{"name": "a", "n": 1.5}], "[0].n: 1.5 is not of type 'integer'"),
        ([{"name": "a", "n": 5}], "[0].n: 5 is greater than or equal to"),
        ([{"name": "a", "args": 3}], "[0].args: 3 is not valid under any"),
        ([{"name": "a", "zz": 3}], "[0]: Additional properties are not allowed ('zz' unexpected)"),
    ],
)
def test_json_schema(spark, value, error):
    df = spark.createDataFrame([(json.dumps(value),)], "t string")
    got = df.select(jsonrules.schema_error(F.col("t"), json.dumps(CALLS)).alias("e")).first().e
    assert got is None if error is None else error in got


def test_json_schema_refuses_what_it_cannot_check(spark):
    for schema in ({"uniqueItems": True}, {"$ref": "https://example.org/x"}, {"$ref": "#", "type": "object"}, {"$ref": "#/$defs/none"}):
        with pytest.raises(jsonrules.UnsupportedSchema):
            jsonrules.check_schema(json.dumps(schema))


def test_rules_agree_with_the_document(spark):
    """A row that passes the rules also fits the contract document."""
    contract = Contract.of(Field("t", required=True), Field("n", "number"), Field("m", "multi_select", options=("a",)), Field("j", "json", required=True))
    rows = [
        {"t": '"x"', "n": "1", "m": '["a","a"]', "j": "[]"}, {"t": '"x"', "n": '""', "m": "[]", "j": '""'}, {"t": '"x"', "j": "0"},
        {"t": '"x"', "n": "null", "j": "{}"}, {"t": '""', "j": "1"}, {"t": '"x"', "j": "null"}, {"t": '"x"', "n": "true", "j": "1"},
        {"t": '"x"', "m": '["b"]', "j": "1"}, {"t": "5", "j": "1"}, {"j": "1"},
    ]
    df = spark.createDataFrame([(r,) for r in rows], "data map<string,string>")
    got = df.select(F.size(checks.row_errors(canon.cells_of("data"), contract)).alias("a"), F.size(checks.document_errors(F.col("data"), contract)).alias("b")).collect()
    assert [(r.a > 0, r.b > 0) for r in got] == [(i >= 4, i >= 4) for i in range(len(rows))]


def test_parsed_records_are_made_once(spark):
    """A source that gives other keys each time it is read: claims and rows must see the same ones."""
    any_key = F.udf(lambda: f'"{random.randrange(4)}"').asNondeterministic()
    mapped = spark.range(200).select(F.col("id").alias("row_idx"), F.lit(None).cast("string").alias("problem"), any_key().alias("cell:id"))
    mapped = mapped.withColumn("failures", F.array().cast(checks.ERRORS_TYPE))
    rows = importing.check_rows(mapped, Contract.of(Field("id", required=True, is_key=True))).select("row_idx", "cell:id", "outcome").collect()
    firsts = {}
    for r in sorted(rows, key=lambda r: r.row_idx):
        firsts.setdefault(r["cell:id"], r.row_idx)
    assert len(rows) == 200 and {r.row_idx for r in rows if r.outcome == "created"} == set(firsts.values())
