"""File scans, record rules, flattening and nesting."""

import json
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.functions import canon
from rowsmith.operators import contracts
from rowsmith.operators import records as ops
from rowsmith.sources import readers


def flat(spark, records, leaves=()):
    lines = [(i, json.dumps(r)) for i, r in enumerate(records, 1)]
    return ops.flatten_records(spark.createDataFrame(lines, "row_idx bigint, line string"), leaves)


def texts_of(record, leaves=(), above=""):
    """Dotted path to canonical text, worked out by hand."""
    out = {}
    for name, value in record.items():
        path = f"{above}{name}"
        if isinstance(value, dict) and value and path not in leaves:
            out |= texts_of(value, leaves, f"{path}.")
        else:
            out[path] = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return out


ODD_STRINGS = ["{x", "[1]", '{"a":1}', "null", "1.0", "\\", '"', "\x1f\n", "é", "🙂", "", 'a: "b"', "\u2028"]


def any_value(rng, depth=0):
    """A random JSON value; floats have at most 15 digits, which every writer spells alike."""
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -1, 7, 10**18, -(10**30), rng.randrange(10**6)])
    if kind == 2:
        return rng.choice([0.5, -0.0, 1.0, 1e16, 1e-5, 0.0001, 1e22, round(rng.uniform(-1e6, 1e6), 4), 1.5e300])
    if kind < 5:
        return rng.choice(ODD_STRINGS)
    if kind == 5:
        return [any_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "c", "x y", "é", "b-c", "_"]): any_value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_flat_texts_against_python(spark):
    rng = random.Random(20)
    records = [{rng.choice(["a", "b", "c", "d", "z z"]): any_value(rng) for _ in range(rng.randrange(5))} for _ in range(600)]
    for leaves in ((), ("a", "b.c")):
        got = {r.row_idx: r for r in flat(spark, records, leaves).collect()}
        for i, record in enumerate(records, 1):
            assert got[i].problem is None
            want = texts_of(record, leaves)
            assert got[i].rec == want, record
            assert got[i].paths == list(want)


def test_nesting_undoes_flattening(spark):
    docs = duckdb.sql("SELECT doc_id, lang, source, n_chars FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1 LIMIT 40").fetchall()
    records = [{"key": f"d{i}", "text": {"lang": lang, "size": {"chars": n}}, "from": source} for i, lang, source, n in docs]
    keys = ["key", "text.lang", "text.size.chars", "text.size.words", "nowhere.at.all", "from"]
    lines = flat(spark, records).select(
        "row_idx", canon.nested_text(canon.cells_of("rec"), keys).alias("sorted"), canon.nested_text(canon.cells_of("rec"), keys, ordered=True).alias("ordered")
    )
    for r in lines.collect():
        record = records[r.row_idx - 1]
        assert r.sorted == json.dumps(record, sort_keys=True, separators=(",", ":"))
        assert r.ordered == json.dumps(record, separators=(",", ":"))


@pytest.mark.parametrize("keys", [["a", "a.b"], ["a.b", "a"], ["a..b"], ["a", "a"]])
def test_nest_refuses_clashes(spark, keys):
    with pytest.raises(ValueError):
        canon.nested_text(canon.cells_of("rec"), keys)


def test_literal_dotted_key_and_leaves(spark):
    got = flat(spark, [{"a.b": 1, "m": {"x": {"y": 1}}, "e": {}}], leaves=["m"]).first()
    assert got.rec == {"a.b": "1", "m": '{"x":{"y":1}}', "e": "{}"}
    clash = flat(spark, [{"a.b": 1, "a": {"b": 2}}]).first()
    assert clash.problem == "path 'a.b' appears twice"
    assert flat(spark, [{"a..b": 1}]).first().problem == "invalid path 'a..b': empty segment"


BAD_LINES = {
    '{"k": "v"}': None,
    "": "blank",
    '   ': "blank",
    '{"k": "v"': "invalid JSON",
    '{"k": 1} {"k": 2}': "invalid JSON",
    '{"k": 01}': "invalid JSON",
    '{"k": Infinity}': "invalid JSON",
    '{"k": [1, NaN]}': "invalid JSON",
    '{"k": "a\tb"}': "invalid JSON",
    '"{}"': "record is not an object",
    "null": "record is not an object",
    '[{"k": 1}]': "record is not an object",
    "17": "record is not an object",
    '{"k": 1, "l": 2, "k": 3}': "duplicate key 'k'",
    '{"k": {"m": [0, {"x": 1, "x": 2}]}, "l": {"y": 1, "y": 1}}': "duplicate key 'x'",
    '{"k": "\\"l\\": 1, \\"l\\": 2"}': None,
    '{"k": "{oops", "l": "[", "m": "}"}': None,
    '{"k": -0.5, "l": "\\u00e9", "m": 1e3}': None,
}


def test_line_problems(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\ufeff" + "\n".join(BAD_LINES) + "\n", encoding="utf-8")
    rows = readers.read_jsonl(spark, str(tmp_path)).collect()
    want, number = [], 0
    for i, reason in enumerate(BAD_LINES.values(), 1):
        if reason != "blank":
            number += 1
            want.append((number, i, f"line {i}: {reason}" if reason == "invalid JSON" else reason))
    assert sorted((r.row_idx, r.line_number, r.problem) for r in rows) == want


def test_a_megabyte_of_prose_is_one_quick_record(spark):
    words = "It ended. Then, nothing. e.g. 1.5 " * 30_000
    line = json.dumps({"id": "x", "a.b": 1, "text": words})
    plain = json.dumps({"id": "x", "text": words})
    df = spark.createDataFrame([(1, line), (2, plain)], "row_idx bigint, line string")
    started = time.perf_counter()
    rows = ops.known_cells(readers.check_lines(df, F.col("line"), F.col("row_idx")), Contract.of(Field("id"), Field("text"))).collect()
    assert time.perf_counter() - started < 15
    assert all(r["json:text"] == json.dumps(words) and r.problem is None for r in rows)


def test_numbers_across_splits_and_files(spark, tmp_path):
    for f, n in (("a", 3000), ("b", 500)):
        body = "\n".join("" if i % 7 == 0 else f'{{"i":{i}}}' for i in range(1, n + 1))
        (tmp_path / f"{f}.jsonl").write_text(body)
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = readers.read_jsonl(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        rows = scan.select(F.regexp_extract("file", r"(\w)\.jsonl", 1).alias("f"), "row_idx", "line_number", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    for f, n in (("a", 3000), ("b", 500)):
        kept = [i for i in range(1, n + 1) if i % 7]
        got = sorted((r.row_idx, r.line_number, json.loads(r.line)["i"]) for r in rows if r.f == f)
        assert got == [(k, i, i) for k, i in enumerate(kept, 1)]


def test_csv_cells_stay_raw(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Q,Q,"a ""b"""\n 1 ,,"two\nlines"\nshort\nx,y,z,extra\n')
    header, rows = readers.read_csv(spark, str(tmp_path), multi_line=True)
    assert header == ["Q", "Q", 'a "b"']
    got = [tuple(r) for r in rows.orderBy("row_idx").select("row_idx", "_c0", "_c1", "_c2").collect()]
    assert got == [(1, " 1 ", "", "two\nlines"), (2, "short", "", ""), (3, "x", "y", "z")]


def test_csv_odd_headers(spark, tmp_path):
    (tmp_path / "x.csv").write_text('\ufeffid,"two\nlines",,a.b\n1,2,3,4\n', encoding="utf-8")
    header, rows = readers.read_csv(spark, str(tmp_path), multi_line=True)
    assert header == ["id", "two\nlines", "", "a.b"]
    assert [tuple(r) for r in rows.select("row_idx", "_c0", "_c1", "_c2", "_c3").collect()] == [(1, "1", "2", "3", "4")]


def test_csv_files_with_another_header_are_reported(spark, tmp_path):
    for name, body in (("a", "x,y\n1,2\n3,4\n"), ("b", "y,x\n5,6\n"), ("c", "x,y\n7\n"), ("d", "x,y\n")):
        (tmp_path / f"{name}.csv").write_text(body)
    header, rows = readers.read_csv(spark, str(tmp_path))
    assert header == ["x", "y"]
    got = {(r.file[-5], r.row_idx): (r._c0, r._c1, r.problem) for r in rows.collect()}
    assert got[("a", 1)] == ("1", "2", None) and got[("a", 2)] == ("3", "4", None) and got[("c", 1)] == ("7", "", None)
    assert got[("b", 1)][2].endswith("y,x") and len(got) == 4


def write_docs(tmp_path, docs):
    for name, body in docs.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    return str(tmp_path)


def by_file(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.file.rsplit("/", 1)[1], []).append((r.row_idx, r.line, r.problem))
    return {k: sorted(v) for k, v in out.items()}


def test_documents_to_records(spark, tmp_path):
    path = write_docs(
        tmp_path,
        {
            "mixed.json": '[{"w": 2.50}, "{\\"w\\": 1}", null, true, [{"w": 1}], {"w": "x"}]',
            "named.json": '{"about": {"by": "me"}, "parts": [{"w": 1}], "tags": ["a"]}',
            "stored.json": '{"rows": [{"w": 1}], "manifest": {"n": 1}, "parts": [{"w": 9}]}',
            "unclear.json": '{"left": [{"w": 1}], "right": [], "n": 4}',
            "lines.json": '{"w": 1}\n{"w": 2}\n',
            "again.json": '{"parts": [{"w": 1, "x": {"y": 1, "y": 2}}, {"w": 2}]}',
            "keys.json": '{"parts": [], "more": 1, "parts": [{"w": 1}]}',
            "none.json": "\n \n",
            "nothing.json": "null",
            "text.json": '"[{}]"',
            "broken.json": '[{"w": 1},]',
            "lists.json": '{"parts": "[{}]", "about": "{}"}',
        },
    )
    got = by_file(ops.locate_records(readers.read_json_docs(spark, path)))
    refused = "record is not an object"
    assert [(r[0], r[2]) for r in got["mixed.json"]] == [(1, None), (2, refused), (3, refused), (4, refused), (5, refused), (6, None)]
    assert got["mixed.json"][0][1] == '{"w":2.5}' and got["mixed.json"][1][1] == '"{\\"w\\": 1}"'
    assert got["named.json"] == [(1, '{"w":1}', None)] == got["stored.json"]
    assert got["unclear.json"][0][2].endswith("(lists found: left, right)")
    assert "save it as .jsonl" in got["lines.json"][0][2]
    assert [(r[0], r[2]) for r in got["again.json"]] == [(1, "duplicate key 'y'"), (2, None)]
    assert got["keys.json"][0][2] == "duplicate top-level key 'parts'"
    assert "none.json" not in got and "nothing.json" not in got
    assert got["text.json"][0][2].startswith("expected a list of records") and got["broken.json"][0][2] == "invalid JSON"
    assert got["lists.json"][0][2].endswith("choose a records_key")
    chosen = by_file(ops.locate_records(readers.read_json_docs(spark, path + "/unclear.json"), "left"))
    assert chosen["unclear.json"] == [(1, '{"w":1}', None)]


def test_export_lines_are_unwrapped_per_file(spark, tmp_path):
    lines = {
        "export.json": '[{"data": {"w": 1}, "id": "a", "status": "draft"}, {"id": "b", "status": "draft", "data": {"w": {"x": 1, "x": 2}}}]',
        "string.json": '[{"data": {"w": 1}, "id": "a", "status": "draft"}, {"data": "{oops", "id": "b", "status": "draft"}]',
        "extra.json": '[{"data": {"w": 1}, "id": "a", "status": "draft", "more": 1}]',
        "twice.json": '[{"data": {"w": 1}, "id": "a", "status": "draft", "id": "b"}]',
    }
    got = by_file(ops.read_records(readers.read_json_docs(spark, write_docs(tmp_path, lines))))
    assert got["export.json"][0] == (1, '{"w":1}', None) and got["export.json"][1][2] == "duplicate key 'x'"
    assert [r[2] for r in got["string.json"]] == [None, None] and '"{oops"' in got["string.json"][1][1]
    assert '"more"' in got["extra.json"][0][1] and got["twice.json"][0][2] == "duplicate key 'id'"


def test_gates(spark, tmp_path):
    (tmp_path / "ok.txt").write_bytes("é".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "big.txt").write_bytes(b"x" * 100)
    got = {r.file.rsplit("/", 1)[1]: r.reason for r in readers.gate_files(spark, str(tmp_path), max_bytes=50).collect()}
    assert got == {"ok.txt": None, "bad.txt": "file is not UTF-8", "big.txt": "file is larger than 50 bytes"}


def test_draft_contract(spark):
    records = [
        {"id": "a", "when": "2024-01-02", "tags": ["x", "y"], "meta": {"n": 1, "deep-label_x": True}, "note": None, "mixed": 1},
        {"id": "b", "when": "2024-99-99", "tags": [], "meta": {"n": 2.5}, "note": None, "mixed": "s"},
    ]
    contract, warnings = contracts.draft_contract(flat(spark, records))
    assert [(f.key, f.type) for f in contract.fields] == [
        ("id", "text"), ("when", "date"), ("tags", "multi_select"), ("meta.n", "number"), ("meta.deep-label_x", "boolean"),
        ("note", "text"), ("mixed", "json"),
    ]
    assert contract.key_field.key == "id" and contract.field("tags").options == ("x", "y")
    assert contract.field("meta.deep-label_x").label == "Deep label x"
    assert warnings == ["note: only nulls seen - check type"]


def test_known_cells_equal_flattened_cells(spark):
    contract = Contract.of(
        Field("a"), Field("b.c", "number"), Field("b.d.e"), Field("j", "json"), Field("k.j", "json"), Field("t", "multi_select", options=("x",)), Field("gone.x"),
    )
    contract = Contract(contract.fields + (Field("gone", "json", archived=True),))
    rng = random.Random(7)
    leaves = [1, 1.0, 1.5, -0.0, 1e22, 12345678901234567890, 0.1, 1e-7, True, None, "x", "", "é\n\"q\"", "a.b", "\x1f", [], ["x", "y"], [1.0, {"z": 1, "a": None}], {}, {"q": 1.0}]

    def some():
        return rng.choice(leaves)

    lines = []
    for _ in range(400):
        r = {}
        for name in ("a", "j", "t", "u", "gone"):
            if rng.random() < 0.7:
                r[name] = some()
        if rng.random() < 0.8:
            r["b"] = rng.choice([{"c": some(), "d": {"e": some()}}, {"d": some()}, some()])
        if rng.random() < 0.5:
            r["k"] = {"j": some()}
        if rng.random() < 0.2:
            r[rng.choice(["b.c", "b.d.e", "k.j", "a..b", ""])] = some()
        lines.append(json.dumps(r, ensure_ascii=rng.random() < 0.3))
    lines += ["[1]", '{"a":1', '{"a":1,"a":2}', '{"a":1} x', '{"b":{"c":1,"c":2}}', '{"a": 1.50, "b": {"c": 1E3}, "j": [1.50, 1e3]}']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "row_idx bigint, line string")
    flat = {r.row_idx: r for r in ops.flatten_records(df, contract.json_keys).collect()}
    checked = readers.check_lines(df, F.col("line"), F.col("row_idx"))
    for r in ops.known_cells(checked, contract).collect():
        want = flat[r.row_idx]
        assert (r.problem or "").split(": ")[-1] == (want.problem or "").split(": ")[-1], r.line
        for k in contract.active_keys:
            got, exact = r[f"json:{k}"], (want.rec or {}).get(k)
            assert got == exact, (r.line, k)
        assert (r.unknown or []) == [p for p in want.paths or [] if p not in contract.active_keys], r.line


def test_contract_round_trips_through_its_table(spark):
    contract = Contract.of(Field("id", required=True, is_key=True, label="Id"), Field("s", "select", options=("a", "b")))
    assert Contract.from_columns(contract.to_columns(spark, "d"), "d") == contract
    assert [c["key"] for c in json.loads(contract.snapshot_json())["columns"]] == ["id", "s"]
    with pytest.raises(ValueError):
        Field("x", "datetime")
