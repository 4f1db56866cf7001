"""Options kept as rows."""

import time

import pytest
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.operators import contracts, importing, options
from rowsmith.operators.records import known_cell, known_cells
from rowsmith.plans import durable, sieve, skew
from rowsmith.sources import readers
from tests.test_records import flat

CONTRACT = Contract.of(
    Field("id", required=True, is_key=True),
    Field("kind", "select", options_table=True, required=True),
    Field("n", "number"),
    Field("tags", "multi_select", options_table=True),
)
LISTED = Contract.of(*[
    Field(f.key, f.type, required=f.required, is_key=f.is_key, options={"kind": ("a", "b"), "tags": ("x", "y")}.get(f.key)) for f in CONTRACT.fields
])
LINES = [
    '{"id":"1","kind":"a","n":1,"tags":["x","y"]}', '{"id":"2","kind":"z","n":"no","tags":["x","q","r","q"]}', '{"id":"3","kind":"","tags":[]}',
    '{"id":"4","kind":5,"tags":"x"}', '{"id":"5","kind":"b","tags":[1]}', '{"id":"6","kind":"A","tags":null}', "nonsense", '{"id":"1","kind":"q"}',
    '{"id":"8","kind":"x","tags":["a"]}',
]


def checked(spark, tmp_path, contract, allowed=None):
    path = tmp_path / "lines.jsonl"
    path.write_text("\n".join(LINES) + "\n")
    cells = known_cells(readers.read_jsonl(spark, str(path)), contract)
    mapped = importing.map_rows(cells, {k: k for k in contract.active_keys}, contract, known_cell, structured=True)
    rows = importing.check_rows(mapped, contract, options=allowed).select("row_idx", "outcome", "errors").collect()
    return {r.row_idx: (r.outcome, [(e["column"], e["reason"]) for e in r.errors]) for r in rows}


@pytest.mark.parametrize("small", [True, False])
def test_a_table_judges_like_a_list(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(skew, "is_small", lambda _: small)
    allowed = options.listed(spark, LISTED)
    found = checked(spark, tmp_path, CONTRACT, allowed)
    wanted = checked(spark, tmp_path, LISTED)
    names = {"['a', 'b']": "the options", "['x', 'y']": "the options"}

    def plain(reason):
        for a, b in names.items():
            reason = reason.replace(f"of {a}", f"of {b}").replace(f"in {a}", f"in {b}").replace(f"from {a}", f"from {b}")
        return reason

    assert found == {k: (o, [(c, plain(r)) for c, r in errors]) for k, (o, errors) in wanted.items()}
    assert found[2] == ("errored", [("kind", "'z' is not one of the options"), ("n", found[2][1][1][1]), ("tags", "['q', 'r', 'q'] not in the options")])
    assert {o for o, _ in found.values()} == {"created", "errored"}


def test_a_hot_value_and_many_options(spark):
    rows = spark.range(3_000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 == 0, F.lit('"gone"')).otherwise(F.concat(F.lit('"o'), "id", F.lit('"'))).alias("kind"))
    contract = Contract.of(Field("kind", "select", options_table=True))
    allowed = spark.range(3_000).select(F.lit("kind").alias("column"), F.concat(F.lit("o"), "id").alias("option"))
    found = options.option_errors(options.unknown_values(rows, F.col, contract, allowed, ["row_idx"]), contract, ["row_idx"])
    assert {(r.row_idx, r.reason) for r in found.collect()} == {(i, "'gone' is not one of the options") for i in range(0, 3_000, 3)}


def test_options_are_sorted_by_a_number(spark, monkeypatch):
    """Texts of one column begin alike, so sorting 20 options a value by them compared whole rows."""
    plans, kept = [], options.skew.attach_by_key

    def attach(rows, facts, *rest, **more):
        plans.append(facts._jdf.queryExecution().executedPlan().toString())
        return kept(rows, facts, *rest, **more)

    monkeypatch.setattr(options.skew, "attach_by_key", attach)
    monkeypatch.setattr(options.skew, "is_small", lambda _: False)
    rows = spark.createDataFrame([(1, '["a","b,c"]'), (2, '[]'), (3, '["q\\"","x"]'), (4, '["1:a"]')], "row_idx long, tags string")
    contract = Contract.of(Field("tags", "multi_select", options_table=True))
    allowed = spark.createDataFrame([("tags", "a"), ("tags", "x"), ("tags", "x"), (None, "b,c"), ("tags", None), ("other", "1:a")], options.SCHEMA)
    found = options.unknown_values(rows, F.col, contract, allowed, ["row_idx"]).collect()
    assert {r.row_idx: r["values"] for r in found} == {1: ["b,c"], 3: ['q"'], 4: ["1:a"]}
    sorts = [line for line in plans[0].splitlines() if "Sort [" in line]
    assert len(sorts) == 2 and all("Sort [xxhash64(" in line for line in sorts)


def shuffles(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for i in range(blocks.size()) if (b := blocks.apply(i).name()).startswith("shuffle_")}


@pytest.mark.parametrize("keys", [1 << 26, 100])
@pytest.mark.parametrize("small", [True, False])
def test_only_options_near_a_value_are_shuffled(spark, monkeypatch, keys, small):
    """Twenty options a value, as rows of a join, filled the disk."""
    met, kept = [], sieve.passed

    def passed(rows, key, held):
        out = kept(rows, key, held)
        if key == ["column", "option"]:
            met.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(sieve, "passed", passed)
    monkeypatch.setattr(sieve, "KEYS", keys)
    monkeypatch.setattr(skew, "is_small", lambda _: small)
    contract = Contract.of(Field("kind", "select", options_table=True), Field("tags", "multi_select", options_table=True))
    rows = spark.range(500).select(
        F.col("id").alias("row_idx"), F.concat(F.lit('"o'), F.col("id") % 400 * 21, F.lit('"')).alias("kind"), F.lit('["o0","t","u","t"]').alias("tags")
    )
    allowed = spark.range(8_000).select(F.lit("kind").alias("column"), F.concat(F.lit("o"), "id").alias("option"))
    allowed = allowed.unionByName(spark.createDataFrame([("tags", "u"), ("tags", None), (None, "t")], options.SCHEMA))
    found = options.unknown_values(rows, F.col, contract, allowed, ["row_idx"]).collect()
    wanted = {(i, "tags"): ["o0", "t", "t"] for i in range(500)} | {(i, "kind"): [f"o{i % 400 * 21}"] for i in range(500) if i % 400 * 21 >= 8_000}
    assert {(r.row_idx, r["column"]): r["values"] for r in found} == wanted and len(found) == len(wanted)
    assert len(met) == (1 if keys > 1000 else 5) and sum(a for a, _ in met) == 8_003
    assert 380 <= sum(b for _, b in met) < 1_600


def test_a_sieve_keeps_every_key(spark):
    keys = spark.range(0, 60_000, 3).select(F.concat(F.lit("k"), "id").alias("k"))
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), "id")).alias("k"))
    through = {r.id for r in sieve.sifted(rows, keys, "k").collect()}
    hit = {i for i in range(0, 60_000, 3) if i % 7}
    assert hit <= through and all(i % 7 for i in through)
    assert len(through) < len(hit) + 0.2 * 40_000


def test_lean_tables_leave_no_shuffles(spark):
    rows = spark.range(5_000).groupBy((F.col("id") % 1_000).alias("k")).agg(F.count("*").alias("n"))
    before = shuffles(spark)
    with durable.briefly(rows, "brief") as table:
        path = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.agg(F.sum("n")).first()[0] == 5_000 and durable.exists(spark, path)
    assert not durable.exists(spark, path)
    assert durable.written(rows, "lean", lean=True).count() == 1_000
    assert spark.conf.get(durable.FREE_SETTING, "false") == "false"
    until = time.time() + 20
    while (left := {b.split("_")[1] for b in shuffles(spark) - before}) and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 2  # of the sum and the count, which are not written


def test_drafting_keeps_options_as_rows(spark, monkeypatch):
    records = [{"id": f"{i}", "tags": [f"t{i}", f"t{i % 3}"]} for i in range(20)]
    contract, rows, _ = contracts.draft_with_options(flat(spark, records))
    assert contract.field("tags").options_table and contract.field("tags").options is None
    assert sorted(tuple(r) for r in rows.collect()) == sorted(("tags", f"t{i}") for i in range(20))
    listed, _ = contracts.draft_contract(flat(spark, records))
    assert listed.field("tags").options == tuple(sorted(f"t{i}" for i in range(20))) and not listed.field("tags").options_table
    monkeypatch.setattr(contracts, "MOST_OPTIONS", 19)
    with pytest.raises(ValueError, match="keep them as rows"):
        contracts.draft_contract(flat(spark, records))


def test_columns_table_keeps_the_choice(spark):
    back = Contract.from_columns(CONTRACT.to_columns(spark, "d"), "d")
    assert back == Contract(tuple(f if f.label else f for f in CONTRACT.fields))
    old = Contract.from_columns(CONTRACT.to_columns(spark, "d").drop("options_table"), "d")
    assert not old.field("kind").options_table
