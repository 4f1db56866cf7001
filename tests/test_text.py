"""JSON texts against Python's own rendering."""

import json
import random

from pyspark.sql import functions as F

from rowsmith.functions import coerce, text

STRINGS = ["a", "", 'q"x\\y', "n\nt\tr\rb\bf\f", "\x01\x1f\x0b\x00z\x7f", "é😀\u2028", "\\u001F\x1f", "mix\x02\"\\\n", "  x ", "a/b </s>", "\x7f\u2029", "x" * 5000]


def test_quote_and_unquote_match_json(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    for r in df.select("s", text.quote(F.col("s")).alias("q"), text.unquote(text.quote(F.col("s"))).alias("u")).collect():
        assert r.q == json.dumps(r.s, ensure_ascii=False)
        assert r.u == r.s


def test_strip_removes_unicode_whitespace(spark):
    raw = ["\u3000 x\x1c", "\xa0\t", "a b", "\u200ay\x85"]
    got = spark.createDataFrame([(s,) for s in raw], "s string").select(text.strip(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == [s.strip() for s in raw]


def test_is_present_agrees_with_strip(spark):
    raw = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(s,) for s in raw], "s string").select("s", text.is_present(F.col("s")).alias("p")).collect()
    assert [r.s for r in rows if r.p != (r.s.strip() != "")] == []


def test_blank_reads_escaped_whitespace(spark):
    raw = ["", " ", "\n\t\u3000\x1c", "x", "\\n", " a"]
    rows = spark.createDataFrame([(s,) for s in raw], "s string").select(text.is_blank(text.quote(F.col("s"))).alias("b")).collect()
    assert [r.b for r in rows] == [s.strip() == "" for s in raw]


def test_blank_and_list_patterns_survive_long_texts(spark):
    df = spark.createDataFrame([(" " * 200_000,), ('a"' * 100_000,)], "s string")
    rows = df.select(text.is_blank(text.quote(F.col("s"))).alias("b"), text.stored_size(text.quote(F.col("s"))).alias("n")).collect()
    assert [r.b for r in rows] == [True, False]
    assert rows[1].n == len(json.dumps('a"' * 100_000))


def test_float_text_matches_json(spark):
    rng = random.Random(3513)
    values = [rng.randrange(-10**9, 10**9) / 100 for _ in range(400)]
    values += [1e16, 1e-7, 1.5e-5, 12345678.5, 1e7, 0.0001, 0.00123, 123456789012345.0, 1e15, 2.5e20, -3.0, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.float_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [json.dumps(r.x) for r in rows]


def test_number_text(spark):
    cases = {
        "4": "4", "+5": "5", "007": "7", "-0": "0", "-00": "0", "-012": "-12", "4.50": "4.5", ".5": "0.5", "1.": "1.0",
        "1e3": "1000.0", "1e400": None, "abc": None, "1_000": None, "nan": None, "": None, "123456789012345678901": "123456789012345678901",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.number_text(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == cases


def test_stored_size_uses_default_separators(spark):
    values = [{"a": [1, 2, {"b": "x,y:z"}]}, [], "a,b", 5, {"k": 'q"\\'}]
    compact = [json.dumps(v, separators=(",", ":")) for v in values]
    rows = spark.createDataFrame([(t,) for t in compact], "t string").select(text.stored_size(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [len(json.dumps(v)) for v in values]


def test_loose_equality(spark):
    pairs = [("1", "1.0", False), ("1", "true", False), ("0", "false", False), ("1", '"1"', True), ("null", None, False), ("2.50", "2.5", True),
             ("1e+16", "10000000000000000", False), ("1e-20", "0", True), ('{"a":[1.0]}', '{"a":[1]}', False), ('{"a":"1.0"}', '{"a":"1"}', True),
             ('"true"', "true", True), ("-0.0", "0", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, d boolean").select("d", text.loosely_differ(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == [r.d for r in rows]


def test_shown_strings(spark):
    raw = ["x", "it's", 'a"b', "it's \"x\"", "a\nb", "c\\d"]
    rows = spark.createDataFrame([(s,) for s in raw], "s string").select(text.shown(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows] == [repr(s) for s in raw]


def test_dates(spark):
    cases = {"2024-02-29": True, "2024-02-30": False, "2024-2-3": False, "0000-01-01": False, "0001-01-01": True, "2024-01-01\n": False, "9999-12-31": True}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", coerce.is_date(F.col("s")).alias("ok")).collect()
    assert {r.s: r.ok for r in rows} == cases


def test_canonical_nested(spark):
    texts = ['{"b": 1.0, "a": {"d": [1, 2.50], "c": null}}', "[1, 2]", '"x"', "4"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.canonical_nested(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")) for t in texts]
