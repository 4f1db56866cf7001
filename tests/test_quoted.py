"""CSV records over many splits against the engine's one-task reader and a plain parser."""

import csv
import io
import random
from contextlib import contextmanager

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowsmith.sources import quoted, readers


@contextmanager
def split_bytes(spark, n):
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(rows, header):
    out = {}
    for r in rows.collect():
        out.setdefault(r.file.rsplit("/", 1)[1], {})[r.row_idx] = [r[f"_c{i}"] for i in range(len(header))]
    return {f: [v for _, v in sorted(by.items())] for f, by in out.items()}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quotes_straddle_every_border(spark, tmp_path, end):
    rng = random.Random(71)
    cells = ["", "a", "a,b", 'say "x"', f"two{end}lines", f"{end}", f'"{end}","{end}', '""', "é", f"x{end}" * 30 + "end", "b,\n\nc"]
    want = {}
    for name in ("a.csv", "b.csv"):
        rows = [[str(i), *[rng.choice(cells) for _ in range(2)]] for i in range(25)]
        body = io.StringIO(newline="")
        csv.writer(body, lineterminator=end).writerows([["id", "p", "q\nr"], *rows])
        (tmp_path / name).write_bytes(body.getvalue().encode())
        want[name] = rows
    one_task = spark.read.options(**readers._CSV).option("multiLine", True).csv(str(tmp_path))
    with split_bytes(spark, 97):
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        header, rows = readers.read_csv(spark, str(tmp_path), multi_line=True)
        got = rows_of(rows, header)
    assert header == ["id", "p", "q\nr"]
    assert got == want
    if end == "\n":  # with "\r\n" the one-task reader leaves "\r" in some last cells
        assert sorted([r._c0, r._c1, r._c2] for r in one_task.fillna("").collect() if r._c0 != "id") == sorted(got["a.csv"] + got["b.csv"])


def test_odd_texts_as_in_one_task(spark, tmp_path):
    """Any mix of quotes, commas and line ends whose quotes open cells and close before a comma or line end."""
    rng = random.Random(5)
    for f in range(3):
        cell = lambda: rng.choice(["", "x", 'x"y', '"p"', '"p""q"', '"\n"', '",\n,"', '""', '"""\n"', " "])
        body = "".join(",".join(cell() for _ in range(rng.choice([1, 2, 3]))) + rng.choice(["\n", "\n", "\n\n"]) for _ in range(25))
        (tmp_path / f"{f:02}.csv").write_text("h,i,j\n" + body)
    schema = "_c0 string, _c1 string, _c2 string"
    one_task = spark.read.options(**readers._CSV).option("multiLine", True).schema(schema).csv(str(tmp_path))
    want = sorted([x or "" for x in r] for r in one_task.collect() if r[1] != "i")
    with split_bytes(spark, 120):
        header, rows = readers.read_csv(spark, str(tmp_path), multi_line=True)
        got = rows_of(rows, header)
    assert sorted(x for rows in got.values() for x in rows) == want


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    body = "".join(f'{i},"{"line" + chr(10)}{i % 7 * chr(10)}"\n' + "\n" * (i % 3) for i in range(60))
    (tmp_path / "x.csv").write_text("﻿id,t\n" + body, encoding="utf-8")
    seen = []
    for size in (60, 1 << 20):
        with split_bytes(spark, size):
            seen.append(sorted((r.row_idx, r.line) for r in quoted.csv_records(spark, str(tmp_path))[1].collect()))
    assert seen[0] == seen[1]
    assert [n for n, _ in seen[0]] == list(range(1, 62))


def test_open_quotes_empty_files_and_other_headers(spark, tmp_path):
    for name, body in (("a", 'x,y\n1,2\n3,"4\n\n5,6\n'), ("b", "y,x\n5,6\n"), ("c", ""), ("d", "x,y\n\n7\n")):
        (tmp_path / f"{name}.csv").write_text(body)
    header, rows = readers.read_csv(spark, str(tmp_path), multi_line=True)
    got = {(r.file[-5], r.row_idx): (r._c0, r._c1, r.problem) for r in rows.collect()}
    nothing, none = readers.read_csv(spark, str(tmp_path / "c.csv"), multi_line=True)
    assert nothing == [] and none.count() == 0
    assert header == ["x", "y"]
    assert got[("a", 1)] == ("1", "2", None) and got[("d", 1)] == ("7", "", None) and got[("b", 1)][2].endswith("y,x")
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("d", 1)} and got[("a", 2)][:2] == ("3", "4\n\n5,6")


def test_maps_of_lines():
    for line, ends in (("a,b", (False, True)), ('"a', (True, False)), ('"",', (False, True)), ('a"b', (False, False)), ('x","', (True, True))):
        got = tuple(quoted.open_after(line, entry) for entry in (False, True))
        want = tuple(_walk(line, entry) for entry in (False, True))
        assert got == want, line
    rng = random.Random(9)
    for _ in range(3000):
        line = "".join(rng.choice('",a') for _ in range(rng.randrange(9)))
        for entry in (False, True):
            assert quoted.open_after(line, entry) == _walk(line, entry), line


def _walk(line, is_open):
    state = "quoted" if is_open else "begin"
    for ch in line:
        if state == "quoted":
            state = "closing" if ch == '"' else "quoted"
        elif ch == ",":
            state = "begin"
        elif ch == '"' and state in ("begin", "closing"):
            state = "quoted"
        else:
            state = "plain"
    return state == "quoted"


def _batch(lines):
    columns = [pa.array(["f"] * len(lines)), pa.array([0] * len(lines)), pa.array(range(len(lines))), pa.array(lines)]
    return pa.RecordBatch.from_arrays(columns, ["file", "_start", "_at", "line"])


def test_regular_lines_are_not_walked(monkeypatch):
    """Lines of plain records need no call each, whichever state a split starts in."""
    walked = []
    walk = quoted.open_after
    monkeypatch.setattr(quoted, "open_after", lambda line, is_open: walked.append(line) or walk(line, is_open))
    lines = [x for i in range(200) for x in (f'"{i}","a', '""b"",', '"",c', f'd","{i}"', "", f"{i},e")]
    (found,) = quoted._split_maps(iter([_batch(lines)]))
    assert (found.column("open0")[0].as_py(), found.column("n0")[0].as_py()) == (False, 400)
    assert len(walked) <= 2  # the wrong state meets the right one


def test_states_of_batches_as_walked():
    rng = random.Random(13)
    for _ in range(400):
        lines = ["".join(rng.choice('",a\ré') for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 12))]
        some = quoted._Batch(pa.array(["x", *lines, '"']).slice(1, len(lines)))
        lo = rng.randrange(len(lines))
        for is_open in (False, True):
            want = [is_open]
            for line in lines[lo:]:
                want.append(_walk(line, want[-1]))
            assert some.states(lo, len(lines), is_open).tolist() == want, lines


def test_many_splits_are_shuffled(spark, tmp_path, monkeypatch):
    """Lines of more splits than are broadcast come back in order by the number of their split."""
    monkeypatch.setattr(quoted, "MAX_BROADCAST_SPLITS", 0)
    for f in "ab":
        (tmp_path / f"{f}.csv").write_text("id,t\n" + "".join(f'{f}{i},"x\n""{i}"",\ny"\n' for i in range(30)))
    with split_bytes(spark, 97):
        header, rows = readers.read_csv(spark, str(tmp_path), multi_line=True)
        got = rows_of(rows, header)
    assert got == {f"{f}.csv": [[f"{f}{i}", f'x\n"{i}",\ny'] for i in range(30)] for f in "ab"}
