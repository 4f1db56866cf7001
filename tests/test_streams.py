"""Streams: state between batches, restarts."""

import json
import os
import random

from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.operators import importing
from rowsmith.operators.records import known_cell, known_cells
from rowsmith.sources import readers
from rowsmith.streaming import imports, patches

PATCH = "id string, seq bigint, expected_rev int, status string"


def by_loop(start, batch):
    rev, out = dict(start), {}
    for id_, seq, expected, _ in batch:
        passes = id_ in rev and expected == rev[id_]
        if passes:
            rev[id_] += 1
        out[seq] = (passes, rev.get(id_) if expected is not None else None)
    return out


def patch_files(spark, folder, n, seed):
    """``n`` files of patches; a third of all go to one row."""
    rng = random.Random(seed)
    start = {f"r{i}": i % 3 for i in range(20)}
    rev, batch = dict(start), []
    for seq in range(n * 15):
        id_ = "r3" if rng.random() < 0.33 else f"r{rng.randrange(23)}"
        expected = rng.choice([rev.get(id_, 0), rev.get(id_, 0), 0, None])
        batch.append((id_, seq, expected, "draft"))
        if id_ in rev and expected == rev[id_]:
            rev[id_] += 1
    parts = [batch[i * 15 : (i + 1) * 15] for i in range(n)]

    def write(i):
        rows = parts[i][:]
        rng.shuffle(rows)  # a batch is judged by seq, not by place
        folder.mkdir(exist_ok=True)
        lines = [json.dumps(dict(zip(("id", "seq", "expected_rev", "status"), r, strict=True))) for r in rows]
        (folder / f"{i:03d}.json").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files arrive in this order

    return start, batch, write


def run(spark, folder, start, sink, checkpoint):
    rows = spark.createDataFrame(list(start.items()), "id string, rev int")
    stream = spark.readStream.schema(PATCH).option("maxFilesPerTrigger", 1).json(str(folder))
    query = patches.start_patches(stream, rows, str(sink), str(checkpoint), {"availableNow": True})
    query.awaitTermination()
    return query.recentProgress


def test_patches_over_restarts(spark, tmp_path):
    folder, sink, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "progress"
    start, batch, write = patch_files(spark, folder, 12, 4)
    done = 0
    progress = []
    for upto in (3, 4, 12):  # three runs of the stream on one checkpoint
        for i in range(done, upto):
            write(i)
        progress += run(spark, folder, start, sink, checkpoint)
        done = upto
    got = {r.seq: (r.accepted, r.rev) for r in spark.read.parquet(str(sink)).collect()}
    assert spark.read.parquet(str(sink)).count() == len(batch)  # none lost, none twice
    assert got == by_loop(start, batch)
    states = [p.stateOperators[0] for p in progress if p.numInputRows]
    assert len(states) == 12
    assert max(s.numRowsTotal for s in states) <= len(start)  # one value a row
    assert all(s.numRowsUpdated <= 15 for s in states)  # a batch touches the rows it patches


def test_a_batch_that_fails_is_judged_again_once(spark, tmp_path):
    """The sink's folder cannot be made in the first run: nothing counts as judged."""
    folder, checkpoint = tmp_path / "in", tmp_path / "progress"
    start, batch, write = patch_files(spark, folder, 2, 5)
    write(0)
    run(spark, folder, start, tmp_path / "out", checkpoint)
    write(1)
    blocked = tmp_path / "file"
    blocked.write_text("")
    try:
        run(spark, folder, start, blocked / "out", checkpoint)
    except Exception:  # noqa: BLE001
        pass
    else:
        raise AssertionError("the sink should have failed")
    run(spark, folder, start, tmp_path / "out", checkpoint)
    got = {r.seq: (r.accepted, r.rev) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == by_loop(start, batch) and spark.read.parquet(str(tmp_path / "out")).count() == len(batch)


KEYED = Contract.of(Field("key", "text", required=True, is_key=True), Field("n", "number"))


def key_files(folder, seed):
    """Files of lines: keys repeated in and between files, one with a third of all; blank and broken lines, bad cells."""
    rng = random.Random(seed)
    folder.mkdir()

    def write(i):
        lines = ["\ufeff" + json.dumps({"key": f"bom{i}"})]
        for _ in range(25):
            key = "hot" if rng.random() < 0.33 else f"k{rng.randrange(60)}"
            value = rng.choice([1, 2.5, "x", None])  # a row with a bad cell claims its key all the same
            lines.append(rng.choice([json.dumps({"key": key, "n": value})] * 6 + ["", "{", json.dumps({"n": 1}), json.dumps({"key": " "})]))
        path = folder / f"{i:03d}.jsonl"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))

    return write


def run_import(spark, folder, tmp_path, existing=None, per=1):
    good, bad, state = (str(tmp_path / n) for n in ("good", "bad", "state"))
    query = imports.start_import(spark, str(folder), KEYED, good, bad, state, {"availableNow": True}, existing, per)
    query.awaitTermination()


def place(row):
    return row["file"].rsplit("/", 1)[1], row["line_number"]


def streamed(spark, tmp_path):
    good = [place(r) for r in spark.read.parquet(str(tmp_path / "good")).collect()]
    bad = [(*place(r), r["column"], r.reason) for r in spark.read.parquet(str(tmp_path / "bad")).collect()]
    return sorted(good), sorted(bad)


def at_once(spark, folder, existing):
    """The batch import of the same files."""
    read = known_cells(readers.read_jsonl(spark, str(folder)), KEYED)
    mapped = importing.map_rows(read, {k: k for k in KEYED.active_keys}, KEYED, known_cell, structured=True)
    checked = importing.check_rows(mapped, KEYED, existing)
    good = [place(r) for r in checked.filter("outcome = 'created'").collect()]
    bad = importing.report(checked, "file", "line_number").withColumn("reason", F.regexp_replace("reason", r"\Aline [0-9]+: ", ""))
    return sorted(good), sorted((*place(r), r["column"], r.reason) for r in bad.collect())


def test_import_claims_keys_over_batches_and_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    write = key_files(folder, 21)
    rows = [("k1", None), ("k2", "2024-01-01"), ("hot", None), (None, None)]
    existing = spark.createDataFrame(rows, "row_key string, deleted_at string")
    done = 0
    for upto in (1, 2, 4):  # three runs on one checkpoint, a file a micro-batch
        for i in range(done, upto):
            write(i)
        run_import(spark, folder, tmp_path, existing)
        done = upto
    good, bad = streamed(spark, tmp_path)
    assert (good, bad) == at_once(spark, folder, existing)
    reasons = " ".join(b[3] for b in bad)
    assert "already exists" in reasons and " of file" in reasons and "invalid JSON" in reasons
    left = tmp_path / "state" / "import"
    assert sorted(p.name for p in (left / "checked").iterdir()) == ["3", "existing"]  # earlier batches are deleted
    assert [p.name for p in (left / "held").iterdir()] == ["3"]


def test_import_of_several_files_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    write = key_files(folder, 22)
    for i in range(4):
        write(i)
    run_import(spark, folder, tmp_path, per=2)
    assert streamed(spark, tmp_path) == at_once(spark, folder, None)


def test_an_import_batch_that_fails_claims_its_keys_once(spark, tmp_path):
    """The outputs of the second batch cannot be written at first, after its claims were counted."""
    folder = tmp_path / "in"
    write = key_files(folder, 23)
    write(0)
    run_import(spark, folder, tmp_path)
    write(1)
    good, bad, state = (str(tmp_path / n) for n in ("good", "bad", "state"))
    blocked = tmp_path / "file"
    blocked.write_text("")
    try:
        imports.start_import(spark, str(folder), KEYED, f"{blocked}/good", bad, state, {"availableNow": True}, None, 1).awaitTermination()
    except Exception:  # noqa: BLE001
        pass
    else:
        raise AssertionError("the output should have failed")
    write(2)
    run_import(spark, folder, tmp_path)
    assert streamed(spark, tmp_path) == at_once(spark, folder, None)


def test_streamed_rows_meet_their_keys_once(spark, tmp_path, monkeypatch):
    """Valid rows and quarantined lines come from one pass over the rows and the holders of their keys."""
    folder, met, attach = tmp_path / "in", spark.sparkContext.accumulator(0), imports.attach_by_key
    key_files(folder, 5)(0)

    def counted(*args):
        joined = attach(*args)

        def count(batches):
            for batch in batches:
                met.add(batch.num_rows)
                yield batch

        return joined.mapInArrow(count, joined.schema)

    monkeypatch.setattr(imports, "attach_by_key", counted)
    run_import(spark, folder, tmp_path)
    lines = [line for path in folder.glob("*") for line in path.read_text().splitlines() if line.strip()]
    assert met.value == len(lines) > 0
