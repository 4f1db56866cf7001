"""Versions: hashes, immutability, differences."""

import hashlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.operators import versions
from rowsmith.sources import snapshots, store
from tests.test_changes import table

CONTRACT = Contract.of(Field("input", required=True), Field("score", "number"))


def rows(spark, n=50, bump=0):
    items = [(f"r{i:03d}", {"input": f'"text {i}"', "score": str(i + bump), "old": "1"}, "approved" if i % 3 else "draft", 1, i == 7) for i in range(n)]
    return table(spark, items)


def brute_tree(leaves):
    """The tree by hand: leaves in row order, then names and hashes of children."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = {}
    for h in leaves:
        level.setdefault(h[:6], []).append(h)
    level = {k: sha("".join(v)) for k, v in level.items()}
    for digits in (4, 2, 0):
        nodes = {}
        for k in sorted(level):
            nodes.setdefault(k[:digits], []).append(k + level[k])
        level = {k: sha("".join(v)) for k, v in nodes.items()}
    return "sha256:" + level[""]


def test_tree_hash_against_brute_force(spark):
    snap = versions.snapshot(rows(spark), CONTRACT)
    lines = [
        f'{{"data":{{"input":"text {i}","score":{i}}},"id":"r{i:03d}","status":"approved"}}' for i in range(50) if i % 3 and i != 7
    ]
    assert versions.content_hash(snap) == brute_tree([hashlib.sha256(line.encode()).hexdigest() for line in lines])


def test_tree_hash_ignores_partitioning(spark):
    snap = versions.snapshot(rows(spark), CONTRACT, include_unapproved=True)
    hashes = {versions.tree_hash(snap.repartition(n)).first().content_hash for n in (1, 5, 13)}
    assert len(hashes) == 1
    other = versions.snapshot(rows(spark, bump=1), CONTRACT, include_unapproved=True)
    assert versions.tree_hash(other).first().content_hash not in hashes


def test_grouped_hash_equals_separate_hashes(spark):
    snap = versions.snapshot(rows(spark), CONTRACT, True).withColumn("g", F.substring("id", 4, 1))
    grouped = {r.g: r.content_hash for r in versions.tree_hash(snap, ("g",)).collect()}
    for g, digest in grouped.items():
        assert versions.tree_hash(snap.filter(F.col("g") == g)).first().content_hash == digest


def test_cut_verify_and_immutability(spark, tmp_path):
    root = str(tmp_path)
    manifest = versions.cut_version(rows(spark), CONTRACT, "d", root, 1, "u@x").first()
    assert manifest.row_count == 32 and versions.verify(spark, root, "d", 1)[0]
    again = versions.cut_version(rows(spark).repartition(7), CONTRACT, "d", root, 2, "u@x").first()
    assert again.content_hash == manifest.content_hash
    with pytest.raises(store.VersionExists):
        versions.cut_version(rows(spark), CONTRACT, "d", root, 1, "u@x")
    with pytest.raises(ValueError):
        versions.cut_version(rows(spark).filter("id = 'none'"), CONTRACT, "d", root, 3, "u@x")
    bucket = store.read_version(spark, root, "d", 2).select(F.input_file_name()).first()[0].rsplit("/", 1)[0]
    store.read_version(spark, root, "d", 2).limit(1).write.mode("append").parquet(bucket)  # a row too many
    assert not versions.verify(spark, root, "d", 2)[0]
    assert [r[0] for r in store.read_manifest(spark, root, "d", 1).select("row_count").collect()] == [32]
    with pytest.raises(AnalysisException):
        store.read_version(spark, root, "d", 9).count()
    snapshots.write_snapshot(versions.snapshot(rows(spark), CONTRACT), root, "e", 1)
    with pytest.raises(AnalysisException):
        snapshots.write_snapshot(versions.snapshot(rows(spark), CONTRACT), root, "e", 1)


def test_diff(spark):
    a = versions.snapshot(rows(spark), CONTRACT, True)
    assert versions.diff_rows(a, a).isEmpty()
    changed = rows(spark, 52).withColumn(
        "data", F.when(F.col("id") == "r001", F.map_from_arrays(F.array(F.lit("input")), F.array(F.lit('"new"')))).otherwise(F.col("data"))
    ).withColumn("status", F.when(F.col("id") == "r002", "needs_review").otherwise(F.col("status"))).filter("id <> 'r003'")
    b = versions.snapshot(changed, CONTRACT, True)
    diff = versions.diff_rows(a, b)
    assert {r.id: r.change for r in diff.collect()} == {"r001": "modified", "r002": "modified", "r003": "removed", "r050": "added", "r051": "added"}
    assert [tuple(r) for r in versions.field_changes(diff).collect()] == [("r001", "input", '"text 1"', '"new"'), ("r001", "score", "1", None)]
    assert [tuple(r) for r in versions.status_changes(diff).collect()] == [("r002", "approved", "needs_review")]


def test_diff_order(spark):
    a = versions.snapshot(rows(spark, 30), CONTRACT, True)
    later = rows(spark, 40).filter("id not in ('r009', 'r004')").withColumn("created_at", F.lit("2024-02-01").cast("timestamp") - F.make_dt_interval(days=F.substring("id", 2, 3).cast("int")))
    later = later.withColumn("status", F.when(F.col("id").isin("r021", "r012"), "needs_review").otherwise(F.col("status")))
    got = [(r.change, r.id) for r in versions.in_diff_order(versions.diff_rows(a, versions.snapshot(later, CONTRACT, True))).collect()]
    added = [("added", f"r{i:03d}") for i in range(39, 29, -1)]  # newer ids were created earlier
    assert got == added + [("removed", "r004"), ("removed", "r009"), ("modified", "r012"), ("modified", "r021")]


def test_diff_compares_loosely(spark):
    a = versions.snapshot(rows(spark), CONTRACT, True)
    floats = rows(spark).withColumn("data", F.transform_values("data", lambda k, v: F.when(k == "score", F.concat(v, F.lit(".0"))).otherwise(v)))
    assert versions.diff_rows(a, versions.snapshot(floats, CONTRACT, True)).isEmpty()


def test_reimport_of_an_export(spark, tmp_path):
    snap = versions.snapshot(rows(spark), CONTRACT, True)
    for shape in ("flat", "nested"):
        lines = versions.export_line(snap, CONTRACT, shape)
        back = versions.rows_from_lines(lines, CONTRACT)
        assert versions.diff_rows(snap, back).isEmpty()
        snapshots.export_jsonl(lines, str(tmp_path / shape))
        assert spark.read.text(str(tmp_path / shape)).count() == 49
