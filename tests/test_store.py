"""Published versions: shared buckets, tree diffs, one winner a number, leftovers."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.operators import versions
from rowsmith.sources import store
from tests.test_changes import table

CONTRACT = Contract.of(Field("input", required=True), Field("score", "number"))


def rows(spark, n=200, days=10, changed=()):
    """Rows created on ``days`` days; those numbered ``changed`` hold another score."""
    items = [(f"r{i:03d}", {"input": f'"text {i}"', "score": str(i + 1000 * (i in changed))}, "approved", 1, False) for i in range(n)]
    at = F.timestamp_seconds(F.pmod(F.substring("id", 2, 3).cast("int"), F.lit(days)) * 86_400)
    return table(spark, items).withColumn("created_at", at)


def cut(df, root, version, **more):
    return versions.cut_version(df, CONTRACT, "d", root, version, "u@x", **more).first()


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_later_cuts_write_changed_buckets_only(spark, tmp_path):
    root, other = str(tmp_path / "a"), str(tmp_path / "b")
    first, second = cut(rows(spark), root, 1), cut(rows(spark, changed=(23, 33)), root, 2)  # both created on day 3
    assert second.parent == 1
    written = list((tmp_path / f"a/datasets/d/objects/{second.home}").glob("bucket=*"))
    assert [p.name for p in written] == ["bucket=3_"]
    assert first.content_hash != second.content_hash
    assert cut(rows(spark, changed=(23, 33)), other, 1).content_hash == second.content_hash
    assert versions.verify(spark, root, "d", 1)[0] and versions.verify(spark, root, "d", 2)[0]
    a, b = (versions.snapshot(rows(spark, changed=c), CONTRACT).select("id", "line").collect() for c in ((), (23, 33)))
    assert sorted(store.read_version(spark, root, "d", 1).select("id", "line").collect()) == sorted(a)
    assert sorted(store.read_version(spark, root, "d", 2).select("id", "line").collect()) == sorted(b)
    third = cut(rows(spark, changed=(23, 33)), root, 3)  # nothing new: no rows are written at all
    assert not (tmp_path / f"a/datasets/d/objects/{third.home}").exists() and versions.verify(spark, root, "d", 3)[0]


@pytest.mark.parametrize("most_paths", [10_000, 0])
def test_diff_opens_differing_buckets_only(spark, tmp_path, monkeypatch, most_paths):
    monkeypatch.setattr(store, "MOST_PATHS", most_paths)
    root = str(tmp_path)
    cut(rows(spark), root, 1)
    later = rows(spark, 203, changed=(23, 47)).filter("id not in ('r031', 'r041')")  # days 3, 7; new on 0, 1, 2; gone from 1
    cut(later, root, 2)
    a, b = store.differing_rows(spark, root, "d", 1, 2)
    if most_paths:
        opened = [{f.split("bucket=")[1].split("/")[0] for f in files(side)} for side in (a, b)]
        assert opened[0] == opened[1] == {"0_", "1_", "2_", "3_", "7_"} and len(files(a)) == len(files(b)) == 5
    assert a.count() == 100
    found = {r.id: r.change for r in versions.diff_published(spark, root, "d", 1, 2).collect()}
    full = {r.id: r.change for r in versions.diff_rows(*(store.read_version(spark, root, "d", v) for v in (1, 2))).collect()}
    assert found == full == {
        "r023": "modified", "r047": "modified", "r031": "removed", "r041": "removed", "r200": "added", "r201": "added", "r202": "added",
    }
    assert versions.diff_published(spark, root, "d", 2, 2).isEmpty()
    back = {r.id: r.change for r in versions.diff_published(spark, root, "d", 2, 1).collect()}
    assert back["r200"] == "removed" and back["r031"] == "added"


def test_a_row_that_changes_its_day(spark, tmp_path):
    root = str(tmp_path)
    cut(rows(spark, 30), root, 1)
    moved = F.when(F.col("id") == "r004", F.timestamp_seconds(F.lit(864_000))).otherwise(F.col("created_at"))
    cut(rows(spark, 30, changed=(5,)).withColumn("created_at", moved), root, 2)
    assert {r.id: r.change for r in versions.diff_published(spark, root, "d", 1, 2).collect()} == {"r005": "modified"}


def test_a_first_cut_makes_its_rows_once(spark, tmp_path):
    """Values that every run of the source makes anew: a cut that made them twice met other hashes."""
    root = str(tmp_path)
    fresh = F.udf(lambda: f'"{uuid.uuid4().hex}"').asNondeterministic()
    made = rows(spark, 40, 4).withColumn("data", F.create_map(F.lit("input"), fresh()))
    first = cut(made, root, 1)
    assert first.row_count == 40 and versions.verify(spark, root, "d", 1) == (True, first.content_hash)
    tree = store._tree(spark, root, "d", first.home)
    assert sorted((r.node, r.day, r.digits, r.n) for r in tree.filter("level = 2").collect()) == [(f"{d}_", f"{d}", 0, 10) for d in range(4)]
    with pytest.raises(ValueError, match="cannot be empty"):
        cut(made.filter("id = 'none'"), str(tmp_path / "none"), 1)
    assert not list((tmp_path / "none").glob("datasets/d/objects/*"))


def test_buckets_of_a_day_follow_its_size(spark, tmp_path):
    root = str(tmp_path)
    leaves = lambda df: versions.snapshot(df, CONTRACT).select("id", "created_at", "leaf")

    def digits(n, days, parent, version):
        snap = versions.snapshot(rows(spark, n, days), CONTRACT)
        home = store.write_version(snap, leaves(rows(spark, n, days)), root, "d", parent, bucket_rows=10)
        store.publish(spark, root, "d", {"dataset": "d", "version": version, "home": home})
        found = store._tree(spark, root, "d", home)
        assert store.read_version(spark, root, "d", version).count() == n
        return {r.node: r.digits for r in found.filter("level = 1").collect()}, found.filter("level = 2").count()

    assert digits(20, 2, None, 1) == ({"0": 0, "1": 0}, 2)
    assert digits(300, 2, 1, 2)[0] == {"0": 0, "1": 0}  # 150 rows a day: within sixteen buckets' worth
    grown, buckets = digits(400, 2, 2, 3)
    assert grown == {"0": 2, "1": 2} and buckets > 100
    null = rows(spark, 5).withColumn("created_at", F.lit(None).cast("timestamp"))
    assert cut(null, str(tmp_path / "null"), 1).row_count == 5


def test_one_of_two_writers_wins(spark, tmp_path):
    root, outcome = str(tmp_path), {}

    def write(i):
        try:
            outcome[i] = cut(rows(spark, 20, changed=(i,)), root, 1).content_hash
        except store.VersionExists:
            outcome[i] = None

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [h for h in outcome.values() if h]
    assert len(outcome) == 3 and len(won) == 1
    ok, digest = versions.verify(spark, root, "d", 1)
    assert ok and digest == won[0]
    assert store.clean(spark, root, "d", 0) == []  # losers removed what they wrote
    assert not list((tmp_path / "datasets/d/v1").glob(".staged-*"))


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "x/y.json")
    assert store.put_if_absent(spark, path, "1\n") and not store.put_if_absent(spark, path, "2\n")
    assert open(path).read() == "1\n"
    assert sorted(p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")) == ["y.json"]


def test_a_failed_cut_leaves_the_number_free(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    cut(rows(spark, 20), root, 1)

    def broken(*_):
        raise OSError("lost the driver")

    with monkeypatch.context() as m:
        m.setattr(store, "publish", broken)
        with pytest.raises(OSError):
            cut(rows(spark, 25), root, 2)
    assert store.published(spark, root, "d") == [1]
    assert store.clean(spark, root, "d") == []  # too young: the cut might still run
    second = cut(rows(spark, 26), root, 2)
    gone = store.clean(spark, root, "d", 0)
    assert len(gone) == 1 and second.home not in gone
    assert versions.verify(spark, root, "d", 1)[0] and versions.verify(spark, root, "d", 2)[0]
    with pytest.raises(store.VersionExists):
        cut(rows(spark, 20), root, 2)
    with pytest.raises(ValueError, match="cannot be empty"):
        cut(rows(spark, 20).filter("id = 'none'"), root, 3)
    assert store.published(spark, root, "d") == [1, 2] and store.published(spark, root, "unknown") == []
