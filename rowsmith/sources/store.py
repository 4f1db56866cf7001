"""Versions of a dataset as manifests over shared, immutable buckets of rows.

``<root>/datasets/<name>/`` holds

* ``objects/<home>/bucket=<b>/``: the rows of bucket ``b`` that the cut ``home`` wrote;
* ``trees/<home>/level=<l>/``: the hash tree of that cut, which says in which home each bucket lies;
* ``v<N>/manifest.json``: one line, put there last and only if absent. It alone makes a version.

A bucket is the day a row was created and, on days of many rows, the first hex digits of the
sha256 of its id. A row keeps its bucket as long as it lives, so a later cut writes only
buckets whose rows changed and names the old homes of the others; days that got no change
cost nothing. Days keep their digits until they have grown sixteenfold. The tree has a node a
bucket (2), a day (1) and a dataset (0); two versions are compared from the top, and only
buckets whose hashes differ are read.

A cut that fails leaves a home no manifest names: it is never read, does not block the number and
``clean`` removes it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.plans import durable, skew

ROW_SCHEMA = "id string, status string, data map<string,string>, created_at timestamp, line string, leaf string"
TREE_SCHEMA = "node string, day string, digits int, hash string, n bigint, home string, level int"
MANIFEST_SCHEMA = (
    "dataset string, version int, content_hash string, row_count bigint, schema_snapshot string, "
    "notes string, created_by string, created_at timestamp, home string, parent int"
)
BUCKET_ROWS = 50_000
MOST_DIGITS = 6
MOST_PATHS = 10_000  # buckets whose folders are named one by one; more are looked up by a join
DAY_MICROS = 86_400_000_000


class VersionExists(ValueError):
    """Another writer has published this number."""


def dataset_dir(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/datasets/{name}"


def manifest_path(root: str, name: str, version: int) -> str:
    return f"{dataset_dir(root, name)}/v{version}/manifest.json"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


# --- Publishing -----------------------------------------------------------


def put_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file unless it exists; of several writers exactly one gets True.

    The content is staged beside it. A local file system gets a hard link, which fails on an
    existing name; others a rename that does not overwrite, atomic where the store's rename is.
    """
    jvm = spark._jvm
    target, fs = _file_system(spark, path)
    fs.mkdirs(target.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".staged-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            name = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(name(target), name(staged))
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            how = spark.sparkContext._gateway.new_array(kind, 1)
            how[0] = kind.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            context.rename(staged, target, how)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName() and not fs.exists(target):
            raise
        return False
    finally:
        fs.delete(staged, False)
    return True


def publish(spark: SparkSession, root: str, name: str, manifest: dict) -> None:
    if not put_if_absent(spark, manifest_path(root, name, manifest["version"]), json.dumps(manifest) + "\n"):
        raise VersionExists(f"version {manifest['version']} of {name!r} is already published")


def read_manifest(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(manifest_path(root, name, version))


def published(spark: SparkSession, root: str, name: str) -> list[int]:
    """The numbers of all versions, oldest first."""
    at, fs = _file_system(spark, dataset_dir(root, name))
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    numbers = [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n)]
    return sorted(v for v in numbers if fs.exists(_file_system(spark, manifest_path(root, name, v))[0]))


# --- Buckets and their tree --------------------------------------------------


def _day(created_at: Column) -> Column:
    return F.coalesce(F.floor(F.unix_micros(created_at) / F.lit(DAY_MICROS)).cast("string"), F.lit("none"))


def _placed(rows: DataFrame, days: DataFrame) -> DataFrame:
    """``rows`` with ``day``, ``digits`` and ``node``, the bucket they belong to; a day that ``days`` lacks is one bucket."""
    rows = rows.withColumn("day", _day(F.col("created_at"))).join(days, "day", "left").withColumn("digits", F.coalesce("digits", F.lit(0)))
    return rows.withColumn("node", F.concat("day", F.lit("_"), F.substring(F.sha2("id", 256), F.lit(1), F.col("digits"))))


def _bucket_hashes(placed: DataFrame) -> DataFrame:
    """``(node, day, digits, hash, n)``: a bucket's hash names its lines and when they were created."""
    item = F.concat("leaf", F.lit("@"), F.coalesce(F.unix_micros("created_at").cast("string"), F.lit("")))
    return placed.groupBy("node", "day", "digits").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(item)), "\n"), 256).alias("hash"), F.count("*").alias("n")
    )


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The level above: one node a day (1), or the root (0)."""
    by = [F.col("day").alias("node"), "day", "digits"] if level == 1 else [F.lit("").alias("node")]
    child = F.struct("node", F.concat("node", F.lit(":"), "hash").alias("named"))
    up = nodes.groupBy(*by).agg(F.sort_array(F.collect_list(child)).alias("c"), F.sum("n").alias("n"))
    none = F.lit(None).cast("string").alias("home")
    rest = ["day", "digits"] if level == 1 else [F.lit(None).cast("string").alias("day"), F.lit(None).cast("int").alias("digits")]
    return up.select("node", *rest, F.sha2(F.array_join("c.named", "\n"), 256).alias("hash"), "n", none, F.lit(level).alias("level"))


def _tree_dir(root: str, name: str, home: str) -> str:
    return f"{dataset_dir(root, name)}/trees/{home}"


def _tree(spark: SparkSession, root: str, name: str, home: str) -> DataFrame:
    return spark.read.schema(TREE_SCHEMA).parquet(_tree_dir(root, name, home))


def _days(leaves: DataFrame, prior: DataFrame | None, bucket_rows: int) -> DataFrame:
    """``(day, digits)``: as many digits as the day's rows ask for, or those it had unless it outgrew them."""
    days = leaves.groupBy(_day(F.col("created_at")).alias("day")).agg(F.count("*").alias("n"))
    asked = F.ceil(F.log(16.0, F.col("n") / F.lit(float(bucket_rows))) - F.lit(1e-9))
    digits = F.least(F.lit(MOST_DIGITS), F.greatest(F.lit(0), asked)).cast("int")
    if prior is not None:
        had = prior.filter(F.col("level") == 1).select("day", F.col("digits").alias("had"))
        room = F.lit(16.0 * bucket_rows) * F.pow(F.lit(16.0), F.col("had"))
        digits = F.when(F.col("had").isNotNull() & (F.col("n") <= room), F.col("had")).otherwise(digits)
        days = days.join(had, "day", "left")
    days = durable.written(days.select("day", digits.alias("digits")), "days")
    return F.broadcast(days) if skew.is_small(days) else days


def _store(rows: DataFrame, objects: str) -> DataFrame:
    """Write placed rows into their buckets; what was stored as ``(node, leaf, created_at, id)``."""
    rows = rows.withColumnRenamed("node", "bucket").repartition("bucket").sortWithinPartitions("bucket", "created_at", "id")
    columns = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
    rows.select(*columns, "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(objects)
    stored = rows.sparkSession.read.schema(ROW_SCHEMA + ", bucket string").parquet(objects)
    return stored.select(F.col("bucket").alias("node"), "leaf", "created_at", "id")


def _write_tree(nodes: DataFrame, root: str, name: str, home: str) -> None:
    day_nodes = _parents(nodes, 1)
    tree = nodes.unionByName(day_nodes).unionByName(_parents(day_nodes, 0))
    tree.repartition("level").sortWithinPartitions("node").write.mode("errorifexists").partitionBy("level").parquet(_tree_dir(root, name, home))


def write_rows(snap: DataFrame, root: str, name: str, bucket_rows: int = BUCKET_ROWS) -> tuple[str, DataFrame]:
    """Store all rows of ``snap``; returns their home and ``(node, leaf, created_at, id)`` of what was stored.

    Rows that share no bucket with an earlier version are made once: all hashes come from what was
    stored, and only the days are counted before.
    """
    days = _days(snap.select("created_at"), None, bucket_rows)
    home = uuid.uuid4().hex
    return home, _store(_placed(snap, days), f"{dataset_dir(root, name)}/objects/{home}")


def write_tree(stored: DataFrame, root: str, name: str, home: str) -> bool:
    """The tree of the rows that ``write_rows`` stored; false if there are none."""
    parts = {"day": F.substring_index("node", "_", 1), "digits": F.length(F.substring_index("node", "_", -1))}
    nodes = _bucket_hashes(stored.withColumns(parts)).withColumn("home", F.lit(home))
    nodes = durable.written(nodes.select("node", "day", "digits", "hash", "n", "home", F.lit(2).alias("level")), "nodes")
    if nodes.isEmpty():
        discard(stored.sparkSession, root, name, home)
        return False
    _write_tree(nodes, root, name, home)
    return True


def write_version(
    snap: DataFrame, leaves: DataFrame, root: str, name: str, parent: int | None = None, bucket_rows: int = BUCKET_ROWS
) -> str | None:
    """Store the rows of ``snap`` that no version holds yet, and the tree of all of them.

    ``leaves`` holds ``(id, created_at, leaf)`` of the same rows as a written table. Returns the
    home of the tree, or None if there are no rows. Nothing is visible before ``publish``. What was
    stored is read back and must give the hashes that were planned, else the cut fails.
    """
    spark = snap.sparkSession
    prior = None if parent is None else _tree(spark, root, name, read_manifest(spark, root, name, parent).first()["home"])
    days = _days(leaves, prior, bucket_rows)
    home = uuid.uuid4().hex
    nodes = _bucket_hashes(_placed(leaves, days))
    if prior is None:
        nodes = nodes.withColumn("home", F.lit(home))
    else:
        had = prior.filter(F.col("level") == 2).select("node", "hash", F.col("home").alias("_home"))
        nodes = nodes.join(had, ["node", "hash"], "left").withColumn("home", F.coalesce("_home", F.lit(home))).drop("_home")
    nodes = durable.written(nodes.select("node", "day", "digits", "hash", "n", "home", F.lit(2).alias("level")), "nodes")
    fresh = nodes.filter(F.col("home") == home).select("node", "hash")
    sizes = nodes.agg(F.count("*").alias("all"), F.count(F.when(F.col("home") == home, 1)).alias("fresh")).first()
    if not sizes["all"]:
        return None
    objects = f"{dataset_dir(root, name)}/objects/{home}"
    if sizes["fresh"]:
        rows = _placed(snap, days)
        if sizes["fresh"] < sizes["all"]:
            names = fresh.select("node")
            rows = rows.join(F.broadcast(names) if skew.is_small(names) else names, "node", "left_semi")
        stored = _bucket_hashes(_store(rows, objects).select("leaf", "created_at", "node", F.lit("").alias("day"), F.lit(0).alias("digits")))
        wrong = fresh.join(stored.select("node", F.col("hash").alias("_now")), "node", "full_outer")
        if not wrong.filter(~F.col("hash").eqNullSafe(F.col("_now"))).isEmpty():
            raise RuntimeError("the rows changed while they were stored; nothing was published")
    _write_tree(nodes, root, name, home)
    return home


def discard(spark: SparkSession, root: str, name: str, home: str) -> None:
    """Remove what a cut wrote that was not published."""
    for path in (f"{dataset_dir(root, name)}/objects/{home}", _tree_dir(root, name, home)):
        at, fs = _file_system(spark, path)
        fs.delete(at, True)


# --- Reading -----------------------------------------------------------------


def _home_rows(spark: SparkSession, root: str, name: str, home: str, nodes: DataFrame) -> DataFrame:
    objects = f"{dataset_dir(root, name)}/objects/{home}"
    names = [r[0] for r in nodes.limit(MOST_PATHS + 1).collect()]
    if len(names) <= MOST_PATHS:
        return spark.read.schema(ROW_SCHEMA).parquet(*[f"{objects}/bucket={n}" for n in names])
    rows = spark.read.schema(ROW_SCHEMA + ", bucket string").parquet(objects)
    return rows.join(nodes.select(F.col("node").alias("bucket")), "bucket", "left_semi").drop("bucket")


def bucket_rows(spark: SparkSession, root: str, name: str, nodes: DataFrame) -> DataFrame:
    """The rows of ``nodes(node, home)``; no other bucket is opened. There is a home a cut at most."""
    homes = sorted(r[0] for r in nodes.select("home").distinct().collect())
    found = [_home_rows(spark, root, name, h, nodes.filter(F.col("home") == h).select("node")) for h in homes]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], ROW_SCHEMA)


def read_version(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    home = read_manifest(spark, root, name, version).first()["home"]
    nodes = _tree(spark, root, name, home).filter(F.col("level") == 2)
    return bucket_rows(spark, root, name, nodes.select("node", "home"))


def differing_buckets(spark: SparkSession, root: str, name: str, a: int, b: int) -> DataFrame:
    """``(node, a_home, b_home)`` of buckets that are not the same in two versions.

    From the top: equal roots end it, then days are compared, then the buckets of differing days.
    """
    homes = [read_manifest(spark, root, name, v).first()["home"] for v in (a, b)]
    left, right = (_tree(spark, root, name, h).select("level", "node", "day", "hash", "home") for h in homes)

    def differ(level: int, days: DataFrame | None = None) -> DataFrame:
        x, y = (t.filter(F.col("level") == level) for t in (left, right))
        if days is not None:
            x, y = (t.join(F.broadcast(days) if skew.is_small(days) else days, "day", "left_semi") for t in (x, y))
        x = x.select("node", F.col("hash").alias("a_hash"), F.col("home").alias("a_home"))
        y = y.select("node", F.col("hash").alias("b_hash"), F.col("home").alias("b_home"))
        return x.join(y, "node", "full_outer").filter(~F.col("a_hash").eqNullSafe(F.col("b_hash"))).select("node", "a_home", "b_home")

    if differ(0).isEmpty():
        return spark.createDataFrame([], "node string, a_home string, b_home string")
    days = durable.written(differ(1).select(F.col("node").alias("day")), "differing-days")
    return durable.written(differ(2, days), "differing-buckets")


def differing_rows(spark: SparkSession, root: str, name: str, a: int, b: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the buckets in which two versions differ."""
    nodes = differing_buckets(spark, root, name, a, b)
    sides = [nodes.filter(F.col(h).isNotNull()).select("node", F.col(h).alias("home")) for h in ("a_home", "b_home")]
    return tuple(bucket_rows(spark, root, name, side) for side in sides)


def clean(spark: SparkSession, root: str, name: str, older_than_seconds: float = 86_400) -> list[str]:
    """Remove homes that no published version names; young ones may belong to a cut that still runs."""
    used = set()
    for version in published(spark, root, name):
        own = read_manifest(spark, root, name, version).first()["home"]
        used.add(own)
        used.update(r[0] for r in _tree(spark, root, name, own).filter("level = 2").select("home").distinct().collect())
    now, gone = time.time(), set()
    for kind in ("objects", "trees"):
        at, fs = _file_system(spark, f"{dataset_dir(root, name)}/{kind}")
        for status in fs.listStatus(at) if fs.exists(at) else []:
            home = status.getPath().getName()
            if home not in used and now - status.getModificationTime() / 1000 >= older_than_seconds:
                fs.delete(status.getPath(), True)
                gone.add(home)
    return sorted(gone)
