"""Immutable versions: cut, hash, verify, list, diff."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.contract import Contract
from rowsmith.functions import canon
from rowsmith.operators.contracts import diff_contract
from rowsmith.operators.rows import live
from rowsmith.plans import durable
from rowsmith.sources import store

PREFIXES = (6, 4, 2, 0)  # hex digits of a leaf that name its node, level by level: the same tree at every size
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
VERSIONS_SCHEMA = (
    "dataset string, version int, content_hash string, row_count bigint, schema_snapshot string, "
    "notes string, created_by string, created_at timestamp"
)


def selection(rows: DataFrame, include_unapproved: bool = False) -> DataFrame:
    """Live rows, approved ones only unless asked otherwise."""
    found = live(rows)
    return found if include_unapproved else found.filter(F.col("status") == "approved")


def snapshot(rows: DataFrame, contract: Contract, include_unapproved: bool = False) -> DataFrame:
    """``(id, status, data, created_at, line, leaf)`` with only active contract fields.

    ``leaf`` is the sha256 of the line. Stored beside it, it lets hashing and
    diffing read two narrow columns instead of whole rows.
    """
    keys = contract.active_keys
    chosen = selection(rows, include_unapproved)
    line = canon.canonical_line(canon.cells_of("data"), keys, F.col("id"), F.col("status"))
    lined = chosen.select("id", "status", canon.prune(F.col("data"), keys).alias("data"), "created_at", line.alias("line"))
    return lined.withColumn("leaf", F.sha2("line", 256))


def in_snapshot_order(snap: DataFrame) -> DataFrame:
    """(created_at, id) order as sorted ranges, written without a global sort task."""
    return snap.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id")


def tree_hash(snap: DataFrame, by: tuple[str, ...] = (), stored: bool = False) -> DataFrame:
    """``(content_hash, row_count)`` of a snapshot, or of each ``by`` group.

    Leaf = sha256 of a line; its first digits name its node, which spreads leaves
    evenly whatever the data. A node of the lowest level hashes its leaves in
    (created_at, id) order, a higher one the names and hashes of its at most 256
    children, so no task holds more than one node. The tree depends on the leaves
    alone: not on partitioning, on the number of rows or on other groups. Leaves are
    computed from the lines unless ``stored`` says to trust the ``leaf`` column.
    """
    leaf = F.col("leaf") if stored else F.sha2("line", 256)
    leaves = snap.select(*by, "created_at", "id", leaf.alias("h"))
    level = leaves.groupBy(*by, F.substring("h", 1, PREFIXES[0]).alias("node")).agg(
        F.sort_array(F.collect_list(F.struct("created_at", "id", "h"))).alias("_l"), F.count("*").alias("n")
    )
    level = level.select(*by, "node", F.sha2(F.array_join(F.col("_l.h"), ""), 256).alias("h"), "n")
    for digits in PREFIXES[1:]:
        child = F.struct("node", F.concat("node", "h").alias("named"))
        level = level.groupBy(*by, F.substring("node", 1, digits).alias("parent")).agg(
            F.sort_array(F.collect_list(child)).alias("_l"), F.sum("n").alias("n")
        )
        level = level.select(*by, F.col("parent").alias("node"), F.sha2(F.array_join(F.col("_l.named"), ""), 256).alias("h"), "n")
    root = F.concat(F.lit(canon.HASH_PREFIX), F.col("h")).alias("content_hash")
    return level.select(*by, root, F.col("n").alias("row_count"))


def content_hash(snap: DataFrame) -> str:
    return tree_hash(snap, stored="leaf" in snap.columns).first().content_hash


def next_versions(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """``(dataset, next_version)``: the greatest version plus one, or one."""
    latest = versions.groupBy("dataset").agg(F.max("version").alias("_v"))
    return datasets.select("dataset").distinct().join(latest, "dataset", "left").select(
        "dataset", (F.coalesce("_v", F.lit(0)) + 1).alias("next_version")
    )


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of every dataset: a map-side aggregate, no sort."""
    names = [c for c in versions.columns if c != "dataset"]
    newest = versions.groupBy("dataset").agg(F.max_by(F.struct(*names), "version").alias("_v"))
    return newest.select("dataset", "_v.*").select(*versions.columns)


def cut_version(
    rows: DataFrame,
    contract: Contract,
    name: str,
    root: str,
    version: int,
    created_by: str,
    notes: str = "",
    include_unapproved: bool = False,
    created_at: str | None = None,
) -> DataFrame:
    """Store and publish one immutable version and return its manifest row.

    Rows are stored first, sharing the buckets that did not change since the newest
    version, then the manifest is put if absent: of two writers of one number one wins,
    and a cut that fails leaves nothing that a reader or a later cut would meet. An
    empty selection is refused.
    """
    spark = rows.sparkSession
    earlier = store.published(spark, root, name)
    if version in earlier:
        raise store.VersionExists(f"version {version} of {name!r} is already published")
    parent = max(earlier, default=None)
    snap = snapshot(rows, contract, include_unapproved)
    with ThreadPoolExecutor(1) as beside:  # the content hash needs the leaves only and runs beside the writes
        if parent is None:
            home, leaves = store.write_rows(snap, root, name)
            hashed = beside.submit(lambda: tree_hash(leaves, stored=True).first())
            home = home if store.write_tree(leaves, root, name, home) else None
        else:
            leaves = durable.written(snap.select("id", "created_at", "leaf"), "leaves")
            hashed = beside.submit(lambda: tree_hash(leaves, stored=True).first())
            home = store.write_version(snap, leaves, root, name, parent)
        found = hashed.result() if home else None
    if home is None:
        raise ValueError("no rows match the selection; a version cannot be empty")
    when = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    manifest = {
        "dataset": name,
        "version": version,
        "content_hash": found.content_hash,
        "row_count": found.row_count,
        "schema_snapshot": contract.snapshot_json(),
        "notes": notes,
        "created_by": created_by,
        "created_at": spark.range(1).select(F.date_format(when, TIME_FORMAT)).first()[0],
        "home": home,
        "parent": parent,
    }
    try:
        store.publish(spark, root, name, manifest)
    except store.VersionExists:
        store.discard(spark, root, name, home)
        raise
    return store.read_manifest(spark, root, name, version)


def verify(spark: SparkSession, root: str, name: str, version: int) -> tuple[bool, str]:
    """Recompute a stored version's hash from its lines and compare it to the manifest."""
    manifest = store.read_manifest(spark, root, name, version).first()
    found = tree_hash(store.read_version(spark, root, name, version)).first()
    actual = found.content_hash if found else ""
    return actual == manifest.content_hash, actual


def check_pins(pins: DataFrame, hashes: DataFrame) -> DataFrame:
    """``pins(dataset, version, content_hash)`` against recomputed hashes, all at once."""
    found = hashes.select("dataset", "version", F.col("content_hash").alias("actual_hash"))
    outcome = (
        F.when(F.col("actual_hash").isNull(), "not_found")
        .when(F.col("actual_hash") == F.col("content_hash"), "ok")
        .otherwise("mismatch")
    )
    return pins.join(found, ["dataset", "version"], "left").withColumn("outcome", outcome)


def diff_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, change, old_status, new_status, changes, data, created_at)`` between two snapshots.

    One full outer join on the id; field changes come from a map zip inside the
    joined row, so nothing is exploded or shuffled twice.
    """
    at = lambda df: F.col("created_at") if "created_at" in df.columns else F.lit(None).cast("timestamp")
    old = a.select("id", F.struct("status", "data", at(a).alias("created_at")).alias("_a"))
    new = b.select("id", F.struct("status", "data", at(b).alias("created_at")).alias("_b"))
    both = old.join(new, "id", "full_outer")
    status_moved = F.col("_a.status") != F.col("_b.status")
    changes = F.when(
        F.col("_a").isNotNull() & F.col("_b").isNotNull(),
        canon.changed_fields(F.col("_a.data"), F.col("_b.data"), strict=False),
    )
    marked = both.withColumn("changes", changes)
    change = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(status_moved | (F.size("changes") > 0), "modified")
    )
    return marked.select(
        "id",
        change.alias("change"),
        F.col("_a.status").alias("old_status"),
        F.col("_b.status").alias("new_status"),
        "changes",
        F.coalesce("_b.data", "_a.data").alias("data"),
        F.coalesce("_b.created_at", "_a.created_at").alias("created_at"),
    ).filter(F.col("change").isNotNull())


def in_diff_order(diff: DataFrame) -> DataFrame:
    """Added rows, then removed ones, each in snapshot order, then modified ones by id.

    A range sort: it is spread over tasks, and each holds a piece of the order.
    """
    rank = F.when(F.col("change") == "added", 0).when(F.col("change") == "removed", 1).otherwise(2)
    return diff.orderBy(rank, F.when(F.col("change") != "modified", F.col("created_at")), "id")


def diff_stored(a: DataFrame, b: DataFrame) -> DataFrame:
    """``diff_rows`` of two stored snapshots, reading whole rows only where they differ.

    Ids and leaf hashes of both versions are joined first. Versions mostly agree,
    so the ids left over are few: both sides are then filtered by them (broadcast
    when measured small) and only those rows are compared field by field.
    """
    left = a.select("id", F.col("leaf").alias("_x"))
    right = b.select("id", F.col("leaf").alias("_y"))
    differing = left.join(right, "id", "full_outer").filter(~F.col("_x").eqNullSafe(F.col("_y"))).select("id")
    differing = durable.written(differing, "differing")
    return diff_rows(a.join(differing, "id", "left_semi"), b.join(differing, "id", "left_semi"))


def diff_published(spark: SparkSession, root: str, name: str, a: int, b: int) -> DataFrame:
    """``diff_rows`` of two published versions; buckets whose hashes agree are not opened."""
    return diff_stored(*store.differing_rows(spark, root, name, a, b))


def field_changes(diff: DataFrame) -> DataFrame:
    """``(id, field, old, new)`` of modified rows, fields by name."""
    return diff.filter(F.col("change") == "modified").select("id", F.explode("changes").alias("_c")).select(
        "id", "_c.field", "_c.old", "_c.new"
    )


def status_changes(diff: DataFrame) -> DataFrame:
    moved = F.col("old_status") != F.col("new_status")
    return diff.filter((F.col("change") == "modified") & moved).select("id", "old_status", "new_status")


def added_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.join(a.select("id"), "id", "left_anti")


def removed_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("id"), "id", "left_anti")


def diff_versions(
    a: DataFrame, b: DataFrame, columns_a: DataFrame, columns_b: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(row differences, contract differences) of two versions."""
    return diff_rows(a, b), diff_contract(columns_a, columns_b)


def export_line(snap: DataFrame, contract: Contract, shape: str = "flat") -> DataFrame:
    """Export lines: the stored ``line`` of a snapshot as it is, or ``nested`` with dotted keys re-nested."""
    if shape == "flat" and "line" in snap.columns:
        return snap.select("created_at", "id", "line")
    cells = canon.cells_of("data")
    body = canon.object_text(cells, contract.active_keys) if shape == "flat" else canon.nested_text(cells, contract.active_keys)
    return snap.select("created_at", "id", canon.line_text(body, F.col("id"), F.col("status")).alias("line"))


def rows_from_lines(lines: DataFrame, contract: Contract) -> DataFrame:
    """Parse export lines back to ``(id, status, data)``."""
    raw = F.from_json("line", "id string, status string, data string")
    from rowsmith.operators.records import flatten_records

    read = lines.select(raw.alias("_r")).select("_r.id", "_r.status", F.col("_r.data").alias("line"))
    return flatten_records(read, contract.json_keys).select("id", "status", F.col("rec").alias("data"))


