"""Plain snapshots and exports on shared storage; published versions are kept by ``store``.

Every path carries the version and is written once: a second write fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT_SCHEMA = "id string, status string, data map<string,string>, created_at timestamp, line string, leaf string"


def version_dir(root: str, name: str, version: int) -> str:
    return f"{root.rstrip('/')}/datasets/{name}/v{version}"


def write_snapshot(snap: DataFrame, root: str, name: str, version: int) -> None:
    snap.write.mode("errorifexists").parquet(version_dir(root, name, version) + "/rows")


def read_snapshot(spark: SparkSession, root: str, name: str, version: int) -> DataFrame:
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(version_dir(root, name, version) + "/rows")


def export_jsonl(lines: DataFrame, path: str) -> None:
    """Export lines as text parts in (created_at, id) order."""
    ordered = lines.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id")
    ordered.select("line").write.mode("errorifexists").text(path)


def export_json(lines: DataFrame, manifest: DataFrame, path: str) -> None:
    """JSON part files with the manifest beside them."""
    export_jsonl(lines, f"{path}/rows")
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def append_edits(edits: DataFrame, path: str) -> None:
    """The audit log only ever grows."""
    edits.select("row_id", "field", "old_value", "new_value", "user_id", F.col("at")).write.mode("append").parquet(path)
