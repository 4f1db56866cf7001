"""Cutting lineage with tables written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
FREE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rowsmith-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_written: list[str] = []
_scope = threading.local()


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder; false if there is none."""
    at, files = _at(spark, path)
    return files.delete(at, True)


def clean(spark: SparkSession) -> int:
    """Delete the tables this process has written, once their results are stored; returns how many."""
    done = 0
    while _written:
        done += delete(spark, _written.pop())
    return done


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside are deleted at the end; store their results before."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        paths, _scope.paths = _scope.paths, outer
        for path in paths:
            delete(spark, path)


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE_SETTING, None)
    spark.conf.set(FREE_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SETTING) if before is None else spark.conf.set(FREE_SETTING, before)


def _stored(df: DataFrame, path: str, lean: bool) -> DataFrame:
    writer = df.write.mode("errorifexists")
    with _freeing(df.sparkSession) if lean else nullcontext():
        (writer.option("compression", "zstd") if lean else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rowsmith/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """``df`` as a Parquet table: later plans read it and lost executors cost nothing.

    Tables stay until ``clean`` or the end of the ``scope``, as plans that read them may not have run yet.
    ``lean`` is for large tables: compressed harder, and the shuffle files of the write are deleted at
    its end, not when the driver collects its garbage.
    """
    path = _new_path(df.sparkSession, name)
    inside = getattr(_scope, "paths", None)
    (_written if inside is None else inside).append(path)
    return _stored(df, path, lean)


@contextmanager
def briefly(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a lean table that is deleted at the end of the block: no plan that runs later may read it."""
    path = _new_path(df.sparkSession, name)
    try:
        yield _stored(df, path, lean=True)
    finally:
        delete(df.sparkSession, path)
