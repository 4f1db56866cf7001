"""1-based record numbers per file, without a single-task window.

The position of a record inside its file split comes from the scan order, the
split's offset from counts per split. Only one row per split is ever windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.plans import durable

MAX_BROADCAST_SPLITS = 200_000  # about 20 MB of (file, start, offset) rows
_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id keeps the partition above these bits


def file_columns() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    ]


def _join_offsets(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """The offsets are written and counted: a scan of few splits takes them by broadcast."""
    offsets = durable.written(offsets, "splits")
    if offsets.count() <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, ["file", "_start"])


def with_row_idx(scan: DataFrame, keep: Column | None = None, line_number: str | None = None) -> DataFrame:
    """Add ``row_idx`` to a file scan that carries ``file_columns``.

    With ``keep``, only matching rows are kept and counted, and ``line_number``
    optionally names a column with the number among all rows.
    """
    kept = F.lit(True) if keep is None else keep
    splits = scan.groupBy("file", "_start").agg(
        F.count("*").alias("_n"), F.count_if(kept).alias("_k"), F.min("_at").alias("_lo")
    )
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    packed = (
        Window.partitionBy(F.shiftright("_lo", 33)).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0)
    offsets = splits.select(
        "file",
        "_start",
        "_lo",
        F.coalesce(F.sum("_n").over(earlier), zero).alias("_n_before"),
        F.coalesce(F.sum("_k").over(earlier), zero).alias("_k_before"),
        F.coalesce(F.sum("_k").over(packed), zero).alias("_k_packed"),
    )
    rows = scan.filter(kept).withColumn("_kept_at", F.monotonically_increasing_id())
    position = F.col("_kept_at").bitwiseAND(F.lit(_IN_PARTITION)) - F.col("_k_packed")
    numbered = _join_offsets(rows, offsets).withColumn("row_idx", F.col("_k_before") + position + 1)
    if line_number:
        numbered = numbered.withColumn(line_number, F.col("_n_before") + F.col("_at") - F.col("_lo") + 1)
    return numbered.drop("_start", "_at", "_lo", "_n_before", "_k_before", "_k_packed", "_kept_at")
