"""Patch stream with optimistic locking on a state store.

The stream is keyed by row; the state of a row is its rev. A micro-batch reads and writes the
state of the rows it patches and no other, whatever the stream has seen before, and the
checkpoint brings state, input offsets and output back together after a restart: no patch is
lost and none is judged twice.

The patches of one row that arrive in one micro-batch are judged by one task in the order of ``seq``, so
what a trigger admits (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds that task. The
state lies in the session's state store; ``spark.sql.streaming.stateStore.providerClass`` set to
RocksDB keeps it on disk for many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT_SCHEMA = "id string, seq bigint, expected_rev bigint, status string, accepted boolean, rev bigint"
STATE_SCHEMA = "rev bigint"


def judge_row(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The patches of one row: each passes if it names the rev that the last accepted one left."""
    batch = pd.concat(list(parts), ignore_index=True).sort_values("seq", kind="stable")
    stored = batch["stored_rev"].iloc[0]
    rev = state.get[0] if state.exists else (None if pd.isna(stored) else int(stored))
    before, accepted, revs = rev, [], []
    for expected in batch["expected_rev"].tolist():
        passes = rev is not None and not pd.isna(expected) and int(expected) == rev
        rev = rev + 1 if passes else rev
        accepted.append(passes)
        revs.append(None if pd.isna(expected) else rev)
    if rev is not None and (rev != before or not state.exists):
        state.update((rev,))
    yield pd.DataFrame(
        {
            "id": key[0],
            "seq": batch["seq"].to_numpy(),
            "expected_rev": batch["expected_rev"].astype("Int64").to_numpy(dtype=object, na_value=None),
            "status": batch["status"].to_numpy(),
            "accepted": accepted,
            "rev": pd.array(revs, dtype="Int64"),
        }
    )


def judged_stream(patches: DataFrame, rows: DataFrame) -> DataFrame:
    """``(id, seq, expected_rev, status, accepted, rev)`` of a stream of patches; ``rev`` is what the patch left.

    ``rows(id, rev)`` says where a row starts that the stream has not met; unknown rows and patches
    without an expected rev are refused and have no rev.
    """
    known = rows.select("id", F.col("rev").cast("bigint").alias("stored_rev"))
    asked = patches.select("id", F.col("seq").cast("bigint").alias("seq"), F.col("expected_rev").cast("bigint").alias("expected_rev"), "status")
    grouped = asked.join(known, "id", "left").groupBy("id")
    return grouped.applyInPandasWithState(judge_row, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def start_patches(patches: DataFrame, rows: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write ``judged_stream`` to Parquet files in ``sink``, each patch exactly once.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes; by default the stream runs on.
    """
    writer = judged_stream(patches, rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
