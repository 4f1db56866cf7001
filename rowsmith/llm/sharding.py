"""Two-pass external shuffle into shards.

Pass one scatters the records by a seeded hash into buckets that fit in memory; the
scatter is Spark's shuffle, so a bucket lies on disk until its task reads it. Pass two
shuffles every bucket by Fisher-Yates. The buckets one after the other are a random order
of all rows, and shards are equal pieces of it: row counts differ by one at most.

Defined results: a null text weighs nothing beyond its frame, empty and repeated rows are
rows like any other (rows equal in id and text share a bucket unless they outweigh a
piece of one; then they are numbered and dealt to many), a null id is scattered by
its text, an empty table gives no rows, and columns named ``shard`` or ``slot`` keep their
name: the new column then gets an underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.llm.common import boxed, col, free_name
from rowsmith.plans import durable

SHARDS = 24
SEED = 20_241
BUCKET_BYTES = 24 << 20  # text of a bucket, far below what a task may hold
PIECES = 4  # equal rows of more than this part of a bucket are dealt to several
FRAME = 8  # bytes of a record beside its text
BROADCAST_BUCKETS = 200_000  # bucket offsets up to this count (16 bytes each) are broadcast


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + FRAME).cast("long")


def _fisher_yates(n: int, seed: np.ndarray) -> np.ndarray:
    """A uniform permutation of 0 to n-1: each place in turn swaps with one at or behind it."""
    rng = np.random.default_rng(seed)
    other = rng.integers(np.arange(n), n).tolist()
    order = list(range(n))
    for i, j in enumerate(other):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _shuffled(seed: int, shards: int, total: int, names: list[str], shard: str, slot: str):
    def run(table: pa.Table) -> pa.Table:
        given = pc.sort_indices(table.select(["_h", "_size"]), [("_h", "ascending"), ("_size", "ascending")])  # whatever order the rows came in
        bucket, offset = table.column("_bucket")[0].as_py(), table.column("_offset")[0].as_py()
        n = table.num_rows
        order = _fisher_yates(n, np.array([seed, bucket]))
        place = [offset + i for i in range(n)]
        shard_of = [p * shards // total for p in place]
        start = [-(-s * total // shards) for s in shard_of]
        # Fields of the struct are taken one by one, so a bucket is copied once.
        chunks = [c.flatten() for c in table.column("_doc").chunks]
        kinds = [f.type for f in table.schema.field("_doc").type]
        fields = [pa.chunked_array([c[i] for c in chunks], kind) for i, kind in enumerate(kinds)]
        del table, chunks
        order = given.take(pa.array(order))
        table = pa.table([f.take(order) for f in fields], names=names)
        table = table.append_column(shard, pa.array(shard_of, pa.int32()))
        return table.append_column(slot, pa.array([p - s for p, s in zip(place, start, strict=True)], pa.int64()))

    return run


def _dealt(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows whose ``_h`` is in ``repeated`` (_h, pieces), with ``_h`` salted by their number modulo pieces.

    How many rows get a salt depends on their count alone, not on partitions.
    """
    same = durable.written(rows.join(repeated, "_h").withColumn("_at", F.monotonically_increasing_id()), "repeated")
    same = same.withColumn("_part", F.shiftright("_at", 33))
    parts = same.groupBy("_h", "_part").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_h").orderBy("_part")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_h", "_part").orderBy("_at")) - 1
    same = same.withColumn("_inside", inside).join(parts, ["_h", "_part"])
    salted = F.xxhash64("_h", F.pmod(F.col("_before") + F.col("_inside"), F.col("pieces")))
    return durable.written(same.withColumn("_h", salted).select(*rows.columns), "dealt")


def into_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, gapless from 0 in each shard."""
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    h = F.xxhash64(F.lit(seed), col(id), col(text))
    sizes = durable.written(docs.select(h.alias("h"), record_size(col(text)).alias("size")), "sizes")
    all_rows = sizes.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType()), T.StructField(slot, T.LongType())])
    if not all_rows["n"]:
        return docs.sparkSession.createDataFrame([], schema)
    buckets = -(-all_rows["bytes"] // bucket_bytes)
    rows = boxed(docs, h.alias("_h"), record_size(col(text)).alias("_size"))
    # Equal rows that outweigh a piece of a bucket: few, as each weighs that much.
    piece = max(bucket_bytes // PIECES, 1)
    repeated = sizes.groupBy(F.col("h").alias("_h")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    repeated = repeated.filter((F.col("bytes") > piece) & (F.col("n") > 1))
    repeated = durable.written(repeated.select("_h", F.ceil(F.col("bytes") / piece).alias("pieces")), "repeats")
    if not repeated.isEmpty():
        few = F.broadcast(repeated) if repeated.count() <= BROADCAST_BUCKETS else repeated
        same = _dealt(rows, few)
        rows = rows.join(few, "_h", "left_anti").unionByName(same)
        sizes = sizes.join(few, F.col("h") == F.col("_h"), "left_anti").unionByName(same.select(F.col("_h").alias("h"), F.col("_size").alias("size")))
    # Offsets of buckets: one row per bucket, summed up in blocks so that no task sees them all.
    block = 4_096
    counts = sizes.groupBy(F.pmod("h", F.lit(buckets)).alias("_bucket")).agg(F.count("*").alias("n"))
    counts = durable.written(counts.withColumn("block", F.floor(F.col("_bucket") / block)), "buckets")
    blocks = counts.groupBy("block").agg(F.sum("n").alias("in_block"))
    blocks = blocks.withColumn("before", F.sum("in_block").over(Window.orderBy("block")) - F.col("in_block"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("_bucket")) - F.col("n")
    offsets = counts.withColumn("inside", inside).join(blocks, "block")
    offsets = offsets.select(F.col("_bucket"), (F.col("before") + F.col("inside")).alias("_offset"))
    offsets = durable.written(offsets, "offsets")

    rows = rows.withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    rows = rows.join(F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets, "_bucket")
    run = _shuffled(seed, shards, all_rows["n"], docs.columns, shard, slot)
    return rows.groupBy("_bucket").applyInArrow(run, schema)


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder of Parquet files a shard. A bucket lies in one shard or two, so few files are small."""
    sharded.write.mode("errorifexists").partitionBy(shard).parquet(path)
