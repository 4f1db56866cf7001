"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5  # crc32(doc_id) mod FOLDS = 0 is held out from every training


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: Column) -> Column:
    """Whether a row belongs to the fold that no training sees; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` clashes (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def plain_name(name: str) -> str:
    """A column name quoted so that dots and spaces in it are taken literally."""
    return f"`{name.replace('`', '``')}`"


def col(name: str) -> Column:
    return F.col(plain_name(name))


def boxed(docs: DataFrame, *helpers: Column) -> DataFrame:
    """The columns of ``docs`` as one struct ``_doc``, so that no helper column beside it meets one of theirs."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("_doc"), *helpers)


def unboxed(docs: DataFrame) -> list[Column]:
    """The columns that ``boxed`` put away."""
    return [F.col("_doc").getField(c).alias(c) for c in docs.columns]


def text_key(text: Column) -> Column:
    """Sixteen bytes that name a text; null and empty are the same text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
