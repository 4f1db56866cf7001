"""File scans: CSV, JSON Lines, whole JSON documents.

Structured readers return ``(file, row_idx, line, problem)`` where ``line`` is
the record's JSON text; ``operators.records`` flattens it.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions import records, text
from rowsmith.plans import durable
from rowsmith.sources import quoted
from rowsmith.sources.numbering import file_columns, with_row_idx

BOM = "\ufeff"
BOM_AT_START = "\\A\ufeff"


_CSV = {
    # Cells as written: no type guesses, no trimming, no null words.
    "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\u0000", "emptyValue": "", "mode": "PERMISSIVE",
}


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[list[str], DataFrame]:
    """(header, rows) of CSV files that share one header.

    Cells are raw strings: short rows are padded with ``""`` and surplus cells
    dropped. Columns are named ``_c0 ...`` by position, so a repeated or odd
    header cannot rename them. Files are split among tasks, also with ``multi_line=True``,
    which reads cells that hold line ends (see ``quoted``). A fully blank line is not a row.

    A file whose header is another one is not read by position: each of its rows is a
    ``problem`` row, so that no cell lands in a wrong column.
    """
    if multi_line:
        firsts, numbered, header = _quoted_cells(spark, path)
    else:
        numbered, header = _plain_cells(spark, path)
        firsts = numbered.filter(F.col("row_idx") == 1)
    as_read = F.concat_ws("\u001f", F.regexp_replace("_c0", BOM_AT_START, ""), *[F.col(f"_c{i}") for i in range(1, len(header))])
    heads = firsts.select("file", as_read.alias("_head"))
    other = heads.filter(F.col("_head") != "\u001f".join(header)).select(
        "file", F.concat(F.lit("the header differs from the first file's: "), F.replace("_head", F.lit("\u001f"), F.lit(","))).alias("problem")
    )
    rows = numbered.filter(F.col("row_idx") > 1).withColumn("row_idx", F.col("row_idx") - 1)
    other = durable.written(other, "headers")
    return header, rows.join(other, "file", "left")


def _schema(width: int) -> str:
    return ", ".join(f"_c{i} string" for i in range(max(width, 1)))


def _plain_cells(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The cells of single-line records, headers among them, and the first header."""
    reader = spark.read.options(**_CSV)
    scan = reader.csv(path)
    first = scan.limit(1).collect()
    header = _unmarked(first[0]) if first else []
    # Headers are the first rows of their files; the reader leaves them in, so that they can be compared.
    lines = reader.schema(_schema(len(scan.columns))).option("header", False).csv(path)
    cells = [F.coalesce(F.col(f"_c{i}"), F.lit("")).alias(f"_c{i}") for i in range(max(len(header), 1))]
    return with_row_idx(lines.select(*cells, *file_columns())), header


def _quoted_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(first records' cells, all records' cells, header of the first file by name); records may span lines."""
    firsts, records = quoted.csv_records(spark, path)
    first = firsts.orderBy("file").limit(1).collect()
    header = _unmarked(next(csv.reader(io.StringIO(first[0].line, newline="")))) if first else []
    cells = F.from_csv("line", _schema(len(header)), _CSV | {"multiLine": "true"}).alias("_cells")
    named = [F.coalesce(F.col(f"_cells._c{i}"), F.lit("")).alias(f"_c{i}") for i in range(max(len(header), 1))]
    firsts, records = (r.select("file", "row_idx", cells).select("file", "row_idx", *named) for r in (firsts, records))
    return firsts, records, header


def _unmarked(cells: Iterable[str | None]) -> list[str]:
    first, *rest = [cell or "" for cell in cells]
    return [first.lstrip(BOM), *rest]


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record per non-blank line; a bad line is a problem row.

    Gives ``(file, row_idx, line_number, line, problem)``.
    """
    scan = spark.read.text(path).select(F.col("value").alias("line"), *file_columns())
    lines = with_row_idx(scan, keep=text.strip(F.col("line")) != "", line_number="line_number")
    unmarked = F.when(F.col("line_number") == 1, F.regexp_replace("line", BOM_AT_START, "")).otherwise(F.col("line"))
    return check_lines(lines.withColumn("line", unmarked), F.col("line"), F.col("line_number"))


def check_lines(df: DataFrame, line: Column, line_number: Column) -> DataFrame:
    """Attach ``problem``; a problem row keeps its text for quarantine."""
    return df.withColumn("problem", records.line_problem(line, line_number))


def read_json_docs(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON documents: ``(file, doc, problem)``.

    An empty file holds no records. One task reads one file, as a document must
    be parsed whole; large data belongs in JSON Lines.
    """
    docs = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", BOM_AT_START, "").alias("doc")
    )
    blank = F.col("doc").rlike(r"\A\s*\z")
    repeated = records.top_level_duplicate(F.col("doc"))
    joined = F.concat(F.lit("["), F.regexp_replace("doc", r"\}\s*+\{", "},{"), F.lit("]"))
    several = F.size(F.try_parse_json(joined).try_cast("array<variant>")) > 1
    return docs.filter(~blank).withColumn(
        "problem",
        F.when(
            records.is_one_value(F.col("doc")),
            F.when(repeated.isNotNull(), F.concat(F.lit("duplicate top-level key '"), repeated, F.lit("'"))),
        )
        .when(several, "this looks like JSON Lines (one object per line) — save it as .jsonl")
        .otherwise("invalid JSON"),
    )


def gate_files(spark: SparkSession, path: str, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """``(file, length, reason)`` per file: the size cap and the UTF-8 rule.

    The size test runs first on the file listing, so an oversized file's bytes
    are never loaded.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    small = (
        spark.read.format("binaryFile").load(path)
        .filter(F.col("length") <= max_bytes)
        .select(F.col("path").alias("file"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))
    )
    return listed.join(small, "file", "left").select(
        "file",
        "length",
        F.when(F.col("length") > max_bytes, F.lit(f"file is larger than {max_bytes} bytes"))
        .when(~F.col("utf8"), "file is not UTF-8")
        .alias("reason"),
    )
