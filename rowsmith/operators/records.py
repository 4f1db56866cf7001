"""From record texts to flat rows: locating, unwrapping, flattening."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.contract import Contract, Field
from rowsmith.functions import records, text
from rowsmith.plans.fence import fenced
from rowsmith.plans.skew import attach_by_key

CANNOT_TELL = "can't tell which key holds the records — choose a records_key"


def record_list(docs: DataFrame, records_key: str | None = None) -> DataFrame:
    """Which key of each document holds the records.

    Adds ``chosen`` (NULL for a top-level list), ``candidates`` (keys holding a
    list), ``ignored`` (the other keys) and ``problem``.
    """
    shapes = F.col("_shapes")
    keys = F.json_object_keys("_outline")
    lists = F.filter(keys, lambda k: records.is_list(F.try_element_at(shapes, k)))
    objects = F.filter(
        F.col("candidates"),
        lambda k: F.forall(records.items(F.try_element_at(shapes, k)), records.is_object),
    )
    if records_key is not None:
        chosen = F.when(F.array_contains("candidates", records_key), F.lit(records_key))
        missing = F.lit(f"records_key '{records_key}' is not a list in this file")
    else:
        export = records.is_object(F.try_element_at(shapes, F.lit("manifest"))) & F.array_contains("candidates", "rows")
        chosen = F.when(export, F.lit("rows")).when(F.size("_objects") == 1, F.get("_objects", F.lit(0)))
        found = F.concat(F.lit(" (lists found: "), F.array_join("candidates", ", "), F.lit(")"))
        missing = F.concat(F.lit(CANNOT_TELL), F.when(F.size("candidates") > 0, found).otherwise(""))
    readable = F.when(F.col("problem").isNull(), F.col("doc"))
    located = (
        docs.withColumn("_outline", records.outline(readable))
        .withColumn("_shapes", F.when(records.is_object(F.col("_outline")), records.members(F.col("_outline"))))
        .withColumn("_list", records.is_list(F.col("_outline")))
        .withColumn("candidates", F.when(shapes.isNotNull(), lists))
        .withColumn("_objects", objects)
        .withColumn("chosen", F.when(shapes.isNotNull(), chosen))
        .withColumn("ignored", F.when(F.col("chosen").isNotNull(), F.filter(keys, lambda k: k != F.col("chosen"))))
    )
    is_null = F.coalesce(F.col("_outline").rlike(r"\A\s*+null\s*+\z"), F.lit(False))
    problem = (
        F.when(F.col("_list") | is_null | F.col("problem").isNotNull(), F.lit(None).cast("string"))
        .when(shapes.isNull(), "expected a list of records, or an object containing one")
        .when(F.col("chosen").isNull(), missing)
    )
    return located.withColumn("problem", F.coalesce(F.col("problem"), problem)).drop("_objects")


ENTRIES_TYPE = "array<struct<row_idx:bigint,line:string,problem:string>>"


def locate_records(docs: DataFrame, records_key: str | None = None) -> DataFrame:
    """``(file, row_idx, line, problem)`` of every record; row 0 is a whole-file problem.

    One pass over the documents: each becomes its list of entries, exploded once.
    Whether an item is an object is told by its outline, so a string that holds JSON,
    a number or a null is reported and never read as a record.
    """
    located = record_list(docs, records_key)
    raw = F.when(F.col("_list"), F.col("doc")).otherwise(F.try_element_at(records.members(F.col("doc")), F.col("chosen")))
    shape = F.when(F.col("_list"), F.col("_outline")).otherwise(F.try_element_at(F.col("_shapes"), F.col("chosen")))

    def entry(idx: Column, line: Column, problem: Column) -> Column:
        return F.struct(idx.cast("bigint").alias("row_idx"), line.alias("line"), problem.alias("problem"))

    def item(x: Column, i: Column) -> Column:
        line = F.when(x["raw"].isNull(), "null").when(x["shape"] == "", text.quote(x["raw"])).otherwise(x["raw"])
        return entry(i + 1, line, F.when(~records.is_object(x["shape"]), "record is not an object"))

    both = F.arrays_zip(records.items(raw).alias("raw"), records.items(shape).alias("shape"))
    found = F.transform(both, item).cast(ENTRIES_TYPE)
    whole = F.array(entry(F.lit(0), F.lit(None).cast("string"), F.col("problem"))).cast(ENTRIES_TYPE)
    entries = F.when(F.col("problem").isNotNull(), whole).otherwise(found)
    rows = located.select("file", F.explode_outer(entries).alias("_e")).filter(F.col("_e").isNotNull()).select("file", "_e.*")
    checked = records.line_problem(F.when(F.col("row_idx") > 0, F.col("line")), F.col("row_idx"))
    return rows.select("file", "row_idx", "line", F.coalesce("problem", checked).alias("problem"))


def is_export_line(line: Column) -> Column:
    """Exactly the keys id, status and data, with data an object."""
    shapes = records.outline(line)
    keys = F.json_object_keys(shapes)
    exact = F.coalesce(F.array_sort(keys) == F.array(*[F.lit(k) for k in records.LINE_KEYS]), F.lit(False))
    return F.when(exact, records.is_object(F.try_element_at(records.members(shapes), F.lit("data")))).otherwise(F.lit(False))


def export_files(recs: DataFrame) -> DataFrame:
    """Per file: record count and whether every readable record is an export line."""
    readable = F.col("problem").isNull() | ~F.col("problem").contains("invalid JSON")
    lines = recs.filter(readable & (F.col("row_idx") > 0))
    return lines.groupBy("file").agg(
        F.count("*").alias("records"), F.bool_and(is_export_line(F.col("line"))).alias("all_lines")
    )


def unwrap_lines(recs: DataFrame) -> DataFrame:
    """Replace each record of an all-export-lines file by its ``data``.

    A file may hold any share of the rows, so its flag is joined with salting.
    """
    flagged = export_files(recs).filter("all_lines")
    joined = attach_by_key(recs, flagged, "file", "records", F.col("row_idx"))
    unwrap = F.coalesce(F.col("all_lines"), F.lit(False)) & F.coalesce(~F.col("problem").contains("invalid JSON"), F.lit(True))
    data = F.when(unwrap, F.try_element_at(records.members(F.col("line")), F.lit("data")))
    rows = joined.withColumn("_unwrap", unwrap).withColumn("line", F.coalesce(data, "line"))
    checked = records.line_problem(F.when(F.col("_unwrap"), F.col("line")), F.col("row_idx"))
    problem = F.when(F.col("_unwrap"), checked).otherwise(F.col("problem"))
    return rows.withColumn("problem", problem).drop("records", "all_lines", "_unwrap")


def read_records(docs: DataFrame, records_key: str | None = None) -> DataFrame:
    """Documents to numbered records: located, unwrapped when they are export lines, checked.

    Gives ``(file, row_idx, line, problem)``; a problem record keeps its text and number.
    """
    return unwrap_lines(locate_records(docs, records_key))


def flatten_records(recs: DataFrame, leaves: Iterable[str] = ()) -> DataFrame:
    """Add ``rec`` (dotted path to canonical text) and ``paths`` in source order.

    ``leaves`` are the json columns, whose objects stay whole. A path that appears
    twice or has an empty segment makes the record a problem. Without a ``problem``
    column the lines are checked first.
    """
    if "problem" not in recs.columns:
        checked = records.line_problem(F.col("line"), F.lit(0))
        recs = recs.withColumn("problem", F.regexp_replace(checked, r"\Aline 0: ", ""))
    # One projection per step, so that no step repeats the one before.
    readable = F.when(F.col("problem").isNull(), F.col("line"))
    flat = recs.withColumn("_nodes", F.when(readable.isNotNull(), records.nodes(readable, leaves)))
    flat = flat.withColumn("problem", F.coalesce("problem", records.nodes_problem(F.col("_nodes"))))
    flat = flat.withColumn("paths", F.when(F.col("problem").isNull(), F.transform("_nodes", lambda e: e["path"])))
    texts = F.when(F.col("problem").isNull(), records.node_texts(F.col("_nodes")))
    return fenced(flat.withColumn("rec", F.map_from_arrays("paths", texts)).drop("_nodes"), ["problem", "paths", "rec"])


def known_cells(recs: DataFrame, contract: Contract) -> DataFrame:
    """Add ``json:<key>`` per active column, the canonical text at its path, and ``unknown``.

    The contract names every path, so an ordinary line is taken apart once per object
    above a known path. Lines with a key that a dotted path could be taken for, and
    contracts with unusual key characters, are flattened instead; both give the same
    texts and problems. ``unknown`` lists the paths of a record that are no active column,
    NULL when there are none.
    """
    keys = contract.active_keys
    flat = recs if "problem" in recs.columns else recs.withColumn("problem", F.lit(None).cast("string"))
    plain_keys = all(re.fullmatch(records.PLAIN_KEY, k) for k in keys)
    readable = F.col("problem").isNull() & F.col("line").isNotNull()
    flat = flat.withColumn("_odd", readable & (records.has_odd_keys(F.col("line")) if plain_keys else F.lit(True)))
    odd_line = F.when(F.col("_odd"), F.col("line"))
    flat = flat.withColumn("_nodes", F.when(F.col("_odd"), records.nodes(odd_line, contract.json_keys)))
    flat = flat.withColumn("problem", F.coalesce("problem", records.nodes_problem(F.col("_nodes"))))
    paths = F.transform("_nodes", lambda e: e["path"])
    flattened = F.when(F.col("_odd") & F.col("problem").isNull(), F.map_from_arrays(paths, records.node_texts(F.col("_nodes"))))
    plain = F.when(readable & ~F.col("_odd"), F.col("line"))
    flat = flat.withColumns({"_rec": flattened, "_raw:": plain, "_outline:": records.outline(plain)})

    def parent(path: str) -> str:
        return path.rpartition(".")[0]

    def name(path: str) -> Column:
        return F.lit(path.rpartition(".")[2])

    whole = [k for k in keys if not any(k.startswith(j + ".") for j in contract.json_keys)] if plain_keys else []
    above = {".".join(k.split(".")[:i]) for k in whole for i in range(len(k.split(".")))}
    above = sorted(above, key=lambda p: (p.count(".") + bool(p), p))  # outer objects first
    for path in above:
        raw, shape = F.col(f"`_raw:{path}`"), F.col(f"`_outline:{path}`")
        is_object = records.is_object(shape)
        flat = flat.withColumns(
            {f"_raws:{path}": F.when(is_object, records.members(raw)), f"_shapes:{path}": F.when(is_object, records.members(shape))}
        )
        raws, shapes = F.col(f"`_raws:{path}`"), F.col(f"`_shapes:{path}`")
        inner = [p for p in above if p and parent(p) == path]
        flat = flat.withColumns(
            {f"_raw:{p}": F.try_element_at(raws, name(p)) for p in inner}
            | {f"_outline:{p}": F.try_element_at(shapes, name(p)) for p in inner}
        )
    # A record with a path that is not a key of the contract is flattened for the names alone.
    cells, strange = {}, F.lit(False)
    for path in above:
        children = {p.rpartition(".")[2] for p in (*above, *whole) if p and parent(p) == path}
        extra = F.array_except(F.map_keys(F.col(f"`_raws:{path}`")), F.array(*[F.lit(c) for c in sorted(children)]))
        scalar = ~records.opens(F.col(f"`_outline:{path}`")) & F.col(f"`_outline:{path}`").isNotNull()
        strange = strange | F.coalesce(F.size(extra) > 0, F.lit(False)) | (scalar if path else F.lit(False))
    for k in keys:
        found = F.col("_rec")[k]
        if k in whole:
            raws, shapes = F.col(f"`_raws:{parent(k)}`"), F.col(f"`_shapes:{parent(k)}`")
            raw, shape = F.try_element_at(raws, name(k)), F.try_element_at(shapes, name(k))
            there = F.coalesce(F.map_contains_key(raws, name(k)), F.lit(False))
            if k not in contract.json_keys:  # an object with members is a level, not a cell
                there = there & ~records.opens(shape)
                strange = strange | F.coalesce(records.opens(shape), F.lit(False))
            found = F.coalesce(found, F.when(there, records.value_text(raw, shape)))
        cells[f"json:{k}"] = F.when(F.col("problem").isNull(), found)
    named = F.when(F.col("_odd"), paths).when(
        readable & strange, F.transform(records.nodes(F.when(strange, plain), contract.json_keys), lambda e: e["path"])
    )
    cells["unknown"] = F.when(F.col("problem").isNull(), F.filter(named, lambda p: ~p.isin(keys)))
    made = [f"{mark}:{p}" for p in above for mark in ("_raw", "_outline", "_raws", "_shapes")]
    done = flat.withColumns(cells).drop("_odd", "_nodes", "_rec", "_raw:", "_outline:", *made)
    return fenced(done, ["problem", *cells])


def known_cell(key: str) -> Column:
    return F.col(f"`json:{key}`")


def discover_paths(flat: DataFrame) -> DataFrame:
    """Distinct paths in first-seen order: ``(path, first_row, position)``."""
    seen = flat.select("row_idx", F.posexplode("paths").alias("pos", "path"))
    first = seen.groupBy("path").agg(F.min(F.struct("row_idx", "pos")).alias("_at"))
    return first.select(
        "path", F.col("_at.row_idx").alias("first_row"), F.col("_at.pos").cast("bigint").alias("position")
    ).orderBy("first_row", "position")


def unknown_paths(flat: DataFrame, active_keys: Iterable[str]) -> DataFrame:
    """Source paths without a contract column: errors, or listed as ignored."""
    return discover_paths(flat).filter(~F.col("path").isin(list(active_keys)))


def usable_keys(recs: DataFrame, key: str) -> DataFrame:
    """The key values of a file that can name rows: non-empty strings.

    Only the key's own path is read of each record.
    """
    value = text.unquote(known_cell(key))
    return known_cells(recs, Contract.of(Field(key))).filter(value != "").select("row_idx", value.alias("row_key"))
