"""Validation rules compiled from a contract to column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.contract import TEXT_TYPES, Contract, Field
from rowsmith.functions import coerce, jsonrules, text
from rowsmith.functions.canon import Cells

# Fixed value: the largest JSON cell, in bytes.
JSON_CELL_MAX_BYTES = 262_144
NO_SURROUNDING_SPACE = "key value must not have leading or trailing whitespace"
ERRORS_TYPE = "array<struct<column:string,reason:string>>"


def is_empty(t: Column, type_: str) -> Column:
    """Null, whitespace-only text or an empty list; for json only null."""
    missing = t.isNull() | (t == "null")
    if type_ == "json":
        return missing
    return missing | F.coalesce(text.is_blank(t) | (t == "[]"), F.lit(False))


def options_text(field: Field) -> str:
    return "the options" if field.options_table else repr(list(field.options or ()))


def _select_error(field: Field, t: Column) -> Column:
    allowed = [text.quoted_literal(o) for o in field.options or ()]
    shown = F.lit(options_text(field))
    shape = F.when(~text.is_string(t), F.concat(F.lit("expected one of "), shown, F.lit(", got "), text.kind(t)))
    if field.options_table:
        return shape
    return shape.when(
        ~t.isin(allowed),
        F.concat(F.lit("'"), text.unquote(t), F.lit("' is not one of "), shown),
    )


def _multi_error(field: Field, t: Column) -> Column:
    listed = F.lit(options_text(field))
    bad = F.filter(text.string_array(t), lambda x: ~x.isin(list(field.options or ())))
    shape = F.when(~t.rlike(text.STRING_LIST), F.concat(F.lit("expected a list of strings from "), listed))
    if field.options_table:
        return shape
    return shape.when(F.size(bad) > 0, F.concat(text.shown_list(bad), F.lit(" not in "), listed))


def _json_error(field: Field, t: Column) -> Column:
    size = text.stored_size(t)
    # A text below half the cap cannot exceed it once separators are widened.
    over = (F.octet_length(t) > JSON_CELL_MAX_BYTES // 2) & (size > JSON_CELL_MAX_BYTES)
    error = F.when(
        over,
        F.concat(F.lit("value is "), size.cast("string"), F.lit(f" bytes; the limit is {JSON_CELL_MAX_BYTES}")),
    )
    if field.json_schema:
        error = F.coalesce(error, jsonrules.schema_error(t, field.json_schema))
    return error


def type_error(field: Field, t: Column) -> Column:
    """Why a non-empty value does not fit the column; NULL when it fits."""
    got = F.concat(F.lit(", got "), text.kind(t))
    if field.type in TEXT_TYPES:
        error = F.when(~text.is_string(t), F.concat(F.lit("expected text"), got))
    elif field.type == "number":
        error = F.when(~text.is_number(t), F.concat(F.lit("expected a number"), got))
    elif field.type == "boolean":
        error = F.when(~t.isin("true", "false"), F.concat(F.lit("expected a boolean"), got))
    elif field.type == "select":
        error = _select_error(field, t)
    elif field.type == "multi_select":
        error = _multi_error(field, t)
    elif field.type == "json":
        return _json_error(field, t)
    else:
        valid = t.rlike(r'\A"[0-9]{4}-[0-9]{2}-[0-9]{2}"\z') & coerce.is_date(F.substring(t, 2, 10))
        error = F.when(~valid, F.concat(F.lit("expected a date as YYYY-MM-DD, got "), text.shown_value(t)))
    if field.is_key:
        padded = text.is_string(t) & text.is_untrimmed(t)
        error = F.coalesce(error, F.when(padded, NO_SURROUNDING_SPACE))
    return error


def field_error(field: Field, t: Column) -> Column:
    """The one error of a cell: ``required``, a type error, or NULL."""
    on_empty = F.lit("required") if field.required else F.lit(None).cast("string")
    return F.when(is_empty(t, field.type), on_empty).otherwise(type_error(field, t))


def collect(parts: list[Column]) -> Column:
    if not parts:
        return F.array().cast(ERRORS_TYPE)
    return F.array_compact(F.array(*parts)).cast(ERRORS_TYPE)


def error_entry(key: str, reason: Column) -> Column:
    return F.when(reason.isNotNull(), F.struct(F.lit(key).alias("column"), reason.alias("reason")))


def one_error(key: str, reason: Column) -> Column:
    """An error list for a single rule."""
    return collect([error_entry(key, reason)])


def row_errors(cells: Cells, contract: Contract) -> Column:
    """Every (column, reason) of a row, in contract order."""
    return collect([error_entry(f.key, field_error(f, cells(f.key))) for f in contract.active])


def first_error(cells: Cells, contract: Contract) -> Column:
    """The one-row write message: the first error only."""
    messages = F.transform(
        row_errors(cells, contract), lambda e: F.concat(F.lit("column '"), e["column"], F.lit("': "), e["reason"])
    )
    return F.get(messages, F.lit(0))


def missing_required(cells: Cells, contract: Contract) -> Column:
    """Any active required column is empty."""
    flag = F.lit(False)
    for f in contract.active:
        if f.required:
            flag = flag | is_empty(cells(f.key), f.type)
    return flag


def _document_fit(field: Field, t: Column) -> Column:
    """Does a present cell satisfy the contract document shipped with a version?"""
    if field.type in TEXT_TYPES:
        fit = text.is_string(t)
        if field.required:
            fit = fit & (t != '""')
    elif field.type == "number":
        fit = text.is_number(t)
    elif field.type == "boolean":
        fit = t.isin("true", "false")
    elif field.type == "select":
        fit = t.isin([text.quoted_literal(o) for o in field.options or ()])
    elif field.type == "multi_select":
        fit = t.startswith("[") & _multi_error(field, t).isNull()
        if field.required:
            fit = fit & (t != "[]")
    elif field.type == "date":
        fit = t.rlike(r'\A"[0-9]{4}-[0-9]{2}-[0-9]{2}"\z')
    else:
        fit = F.lit(True)
        if field.json_schema:
            fit = jsonrules.schema_error(t, field.json_schema).isNull()
        return fit & (t != "null") if field.required else fit | (t == "null")
    return fit if field.required else fit | t.isin("null", '""', "[]")


def document_errors(data: Column, contract: Contract) -> Column:
    """Snapshot rows against the emitted contract document.

    Required columns must be present and non-empty, optional ones also accept
    null, ``""`` and ``[]``, and no other field may appear.
    """
    parts = []
    for f in contract.active:
        t = data.getItem(f.key)
        reason = F.when(t.isNull(), "required" if f.required else None).when(
            ~_document_fit(f, t), F.lit(f"does not fit {f.type}")
        )
        parts.append(error_entry(f.key, reason))
    extra = F.transform(
        F.array_sort(F.array_except(F.map_keys(data), F.array(*[F.lit(k) for k in contract.active_keys]))),
        lambda k: F.struct(k.alias("column"), F.lit("not in the contract").alias("reason")),
    )
    return F.concat(collect(parts), extra.cast(ERRORS_TYPE))
