"""Coercion of source cells to the contract's column types.

Each function returns JSON text; what cannot be coerced stays as the original
string for validation to report. ``*_failure`` name values that may not enter
the column at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.contract import TEXT_TYPES
from rowsmith.functions import text

# Accepted boolean words and the date shapes.
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")
DATE_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
HAS_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]"
NEEDS_JSON = "map this to a json column"
NOT_JSON_MARK = "!"
# Types whose coercion reads the trimmed cell; long texts are never trimmed.
TRIMMED_TYPES = ("select", "multi_select", "number", "boolean", "date")


def is_date(c: Column) -> Column:
    """A real calendar date in ``YYYY-MM-DD`` form, years 0001 to 9999."""
    shaped = F.when(c.rlike(DATE_SHAPE), c)
    return F.coalesce(shaped.try_cast("date").isNotNull() & ~c.startswith("0000"), F.lit(False))


def to_number(c: Column, trimmed: Column | None = None) -> Column:
    return F.coalesce(text.number_text(text.strip(c) if trimmed is None else trimmed), text.quote(c))


def to_boolean(c: Column, trimmed: Column | None = None) -> Column:
    word = F.lower(text.strip(c) if trimmed is None else trimmed)
    return F.when(word.isin(*TRUE_WORDS), "true").when(word.isin(*FALSE_WORDS), "false").otherwise(text.quote(c))


def multi_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,;]"), text.strip), lambda x: x != "")


def to_multi(c: Column, trimmed: Column | None = None) -> Column:
    return text.array_text(multi_items(c))


def to_select(c: Column, trimmed: Column | None = None) -> Column:
    return text.quote(text.strip(c) if trimmed is None else trimmed)


def as_is(c: Column, trimmed: Column | None = None) -> Column:
    return text.quote(c)


def to_date_text(c: Column, trimmed: Column | None = None) -> Column:
    trimmed = text.strip(c) if trimmed is None else trimmed
    return text.quote(F.when(is_date(trimmed), trimmed).otherwise(c))


def date_text_failure(c: Column, trimmed: Column | None = None) -> Column:
    trimmed = text.strip(c) if trimmed is None else trimmed
    timed = trimmed.rlike(HAS_TIME)
    return F.when(timed, F.concat(text.shown(trimmed), F.lit(" has a time component")))


_FROM_TEXT = {
    "number": to_number,
    "boolean": to_boolean,
    "multi_select": to_multi,
    "select": to_select,
    "date": to_date_text,
}


def coerce_text(c: Column, type_: str, trimmed: Column | None = None) -> Column:
    """A raw text cell for a column of ``type_``."""
    return _FROM_TEXT.get(type_, as_is)(c, trimmed)


def text_cell(c: Column, type_: str, trimmed: Column | None = None) -> tuple[Column, Column]:
    """(value, failure) of a raw cell; a whitespace-only cell is absent."""
    if type_ not in TRIMMED_TYPES:
        return F.when(text.is_present(c), as_is(c)), F.lit(None).cast("string")
    trimmed = text.strip(c) if trimmed is None else trimmed
    present = trimmed != ""
    if type_ != "date":
        return F.when(present, coerce_text(c, type_, trimmed)), F.lit(None).cast("string")
    failure = date_text_failure(c, trimmed)
    timed = F.coalesce(trimmed.rlike(HAS_TIME), F.lit(False))
    return F.when(present & ~timed, coerce_text(c, type_, trimmed)), failure


def typed_failure(t: Column, type_: str, string: Column | None = None, trimmed: Column | None = None) -> Column:
    """Why a JSON value may not enter a column of ``type_``; NULL when it may."""
    if type_ == "json":
        return F.when(
            t.startswith(NOT_JSON_MARK),
            F.concat(F.substring(t, F.lit(2), F.length(t)), F.lit(" is not representable in JSON")),
        )
    container = t.startswith("{") if type_ == "multi_select" else t.rlike(r"\A[\[{]")
    if type_ != "date":
        return F.when(container, NEEDS_JSON)
    string = text.unquote(t) if string is None else string
    number = F.concat(text.shown_value(t), F.lit(" is a number, not a date (write YYYY-MM-DD)"))
    return (
        F.when(container, NEEDS_JSON)
        .when(text.is_string(t), date_text_failure(string, trimmed))
        .when(t != "null", number)
    )


def _typed_other(t: Column, type_: str) -> Column:
    """A bool, number or list for a column of ``type_``."""
    if type_ in TEXT_TYPES or type_ == "select":
        return F.concat(F.lit('"'), t, F.lit('"'))
    if type_ == "boolean":
        one, zero = r"\A(?:true|1|1\.0)\z", r"\A(?:false|-?0|-?0\.0)\z"
        return F.when(t.rlike(one), "true").when(t.rlike(zero), "false").otherwise(t)
    return t


def coerce_typed(t: Column, type_: str, string: Column | None = None, trimmed: Column | None = None) -> Column:
    """A JSON value for a column of ``type_``; null is absent.

    ``string`` and ``trimmed`` are the unquoted text of ``t`` and its trimmed form
    where the caller has them as columns.
    """
    if type_ == "json":
        return F.when((t != "null") & ~t.startswith(NOT_JSON_MARK), t)
    string = text.unquote(t) if string is None else string
    from_string = t if type_ in TEXT_TYPES else coerce_text(string, type_, trimmed)
    if type_ == "date":
        shown = text.strip(string) if trimmed is None else trimmed
        return F.when(text.is_string(t) & ~shown.rlike(HAS_TIME), from_string)
    refused = t.startswith("{") if type_ == "multi_select" else t.rlike(r"\A[\[{]")
    return F.when(text.is_string(t), from_string).when((t != "null") & ~refused, _typed_other(t, type_))


def typed_cell(
    t: Column, type_: str, string: Column | None = None, trimmed: Column | None = None
) -> tuple[Column, Column]:
    return coerce_typed(t, type_, string, trimmed), typed_failure(t, type_, string, trimmed)
