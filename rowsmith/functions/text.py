"""JSON texts as column expressions.

Every stored cell is a canonical JSON text, so equality, grouping and hashing
are plain string operations inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace characters trimmed from cells.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as they appear inside a JSON string.
_JSON_SPACE = (
    r"(?:[ \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    r"|\\[tnrf]|\\u000b|\\u001[c-f])"
)
_VISIBLE = r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Possessive loops: they never backtrack, so long texts cannot exhaust the stack.
_BLANK = rf'\A"{_JSON_SPACE}*+"\z'
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
STRING_LIST = rf"\A\[(?:{STRING}(?:,{STRING})*+)?\]\z"
NUMBER = r"\A-?[0-9]"
_COMMON_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_RARE_CONTROL = "[\\x00-\\x07\\x0b\\x0e-\\x1f]"
_ESCAPED = r'["\\\x00-\x1f]'
# Decimals that are their own canonical text: at most 14 digits, so a double gives them back, and no zeros to cut.
_OWN_TEXT = r"\A-?(?:0|[1-9][0-9]{0,9})\.(?:[0-9]|[0-9]{1,3}[1-9])\z"


def strip(c: Column) -> Column:
    """Trim all Unicode whitespace (``trim`` alone removes only spaces)."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_present(c: Column) -> Column:
    """Holds more than whitespace: stops at the first such character."""
    return c.rlike(_VISIBLE)


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def quote(c: Column) -> Column:
    """A string column as JSON string text; NULL stays NULL.

    Most texts need no escapes. For others the engine's own writer does it in one pass. It spells rare
    control characters with capital hex digits, so only texts that hold one are escaped piecewise.
    """
    common = c
    for raw, escaped in _COMMON_ESCAPES.items():
        common = _swap(common, raw, escaped)
    each = F.transform(
        F.regexp_extract_all(common, F.lit("(?s)."), F.lit(0)),
        lambda ch: F.when(ch.rlike(_RARE_CONTROL), F.concat(F.lit("\\u00"), F.lower(F.hex(ch)))).otherwise(ch),
    )
    piecewise = F.concat(F.lit('"'), F.array_join(each, ""), F.lit('"'))
    simple = F.concat(F.lit('"'), c, F.lit('"'))
    escaped = F.when(c.rlike(_RARE_CONTROL), piecewise).otherwise(F.to_json(c.cast("variant")))
    return F.when(~c.rlike(_ESCAPED), simple).otherwise(escaped)


def quoted_literal(text: str) -> str:
    """The JSON text of a driver-side string, equal to ``quote`` of it."""
    import json

    return json.dumps(text, ensure_ascii=False)


def is_string(t: Column) -> Column:
    return t.startswith('"')


def unquote(t: Column) -> Column:
    """The string inside JSON string text; NULL for any other JSON value."""
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    decoded = F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v")
    return F.when(is_string(t), F.when(F.contains(t, F.lit("\\")), decoded).otherwise(inner))


def is_blank(t: Column) -> Column:
    """JSON text of a string that is empty or only whitespace."""
    return t.rlike(_BLANK)


def is_untrimmed(t: Column) -> Column:
    text = unquote(t)
    return text != strip(text)


def is_number(t: Column) -> Column:
    return t.rlike(NUMBER)


def kind(t: Column) -> Column:
    """The value's type name as error reports show it."""
    return (
        F.when(is_string(t), "str")
        .when(t.startswith("["), "list")
        .when(t.startswith("{"), "dict")
        .when(t.isin("true", "false"), "bool")
        .when(t == "null", "NoneType")
        .when(t.rlike("[.eE]"), "float")
        .otherwise("int")
    )


def shown(text: Column) -> Column:
    """A string as error reports quote it: single quotes unless it holds one."""
    body = _swap(text, "\\", "\\\\")
    for raw in ("\n", "\r", "\t"):
        body = _swap(body, raw, _COMMON_ESCAPES[raw])
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return (
        F.when(~single, F.concat(F.lit("'"), body, F.lit("'")))
        .when(~double, F.concat(F.lit('"'), body, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), _swap(body, "'", "\\'"), F.lit("'")))
    )


def shown_value(t: Column) -> Column:
    """Any JSON text as error reports quote it (containers keep their JSON form)."""
    return (
        F.when(is_string(t), shown(unquote(t)))
        .when(t == "true", "True")
        .when(t == "false", "False")
        .when(t == "null", "None")
        .otherwise(t)
    )


def shown_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, shown), ", "), F.lit("]"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once, for rare branches that read it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _respell_exponent(shown: Column) -> Column:
    """``1.5E7`` as plain digits from 1e-4 up to 1e16, else as ``1.5e+17``."""
    sign = F.when(shown.startswith("-"), "-").otherwise("")
    parts = F.split(F.ltrim(shown, F.lit("-")), "E")
    mantissa = F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", "")
    power = F.get(parts, F.lit(1)).cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    wide = F.rpad(digits, F.greatest(power + 2, F.length(digits)), "0")
    large = F.concat(F.substring(wide, F.lit(1), power + 1), F.lit("."), F.substring(wide, power + 2, F.length(wide)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0")
    scientific = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), exponent)
    return F.concat(
        sign, F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(scientific)
    )


def float_text(x: Column) -> Column:
    """A double as JSON text: plain digits from 1e-4 up to 1e16, else ``1e+16`` form."""
    shown = x.cast("string")
    return F.when(shown.contains("E"), let(shown, _respell_exponent)).otherwise(shown)


def number_text(token: Column) -> Column:
    """Canonical JSON text of a decimal token; NULL when it is not a finite number."""
    whole = F.regexp_replace(F.ltrim(token, F.lit("+")), r"\A(-?)0+(?=[0-9])", "$1")
    real = F.when(token.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), token).try_cast("double")
    finite = F.when(F.abs(real) < float("inf"), real)
    return F.when(token.rlike(_OWN_TEXT), token).when(
        token.rlike(r"\A[+-]?[0-9]+\z"), F.when(token.rlike(r"\A-0+\z"), "0").otherwise(whole)
    ).otherwise(float_text(finite))


def string_array(t: Column) -> Column:
    """JSON array text as an array of strings (non-string items lose their type)."""
    return F.from_json(t, "array<string>")


def array_text(items: Column) -> Column:
    """An array of strings as JSON array text."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quote), ","), F.lit("]"))


def loose(t: Column) -> Column:
    """A text that is equal for loosely equal values: 1, 1.0 and true are the same.

    Inside containers 1 and 1.0 are the same, too.
    """
    whole = F.regexp_replace(F.regexp_replace(t, r"\.0\z", ""), r"\A-0\z", "0")
    return (
        F.when(is_string(t), t)
        .when(t == "true", "1")
        .when(t == "false", "0")
        .when(t == "null", F.lit(None).cast("string"))
        .when(t.rlike(r"\A[\[{]"), F.coalesce(F.to_json(F.try_parse_json(t)), t))
        .when(t.rlike(r"\A-?[0-9]+\.0\z"), whole)
        .when(t.rlike(r"\A-?[0-9.]+e\+[0-9]+\z"), F.coalesce(t.try_cast("decimal(38,0)").cast("string"), t))
        .otherwise(t)
    )


def loosely_differ(a: Column, b: Column) -> Column:
    return ~loose(a).eqNullSafe(loose(b))


def stored_size(t: Column) -> Column:
    """UTF-8 bytes of the value written with ``", "`` and ``": "`` separators."""
    bare = F.regexp_replace(t, STRING, "")
    return F.octet_length(t) + F.length(bare) - F.length(F.translate(bare, ",:", ""))


# A string, a number, or what stands between them.
_TOKEN = rf'{STRING}|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'
_HELD = "\\u0001f"  # marks a number held back from the engine's parser, which would respell it


def canonical_nested(t: Column) -> Column:
    """Sorted-key compact text of a list or object text; other texts stay.

    The engine's parser sorts the keys. Floats and integers of 19 or more digits go
    through it as marked strings, as it would shorten them; control characters of
    strings are spelled as ``quote`` does.
    """
    nested = t.startswith("{") | t.startswith("[")

    def tokens(c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))

    def held(x: Column) -> Column:
        number = F.when(x.rlike("[.eE]"), float_text(x.try_cast("double"))).otherwise(x)
        respelled = x.rlike(r"\A-?[0-9]") & (x.rlike("[.eE]") | (F.length(x) > 18))
        return F.when(respelled, F.concat(F.lit(f'"{_HELD}'), number, F.lit('"'))).otherwise(x)

    def spelled(x: Column) -> Column:
        return F.when(x.startswith('"') & x.contains("\\u00"), quote(unquote(x))).otherwise(x)

    inside = F.when(t.rlike("[.eE]|[0-9]{19}"), F.array_join(F.transform(tokens(t), held), "")).otherwise(t)
    ordered = F.to_json(F.try_parse_json(inside))
    back = F.regexp_replace(ordered, r'"\\u0001f([^"]*+)"', "$1")
    exact = F.when(back.contains("\\u00"), F.array_join(F.transform(tokens(back), spelled), "")).otherwise(back)
    return F.when(nested, exact).otherwise(t)
