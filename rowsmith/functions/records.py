"""Reading one JSON text as a record: problems, flattening, unwrapping.

A text is read next to its outline, the same text with every string value emptied.
In the outline the first character of a value is its kind, so a string that looks like
an object or a list is never taken for one. All of it stays inside the engine.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions import text

LINE_KEYS = ("data", "id", "status")
STRICT = {"allowNonNumericNumbers": "false"}
# A key with its colon, or the closing quote of a string value.
_KEY_OR_VALUE = rf'({text.STRING}\s*+:)|"[^"\\]*+(?:\\.[^"\\]*+)*+(")'
PLAIN_KEY = r"[A-Za-z0-9_ -]+(\.[A-Za-z0-9_ -]+)*"
_EMPTY_SEGMENT = r"(\A|\.)(\.|\z)"
_EMPTY_OBJECT = r"\A\s*+\{\s*+\}"
NODES = "array<struct<path:string,raw:string,outline:string,open:boolean,bad:string>>"


def outline(line: Column) -> Column:
    """The text with every string value emptied; keys, numbers and structure stay."""
    return F.regexp_replace(line, _KEY_OR_VALUE, "$1$2$2")


def members(raw: Column) -> Column:
    """Top-level keys of an object text with their values as texts."""
    return F.from_json(raw, "map<string,string>", STRICT)


def items(raw: Column) -> Column:
    return F.from_json(raw, "array<string>", STRICT)


def is_object(outlined: Column) -> Column:
    return F.coalesce(F.ltrim(outlined).startswith("{"), F.lit(False))


def is_list(outlined: Column) -> Column:
    return F.coalesce(F.ltrim(outlined).startswith("["), F.lit(False))


def opens(outlined: Column) -> Column:
    """An object with at least one member."""
    return is_object(outlined) & ~F.coalesce(outlined.rlike(_EMPTY_OBJECT), F.lit(False))


def is_one_value(line: Column) -> Column:
    """Exactly one JSON value and nothing after it.

    The parser ignores trailing text, so the line must also parse wrapped as an
    object member and as a one-element array.
    """
    wrapped = members(F.concat(F.lit('{"v":'), line, F.lit("}")))
    listed = items(F.concat(F.lit("["), line, F.lit("]")))
    return F.coalesce((F.size(wrapped) == 1) & (F.size(listed) == 1), F.lit(False))


def _repeated(keys: Column) -> Column:
    return F.get(F.filter(keys, lambda k, i: F.array_position(keys, k) <= i), F.lit(0))


def top_level_duplicate(line: Column) -> Column:
    """The first repeated top-level key, or NULL."""
    return _repeated(F.json_object_keys(line))


def first_repeated(outlined: Column) -> Column:
    """The first repeated key at any depth, outer objects before what they hold."""
    kind = "array<struct<raw:string,twice:string>>"
    none = F.lit(None).cast("string")

    def node(raw: Column, twice: Column) -> Column:
        return F.struct(raw.alias("raw"), twice.alias("twice"))

    def opened(e: Column) -> Column:
        raw, twice = e["raw"], top_level_duplicate(e["raw"])
        inside = F.transform(F.map_values(members(raw)), lambda c: node(c, none))
        return (
            F.when(is_object(raw), F.when(twice.isNotNull(), F.array(node(none, twice))).otherwise(inside))
            .when(is_list(raw), F.transform(items(raw), lambda c: node(c, none)))
            .otherwise(F.array(node(e["raw"], e["twice"])))
            .cast(kind)
        )

    levels = F.length(outlined) - F.length(F.translate(outlined, "{[", ""))
    start = F.array(node(outlined, none)).cast(kind)
    found = F.aggregate(F.sequence(F.lit(0), levels), start, lambda acc, _: F.flatten(F.transform(acc, opened)).cast(kind))
    return F.get(F.filter(found, lambda e: e["twice"].isNotNull()), F.lit(0))["twice"]


def line_problem(line: Column, line_number: Column) -> Column:
    """Why a JSON line cannot be a record; NULL for a clean object.

    A repeated key at any depth makes the engine's strict parser fail; only lines that
    it refuses and that are valid otherwise are searched for the key.
    """
    strict = F.try_parse_json(line).isNotNull()
    bad = F.concat(F.lit("line "), line_number.cast("string"), F.lit(": invalid JSON"))
    twice = F.concat(F.lit("duplicate key '"), first_repeated(outline(line)), F.lit("'"))
    return (
        F.when(line.isNull(), F.lit(None).cast("string"))
        .when(~is_one_value(line), bad)
        .when(~line.rlike(r"\A\s*+\{"), "record is not an object")
        .when(~strict, F.coalesce(twice, bad))
    )


def _children(path: Column | None, raw: Column, outlined: Column, leaves: list[str]) -> Column:
    """The members of an object as nodes, in source order; ``leaves`` and empty objects stay whole."""
    raws, shapes = members(raw), members(outlined)

    def node(k: Column) -> Column:
        name = k if path is None else F.concat(path, F.lit("."), k)
        shape = F.try_element_at(shapes, k)
        bad = F.when(k.rlike(_EMPTY_SEGMENT), k)
        may_open = opens(shape) & bad.isNull()
        if leaves:
            may_open = may_open & ~name.isin(leaves)
        return F.struct(
            name.alias("path"), F.try_element_at(raws, k).alias("raw"), shape.alias("outline"), may_open.alias("open"), bad.alias("bad")
        )

    return F.transform(F.json_object_keys(outlined), node).cast(NODES)


def nodes(line: Column, leaves: Iterable[str] = ()) -> Column:
    """The leaves of a valid object text, in source order, as ``NODES``."""
    keep = sorted(leaves)
    outlined = outline(line)

    def opened(e: Column) -> Column:
        same = F.struct(*[e[c].alias(c) for c in ("path", "raw", "outline", "open", "bad")])
        return F.when(e["open"], _children(e["path"], e["raw"], e["outline"], keep)).otherwise(F.array(same).cast(NODES))

    def deeper(acc: Column, _: Column) -> Column:
        return F.when(F.exists(acc, lambda e: e["open"]), F.flatten(F.transform(acc, opened))).otherwise(acc).cast(NODES)

    # As many rounds as there are braces; a round without an open object does nothing.
    rounds = F.length(outlined) - F.length(F.replace(outlined, F.lit("{"), F.lit("")))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), _children(None, line, outlined, keep), deeper)


def nodes_problem(found: Column) -> Column:
    """A bad path or a path that appears twice, whichever the text has first."""
    paths = F.transform(found, lambda e: e["path"])
    marked = F.transform(
        found,
        lambda e, i: F.when(e["bad"].isNotNull(), F.concat(F.lit("invalid path '"), e["bad"], F.lit("': empty segment"))).when(
            F.array_position(paths, e["path"]) <= i, F.concat(F.lit("path '"), e["path"], F.lit("' appears twice"))
        ),
    )
    return F.get(F.filter(marked, lambda p: p.isNotNull()), F.lit(0))


def value_text(raw: Column, shape: Column) -> Column:
    """Canonical text of a member's value, from its text and its outline."""
    return (
        F.when(raw.isNull(), "null")
        .when(shape == "", text.quote(raw))
        .when(is_object(shape) | is_list(shape), text.canonical_nested(raw))
        .when(raw.rlike("[.eE]") & raw.rlike(r"\A-?[0-9]"), text.float_text(raw.try_cast("double")))
        .otherwise(raw)
    )


def node_texts(found: Column) -> Column:
    return F.transform(found, lambda e: value_text(e["raw"], e["outline"]))


def has_odd_keys(line: Column) -> Column:
    """A key that is empty or holds a dot or an escape, which a dotted path could be taken for."""
    keys = F.regexp_replace(line, _KEY_OR_VALUE, "$1")
    return F.coalesce(keys.rlike(r'""\s*+:|"[^".\\]*+[.\\]'), F.lit(False))
