"""Canonical objects, snapshot lines, row hashes and map merges."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions import text

Cells = Callable[[str], Column]
HASH_PREFIX = "sha256:"
NULL = "null"


def cells_of(data: Column | str = "data") -> Cells:
    """Read cells out of a ``map<string,string>`` column."""
    column = F.col(data) if isinstance(data, str) else data
    return lambda key: column.getItem(key)


def absent(t: Column) -> Column:
    """NULL for an absent cell and for an explicit JSON null."""
    return F.when(t != NULL, t)


def object_text(cells: Cells, keys: Iterable[str], drop_null: bool = False) -> Column:
    """Sorted-key compact object text of the present ``keys``.

    The keys are known up front, so this is one codegen'd concatenation: an
    absent cell makes its part NULL and ``concat_ws`` leaves it out.
    """
    parts = [
        F.concat(F.lit(text.quoted_literal(k) + ":"), absent(cells(k)) if drop_null else cells(k))
        for k in sorted(keys)
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts) if parts else F.lit(""), F.lit("}"))


def line_text(data: Column, id_: Column, status: Column) -> Column:
    """One snapshot line without its newline, keys in sorted order."""
    return F.concat(
        F.lit('{"data":'), data, F.lit(',"id":'), text.quote(id_), F.lit(',"status":'),
        text.quote(status), F.lit("}"),
    )


def canonical_line(cells: Cells, keys: Iterable[str], id_: Column, status: Column) -> Column:
    return line_text(object_text(cells, keys), id_, status)


def row_hash(cells: Cells, keys: Iterable[str]) -> Column:
    """Identity of a row for sync: only active keys count, and nulls are dropped."""
    return F.concat(F.lit(HASH_PREFIX), F.sha2(object_text(cells, keys, drop_null=True), 256))


def nested_text(cells: Cells, keys: Iterable[str], drop_null: bool = False, ordered: bool = False) -> Column:
    """Object text with dotted keys re-nested.

    An inner object appears only if one of its children is present. ``ordered``
    keeps the given key order instead of sorting at every level.
    """
    tree: dict = {}
    for key in keys:
        node = tree
        *parents, last = key.split(".")
        if "" in (*parents, last):
            raise ValueError(f"invalid path '{key}': empty segment")
        for part in parents:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"path '{key}' clashes with a value at '{part}'")
        if last in node:
            raise ValueError(f"path '{key}' clashes with another path")
        node[last] = key

    def render(node: dict, top: bool) -> Column:
        parts = []
        for name in node if ordered else sorted(node):
            child = node[name]
            if isinstance(child, dict):
                value = render(child, False)
            else:
                value = absent(cells(child)) if drop_null else cells(child)
            parts.append(F.concat(F.lit(text.quoted_literal(name) + ":"), value))
        body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        return body if top else F.when(F.coalesce(*parts).isNotNull(), body)

    return render(tree, True) if tree else F.lit("{}")


def as_map(pairs: dict[str, Column]) -> Column:
    """A map of the cells that are present."""
    if not pairs:
        return F.lit(None).cast("map<string,string>")
    full = F.map_from_arrays(
        F.array(*[F.lit(k) for k in pairs]), F.array(*[v for v in pairs.values()])
    )
    return F.map_filter(full, lambda _, v: v.isNotNull())


def prune(data: Column, keys: Iterable[str]) -> Column:
    """Keep only the fields of the active contract."""
    keys = list(keys)
    return F.map_filter(data, lambda k, _: k.isin(keys))


def merge_patch(old: Column, new: Column) -> Column:
    """Shallow merge where an explicit null is stored as null."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))


def merge_sync(old: Column, new: Column) -> Column:
    """Shallow merge where an explicit null removes the field."""
    return F.map_filter(merge_patch(old, new), lambda _, v: v != NULL)


def changed_fields(old: Column, new: Column, strict: bool = True) -> Column:
    """``array<struct<field,old,new>>`` of differing fields, by field name.

    Absent and null are the same. ``strict`` compares canonical texts, otherwise
    1, 1.0 and true are equal.
    """
    pairs = F.map_zip_with(old, new, lambda _, a, b: F.struct(absent(a).alias("old"), absent(b).alias("new")))

    def differs(pair: Column) -> Column:
        a, b = pair["old"], pair["new"]
        return ~a.eqNullSafe(b) if strict else text.loosely_differ(a, b)

    return F.array_sort(
        F.transform(
            F.map_entries(F.map_filter(pairs, lambda _, pair: differs(pair))),
            lambda e: F.struct(
                e["key"].alias("field"), e["value"]["old"].alias("old"), e["value"]["new"].alias("new")
            ),
        )
    )
