"""A JSON Schema subset compiled to one column expression.

Supported: ``type properties required additionalProperties items enum const
pattern minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength
minItems maxItems anyOf allOf oneOf not`` and local ``$ref`` (not recursive).
Any other validating keyword is refused when the contract is compiled, never
ignored. The reported error is the first in keyword order.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNOTATIONS = frozenset({"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment", "format", "deprecated", "readOnly", "writeOnly"})
SUPPORTED = frozenset(
    "type properties required additionalProperties items enum const pattern minimum maximum "
    "exclusiveMinimum exclusiveMaximum minLength maxLength minItems maxItems anyOf allOf oneOf not $ref".split()
)


class UnsupportedSchema(ValueError):
    """The schema uses a keyword or reference this compiler does not cover."""


def _kind(v: Column) -> Column:
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .otherwise("number")
    )


def _integral(v: Column) -> Column:
    number = F.try_variant_get(v, "$", "double")
    return number == F.floor(number)


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$[" + json.dumps(name, ensure_ascii=False) + "]", "variant")


def _literal(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _loose_json(value):
    """Numbers as the variant renders them: 1.0 is 1."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, list):
        return [_loose_json(x) for x in value]
    if isinstance(value, dict):
        return {k: _loose_json(x) for k, x in value.items()}
    return value


class _Compiler:
    def __init__(self, root: dict):
        self.root = root

    def resolve(self, ref: str, seen: tuple[str, ...]):
        if not ref.startswith("#"):
            raise UnsupportedSchema(f"only local $ref is supported, got {ref!r}")
        if ref in seen:
            raise UnsupportedSchema(f"recursive $ref {ref!r} is not supported")
        node = self.root
        for part in [p for p in ref[1:].split("/") if p]:
            part = part.replace("~1", "/").replace("~0", "~")
            if not isinstance(node, dict) or part not in node:
                raise UnsupportedSchema(f"json_schema has an unresolvable $ref: {ref}")
            node = node[part]
        return node

    def error(self, v: Column, schema, path: Column, seen: tuple[str, ...] = ()) -> Column:
        """Error text at ``path``, or NULL. ``v`` is a variant that exists."""
        none = F.lit(None).cast("string")
        if schema is True or schema == {}:
            return none
        if schema is False:
            return self.at(path, F.lit("False schema does not allow this value"))
        unknown = set(schema) - SUPPORTED - ANNOTATIONS
        if unknown:
            raise UnsupportedSchema(f"unsupported JSON Schema keyword: {sorted(unknown)[0]!r}")
        kind = _kind(v)
        shown = F.to_json(v)
        found: list[Column] = []

        def fail(condition: Column, message: Column | str) -> None:
            message = F.lit(message) if isinstance(message, str) else message
            found.append(F.when(condition, self.at(path, message)))

        if "$ref" in schema:
            ref = schema["$ref"]
            found.append(self.error(v, self.resolve(ref, seen), path, (*seen, ref)))
        if "type" in schema:
            types = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
            fits = F.lit(False)
            for name in types:
                fits = fits | ((kind == "number") & _integral(v) if name == "integer" else kind == name)
            wanted = ", ".join(f"'{t}'" for t in types)
            fail(~fits, F.concat(shown, F.lit(f" is not of type {wanted}")))
        if "enum" in schema:
            allowed = [_literal(_loose_json(x)) for x in schema["enum"]]
            fail(~shown.isin(allowed), F.concat(shown, F.lit(f" is not one of {_literal(schema['enum'])}")))
        if "const" in schema:
            fail(shown != _literal(_loose_json(schema["const"])), f"{_literal(schema['const'])} was expected")
        self._scalars(v, schema, kind, shown, fail)
        self._containers(v, schema, kind, path, seen, found, fail)
        self._combinations(v, schema, path, seen, shown, found, fail)
        return F.coalesce(*found) if found else none

    @staticmethod
    def at(path: Column, message: Column) -> Column:
        return F.when(path == "", message).otherwise(F.concat(F.ltrim(path, F.lit(".")), F.lit(": "), message))

    def _scalars(self, v, schema, kind, shown, fail):
        number = F.try_variant_get(v, "$", "double")
        string = F.try_variant_get(v, "$", "string")
        is_number, is_string = kind == "number", kind == "string"
        if "pattern" in schema:
            fail(is_string & ~string.rlike(schema["pattern"]), F.concat(shown, F.lit(f" does not match '{schema['pattern']}'")))
        if "minLength" in schema:
            fail(is_string & (F.length(string) < schema["minLength"]), F.concat(shown, F.lit(" is too short")))
        if "maxLength" in schema:
            fail(is_string & (F.length(string) > schema["maxLength"]), F.concat(shown, F.lit(" is too long")))
        bounds = {
            "minimum": (lambda b: number < b, "is less than the minimum of"),
            "maximum": (lambda b: number > b, "is greater than the maximum of"),
            "exclusiveMinimum": (lambda b: number <= b, "is less than or equal to the minimum of"),
            "exclusiveMaximum": (lambda b: number >= b, "is greater than or equal to the maximum of"),
        }
        for name, (breaks, words) in bounds.items():
            if name in schema:
                fail(is_number & breaks(F.lit(schema[name])), F.concat(shown, F.lit(f" {words} {schema[name]}")))

    def _containers(self, v, schema, kind, path, seen, found, fail):
        is_object, is_array = kind == "object", kind == "array"
        for name in schema.get("required", []):
            fail(is_object & _member(v, name).isNull(), f"'{name}' is a required property")
        properties = schema.get("properties", {})
        for name, sub in properties.items():
            member = _member(v, name)
            inner = self.error(member, sub, F.concat(path, F.lit(f".{name}")), seen)
            found.append(F.when(is_object & member.isNotNull(), inner))
        extra = schema.get("additionalProperties", True)
        if extra is not True:
            members = F.when(is_object, v.try_cast("map<string,variant>"))
            others = F.map_filter(members, lambda k, _: ~k.isin(list(properties)))
            if extra is False:
                names = F.array_sort(F.map_keys(others))
                fail(
                    F.size(names) > 0,
                    F.concat(F.lit("Additional properties are not allowed ('"), F.array_join(names, "', '"), F.lit("' unexpected)")),
                )
            else:
                errors = F.transform(
                    F.map_entries(others),
                    lambda e: self.error(e["value"], extra, F.concat(path, F.lit("."), e["key"]), seen),
                )
                found.append(F.get(F.array_compact(errors), F.lit(0)))
        items = F.when(is_array, v.try_cast("array<variant>"))
        if "minItems" in schema:
            fail(is_array & (F.size(items) < schema["minItems"]), F.concat(F.to_json(v), F.lit(" is too short")))
        if "maxItems" in schema:
            fail(is_array & (F.size(items) > schema["maxItems"]), F.concat(F.to_json(v), F.lit(" is too long")))
        if "items" in schema:
            errors = F.transform(
                items,
                lambda x, i: self.error(
                    x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen
                ),
            )
            found.append(F.get(F.array_compact(errors), F.lit(0)))

    def _combinations(self, v, schema, path, seen, shown, found, fail):
        for sub in schema.get("allOf", []):
            found.append(self.error(v, sub, path, seen))
        matches = lambda key: [
            self.error(v, sub, path, seen).isNull().cast("int") for sub in schema[key]
        ]
        if "anyOf" in schema:
            fail(sum(matches("anyOf")) == 0, F.concat(shown, F.lit(" is not valid under any of the given schemas")))
        if "oneOf" in schema:
            hits = sum(matches("oneOf"))
            fail(hits == 0, F.concat(shown, F.lit(" is not valid under any of the given schemas")))
            fail(hits > 1, F.concat(shown, F.lit(" is valid under more than one of the given schemas")))
        if "not" in schema:
            fail(
                self.error(v, schema["not"], path, seen).isNull(),
                F.concat(shown, F.lit(f" should not be valid under {_literal(schema['not'])}")),
            )


def schema_error(t: Column, json_schema: str) -> Column:
    """The first violation of ``json_schema`` by JSON text ``t``, or NULL."""
    schema = json.loads(json_schema) if isinstance(json_schema, str) else json_schema
    return _Compiler(schema).error(F.try_parse_json(t), schema, F.lit(""))


def check_schema(json_schema: str) -> None:
    """Refuse a schema that the compiler cannot enforce in full."""
    schema_error(F.lit("null"), json_schema)
