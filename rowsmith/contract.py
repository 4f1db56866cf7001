"""The typed column contract of a dataset.

A contract is small driver-side metadata (one entry per column). Operators
compile it into column expressions; row data never passes through it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

# The eight column types.
TYPES = ("text", "long_text", "select", "multi_select", "number", "boolean", "json", "date")
TEXT_TYPES = ("text", "long_text")
OPTION_TYPES = ("select", "multi_select")

COLUMNS_SCHEMA = (
    "dataset string, key string, label string, type string, options array<string>, "
    "required boolean, ord int, archived boolean, json_schema string, is_key boolean, options_table boolean"
)


@dataclass(frozen=True)
class Field:
    """One column of a contract."""

    key: str
    type: str = "text"
    label: str | None = None
    options: tuple[str, ...] | None = None
    required: bool = False
    ord: int = 0
    archived: bool = False
    json_schema: str | None = None
    is_key: bool = False
    options_table: bool = False  # the options are rows of a table, not listed here

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown column type {self.type!r}")


@dataclass(frozen=True)
class Contract:
    """An ordered list of fields. Archived fields stay but are never checked."""

    fields: tuple[Field, ...]

    @classmethod
    def of(cls, *fields: Field) -> Contract:
        return cls(tuple(replace(f, ord=i) for i, f in enumerate(fields)))

    @classmethod
    def from_columns(cls, columns: DataFrame, dataset: str) -> Contract:
        """The contract of one dataset, read from a columns table."""
        rows = columns.filter(columns.dataset == dataset).collect()  # one dataset's columns
        return cls(
            tuple(
                Field(
                    key=r.key,
                    type=r.type,
                    label=r.label,
                    options=None if r.options is None else tuple(r.options),
                    required=r.required,
                    ord=r.ord,
                    archived=r.archived,
                    json_schema=r.json_schema,
                    is_key=r.is_key,
                    options_table="options_table" in columns.columns and bool(r.options_table),
                )
                for r in sorted(rows, key=lambda r: (r.ord, r.key))
            )
        )

    def to_columns(self, spark: SparkSession, dataset: str) -> DataFrame:
        return spark.createDataFrame(
            [
                (dataset, f.key, f.label, f.type, None if f.options is None else list(f.options),
                 f.required, f.ord, f.archived, f.json_schema, f.is_key, f.options_table)
                for f in self.fields
            ],
            COLUMNS_SCHEMA,
        )

    @property
    def active(self) -> tuple[Field, ...]:
        return tuple(sorted((f for f in self.fields if not f.archived), key=lambda f: (f.ord, f.key)))

    @property
    def active_keys(self) -> list[str]:
        return [f.key for f in self.active]

    @property
    def key_field(self) -> Field | None:
        return next((f for f in self.active if f.is_key), None)

    @property
    def json_keys(self) -> frozenset[str]:
        """Keys whose object values stay whole when a record is flattened."""
        return frozenset(f.key for f in self.fields if f.type == "json")

    def field(self, key: str) -> Field:
        return next(f for f in self.fields if f.key == key)

    def snapshot_json(self) -> str:
        """The contract as stored beside a version."""
        return json.dumps(
            {
                "columns": [
                    {
                        "key": f.key,
                        "label": f.label,
                        "type": f.type,
                        "options": None if f.options is None else list(f.options),
                        "required": f.required,
                        "order": f.ord,
                        "archived": f.archived,
                        "json_schema": None if f.json_schema is None else json.loads(f.json_schema),
                        "is_key": f.is_key,
                    }
                    | ({"options_table": True} if f.options_table else {})
                    for f in self.active
                ]
            },
            ensure_ascii=False,
        )
