"""Joins over the catalog of datasets, versions, users and child tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.operators.versions import latest_versions
from rowsmith.plans import durable, skew


def datasets_by(datasets: DataFrame, feature: str | None = None, name: str | None = None) -> DataFrame:
    found = datasets
    if feature is not None:
        found = found.filter(F.col("feature_id") == feature)
    if name is not None:
        found = found.filter(F.col("name") == name)
    return found.orderBy("name")


def versions_with_creator(versions: DataFrame, users: DataFrame) -> DataFrame:
    """Versions newest first, with the creator's e-mail when the user is known."""
    emails = users.select(F.col("id").alias("created_by"), F.col("email").alias("creator_email"))
    return versions.join(emails, "created_by", "left").orderBy("dataset", F.desc("version"))


def with_latest_version(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Every dataset with its newest version number, if it has one."""
    newest = latest_versions(versions).select("dataset", F.col("version").alias("latest_version"))
    return datasets.join(newest, "dataset", "left")


def versions_per_dataset(versions: DataFrame) -> DataFrame:
    return versions.groupBy("dataset").agg(F.count("*").alias("n_versions"))


def deletable(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """Datasets without any version; the others are pinned for good."""
    return datasets.join(versions.select("dataset").distinct(), "dataset", "left_anti")


def cascade(children: DataFrame, removed: DataFrame, on: str) -> DataFrame:
    """A child table without the rows of removed parents."""
    return children.join(removed.select(on).distinct(), on, "left_anti")


@dataclass(frozen=True)
class Relation:
    """Rows of ``child`` belong to the row of ``parent`` that their column ``key`` names."""

    parent: str
    child: str
    key: str
    parent_key: str = "id"


def _levels(relations: list[Relation]) -> list[str]:
    """Tables with every parent before its children; a table may be its own child."""
    names = list(dict.fromkeys(n for r in relations for n in (r.parent, r.child)))
    order: list[str] = []
    while names:
        ready = [n for n in names if not any(r.child == n and r.parent in names and r.parent != n for r in relations)]
        if not ready:
            raise ValueError(f"relations run in a circle through {', '.join(names)}")
        order += ready
        names = [n for n in names if n not in ready]
    return order


def _marked(rows: DataFrame, parents: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` with ``_n`` set where ``key`` is in ``parents(key)``, however many share one parent."""
    keyed = rows.withColumn("_parent", F.col(key).cast("string"))
    owned = keyed.filter(F.col("_parent").isNotNull()).groupBy("_parent").agg(F.count("*").alias("_n"))
    gone = owned.join(parents.select(F.col("key").alias("_parent")), "_parent", "left_semi")
    return skew.attach_by_key(keyed, gone, "_parent", "_n", F.xxhash64(*rows.columns), how=how)


def cascade_all(tables: dict[str, DataFrame], relations: list[Relation], table: str, removed: DataFrame) -> dict[str, DataFrame]:
    """All tables without ``removed`` (a column ``id``) of ``table`` and everything below it.

    Levels are followed from the top: a table loses the rows that name a lost row of any of its
    parents, and a table that is its own child (replies to comments) is followed until a level
    adds nothing. What a parent lost is a written table of ids; rows with many siblings are salted.
    """
    keys = {r.parent: r.parent_key for r in relations}
    lost: dict[str, DataFrame] = {}
    for name in _levels(relations):
        if name not in keys:
            continue
        key = keys[name]
        own = [removed.select(F.col("id").cast("string").alias("key"))] if name == table else []
        above = [r for r in relations if r.child == name and r.parent in lost]
        own += [_marked(tables[name], lost[r.parent], r.key, "inner").select(F.col(key).cast("string").alias("key")) for r in above]
        if not own:
            continue
        newest = lost[name] = durable.written(reduce(DataFrame.unionByName, own).distinct(), "lost")
        inner = [r.key for r in relations if r.parent == r.child == name]
        while inner and not newest.isEmpty():
            below = [_marked(tables[name], newest, k, "inner").select(F.col(key).cast("string").alias("key")) for k in inner]
            below = reduce(DataFrame.unionByName, below).distinct()
            newest = durable.written(below.join(lost[name], "key", "left_anti"), "lost-below")
            lost[name] = durable.written(lost[name].unionByName(newest), "lost")
    out = dict(tables)
    for name in tables:
        parents = [(lost[r.parent], r.key) for r in relations if r.child == name and r.parent in lost]
        if name == table:
            parents.append((removed.select(F.col("id").cast("string").alias("key")).distinct(), keys.get(name, "id")))
        for gone, key in parents:
            left = _marked(out[name], gone, key, "left").filter(F.col("_n").isNull())
            out[name] = left.select(*[F.col(f"`{c}`") for c in tables[name].columns])
    return out


def unknown_assignees(patches: DataFrame, users: DataFrame) -> DataFrame:
    """Patches whose assignee is not a user."""
    wanted = patches.filter(F.col("assignee").isNotNull())
    return wanted.join(users.select(F.col("id").alias("assignee")).distinct(), "assignee", "left_anti")
