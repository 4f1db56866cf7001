"""Cascades through tables that own one another."""

import random

import pytest

from rowsmith.operators import catalog
from rowsmith.operators.catalog import Relation

RELATIONS = [
    Relation("datasets", "rows", "dataset"), Relation("datasets", "columns", "dataset"), Relation("rows", "edits", "row_id"),
    Relation("rows", "comments", "row_id"), Relation("comments", "comments", "reply_to"), Relation("users", "comments", "author"),
]


def by_hand(tables, relations, table, removed):
    gone = {(table, str(i)) for i in removed}
    while True:
        more = set()
        for r in relations:
            for row in tables[r.child]:
                if row.get(r.key) is not None and (r.parent, str(row[r.key])) in gone:
                    more.add((r.child, str(row["id"])))
        if more <= gone:
            return {t: sorted(str(r["id"]) for r in rows if (t, str(r["id"])) not in gone) for t, rows in tables.items()}
        gone |= more


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_over_levels(spark, seed):
    rng = random.Random(seed)
    some = lambda n, k: rng.choice([*range(n), None]) if rng.random() < k else None
    tables = {
        "datasets": [{"id": i} for i in range(6)],
        "users": [{"id": i} for i in range(4)],
        "rows": [{"id": i, "dataset": rng.choice([0, 0, 0, rng.randrange(6), None])} for i in range(60)],  # one holds a third
        "columns": [{"id": i, "dataset": rng.randrange(6)} for i in range(20)],
        "edits": [{"id": i, "row_id": rng.choice([7, rng.randrange(60)])} for i in range(90)],
        "comments": [{"id": i, "row_id": some(60, 0.5), "reply_to": some(max(i, 1), 0.7), "author": some(4, 0.9)} for i in range(80)],
    }
    schema = {"rows": "id int, dataset int", "columns": "id int, dataset int", "edits": "id int, row_id int", "comments": "id int, row_id int, reply_to int, author int"}
    frames = {t: spark.createDataFrame([tuple(r.values()) for r in rows], schema.get(t, "id int")) for t, rows in tables.items()}
    for table, removed in (("datasets", [0, 3]), ("comments", [1, 5]), ("datasets", [99])):
        left = catalog.cascade_all(frames, RELATIONS, table, spark.createDataFrame([(i,) for i in removed], "id int"))
        assert {t: sorted(str(r.id) for r in df.collect()) for t, df in left.items()} == by_hand(tables, RELATIONS, table, removed)
        assert all(left[t].columns == frames[t].columns for t in frames)


def test_circles_are_refused(spark):
    circle = [Relation("a", "b", "x"), Relation("b", "a", "y")]
    with pytest.raises(ValueError, match="circle"):
        catalog.cascade_all({}, circle, "a", spark.range(1))
