import hashlib
import random

import numpy as np
import pytest

from rowsmith.llm import centroids


def brute(rows, k=16, rounds=3, dim=64):
    """Every vector against every centroid, in Python integers."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(e is not None and np.isfinite(e) for e in x):
            kept.append((vec_id, [int(np.floor(64 * float(e))) for e in x]))
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    total = sum(d for d, _ in at)
    out = []
    for (vec_id, _), (d, c) in zip(kept, at, strict=True):
        sha = hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()
        out.append((vec_id, c, d, sum(e for e, o in at if o == c), total, sha))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(seed, n, spread):
    rng = random.Random(seed)
    heart = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(heart)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(40)]  # one vector often
    rows += [(n + 50 + i, [float(rng.randint(0, 1)) / 64 for _ in range(64)]) for i in range(60)]  # ties
    return rows


ODD = [(None, [0.5] * 64), (None, [0.25] * 64), (1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [1.0] * 63),
       (6, [float("nan")] + [1.0] * 63), (7, [float("inf")] + [0.0] * 63), (8, [-0.001] * 64), (8, [-0.001] * 64)]


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 300, 0.3), (2, 120, 0.01)])
def test_against_all_distances(spark, seed, n, spread):
    rows = vectors(seed, n, spread) + ODD
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int")
    rows = [(i, v and [e if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    assert got(centroids.clusters(df.repartition(3))) == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(i, v) for i, v in ODD], "vec_id long, embedding array<double>")
    assert got(centroids.clusters(df)) == brute(ODD)
    assert centroids.clusters(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="no exact distance"):
        centroids.clusters(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_pivots_save_distances():
    rng = np.random.default_rng(3)
    heart = rng.integers(-60, 60, (16, 64))
    v = np.repeat(heart, 50, axis=0) + rng.integers(-3, 4, (800, 64))
    pivots = centroids.far_apart(heart, 8)
    cluster, distance, done = centroids.nearest(v, centroids._squared(v, pivots), heart, pivots)
    full = centroids._squared(v, heart)
    assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert done < 0.2 * full.size
