"""Keys that change hands within a batch, against a loop over the patches."""

import random

import pytest

from rowsmith.operators import handover, patches
from rowsmith.plans.components import components
from tests.test_changes import CONTRACT, PATCH, patch, table


def by_loop(items, batch):
    """Outcomes one patch at a time."""
    rev = {i: r for i, _, _, r, gone in items if not gone}
    key = {i: d["id"].strip('"') for i, d, _, _, gone in items if not gone}
    owner = {k: i for i, k in key.items()}
    out = {}
    for id_, seq, expected, data, *_ in sorted(batch, key=lambda p: p[1]):
        want = data["id"].strip('"') if data and "id" in data else None
        if id_ not in rev:
            out[seq] = "not_found"
        elif expected is None:
            out[seq] = "rev_required"
        elif expected != rev[id_]:
            out[seq] = "conflict"
        elif want == "":
            out[seq] = "invalid"
        elif want is not None and owner.get(want, id_) != id_:
            out[seq] = "key_taken"
        else:
            out[seq] = "accepted"
            rev[id_] += 1
            if want is not None and want != key[id_]:
                owner.pop(key[id_])
                key[id_], owner[want] = want, id_
    return out


def rows_of(n, gone=()):
    return [(f"r{i}", {"id": f'"k{i}"', "q": '"x"'}, "draft", 1, i in gone) for i in range(n)]


def outcomes(spark, items, batch):
    judged = patches.judge_patches(table(spark, items), spark.createDataFrame(batch, PATCH), CONTRACT)
    return {r.seq: r.outcome for r in judged.select("seq", "outcome").collect()}


@pytest.mark.parametrize(("seed", "together"), [(1, 100_000), (2, 0), (3, 0)])
def test_against_a_loop(spark, monkeypatch, seed, together):
    monkeypatch.setattr(handover, "TOGETHER", together)
    rng = random.Random(seed)
    items, batch, rev = rows_of(60, gone=(5, 9)), [], {}
    for seq in range(300):
        i = rng.randrange(64)
        i = i if rng.random() < 0.7 else rng.randrange(6)
        area = i // 10 * 10  # keys are shared within tens, some with all
        key = rng.choice([f"k{area + rng.randrange(10)}", f"n{area}", f"n{rng.randrange(9)}", "hot"])
        data = {"id": f'"{key}"'} if rng.random() < 0.7 else {"q": '"y"'}
        if rng.random() < 0.05:
            data = {"id": '""'}
        expected = rev.get(i, 1) if rng.random() < 0.9 else rng.choice([7, None])
        batch.append(patch(f"r{i}", seq, expected, data))
        if seq % 20 == 0:
            rev = {}
            for s, o in by_loop(items, batch).items():
                if o == "accepted":
                    j = int(batch[s][0][1:])
                    rev[j] = rev.get(j, 1) + 1
        elif rng.random() < 0.5:
            rev[i] = rev.get(i, 1) + 1
    want = by_loop(items, batch)
    assert len(set(want.values())) == 6
    assert outcomes(spark, items, batch) == want


@pytest.mark.parametrize("together", [100_000, 0])
def test_a_long_chain_of_handovers(spark, monkeypatch, together):
    """Row i asks for the key that row i + 1 gives up just before; the first one is refused or not."""
    monkeypatch.setattr(handover, "TOGETHER", together)
    n = 10_000 if together else 1_000
    for first in ("free", "k0"):
        items = rows_of(n)
        batch = [patch(f"r{n - 1}", 0, 1, {"id": f'"{first}"'})]
        batch += [patch(f"r{i}", n - 1 - i, 1, {"id": f'"k{i + 1}"'}) for i in range(n - 2, -1, -1)]
        want = by_loop(items, batch)
        assert set(want.values()) == ({"accepted"} if first == "free" else {"key_taken"})
        assert outcomes(spark, items, batch) == want


def test_a_key_that_a_third_of_all_ask_for(spark):
    rng = random.Random(8)
    items = rows_of(1_500)
    batch = []
    for seq in range(1_400):
        i = seq + 50
        key = "hot" if seq % 3 == 0 else rng.choice([f"k{rng.randrange(50)}", f"n{seq}"])
        batch.append(patch(f"r{i}", seq * 2, 1 if rng.random() < 0.5 else 9, {"id": f'"{key}"'}))
    batch += [patch("r1", 301, 1, {"id": '"hot"'}), patch("r1", 999, 2, {"id": '"k1"'}), patch("r7", 501, 1, {"id": '"left"'})]
    # Whoever got the key first gives it up in the middle.
    holder = next(b for b in sorted(batch, key=lambda b: b[1]) if by_loop(items, batch)[b[1]] == "accepted" and b[3]["id"] == '"hot"')
    batch.append(patch(holder[0], 1201, 2, {"id": '"away"'}))
    want = by_loop(items, batch)
    assert sum(1 for b in batch if b[3]["id"] == '"hot"' and want[b[1]] == "accepted") == 2
    assert outcomes(spark, items, batch) == want


def test_batches_without_contested_keys(spark):
    items = rows_of(20)
    batch = [patch(f"r{i}", i, 1, {"id": f'"k{i}"'} if i % 2 else {"q": '"z"'}) for i in range(20)]
    assert outcomes(spark, items, batch) == by_loop(items, batch)


def test_components(spark):
    rng = random.Random(3)
    edges = [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(700)]  # a long path
    edges += [("hub", f"h{i}") for i in range(300)] + [("x", "x"), ("a", "b"), ("b", "a"), ("b", "c")]
    edges += [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for x in parent if x != "x"}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u string, v string").repartition(4)).collect()}
    assert found == want


def test_claims_are_joined_off_the_driver(spark, monkeypatch):
    plans, written = {}, patches.durable.written

    def record(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(patches.durable, "written", record)
    assert outcomes(spark, rows_of(30), [patch(f"r{i}", i, 1, {"id": f'"k{i + 1}"'}) for i in range(29)])
    for name in ("patches", "contested", "concerned", "simple-claims", "chains"):
        assert "Join" in plans[name] and "BroadcastHashJoin" not in plans[name]
