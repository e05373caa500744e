import hashlib
import math
import random

import numpy as np
import pytest

from corpuscle.llm import kd_clusters
from corpuscle.llm.kd_clusters import Block, cluster_vectors

SCHEMA = "vec_id long, embedding array<double>, cluster int, label string"


def _plain(rows, width, k, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    cents = [list(f[2]) for f in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            cents[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    of = {n: sum(d for _, m, d in found if m == n) for n in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, n, d, of[n], sum(of.values()), sha[n]) for i, n, d in found), key=str)


def _got(spark, rows, width, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in cluster_vectors(df, width=width, **kw).collect()), key=str)


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.05), (3, 40.0)])
def test_equals_brute_force(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(kd_clusters, "LEAF", 4)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(4)] for _ in range(6)]
    rows = [(k, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for k in range(400)]
    rows += rows[:50] + [(999, rows[0][1])] * 60  # copies and ties
    rows += [(1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0, None, 1.0, 1.0]), (1004, [math.nan] * 4), (1005, [math.inf] * 4), (None, [0.5] * 4)]
    assert _got(spark, rows, 4, k=16, rounds=3, scale=64) == _plain(rows, 4, 16, 3, 64)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.5, 0.0])]
    assert _got(spark, rows, 2, k=16, rounds=2, scale=3) == _plain(rows, 2, 16, 2, 3)
    assert _got(spark, [(1, None), (2, [1.0])], 2) == []
    assert _got(spark, [(5, [0.25, 0.5])], 2, k=1, rounds=0, scale=64) == _plain([(5, [0.25, 0.5])], 2, 1, 0, 64)


def test_large_components(spark):
    rows = [(k, [k * 1e5, -k * 1e4]) for k in range(9)]
    assert _got(spark, rows, 2, k=3, rounds=2, scale=64) == _plain(rows, 2, 3, 2, 64)
    with pytest.raises(Exception, match="after scaling"):
        _got(spark, [(1, [1e300, 0.0])], 2)


def test_whole_nodes_are_assigned():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.integers(-5, 5, (500, 3)), rng.integers(95, 105, (500, 3))]).astype(np.int64)
    order, packed = Block.pack(points)
    block, cents = Block(*packed, 3), np.array([[0, 0, 0], [100, 100, 100], [50, 50, 50]])
    counts, sums = block.totals(cents)
    assert counts.tolist() == [500, 500, 0] and sums[:2].tolist() == [points[:500].sum(axis=0).tolist(), points[500:].sum(axis=0).tolist()]
    looked = []
    block._leaf = lambda *a: looked.append(a)
    block.totals(cents)
    assert not looked  # boxes alone decide
