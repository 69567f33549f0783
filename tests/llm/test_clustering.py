"""Heap-ordered bounds against plain Lloyd rounds, pruning, and edge rows."""

import hashlib
import math

import numpy as np
import pytest

from decklens.llm import clustering as C

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance double"


def plain(rows, clusters, rounds, dimensions, seed=C.SEED):
    """Every vector against every centroid in Python integers: (vec_id, cluster, distance), sorted, and the centroids."""
    def fits(e):
        return e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)

    kept = [(i, [math.floor(x * C.SCALE) for x in e]) for i, e in rows if fits(e)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [p for _, p in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    for turn in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centroids)) for _, p in kept]
        if turn == rounds:
            break
        for n in range(len(centroids)):
            own = [p for (_, p), (_, c) in zip(kept, found) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, found)), key=repr), centroids


def result(spark, rows, **how):
    df = spark.createDataFrame([(i, e, "x", 0.5) for i, e in rows], SCHEMA)
    return C.cluster(df, **how).collect()


@pytest.mark.parametrize("kind", ["blobs", "grid", "few"])
def test_equals_plain_rounds(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "blobs":
        x = rng.normal(size=(6, 5))[rng.integers(0, 6, 300)] + rng.normal(scale=0.05, size=(300, 5))
    elif kind == "grid":  # many ties
        x = rng.integers(-2, 3, (200, 5)) / 4
    else:
        x = rng.random((3, 5))
    rows = [(i % 190, r.tolist()) for i, r in enumerate(x)]  # repeated ids
    got = result(spark, rows, clusters=6, rounds=5, dimensions=5)
    want, centroids = plain(rows, 6, 5, 5)
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=repr) == want
    for r in got:
        assert r.centroid == centroids[r.cluster]
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)


def test_only_expired_gaps_are_scanned(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    x = centres[rng.integers(0, 8, 2000)] + rng.normal(scale=0.02, size=(2000, 16))
    kept = C.points(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), 16)
    _, assigned, scanned = C.fit(kept)
    assert assigned.count() == 2000 and scanned[0] == 2000
    assert sum(scanned[5:]) < 2000, scanned


def test_edge_rows(spark):
    good = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (None, [1.0, 1.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0])]
    bad = [(4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [1.0, float("nan")]), (9, [float("inf"), 0.0]), (None, None), (10, [1e300, 0.0])]
    got = result(spark, good + bad, clusters=2, rounds=3, dimensions=2)
    want, _ = plain(good, 2, 3, 2)
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=repr) == want
    for rows in ([], bad):
        assert result(spark, rows, clusters=2, dimensions=2) == []
    alike = result(spark, [(i, [1.0, 1.0]) for i in range(9)], clusters=3, dimensions=2)
    assert {(r.cluster, r.distance, r.inertia) for r in alike} == {(0, 0, 0)} and len(alike) == 9
    one = result(spark, good, clusters=1, rounds=2, dimensions=2)
    assert len(one) == 5 and {r.cluster for r in one} == {0}
