"""Exact k-means with adaptive bounds, against plain k-means in integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from confluo.llm import drake


def plain(vectors, k, rounds, scale=64, dimensions=4):
    """[(vec_id, cluster, distance)], centroids: every distance computed, in Python integers."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in vectors if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(c) for _, c in first]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                mine = [x for (_, x), (_, n) in zip(kept, near) if n == j]
                if mine:
                    centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, near)], centroids


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, i) for i, v in vectors], "vec_id long, embedding array<float>, cluster long")


@pytest.mark.parametrize("grid", [True, False])
def test_equals_plain_k_means(shipped, grid):
    rng = random.Random(5)
    draw = (lambda: rng.choice([0.0, 0.25, 0.5, -0.25])) if grid else (lambda: rng.gauss(0, 1))  # a grid has many ties
    vectors = [(i, [float(np.float32(draw())) for _ in range(4)]) for i in range(400)]
    got = drake.clusters(frame(shipped, vectors), dimensions=4, k=9, rounds=3, near=2).collect()
    want, centroids = plain(vectors, 9, 3)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    per = {}
    for _, n, d in want:
        per[n] = per.get(n, 0) + d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (per[r.cluster], sum(per.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_bounds_certify_most_vectors_of_separate_groups(shipped):
    rng = random.Random(6)
    vectors = [(i, [float(np.float32(20 * (i % 5 == a) + rng.gauss(0, 0.1))) for a in range(5)]) for i in range(1000)]
    state, _ = drake.clustered(frame(shipped, vectors), dimensions=5, k=12, rounds=3, near=3)
    went = [r.went for r in state.select("went").collect()]
    assert sum(w == 3 for w in went) < 100
    assert {0, 1, 2} & set(went)


def test_odd_vectors_are_left_out(shipped):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, 0.5]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 0.0]), (9, [-0.01, 0.0]), (10, [3e38, 0.0])]
    got = drake.clusters(shipped.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, x string"), dimensions=2, k=16).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (1, 0), (1, 0), (9, 0)]
    # floor, also below zero
    names = {r.vec_id: r.centroid_sha256 for r in got}
    assert names[9] == hashlib.sha256(b"-1,0").hexdigest()


def test_empty_table(shipped):
    assert drake.clusters(frame(shipped, [])).collect() == []


def test_repeated_assignment_never_differs_from_a_scan():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (3000, 6))
    centroids = rng.integers(-40, 40, (10, 6))
    state = {k: v for k, v in drake.scanned(x, centroids, 3).items() if k != "distance"}
    for _ in range(6):
        now = centroids + rng.integers(-4, 5, centroids.shape)
        steps = np.sqrt(((now - centroids) ** 2).sum(axis=1)) * (1 + drake.MARGIN)
        state, went = drake.assigned(x, drake.moved(state, steps), now)
        assert (state["cluster"] == drake.exact(x, now).argmin(axis=1)).all()
        assert len(set(went.tolist())) > 1
        centroids = now
