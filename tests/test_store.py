"""Deletion of points, one a request, against a loop over the requests."""

import numpy as np

from waypath.operators import store

POINT, REQUEST = "point_id long, x double, y double, z double, deleted boolean", "request_id long, x double, y double, z double"


def loop(points, requests, eps):
    live = {p[0]: p[1:4] for p in points if not p[4]}
    for _, *q in sorted(requests):
        near = [(sum((a - b) ** 2 for a, b in zip(v, q)), i) for i, v in live.items() if all(abs(a - b) <= eps for a, b in zip(v, q))]
        if near:
            del live[min(near)[1]]
    return set(live)


def left(spark, points, requests, eps):
    out = store.delete_points(spark.createDataFrame(points, POINT), spark.createDataFrame(requests, REQUEST), eps).collect()
    assert len(out) == len(points)
    return {r.point_id for r in out if not r.deleted}


def test_two_requests_by_two_points(spark):
    points = [(1, 0.0, 0.0, 0.0, False), (2, 9e-7, 0.0, 0.0, False), (3, 5.0, 0.0, 0.0, False), (4, 0.0, 0.0, 0.0, True)]
    assert left(spark, points, [(1, 1e-7, 0.0, 0.0), (2, 2e-7, 0.0, 0.0)], 1e-6) == {3}
    assert left(spark, points, [(1, 1e-7, 0.0, 0.0)] * 1, 1e-6) == {2, 3}
    assert left(spark, points, [], 1e-6) == {1, 2, 3}


def test_clusters(spark):
    rng = np.random.default_rng(2)
    points, requests = [], []
    for c in range(25):  # chains of places that compete, and equal points and requests
        at = rng.integers(0, 6, (rng.integers(1, 9), 3)) * 0.5 + c * 100
        ask = rng.integers(0, 6, (rng.integers(0, 9), 3)) * 0.5 + c * 100 + rng.choice([0, 0.1])
        points += [(len(points) + i, *map(float, v), bool(rng.random() < 0.1)) for i, v in enumerate(at)]
        requests += [tuple(map(float, v)) for v in ask]
    points += [(1000 + i, -7.0, 0.0, 0.0, False) for i in range(40)]
    requests += [(-7.0, 0.0, 0.0)] * 30 + [(-6.9, 0.0, 0.0)] * 15
    order = rng.permutation(len(requests))
    requests = [(int(order[i]), *r) for i, r in enumerate(requests)]
    assert left(spark, points, requests, 1.0) == loop(points, requests, 1.0)
