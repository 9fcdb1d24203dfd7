"""Nearest points where the map's cells are dealt in parts and places in blocks, and planes of whole groups only."""

import numpy as np
from pyspark.sql import functions as F

from waypath.operators import scans, spatial


def test_parts_and_blocks_against_all_distances(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PART_ROWS", 20)
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(0, 1, (400, 3)), np.zeros((30, 3))])
    q = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(0, 1, (60, 3)) + 30, np.zeros((1, 3))])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)], "point_id long, x double, y double, z double")
    asked = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)], "query_id long, x double, y double, z double")
    d2 = ((q[:, None] - m[None]) ** 2).sum(axis=2)
    want = {(i, j + 1): int(p) for i in range(len(q)) for j, p in enumerate(sorted(range(len(m)), key=lambda p: (d2[i, p], m[p, 0], p))[:5])}
    found = spatial.knn_join(asked, points, 5)
    assert {(r.query_id, r["rank"]): r.point_id for r in found.collect()} == want
    # Neighbours leave the tasks as the k nearest of a part: no window ranks all pairs of a cell.
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_groups_too_small_have_no_plane(spark):
    rows = [(1, 1.0, 0.0, 0.0), (1, 1.0, 1.0, 0.0), (1, 1.0, 0.0, 1.0), (2, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (2, 1.0, 0.0, 1.0), (2, 1.0, 1.0, 1.0)]
    near = spark.createDataFrame(rows, "query_id long, x double, y double, z double")
    assert [r.query_id for r in scans.plane_fit(near, least=4).collect()] == [2]
    assert scans.plane_fit(near).count() == 2 and scans.plane_fit(near).where(F.abs("nx") < 0.99).count() == 0
