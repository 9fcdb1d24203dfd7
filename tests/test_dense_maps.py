"""Neighbours in dense maps and of repeated, far and missing places, against all distances."""

import numpy as np
from pyspark.sql import functions as F

from waypath.operators import spatial


def tables(spark, n=3000):
    rng = np.random.default_rng(5)
    m = rng.normal(0, 1, (n, 3))
    m[: n // 10] = m[0]  # copies
    q = np.concatenate([np.repeat(rng.normal(0, 1, (20, 3)), 10, axis=0), rng.normal(0, 1, (50, 3)) + 12, m[:5], [[0.0, 0.0, 0.0], [-0.0, 0.0, -0.0]]])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)], "point_id long, x double, y double, z double")
    asked = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)] + [(-1, None, 0.0, 0.0)], "query_id long, x double, y double, z double")
    return points, asked, m, q, ((q[:, None] - m[None]) ** 2).sum(axis=2)


def test_nearest_in_a_dense_map(spark):
    points, asked, m, q, d2 = tables(spark)
    index = spatial.map_index(points)
    assert index.size < 0.5  # cells of 2 m would hold most of the map
    got = {(r.query_id, r["rank"]): r.point_id for r in spatial.knn_join(asked, points, 4).collect()}
    assert got == {(i, j + 1): int(p) for i in range(len(q)) for j, p in enumerate(sorted(range(len(m)), key=lambda p: (d2[i, p], m[p, 0], p))[:4])}


def test_equal_places_are_looked_up_once(spark):
    points, asked, m, q, d2 = tables(spark)
    got = {r.query_id: (r.n, r.ids, round(r.d2, 6)) for r in spatial.radius_counts(asked, points, 0.7).collect()}
    near = d2 <= 0.7 * 0.7
    assert got == {i: (int(w.sum()), int(np.flatnonzero(w).sum()), round(float(d2[i][w].sum()), 6)) for i, w in enumerate(near) if w.any()}


def test_copies_do_not_halve_cells_for_ever(spark):
    same = spark.range(100).select(F.col("id").alias("point_id"), *(F.lit(1.0).alias(c) for c in "xyz"))
    assert spatial.map_index(same).size > 1e-3
    assert spatial.map_index(same.limit(0)).n == 0
