"""Searches and point queries take their whole tables."""

import numpy as np
from pyspark.sql import functions as F

import waypath.registry_scans  # noqa: F401  (adds its queries)
from waypath.plans.fixtures import table
from waypath.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_searches_take_every_fiftieth_id(spark):
    m = table(spark, SF, "fx_map").select("point_id", "x", "y", "z").collect()
    ids, xyz = np.array([r.point_id for r in m]), np.array([r[1:] for r in m])
    near, within = set(), set()
    for i in ids[ids % 50 == 0]:
        d2 = ((xyz - xyz[ids == i][0]) ** 2).sum(axis=1)
        within |= {(i, j) for j in ids[d2 <= 1.5 * 1.5]}
        near |= {(i, ids[j], k + 1) for k, j in enumerate(np.lexsort((ids, xyz[:, 0], d2))[:5])}
    assert {r[:2] for r in QUERIES["radius_join_map"](spark, SF).select("query_id", "point_id").collect()} == within
    assert {r[:3] for r in QUERIES["knn_join_map"](spark, SF).select("query_id", "point_id", "rank").collect()} == near


def test_point_queries_take_every_row(spark):
    p = table(spark, SF, "fx_points")
    assert QUERIES["so3_log_of_exp_all"](spark, SF).count() == p.count()
    got = QUERIES["inflate_cells_all"](spark, SF).where("cost = 1").count()
    assert got == p.select("scan_id", F.floor(F.col("x") / 0.5), F.floor(F.col("y") / 0.5)).distinct().count()
