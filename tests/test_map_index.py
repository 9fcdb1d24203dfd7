"""A map written once by cell: the same neighbours, no exchange of the map, and registration against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import waypath.registry_more  # noqa: F401  (adds its queries)
from waypath.operators import spatial
from waypath.operators.motion import rotation_of
from waypath.registry import QUERIES, map_points, points

SF = "/root/testdata/sf0.001"


def exchanged(plan, what):
    """Whether a scan of `what` lies below an exchange in the plan's text, without a join between."""
    lines = [(len(x) - len(x.lstrip(" :+-")), x) for x in plan.splitlines()]
    for i, (depth, text) in enumerate(lines):
        if "Exchange" in text:
            for d, t in lines[i + 1 :]:
                if d <= depth or "Join" in t:
                    break
                if what in t:
                    return True
    return False


def test_index_gives_the_same_without_an_exchange(spark):
    m = map_points(spark, SF).drop("label")
    asked = points(spark, SF).where("scan_id < 20").select(F.struct("scan_id", "seq").alias("query_id"), *((F.col(c) / 5).alias(c) for c in "xyz"))
    index = spatial.write_index(m, 2.0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a map that is no small table
    try:
        got, want = spatial.knn_join(asked, index, 5), spatial.knn_join(asked, m, 5, 2.0)
        key = ("query_id", "rank", "point_id")
        assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
        with_plan = got._jdf.queryExecution().sparkPlan().toString(), got._jdf.queryExecution().executedPlan().toString()
        name = index.tables[0]
        assert name in with_plan[0] and not exchanged(with_plan[1], name)
        loose = want._jdf.queryExecution().executedPlan().toString()
        assert exchanged(loose, "embeddings.parquet")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        index.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in index.tables]


def plain_poses(scan_points, m, rounds=3, k=5, most=0.5, limit=1e-3, singular=1e-6):
    ids, xyz = m
    poses = {}
    for scan, body in scan_points.items():
        p, q, done = np.zeros(3), np.array([0.0, 0, 0, 1]), False
        for _ in range(rounds):
            if done:
                break
            x, y, z, w = q
            rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
            h, g, used = np.zeros((6, 6)), np.zeros(6), 0
            for b in body:
                at = rot @ b + p
                d2 = ((xyz - at) ** 2).sum(axis=1)
                a = xyz[np.lexsort((ids, xyz[:, 0], d2))[:k]]
                mm = a.T @ a
                if len(a) < k or abs(np.linalg.det(mm)) <= singular * (np.trace(mm) / 3) ** 3:
                    continue
                u = np.linalg.solve(mm, -a.sum(axis=0))
                n, d = u / np.linalg.norm(u), 1 / np.linalg.norm(u)
                if (np.abs(a @ n + d) > most).any():
                    continue
                j = np.concatenate([n, np.cross(b, rot.T @ n)])
                h, g, used = h + np.outer(j, j), g + j * (n @ at + d), used + 1
            if not used:
                continue
            dx = -np.linalg.lstsq(h, g, rcond=1e-10)[0]
            p, done = p + dx[:3], bool((np.abs(dx) <= limit).all())
            turned = rot @ rotation_of(dx[3:])
            w = np.sqrt(max(0, 1 + np.trace(turned))) / 2
            q = np.array([turned[2, 1] - turned[1, 2], turned[0, 2] - turned[2, 0], turned[1, 0] - turned[0, 1], 4 * w * w]) / (4 * w)
        poses[scan] = (*p, *q)
    return poses


def test_registration_against_numpy(spark):
    p, m = points(spark, SF).orderBy("scan_id", "seq").collect(), map_points(spark, SF).collect()
    scans = {}
    for r in p:
        scans.setdefault(r.scan_id, []).append(np.array([r.x, r.y, r.z]) / 5)
    want = plain_poses(scans, (np.array([r.point_id for r in m]), np.array([[r.x, r.y, r.z] for r in m])))
    got = {r.scan_id: r for r in QUERIES["scan_to_map_register"](spark, SF).collect()}
    assert set(got) == set(want)
    close = 0
    for scan, w in want.items():
        r = got[scan]
        mine, w = np.array([r.px, r.py, r.pz, r.qx, r.qy, r.qz, r.qw]), np.array(w)
        w[3:] *= np.sign(w[3:] @ mine[3:]) or 1
        close += np.allclose(mine, w, atol=1e-4)
    assert close == len(want), close / len(want)
    assert sum(np.abs(np.array(w[:3])).max() > 1e-3 for w in want.values()) > len(want) / 2


@pytest.mark.parametrize("n", [0, 3])
def test_small_maps(spark, n):
    m = map_points(spark, SF).drop("label").limit(n)
    index = spatial.write_index(m)
    q = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "query_id long, x double, y double, z double")
    assert spatial.knn_join(q, index, 5).count() == n
    index.drop()
