"""Inflation by tiles against all offsets, knots found by bisection, and the incremental map's versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypath.operators import scans, spatial
from waypath.streaming.operators import IncrementalMap


def plain(cells, size, radius, k):
    reach, out = int(radius / size + 1e-9), {}
    for m, x, y, c in cells:
        for dx in range(-reach, reach + 1):
            for dy in range(-reach, reach + 1):
                if size * math.sqrt(dx * dx + dy * dy) <= radius:
                    key = (m, x + dx, y + dy)
                    out[key] = max(out.get(key, -math.inf), c * math.exp(-k * size * math.sqrt(dx * dx + dy * dy)))
    return out


@pytest.mark.parametrize("costs", ["few", "many", "negative"])
def test_inflation(spark, costs, monkeypatch):
    monkeypatch.setattr(scans, "TILE", 16)
    rng = np.random.default_rng(len(costs))
    cells = []
    for i in range(300):
        c = {"few": float(rng.choice([100, 254])), "many": float(rng.random() * 254), "negative": float(rng.integers(-5, 5))}[costs]
        cells.append((f"m{i % 2}", int(rng.integers(-60, 60)), int(rng.integers(-60, 60)), c))
    cells += [("m0", 3, 3, 0.0), ("m0", 500, 500, 7.0), ("m0", 500, 500, 9.0)]
    df = spark.createDataFrame([*cells, ("m0", 1, 1, None)], "map_id string, ix int, iy int, cost double")
    for size, radius in ((0.5, 1.0), (0.1, 0.95), (1.0, 0.0)):
        got = {(r.map_id, r.ix, r.iy): r.cost for r in scans.inflate_cells(df, size, radius).collect()}
        want = plain(cells, size, radius, 2.0)
        assert set(got) == set(want) and all(abs(got[key] - want[key]) < 1e-9 for key in want)
    assert scans.inflate_cells(df, 0.5, 1.0).schema.simpleString() == df.schema.simpleString()


def test_distances_are_exact():
    rng = np.random.default_rng(3)
    mask = rng.random((40, 50)) < 0.02
    at, reach = np.argwhere(mask), 12
    want = ((np.indices(mask.shape).transpose(1, 2, 0)[:, :, None] - at[None, None]) ** 2).sum(axis=3).min(axis=2)
    got = scans.squared_distances(mask, reach)
    near = want <= reach * reach
    assert (got[near] == want[near]).all() and (got[~near] > reach * reach).all()


def test_bisection(spark):
    rng = np.random.default_rng(8)
    knots = [(s, i, float(t)) for s, n in ((1, 2), (2, 3), (3, 8), (4, 33), (5, 1)) for i, t in enumerate(np.sort(rng.integers(0, 20, n)))] + [(6, 0, None), (6, 1, 1.0)]
    pts = [(s, i, float(t)) for s in range(1, 8) for i, t in enumerate(np.arange(-1, 21.5, 0.5))] + [(3, 999, None)]
    got = scans.asof_bracket(spark.createDataFrame(pts, "scan_id long, seq long, t double"), spark.createDataFrame(knots, "scan_id long, seq long, t double").withColumn("v", F.col("seq") * 10))
    have = {(r.scan_id, r.seq): (r.head.v // 10, r.tail.v // 10) for r in got.collect()}
    want = {}
    for s, i, t in pts:
        own = sorted((kt, ks) for kn, ks, kt in knots if kn == s and kt is not None)
        n = sum(kt < t for kt, _ in own) if t is not None else 0
        if n and len(own) > 1:
            h = min(n, len(own) - 1) - 1
            want[s, i] = (own[h][1], own[h + 1][1])
    assert have == want and len(want) > 100


def test_no_row_holds_a_scan(spark):
    """A scan's knots may be many: they are passed in order of time, never gathered in an array that each point's row holds."""
    n = 20_000
    knots = spark.range(n).select(F.lit(1).cast("long").alias("scan_id"), F.col("id").alias("seq"), (F.col("id") * 2.0).alias("t"), F.col("id").alias("v"))
    pts = spark.range(2 * n).select(F.lit(1).cast("long").alias("scan_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("t"))
    got = scans.asof_bracket(pts, knots)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("head.v <> least(floor((t - 1) / 2), 19998) or tail.v <> head.v + 1").isEmpty() and got.count() == 2 * n - 1


def batch(spark, lo, n, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(lo + i, *map(float, rng.random(3) * 3 - 1.5)) for i in range(n)], "point_id long, x double, y double, z double")


def rows(df):
    return sorted(map(tuple, df.select("point_id", "x", "y", "z").collect()))


def test_map_versions(spark, tmp_path):
    first, second = batch(spark, 0, 200, 1), batch(spark, 1000, 150, 2)
    build = IncrementalMap(str(tmp_path / "m"), 0.3, region=1.0, name="a")
    assert build.side == 3 and build.read(spark).count() == 0
    build(first, 0)
    none = spark.createDataFrame([], first.schema)
    one = spatial.voxel_keep_center(none, first, 0.3)
    assert rows(build.read(spark)) == rows(one)
    build(second, 1)
    both = spatial.voxel_keep_center(one.drop("is_new"), second, 0.3)
    assert rows(build.read(spark)) == rows(both) and both.count() < one.count() + second.count()
    assert both.groupBy(*(F.floor(F.col(c) / 0.3) for c in "xyz")).count().where("count > 1").isEmpty()
    build(second, 1)  # a batch that runs again
    assert [n for n, _ in build.versions(spark)] == [0, 1] and rows(build.read(spark)) == rows(both)
    build.clean(spark)
    assert [n for n, _ in build.versions(spark)] == [1] and rows(build.read(spark)) == rows(both)


def test_a_batch_that_is_cut_short(spark, tmp_path, monkeypatch):
    build = IncrementalMap(str(tmp_path / "m"), 0.3, region=1.0)
    build(batch(spark, 0, 100, 1), 0)
    before = rows(build.read(spark))
    with monkeypatch.context() as m:
        m.setattr(IncrementalMap, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            build(batch(spark, 500, 100, 2), 1)
    assert rows(build.read(spark)) == before  # its points are written, and not part of the map
    build(batch(spark, 500, 100, 2), 1)
    after = rows(build.read(spark))
    assert after != before and len([p for p in (tmp_path / "m/data").iterdir() if p.name.startswith("batch=")]) == 3
    build.clean(spark)
    assert rows(build.read(spark)) == after
