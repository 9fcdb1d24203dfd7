"""Jobs that SQL can't express, against plain Python or against what is known of made motions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypath.operators import features, filtering, lidar, mapping, motion
from waypath.registry_more import QUERIES, fused_rows, runs

SF = "/root/testdata/sf0.001"
rng = np.random.default_rng(1)


def test_propagation_of_a_steady_turn(spark):
    """A body that turns at 0.5 rad/s and feels gravity only stays where it is, turned by 0.5 a second."""
    t = np.arange(0, 2.0001, 0.01)
    imu = spark.createDataFrame([(1, float(x), 0.0, 0.0, 9.0, 0.0, 0.0, 0.6) for x in t], "vehicle_id long, t double, ax double, ay double, az double, gx double, gy double, gz double")
    scans = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0)], "vehicle_id long, scan_id long, beg double, end double")
    init = spark.createDataFrame([(1, 0.0, 0.0, -9.81, 0.0, 0.0, 0.1, 9.0)], "vehicle_id long, gravity_x double, gravity_y double, gravity_z double, bias_x double, bias_y double, bias_z double, norm double")
    knots = motion.imu_propagate(imu, scans, init).orderBy("scan_id", "seq").collect()
    last = knots[-1]
    assert abs(last.t - 1.0) < 1e-9 and np.allclose(last.pos, 0, atol=1e-9) and np.allclose(last.vel, 0, atol=1e-9)
    assert np.allclose(np.arctan2(last.rot[3], last.rot[0]), 1.0, atol=1e-6)
    assert {k.scan_id for k in knots} == {0, 1} and knots[0].t == 0 and max(k.seq for k in knots if k.scan_id == 0) == 101
    assert motion.imu_propagate(imu.limit(0), scans, init).count() == 0


def test_still_scans_stay_as_they_are(spark):
    points = spark.createDataFrame([(1, i, i / 100, float(i), 2.0, 3.0) for i in range(10)] + [(2, 0, 0.5, 1.0, 1.0, 1.0)], "scan_id long, seq long, t double, x double, y double, z double")
    z, eye = [0.0] * 3, np.eye(3).ravel().tolist()
    knots = spark.createDataFrame([(1, 0, 0.0, z, z, z, z, eye), (1, 1, 0.05, z, z, z, z, eye), (1, 2, 0.1, z, z, z, z, eye)], "scan_id long, seq long, t double, acc array<double>, gyr array<double>, vel array<double>, pos array<double>, rot array<double>")
    got = {(r.scan_id, r.seq): (r.x, r.y, r.z) for r in motion.undistort(points, knots, ((0, -1, 0, 1, 0, 0, 0, 0, 1), (0.1, 0.2, 0.3))).collect()}
    assert len(got) == 11 and all(np.allclose(got[r.scan_id, r.seq], (r.x, r.y, r.z)) for r in points.collect())


def test_filter_follows_fixes(spark):
    t = np.arange(0, 20, 0.02)
    imu = spark.createDataFrame([(1, float(x), 0.2, 0.0, 9.81, 0.0, 0.0, 0.0) for x in t], "vehicle_id long, t double, ax double, ay double, az double, gx double, gy double, gz double")
    fixes = spark.createDataFrame([(1, float(x), float(5 + 0.1 * x * x + rng.normal(0, 0.05)), 0.0, 1.0, 0.05, 0.05, 0.05) for x in np.arange(0, 20, 0.5)], "vehicle_id long, t double, x double, y double, z double, sx double, sy double, sz double")
    init = spark.createDataFrame([(1, 0.0, 0.0, -9.81, 0.0, 0.0, 0.0)], "vehicle_id long, gravity_x double, gravity_y double, gravity_z double, bias_x double, bias_y double, bias_z double")
    for compat in (False, True):
        got = filtering.eskf_trajectory(imu, fixes, init, (0.1, 0.0, 0.2), compat=compat).orderBy("t").collect()
        late = [r for r in got if r.t > 10]
        assert len(got) == 40 and np.sqrt(np.mean([(r.x + 0.1 - 5 - 0.1 * r.t**2) ** 2 for r in late])) < 0.08 and late[-1].sigma < got[0].sigma + 0.2
        assert abs(late[-1].vx - 0.2 * late[-1].t) < 0.2


def test_alignment_is_that_of_numpy(spark):
    got = {r.vehicle_id: r for r in QUERIES["umeyama_align"](spark, SF).collect()}
    for v, rows in fused_rows(spark, SF).items():
        a, b = rows[:, :3], rows[:, 3:]
        u, _, vt = np.linalg.svd((a - a.mean(0)).T @ (b - b.mean(0)))
        rot = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        assert np.allclose(rot @ b.T + (a.mean(0) - rot @ b.mean(0))[:, None], np.array(got[v].rot).reshape(3, 3) @ b.T + np.array(got[v].shift)[:, None], atol=1e-6)


def test_registration_finds_a_small_motion(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    wall = [(a, b, 0.0) for a in np.arange(0, 6, 0.25) for b in np.arange(0, 6, 0.25)]
    world = np.array([*wall, *((0.0, a, b + 0.25) for a, b, _ in wall), *((a, 0.0, b + 0.25) for a, b, _ in wall)]) + 3.0
    m = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(world)], "point_id long, x double, y double, z double")
    turn, shift = motion.rotation_of(np.array([0.01, -0.02, 0.015])), np.array([0.06, -0.04, 0.05])
    body = (world[::5] - shift) @ turn
    scans = spark.createDataFrame([(7, i, *map(float, p)) for i, p in enumerate(body)], "scan_id long, seq long, x double, y double, z double")
    start = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (8, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "scan_id long, px double, py double, pz double, qx double, qy double, qz double, qw double")
    got = {r.scan_id: r for r in mapping.scan_to_map_register(scans, start, m, 4, size=0.5).collect()}
    assert np.allclose((got[7].px, got[7].py, got[7].pz), shift, atol=0.01) and np.allclose((2 * got[7].qx, 2 * got[7].qy, 2 * got[7].qz), (0.01, -0.02, 0.015), atol=5e-3)
    assert got[8].px == 0


def test_labels_of_a_corner(spark):
    """Two straight walls that meet: planes, with an edge where they meet; a lone post is no plane; near points have no label."""
    a = [(5.0, y, 0.0) for y in np.arange(-4, 4, 0.05)] + [(x, 4.0, 0.0) for x in np.arange(5, 1, -0.05)]
    near = [(0.1, 0.1, 0.0)] * 10
    rows = [(1, 0, i, *map(float, p)) for i, p in enumerate(a)] + [(1, 1, i, *p) for i, p in enumerate(near)] + [(1, 2, i, *map(float, a[i])) for i in range(4)]
    points = spark.createDataFrame(rows, "scan_id long, ring int, seq long, x double, y double, z double")
    got = {r.seq: r.label for r in features.label_ring_features(points).collect()}
    assert set(got) == set(range(len(a)))
    assert sum(got[i] in (features.PLANE, features.PLANE_END) for i in range(5, 150)) > 130
    assert features.EDGE_PLANE in {got[i] for i in range(150, 172)}
    assert QUERIES["label_ring_features"](spark, SF).where("label between 0 and 5").count() == QUERIES["label_ring_features"](spark, SF).count() > 0


def test_laser_scan_arrays(spark):
    rows = [(1, 0, 3, 100, 2.0, 5.0), (1, 1, 3, 110, 3.0, 6.0), (1, 2, 2, 9000, 1.0, 1.0), (1, 3, 3, 35999, 4.0, 7.0)]
    points = spark.createDataFrame(rows, "scan_id long, seq long, ring int, azimuth int, distance double, intensity double")
    r = lidar.laserscan_arrays(lidar.laserscan_raster(points, 3, 1.0), 1.0).first()
    assert len(r.ranges) == 360 and r.ranges[358] == 3.0 and r.ranges[0] == 4.0 and sum(x == x for x in r.ranges) == 2
    r = lidar.laserscan_arrays(lidar.laserscan_raster(points, 3, 1.0, False), 1.0).first()
    assert r.ranges[89] == 2.0 or r.ranges[88] == 3.0


def test_status_needs_two_packets_and_near_angles(spark):
    def packet(off):
        raw = bytearray(1206)
        raw[:4] = bytes.fromhex(lidar.MAGIC)
        angles = lidar.VERTICAL["c32_2"]
        for j in range(32):
            v = round(angles[j] * 100) + off
            raw[245 + 2 * (j // 2 + j % 2 * 16) : 247 + 2 * (j // 2 + j % 2 * 16)] = (v if v >= 0 else v + 65535).to_bytes(2, "big")
        raw[186:188], raw[190:192] = (10).to_bytes(2, "big"), (400).to_bytes(2, "big")
        return bytes(raw)

    rows = [(1, 0, bytearray(packet(5))), (1, 1, bytearray(packet(900))), (2, 0, bytearray(packet(900))), (3, 0, bytearray(1206))]
    got = {r.device: r for r in lidar.device_status(spark.createDataFrame(rows, "device long, seq long, data binary")).collect()}
    assert set(got) == {1, 2} and got[1].n == 2 and got[1].corrections[:2] == [10, 400]
    assert np.allclose(got[1].angles, np.array(lidar.VERTICAL["c32_2"]) + 0.05) and got[2].angles is None


@pytest.mark.parametrize("name", ["imu_propagate", "eskf_trajectory", "scan_to_map_register"])
def test_registered_on_whole_tables(spark, name):
    assert QUERIES[name](spark, SF).count() > 0 and runs(spark, SF)[1].where(F.col("end") < F.col("beg")).isEmpty()
