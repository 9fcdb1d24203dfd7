"""Steps whose plans or tasks grew faster than their input."""

from pyspark.sql import functions as F

from waypath.operators import filtering, imu, scans
from waypath.plans.fixtures import table
from waypath.sources.packets import DumpReader, Ranges

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_are_not_made_anew_for_each_byte(spark):
    frames = table(spark, SF, "fx_imu_frames").withColumn("frame", F.unhex("frame_hex"))
    assert plan(imu.decode_imu(frames)).count("unhex(") <= 2


def test_small_ranges_share_tasks(tmp_path):
    for i in range(300):
        (tmp_path / f"1-{i}.bin").write_bytes(bytes([i % 256]) * 120)
    reader = DumpReader({"path": str(tmp_path), "size": "12", "split": "36"})
    parts = reader.partitions()
    assert len(parts) < 100 and all(isinstance(p, Ranges) for p in parts)
    got = sorted((d, s) for p in parts for b in reader.read(p) for d, s in zip(b.column("device").to_pylist(), b.column("seq").to_pylist()))
    assert len(got) == len(set(got)) == 3000


def test_packets_are_numbered_in_ranges(spark):
    assert "Window [row_number() windowspecdefinition(device" in plan(table(spark, SF, "fx_packets")) and ", part#" in plan(table(spark, SF, "fx_packets"))


def test_runs_of_the_filter_come_in_batches(spark):
    rows = spark.createDataFrame([(1, 0.0)], "vehicle_id long, t double")
    numbers = rows.select("*", *(F.lit(1.0).alias(c) for c in ("ax", "ay", "az", "gx", "gy", "gz", "x", "y", "z", "sx", "sy", "sz", *(f"{k}_{c}" for k in ("gravity", "bias") for c in "xyz"))))
    found = filtering.eskf_trajectory(numbers, numbers, numbers.drop("t"))
    assert "FlatMapGroupsInPandas" not in plan(found) and found.count() == 1


def test_runs_of_points_in_one_order(spark):
    rows = spark.createDataFrame([(0, 1, i, c == "p", float(i), 0.0, 0.0) for i, c in enumerate("pppppp.pp.p")], "scan_id long, ring int, seq long, plane boolean, x double, y double, z double")
    found = scans.run_average(rows)
    assert plan(found).count("Window") <= 2 and "Aggregate" not in plan(found)
    assert [(r.seq, r.x) for r in found.orderBy("seq").collect()] == [(3, 3.0), (5, 4.5), (8, 7.5)]
