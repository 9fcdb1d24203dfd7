"""Scans and samples move once for the interval join."""

from pyspark.sql import functions as F

from waypath.operators import scans


def test_each_side_moves_once(spark):
    left = spark.createDataFrame([(v, i, 70_000 * i, 70_000 * i + 500_000) for v in (1, 2) for i in range(40)], "vehicle_id long, scan_id long, beg_us long, end_us long")
    right = spark.createDataFrame([(v, i, 30_000 * i) for v in (1, 2) for i in range(90)], "vehicle_id long, seq long, t_us long")
    for found in (scans.interval_join(left, right), scans.scan_groups(left, right).where("not first")):
        assert found.count() == sum(70 <= 70 * i + 70 and 70 * i <= 30 * j <= 70 * i + 500 for i in range(40) for j in range(90)) * 2
    plan = scans.interval_join(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and plan.count("Exchange hashpartitioning(vehicle_id") == 2


def test_a_sample_is_kept_once_a_scan(spark):
    """Lists are told apart by pieces, scans by all their columns: equal rows on either side stay as many as they are."""
    left = spark.createDataFrame([(1, 5, 0, 400_000)] * 2, "vehicle_id long, scan_id long, beg_us long, end_us long")
    right = spark.createDataFrame([(1, 7, 200_000)] * 3 + [(1, 8, 400_000), (1, 9, 400_001)], "vehicle_id long, seq long, t_us long")
    got = scans.interval_join(left, right).groupBy("imu_seq").agg(F.count("*").alias("n")).collect()
    assert {r.imu_seq: r.n for r in got} == {7: 6, 8: 2}
