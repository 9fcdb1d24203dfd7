"""Scans and samples with equal times are joined once."""

from pyspark.sql import functions as F

from waypath.operators import scans


def test_rows_of_equal_times(spark, monkeypatch):
    monkeypatch.setattr(scans, "TOGETHER", 3)
    asked = [(v, i, 100_000 * (i % 4), 100_000 * (i % 4) + 300_000) for v in (1, 2) for i in range(20)] + [(None, 99, 0, 10)]
    samples = [(v, i, 130_000 * (i % 5)) for v in (1, 2, 3) for i in range(40)] + [(1, 99, None)]
    left = spark.createDataFrame(asked, "vehicle_id long, scan_id long, beg_us long, end_us long")
    right = spark.createDataFrame(samples, "vehicle_id long, seq long, t_us long")
    found = scans.interval_join(left, right)
    assert found.columns == ["vehicle_id", "scan_id", "beg_us", "end_us", "imu_seq", "imu_us"]
    want = sorted((*a, s[1], s[2]) for a in asked for s in samples if a[0] == s[0] and s[2] is not None and a[2] <= s[2] <= a[3])
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_samples") < plan.index("Join Inner")  # taken apart after the join
