"""Times from directions that are equal but for the last bit of their angles."""

from waypath.operators.scans import ring_times


def test_points_in_one_line_with_the_scanner_have_one_direction(spark):
    # atan2 of the second point is one bit above the first one's, so the time was a whole turn
    lines = [(float(k), float(k) * 0.1 * 3) for k in (1, 3, 7, 11, 13, 21)] + [(1.0, 0.1 * 3), (1.0, 0.30000000000000010)]
    rows = [(0, 1, i, x, y, 0.0, 0.0) for i, (x, y) in enumerate(lines)]
    df = spark.createDataFrame(rows, "scan_id long, ring int, seq long, x double, y double, z double, time_s double")
    assert {round(r.ms, 6) + 0.0 for r in ring_times(df).collect()} == {0.0}
