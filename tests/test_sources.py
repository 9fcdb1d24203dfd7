"""Text files: what is skipped, what is kept, and a round trip."""

from pyspark.sql import functions as F

from waypath.sources import text


def test_tum(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# t x y z\n\n1.5 1 2 3 0 0 0 1\n 0.5  4 5 x 0 0 0 1\n")
    rows = text.read_tum(spark, str(tmp_path / "a.txt")).orderBy("t").collect()
    assert [tuple(r)[1:5] for r in rows] == [(0.5, 4.0, 5.0, None), (1.5, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame([("r", 2.0), ("r", 1.0), ("s", 3.0)], "run_id string, t double").select("run_id", "t", *(F.lit(0.25).alias(c) for c in text.POSE[1:]))
    text.write_tum(df, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out/run_id=r")).collect()]
    assert [x[:19] for x in lines] == ["1.000000000 0.25000", "2.000000000 0.25000"]
    assert text.read_tum(spark, str(tmp_path / "out/run_id=s")).first().qw == 0.25


def test_nmea_and_trees(spark, tmp_path):
    (tmp_path / "log").write_text("$GNHDT,1.0,T*1B\r\nnoise\r\n$X\r\n")
    assert [r.sentence for r in text.read_nmea(spark, str(tmp_path / "log")).collect()] == ["$GNHDT,1.0,T*1B", "$X"]
    (tmp_path / "trees.csv").write_text("Tree_ID,Local_X,Local_Y,Latitude,Longitude\n1,0.5,-2,23.5,113.4\n")
    assert tuple(text.read_tree_inventory(spark, str(tmp_path / "trees.csv")).first()) == (1, 0.5, -2.0, 23.5, 113.4)


def test_deletion_edges(spark):
    from waypath.operators import store

    m = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 1.0)], "point_id long, x double").selectExpr("*", "x as y", "x as z", "false as deleted", "false as downsampled")
    asked = m.where("point_id < 3").selectExpr("point_id as request_id", "x", "y", "z")
    gone = store.delete_points(m, asked)  # two equal requests take two equal points
    assert {r.point_id: r.deleted for r in gone.collect()} == {1: True, 2: True, 3: False}
    assert {r.point_id for r in store.removed_points(gone).collect()} == {1, 2}
    assert store.delete_points(m, asked.limit(0)).where("deleted").count() == 0


def test_messages_packets_and_origins(spark, tmp_path):
    from waypath.operators import navigation

    msgs = spark.createDataFrame([("rtk", 1, 5), ("lio", 2, 6), ("rtk", 3, 7)], "topic string, seq long, t_us long")
    msgs.write.partitionBy("topic").parquet(f"{tmp_path}/log")
    got = text.read_messages(spark, f"{tmp_path}/log", ["rtk"])
    assert [r.seq for r in got.orderBy("seq").collect()] == [1, 3] and text.read_messages(spark, f"{tmp_path}/log").count() == 3
    assert "PartitionFilters: [isnotnull(topic" in got._jdf.queryExecution().executedPlan().toString()
    gga = "$GNGGA,1,2330.0000,N,11330.0000,E,{},12,0.8,10.5,M,-3.0,M,,*5A"
    lines = spark.createDataFrame([(1, 1, 10, gga.format(1)), (1, 2, 20, "$GNHDT,90.0,T*1B"), (1, 3, 30, gga.format(4)), (1, 4, 40, gga.format(0)), (2, 5, 50, gga.format(2))], "vehicle_id long, seq long, recv_us long, sentence string")
    origins = navigation.map_origins(navigation.fixes_of(lines))
    navigation.write_map_origin(origins, f"{tmp_path}/origin")
    back = navigation.read_map_origin(spark, f"{tmp_path}/origin")
    assert [(r.vehicle_id, r.lat, r.utm_zone) for r in back.collect()] == [(1, 23.5, "49 N")]
    assert [r.seq for r in navigation.gnss_to_odometry(lines).collect()] == [3]  # none before the origin, none of quality 0
    assert sorted(r.seq for r in navigation.gnss_to_odometry(lines, origins=back).collect()) == [1, 3]
    first = navigation.gnss_to_odometry(lines, "absolute").orderBy("seq").collect()
    assert [r.seq for r in first] == [1, 3, 5] and first[0].qw == 1 and first[1].covariance[35] == 1e-6 and first[0].covariance[35] == 0
    assert len(first[0].covariance) == 36 and len(navigation.fixes_of(lines).select(navigation.position_covariance((F.lit(1.0), F.lit(2.0), F.lit(3.0)), 9).alias("c")).first().c) == 9


def test_nmea_stream(spark, tmp_path):
    from waypath.streaming.runs import settled

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("$GNHDT,1.0,T*1B\r\nnoise\r\n$X\r\n")
    assert sorted(r.sentence for r in settled(text.stream_nmea(spark, f"{tmp_path}/in"), "nmea").collect()) == ["$GNHDT,1.0,T*1B", "$X"]


def test_times_and_intervals(spark, tmp_path):
    from waypath.operators import cloud

    points = spark.createDataFrame([(0, 1.7e9 + 0.05), (1, -1.0), (2, 0.2), (3, 0.21), (4, 0.0)], "scan_id long, time_s double")
    assert [round(r.time_s, 6) for r in cloud.relative_point_time(points, F.lit(1.7e9)).orderBy("scan_id").collect()] == [0.05, 0.0, 0.2, 0.1, 0.0]
    text.write_cloud_by_interval(points, f"{tmp_path}/two", 2)
    text.write_cloud_by_interval(points, f"{tmp_path}/all", -1)
    assert {(r.file_bucket, r.scan_id) for r in spark.read.parquet(f"{tmp_path}/two").collect()} == {(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)}
    assert {r.file_bucket for r in spark.read.parquet(f"{tmp_path}/all").collect()} == {0}


def test_ranges_of_time_change_nothing(spark):
    """As-of joins, last values and sums give the same whatever the length of the ranges."""
    from waypath.operators import asof

    left = spark.createDataFrame([(1, t, i) for i, t in enumerate(range(0, 5_000, 130))] + [(2, 7, 1)], "vehicle_id long, t_us long, seq long")
    right = spark.createDataFrame([(1, t, i) for i, t in enumerate(range(50, 5_000, 370))] + [(1, 420, 99)], "vehicle_id long, t_us long, seq long")
    results = []
    for span in (100, 999, 10**9):
        near = {(r.vehicle_id, r.seq): r.m and r.m.seq for r in asof.asof_nearest(left, right, 150, "m", span_us=span).collect()}
        odd = F.when(F.col("seq") % 3 == 0, F.col("seq"))
        last = sorted(map(tuple, asof.last_seen(left, {"v": odd}, span_us=span).select("vehicle_id", "seq", "v").collect()), key=str)
        prior = sorted(map(tuple, asof.last_seen(left, {"v": odd}, before=True, span_us=span).select("vehicle_id", "seq", "v").collect()), key=str)
        sums = sorted(map(tuple, asof.running_sum(left, "s", odd, span_us=span).select("vehicle_id", "seq", "s").collect()))
        middle = sorted(map(tuple, asof.nth_row(left, lambda n: F.floor(n / 2) + 1, span_us=span).collect()))
        assert middle == [(1, 19 * 130, 19), (2, 7, 1)] and asof.nth_row(left, lambda n: n + 1, span_us=span).count() == 0
        results.append((near, last, prior, sums))
    assert results[0] == results[1] == results[2] and results[0][0][1, 3] == 99 and (1, 4, 3) in results[0][1] and (1, 3, 0) in results[0][2]


def test_neighbours_of_clusters_and_far_queries(spark):
    import numpy as np

    from waypath.operators import spatial

    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 0.1, (300, 3)), rng.normal(50, 5, (100, 3)), [[1000, 0, 0]]])
    q = np.concatenate([rng.normal(0, 20, (40, 3)), [[5000, -100, 3], [0, 0, 0], [1000, 0, 0]]])
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "point_id long, x double, y double, z double")
    queries = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "query_id long, x double, y double, z double")
    got = {}
    for r in spatial.knn_join(queries, points, 5, 0.5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.point_id)
    want = {i: np.lexsort((np.arange(len(p)), p[:, 0], ((p - v) ** 2).sum(axis=1)))[:5].tolist() for i, v in enumerate(q)}
    assert got == want
    few = spatial.knn_join(queries, points.limit(3), 5)
    assert few.groupBy("query_id").count().where("count = 3").count() == len(q) and spatial.knn_join(queries, points.limit(0), 5).count() == 0
    assert spatial.knn_join(queries, points, 5, 0.5, max_dist=10.0).where("d2 > 100").count() == 0
    boxes = spark.createDataFrame([(1, -1000.0, 2000.0, -1000.0, 1000.0, -1000.0, 1000.0), (2, -0.1, 0.1, -0.1, 0.1, -0.1, 0.1), (3, 5.0, 5.0, 0.0, 1.0, 0.0, 1.0)], "box_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    held = {b: {r.point_id for r in spatial.box_join(boxes, points).where(F.col("box_id") == b).collect()} for b in (1, 2, 3)}
    assert held[1] == set(range(len(p))) and held[2] == set(np.flatnonzero(((p >= -0.1) & (p < 0.1)).all(axis=1)).tolist()) and not held[3]
