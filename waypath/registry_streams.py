"""Queries that run a stream over the given tables until its input ends, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

import waypath.registry_more  # noqa: F401  (whose SQL some streams share)
from waypath.registry import ORACLE_SQL, QUERIES, map_points, query, rounded
from waypath.registry_scans import IMU
from waypath.streaming import operators
from waypath.streaming.runs import Ending, settled, shared_folder, stream_table


#: One point a voxel among the first ones; then, in voxels with a new point, one of what was kept and the new ones.
FIRST_KEPT = """WITH a AS (SELECT *, row_number() OVER (PARTITION BY floor(x / {size}), floor(y / {size}), floor(z / {size}) ORDER BY (x - (floor(x / {size}) + 0.5e0) * {size})**2 + (y - (floor(y / {size}) + 0.5e0) * {size})**2 + (z - (floor(z / {size}) + 0.5e0) * {size})**2, point_id) AS n FROM fx_map WHERE point_id % 3 <> 0),
 b AS (SELECT point_id, x, y, z FROM a WHERE n = 1 UNION ALL SELECT point_id, x, y, z FROM fx_map WHERE point_id % 3 = 0)
 SELECT point_id FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / {size}), floor(y / {size}), floor(z / {size}) ORDER BY (x - (floor(x / {size}) + 0.5e0) * {size})**2 + (y - (floor(y / {size}) + 0.5e0) * {size})**2 + (z - (floor(z / {size}) + 0.5e0) * {size})**2, point_id % 3 <> 0, point_id) AS n FROM b) WHERE n = 1"""


def same_sql(name: str):
    """Registers a query whose rows are another's."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, ORACLE_SQL[name]
        return f

    return add


def timed(df):
    """t_us as a timestamp ts; batch time is kept in whole microseconds."""
    return df.withColumn("ts", F.timestamp_micros("t_us"))


@same_sql("gnss_to_fix")
def stream_nmea_fixes(spark, sf_dir):
    end = Ending(stream_table(spark, sf_dir, "fx_nmea"), "vehicle_id", "recv_us")
    fixes = settled(operators.nmea_fixes(end.stream), "fixes", end)
    return rounded(fixes.select("vehicle_id", "seq", "lat", "quality", "sigma_lat", "heading", "yaw"))


@query("SELECT vehicle_id, topic, seq FROM (SELECT *, t_us - first_value(t_us) OVER (PARTITION BY vehicle_id, topic ORDER BY t_us, seq) AS e FROM fx_msgs) WHERE topic <> 'rtk' OR e % 30000000 < 20000000")
def stream_outage(spark, sf_dir):
    end = Ending(stream_table(spark, sf_dir, "fx_msgs"), "vehicle_id")
    return settled(operators.outage(end.stream, "rtk"), "outage", end).select("vehicle_id", "topic", "seq")


@query("WITH l AS (SELECT vehicle_id AS device, seq, coalesce(lag((seq * 1237) % 36000) OVER (PARTITION BY vehicle_id ORDER BY seq) - (seq * 1237) % 36000 > 35000, FALSE) AS fell FROM fx_msgs), s AS (SELECT device, seq, count(*) FILTER (fell) OVER (PARTITION BY device ORDER BY seq) AS sweep FROM l) SELECT * FROM s WHERE sweep > 0")
def stream_sweeps(spark, sf_dir):
    m = stream_table(spark, sf_dir, "fx_msgs")
    end = Ending(m.select(F.col("vehicle_id").alias("device"), "seq", "t_us", ((F.col("seq") * 1237) % 36000).alias("azimuth")), "device")
    return settled(operators.sweeps(end.stream), "sweeps", end)


@query("SELECT s.vehicle_id, s.seq AS scan_id, i.seq AS imu_seq FROM fx_msgs s JOIN fx_msgs i ON s.vehicle_id = i.vehicle_id AND s.topic = 'lio' AND i.topic = 'imu' AND i.t_us BETWEEN s.t_us AND s.t_us + 500000")
def stream_scan_imu(spark, sf_dir):
    lio, imu = (timed(stream_table(spark, sf_dir, "fx_msgs").where(F.col("topic") == t)) for t in ("lio", "imu"))
    return settled(operators.scan_imu(lio.withColumnRenamed("seq", "scan_id"), imu, 500_000), "scan_imu")


@query(f"WITH i AS ({IMU.replace('SELECT vehicle_id,', 'SELECT vehicle_id, t_us,')}), r AS (SELECT *, row_number() OVER w AS k, avg(ax) OVER w AS mx, avg(ay) OVER w AS my, avg(az) OVER w AS mz FROM i WINDOW w AS (PARTITION BY vehicle_id ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING)), o AS (SELECT vehicle_id, count(*) AS n, avg(ax) AS ax, avg(ay) AS ay, avg(az) AS az, avg(gx) AS gx, avg(gy) AS gy, avg(gz) AS gz, sum((ax - mx)**2 * (k - 1) / k) / count(*) AS cx, sum((ay - my)**2 * (k - 1) / k) / count(*) AS cy, sum((az - mz)**2 * (k - 1) / k) / count(*) AS cz FROM r WHERE k <= 10 GROUP BY 1 HAVING count(*) = 10), q AS (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS nm FROM o) SELECT vehicle_id, n, round(-ax / nm * 9.81e0, 6) + 0 AS gravity_x, round(-ay / nm * 9.81e0, 6) + 0 AS gravity_y, round(-az / nm * 9.81e0, 6) + 0 AS gravity_z, round(gx, 6) + 0 AS bias_x, round(gy, 6) + 0 AS bias_y, round(gz, 6) + 0 AS bias_z, round(cx, 6) + 0 AS cov_x, round(cy, 6) + 0 AS cov_y, round(cz, 6) + 0 AS cov_z FROM q")
def stream_imu_state(spark, sf_dir):
    m = stream_table(spark, sf_dir, "fx_msgs").where("topic = 'imu'")
    names = dict(zip(("x", "y", "z", "qz", "qw", "std_x"), ("ax", "ay", "az", "gx", "gy", "gz")))
    end = Ending(m.select("vehicle_id", "seq", "t_us", *(F.col(a).alias(b) for a, b in names.items())), "vehicle_id")
    return rounded(settled(operators.imu_state(end.stream), "imu_state", end))


@query("WITH p AS (SELECT vehicle_id, t_us, x / 10 AS x, y / 10 AS y, t_us % 10000000 / 5e6 AS px, t_us % 4000000 / 2e6 AS py FROM fx_msgs) SELECT vehicle_id, t_us // 100000 * 100000 AS from_us, floor(x / 0.05e0)::INT AS ix, floor(y / 0.05e0)::INT AS iy, count(*) AS hits FROM p WHERE abs(x - px) < 3 AND abs(y - py) < 3 GROUP BY ALL")
def stream_rolling_grid(spark, sf_dir):
    """Hits around a vehicle that moves, in all periods."""
    m = stream_table(spark, sf_dir, "fx_msgs")
    pose = [(F.col("t_us") % n / d).alias(c) for c, n, d in (("px", 10_000_000, 5e6), ("py", 4_000_000, 2e6))]
    end = Ending(m.select("vehicle_id", "t_us", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), *pose), "vehicle_id")
    return settled(operators.rolling_grid(timed(end.stream)), "grid", end)


@query("SELECT DISTINCT vehicle_id, t_us // 1000000 AS second FROM fx_msgs")
def stream_throttle(spark, sf_dir):
    rows = timed(stream_table(spark, sf_dir, "fx_msgs")).select("vehicle_id", "ts")
    return settled(operators.throttled(rows), "throttle").select("vehicle_id", F.floor(F.unix_micros("second") / 1_000_000).alias("second"))


def kept_map(spark, sf_dir, size):
    """Two of three map points come first, then the others, as batches of streams."""
    path, m = shared_folder(spark, "map"), map_points(spark, sf_dir).drop("label")
    operators.IncrementalMap(path, size, name="first")(m.where("point_id % 3 <> 0"), 0)
    build = operators.IncrementalMap(path, size)
    stream = stream_table(spark, sf_dir, "fx_map").select("point_id", "x", "y", "z").where("point_id % 3 = 0")
    stream.writeStream.foreachBatch(build).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start().awaitTermination()
    return build.read(spark).select("point_id", (F.col("point_id") % 3 == 0).cast("int").alias("is_new"))


@query("SELECT point_id, (point_id % 3 = 0)::INT AS is_new FROM (" + FIRST_KEPT.format(size="2e0") + ")")
def stream_map(spark, sf_dir):
    return kept_map(spark, sf_dir, 2.0)


@query("SELECT point_id, (point_id % 3 = 0)::INT AS is_new FROM (" + FIRST_KEPT.format(size="0.3e0") + ")")
def stream_map_fine(spark, sf_dir):
    """Voxels of which 64 m hold no whole number."""
    return kept_map(spark, sf_dir, 0.3)
