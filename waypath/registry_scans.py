"""Queries of operators/scans.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from waypath.operators import scans
from waypath.registry import msgs, points, query, rounded, table

IMU = "SELECT vehicle_id, CAST(floor(t_us / 5000000e0) AS BIGINT) AS grp, seq, x AS ax, y AS ay, z AS az, qz AS gx, qw AS gy, std_x AS gz FROM fx_msgs WHERE topic = 'imu'"
COST = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if dx * dx + dy * dy <= 4]


@query("""k AS (SELECT *, lead(t) OVER w AS tt, lead(v) OVER w AS tv FROM (SELECT scan_id, seq, time_s AS t, x AS v FROM fx_points WHERE tag < 4) WINDOW w AS (PARTITION BY scan_id ORDER BY t, seq))
SELECT scan_id, seq, t, hv, tt, tv FROM (SELECT p.scan_id, p.seq, p.time_s AS t, k.v AS hv, k.tt, k.tv, row_number() OVER (PARTITION BY p.scan_id, p.seq ORDER BY k.t DESC, k.seq DESC) AS rn
 FROM fx_points p JOIN k ON p.scan_id = k.scan_id AND k.t < p.time_s AND k.tt IS NOT NULL) WHERE rn = 1""".replace("k AS", "WITH k AS", 1))
def asof_bracket(spark, sf_dir):
    p = points(spark, sf_dir).select("scan_id", "seq", F.col("time_s").alias("t"), F.col("x").alias("v"), "tag")
    found = scans.asof_bracket(p.select("scan_id", "seq", "t"), p.where("tag < 4").drop("tag"))
    return found.select("scan_id", "seq", "t", F.col("head.v").alias("hv"), F.col("tail.t").alias("tt"), F.col("tail.v").alias("tv"))


@query("""SELECT s.vehicle_id, s.seq AS scan_id, i.seq AS imu_seq, i.t_us AS imu_us FROM fx_msgs s JOIN fx_msgs i
 ON s.vehicle_id = i.vehicle_id AND s.topic = 'lio' AND i.topic = 'imu' AND i.t_us BETWEEN s.t_us AND s.t_us + 500000""")
def scan_imu_interval_join(spark, sf_dir):
    lio = msgs(spark, sf_dir, "lio").select("vehicle_id", F.col("seq").alias("scan_id"), F.col("t_us").alias("beg_us"), (F.col("t_us") + 500_000).alias("end_us"))
    return scans.interval_join(lio, msgs(spark, sf_dir, "imu")).select("vehicle_id", "scan_id", "imu_seq", "imu_us")


@query(f"""WITH i AS ({IMU}), s AS (SELECT vehicle_id, grp, count(*) AS n FROM i GROUP BY ALL),
 u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY vehicle_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
 r AS (SELECT i.*, row_number() OVER w AS k, avg(ax) OVER w AS mx, avg(ay) OVER w AS my, avg(az) OVER w AS mz FROM i JOIN u ON i.vehicle_id = u.vehicle_id AND i.grp = u.grp AND before < 10
  WINDOW w AS (PARTITION BY i.vehicle_id ORDER BY i.grp, i.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 o AS (SELECT vehicle_id, count(*) AS n, avg(ax) AS ax, avg(ay) AS ay, avg(az) AS az, avg(gx) AS gx, avg(gy) AS gy, avg(gz) AS gz, sum((ax - mx) ** 2 * (k - 1) / k) / count(*) AS cx,
  sum((ay - my) ** 2 * (k - 1) / k) / count(*) AS cy, sum((az - mz) ** 2 * (k - 1) / k) / count(*) AS cz, sqrt(avg(ax) ** 2 + avg(ay) ** 2 + avg(az) ** 2) AS nm FROM r GROUP BY vehicle_id)
SELECT vehicle_id, n, round(-ax / nm * 9.81e0, 6) + 0 AS gravity_x, round(-ay / nm * 9.81e0, 6) + 0 AS gravity_y, round(-az / nm * 9.81e0, 6) + 0 AS gravity_z, round(gx, 6) + 0 AS bias_x, round(gy, 6) + 0 AS bias_y,
 round(gz, 6) + 0 AS bias_z, round(cx, 6) + 0 AS cov_x, round(cy, 6) + 0 AS cov_y, round(cz, 6) + 0 AS cov_z FROM o""")
def imu_init(spark, sf_dir):
    m = msgs(spark, sf_dir, "imu").select("vehicle_id", F.floor(F.col("t_us") / 5e6).cast("long").alias("grp"), "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), F.col("qz").alias("gx"), F.col("qw").alias("gy"), F.col("std_x").alias("gz"))
    return rounded(scans.imu_init(m))


@query("""WITH q AS (SELECT scan_id * 100000 + seq // 5 AS query_id, x, y, z FROM fx_points),
 s AS (SELECT query_id, sum(x*x) AS a, sum(x*y) AS b, sum(x*z) AS c, sum(y*y) AS e, sum(y*z) AS f, sum(z*z) AS g, -sum(x) AS p, -sum(y) AS q, -sum(z) AS r, list({'x': x, 'y': y, 'z': z}) AS pts FROM q GROUP BY query_id),
 t AS (SELECT *, a*(e*g-f*f) - b*(b*g-f*c) + c*(b*f-e*c) AS det FROM s),
 u AS (SELECT query_id, pts, (p*(e*g-f*f) - b*(q*g-f*r) + c*(q*f-e*r))/det AS ux, (a*(q*g-f*r) - p*(b*g-f*c) + c*(b*r-q*c))/det AS uy, (a*(e*r-q*f) - b*(b*r-q*c) + p*(b*f-e*c))/det AS uz FROM t WHERE abs(det) > 1e-6 * ((a+e+g)/3) ** 3),
 v AS (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS nm FROM u)
SELECT query_id, round(ux/nm, 6) + 0 AS nx, round(uy/nm, 6) + 0 AS ny, round(uz/nm, 6) + 0 AS nz, round(1/nm, 6) + 0 AS d FROM v
 WHERE nm > 0 AND len(list_filter(pts, lambda m: abs(ux/nm*m.x + uy/nm*m.y + uz/nm*m.z + 1/nm) > 5)) = 0""")
def plane_fit(spark, sf_dir):
    near = points(spark, sf_dir).select((F.col("scan_id") * 100_000 + F.floor(F.col("seq") / 5)).alias("query_id"), "x", "y", "z")
    return rounded(scans.plane_fit(near, most=5.0))


@query("""WITH l AS (SELECT *, tag < 48 AS plane FROM fx_points),
 r AS (SELECT *, sum(CASE WHEN plane THEN 0 ELSE 1 END) OVER (PARTITION BY scan_id, ring ORDER BY seq) AS run FROM l),
 m AS (SELECT *, max(run) OVER (PARTITION BY scan_id, ring) AS runs FROM r),
 p AS (SELECT *, (row_number() OVER (PARTITION BY scan_id, ring, run ORDER BY seq) - 1) // 4 AS part FROM m WHERE plane),
 g AS (SELECT scan_id, ring, run, part, runs, count(*) AS n, max(seq) AS seq, avg(x) AS ax, avg(y) AS ay, avg(z) AS az, max_by(x, seq) AS lx, max_by(y, seq) AS ly, max_by(z, seq) AS lz FROM p GROUP BY scan_id, ring, run, part, runs)
SELECT scan_id, ring, seq, round(CASE WHEN n = 4 THEN lx ELSE ax END, 6) + 0 AS x, round(CASE WHEN n = 4 THEN ly ELSE ay END, 6) + 0 AS y, round(CASE WHEN n = 4 THEN lz ELSE az END, 6) + 0 AS z FROM g WHERE n = 4 OR run < runs""")
def run_average(spark, sf_dir):
    return rounded(scans.run_average(points(spark, sf_dir).withColumn("plane", F.col("tag") < 48)))


@query(f"""WITH c AS (SELECT scan_id AS map_id, CAST(floor(x / 0.5e0) AS BIGINT) AS ix, CAST(floor(y / 0.5e0) AS BIGINT) AS iy, max(1e0 + tag % 5) AS cost FROM fx_points GROUP BY ALL),
 o(dx, dy) AS (VALUES {", ".join(map(str, COST))})
SELECT map_id, ix + dx AS ix, iy + dy AS iy, round(max(cost * exp(-1e0 * sqrt(dx * dx + dy * dy))), 6) AS cost FROM c, o GROUP BY ALL""")
def inflate_cells(spark, sf_dir):
    """Cells of five levels of cost: more than the radius has cells, so all offsets are taken."""
    cells = points(spark, sf_dir).groupBy(F.col("scan_id").alias("map_id"), F.floor(F.col("x") / 0.5).alias("ix"), F.floor(F.col("y") / 0.5).alias("iy")).agg(F.max(1.0 + F.col("tag") % 5).alias("cost"))
    return rounded(scans.inflate_cells(cells))


@query(f"""WITH c AS (SELECT DISTINCT scan_id AS map_id, CAST(floor(x / 0.5e0) AS BIGINT) AS ix, CAST(floor(y / 0.5e0) AS BIGINT) AS iy FROM fx_points),
 o(dx, dy) AS (VALUES {", ".join(map(str, COST))})
SELECT map_id, ix + dx AS ix, iy + dy AS iy, round(max(exp(-1e0 * sqrt(dx * dx + dy * dy))), 6) AS cost FROM c, o GROUP BY ALL""")
def inflate_cells_all(spark, sf_dir):
    cells = points(spark, sf_dir).select(F.col("scan_id").alias("map_id"), F.floor(F.col("x") / 0.5).alias("ix"), F.floor(F.col("y") / 0.5).alias("iy"), F.lit(1.0).alias("cost")).distinct()
    return rounded(scans.inflate_cells(cells))


@query("""WITH p AS (SELECT *, max_by(CASE WHEN scan_id % 2 = 0 THEN 0 ELSE time_s END, seq) OVER (PARTITION BY scan_id) AS timed, degrees(atan2(y, x)) AS yaw FROM fx_points),
 b AS (SELECT *, row_number() OVER w AS i, round(first_value(yaw) OVER w - yaw, 9) AS behind FROM p WHERE timed <= 0 WINDOW w AS (PARTITION BY scan_id, ring ORDER BY seq)),
 r AS (SELECT *, CASE WHEN behind >= 0 THEN behind ELSE behind + 360 END / 3.61e0 AS raw FROM b),
 f AS (SELECT *, coalesce(CAST(raw < lag(raw) OVER (PARTITION BY scan_id, ring ORDER BY seq) AS INT), 0) AS fell FROM r),
 t AS (SELECT *, max(fell) OVER (PARTITION BY scan_id, ring ORDER BY seq) AS turned FROM f)
SELECT scan_id, ring, seq, round(raw + turned * (360 / 3.61e0), 6) + 0 AS ms FROM t WHERE i > 1""")
def ring_times(spark, sf_dir):
    return rounded(scans.ring_times(points(spark, sf_dir).withColumn("time_s", F.when(F.col("scan_id") % 2 == 0, 0.0).otherwise(F.col("time_s")))))


@query("""SELECT device, seq, max(CASE WHEN seq % 17 = 5 THEN 57 ELSE CAST(('0x' || substr(packet_hex, 2409, 2)) AS BIGINT) END = 57) OVER (PARTITION BY device ORDER BY seq) AS dual FROM fx_packets""")
def return_mode(spark, sf_dir):
    packets = table(spark, sf_dir, "fx_packets")
    factory = F.when(F.col("seq") % 17 == 5, 57).otherwise(F.conv(F.substring("packet_hex", 2409, 2), 16, 10).cast("int"))
    return scans.return_mode(packets.select("device", "seq", factory.alias("factory")))


@query("""WITH o AS (SELECT DISTINCT ON (vehicle_id) vehicle_id, x AS ox, y AS oy, z AS oz FROM fx_msgs WHERE topic = 'truth' ORDER BY vehicle_id, t_us, seq)
SELECT m.vehicle_id, seq, round(x - ox, 6) + 0 AS east, round(y - oy, 6) + 0 AS north, round(z - oz, 6) + 0 AS up FROM fx_msgs m JOIN o ON m.vehicle_id = o.vehicle_id WHERE topic = 'rtk'""")
def local_enu(spark, sf_dir):
    first = msgs(spark, sf_dir, "truth").groupBy("vehicle_id").agg(F.min(F.struct("t_us", "seq", "x", "y", "z")).alias("o"))
    return rounded(scans.local_enu(msgs(spark, sf_dir, "rtk"), first.select("vehicle_id", *(F.col(f"o.{c}").alias(f"o{c}") for c in "xyz"))))
