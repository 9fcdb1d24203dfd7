"""Every query of the library by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.functions import geodesy, rotation
from waypath.operators import cloud, gnss, imu, packets, spatial, store, trajectory
from waypath.operators.asof import asof_nearest
from waypath.plans.fixtures import table, with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at a precision at which engines agree; -0 becomes 0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def msgs(spark: SparkSession, sf_dir: str, topic: str | None = None) -> DataFrame:
    df = table(spark, sf_dir, "fx_msgs")
    return df.where(F.col("topic") == topic) if topic else df


#: Spark's own limit of a generated method's bytes, and the one beyond which Java doesn't compile it.
METHOD, SPARK_BYTES, JAVA_BYTES = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points. Long formulas over them run step by step, each compiled, rather than as one method that Java only interprets: the limit is set where it is Spark's own."""
    if spark.conf.get(METHOD, SPARK_BYTES) == SPARK_BYTES:
        spark.conf.set(METHOD, JAVA_BYTES)
    return table(spark, sf_dir, "fx_points")


NEAREST = """SELECT l.vehicle_id, l.seq, {cols} FROM (SELECT * FROM fx_msgs WHERE topic = '{left}') l LEFT JOIN (
 SELECT vehicle_id AS v, lseq, {inner} FROM (SELECT a.vehicle_id, a.seq AS lseq, b.*, row_number() OVER (PARTITION BY a.vehicle_id, a.seq ORDER BY abs(a.t_us - b.t_us), b.t_us DESC, b.seq DESC) AS rn
 FROM fx_msgs a JOIN fx_msgs b ON a.vehicle_id = b.vehicle_id AND a.topic = '{left}' AND b.topic = '{right}' AND abs(a.t_us - b.t_us) <= {tol}) WHERE rn = 1) r ON l.vehicle_id = r.v AND l.seq = r.lseq"""
FUSED = f"""m AS (SELECT t.*, r.rx, r.ry, r.rz, r.rqz, r.rqw, o.ox, o.oy, o.oz, o.oqz, o.oqw FROM fx_msgs t
 JOIN ({NEAREST.format(cols="rx, ry, rz, rqz, rqw", inner="x AS rx, y AS ry, z AS rz, qz AS rqz, qw AS rqw", left="truth", right="rtk", tol=150000)}) r ON t.vehicle_id = r.vehicle_id AND t.seq = r.seq
 JOIN ({NEAREST.format(cols="ox, oy, oz, oqz, oqw", inner="x AS ox, y AS oy, z AS oz, qz AS oqz, qw AS oqw", left="truth", right="lio", tol=100000)}) o ON t.vehicle_id = o.vehicle_id AND t.seq = o.seq WHERE t.topic = 'truth'),
 a AS (SELECT *, last_value(CASE WHEN rx IS NOT NULL THEN {{'x': rx, 'y': ry, 'z': rz, 'qz': rqz, 'qw': rqw}} END IGNORE NULLS) OVER w AS ra,
 last_value(CASE WHEN rx IS NOT NULL AND ox IS NOT NULL THEN {{'x': ox, 'y': oy, 'z': oz, 'qz': oqz, 'qw': oqw}} END IGNORE NULLS) OVER w AS la
 FROM m WINDOW w AS (PARTITION BY vehicle_id ORDER BY t_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, 2 * (atan2(ra.qz, ra.qw) - atan2(la.qz, la.qw)) AS th FROM a),
 f AS (SELECT vehicle_id, t_us, seq, x, y, z, CASE WHEN rx IS NOT NULL THEN rx ELSE ra.x + cos(th) * (ox - la.x) - sin(th) * (oy - la.y) END AS fx,
 CASE WHEN rx IS NOT NULL THEN ry ELSE ra.y + sin(th) * (ox - la.x) + cos(th) * (oy - la.y) END AS fy, CASE WHEN rx IS NOT NULL THEN rz ELSE ra.z + oz - la.z END AS fz, rx IS NOT NULL AS direct FROM b)"""


@query(NEAREST.format(cols="r.t_us AS rtk_us, r.rseq AS rtk_seq", inner="t_us, seq AS rseq", left="truth", right="rtk", tol=150000))
def asof_nearest_rtk(spark, sf_dir):
    found = asof_nearest(msgs(spark, sf_dir, "truth").select("vehicle_id", "t_us", "seq"), msgs(spark, sf_dir, "rtk").select("vehicle_id", "t_us", "seq"), 150_000, "rtk")
    return found.select("vehicle_id", "seq", F.col("rtk.t_us").alias("rtk_us"), F.col("rtk.seq").alias("rtk_seq"))


def fused(spark, sf_dir):
    return trajectory.naive_fusion(*(msgs(spark, sf_dir, t) for t in ("truth", "rtk", "lio")))


@query(f"WITH {FUSED} SELECT vehicle_id, seq, round(fx, 6) + 0 AS fx, round(fy, 6) + 0 AS fy, round(fz, 6) + 0 AS fz, direct FROM f WHERE fx IS NOT NULL")
def naive_fusion(spark, sf_dir):
    return rounded(fused(spark, sf_dir).select("vehicle_id", "seq", "fx", "fy", "fz", "direct"))


@query(f"WITH {FUSED}, e AS (SELECT vehicle_id, sqrt((fx - x)**2 + (fy - y)**2 + (fz - z)**2) AS e FROM f WHERE fx IS NOT NULL) SELECT vehicle_id, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, round(max(e), 6) AS max FROM e GROUP BY 1")
def evaluate_fusion(spark, sf_dir):
    return rounded(trajectory.ape_stats(fused(spark, sf_dir)))


STEPS = """d AS (SELECT *, (t_us - lag(t_us) OVER w) / 1e6 AS dt, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) AS step,
 2 * atan2(qz, qw) AS yaw0 FROM fx_msgs WHERE topic = 'truth' WINDOW w AS (PARTITION BY vehicle_id ORDER BY t_us, seq)),
 y AS (SELECT *, atan2(sin(yaw0), cos(yaw0)) AS yaw FROM d)"""


@query(f"WITH {STEPS}, g AS (SELECT vehicle_id, count(*) AS n, sum(step) AS length, arg_min(x, (t_us, seq)) AS x0, arg_max(x, (t_us, seq)) AS x1, arg_min(y, (t_us, seq)) AS y0, arg_max(y, (t_us, seq)) AS y1 FROM y GROUP BY 1 HAVING count(*) >= 10), h AS (SELECT *, sqrt((x1 - x0)**2 + (y1 - y0)**2) AS distance FROM g) SELECT vehicle_id, n, round(length, 6) AS length, round(distance, 6) AS distance, distance < 5 AND length > 20 AS closed, CASE WHEN NOT (distance < 5 AND length > 20) THEN CASE WHEN distance = 0 THEN 1.0::DOUBLE ELSE round(length / distance, 6) END END AS efficiency FROM h")
def path_summary(spark, sf_dir):
    return rounded(trajectory.path_summary(msgs(spark, sf_dir, "truth")))


@query(f"WITH {STEPS}, r AS (SELECT vehicle_id, dt, yaw - lag(yaw) OVER (PARTITION BY vehicle_id ORDER BY t_us, seq) AS dy FROM y), q AS (SELECT vehicle_id, abs((dy + pi() - 2 * pi() * floor((dy + pi()) / (2 * pi())) - pi()) / dt) AS rate FROM r WHERE dt >= 0.05) SELECT vehicle_id, count(*) AS n, round(avg(rate), 6) AS mean_rate, round(stddev_pop(rate), 6) AS std_rate FROM q WHERE rate < 3.0 GROUP BY 1")
def yaw_rate_stats(spark, sf_dir):
    return rounded(trajectory.yaw_rate_stats(msgs(spark, sf_dir, "truth")))


@query(f"WITH {STEPS} SELECT vehicle_id, seq, round(coalesce(sum(step) OVER (PARTITION BY vehicle_id ORDER BY t_us, seq ROWS UNBOUNDED PRECEDING), 0), 5) AS travelled FROM y")
def cumulative_distance(spark, sf_dir):
    return rounded(trajectory.cumulative_distance(msgs(spark, sf_dir, "truth")).select("vehicle_id", "seq", "travelled"), 5)


ELAPSED = "e AS (SELECT *, t_us - first_value(t_us) OVER (PARTITION BY vehicle_id, topic ORDER BY seq) AS elapsed_us FROM fx_msgs)"


@query(f"WITH {ELAPSED} SELECT vehicle_id, topic, seq, elapsed_us FROM e")
def elapsed_since_first(spark, sf_dir):
    return trajectory.elapsed_since_first(msgs(spark, sf_dir)).select("vehicle_id", "topic", "seq", "elapsed_us")


@query(f"WITH {ELAPSED} SELECT vehicle_id, topic, count(*) AS kept FROM e WHERE topic <> 'rtk' OR ((elapsed_us % 30000000) + 30000000) % 30000000 < 20000000 GROUP BY 1, 2")
def simulate_outage(spark, sf_dir):
    return trajectory.simulate_outage(msgs(spark, sf_dir), "rtk").groupBy("vehicle_id", "topic").agg(F.count("*").alias("kept"))


@query("WITH g AS (SELECT vehicle_id, lag(t_us) OVER (PARTITION BY vehicle_id ORDER BY t_us, seq) AS from_us, t_us AS to_us FROM fx_msgs WHERE topic = 'rtk') SELECT * FROM g WHERE to_us - from_us > 150000")
def outage_segments(spark, sf_dir):
    return trajectory.outage_segments(msgs(spark, sf_dir, "rtk"), 150_000)


@query("WITH s AS (SELECT *, sqrt(std_x**2 + std_y**2) AS std, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us, seq) AS i, count(*) OVER (PARTITION BY vehicle_id) AS n FROM fx_msgs WHERE topic = 'rtk'), o AS (SELECT vehicle_id, coalesce(min(t_us) FILTER (std > 1.5), min(t_us) FILTER (i = n // 2 + 1)) AS onset_us FROM s GROUP BY 1) SELECT vehicle_id, onset_us, count(*) AS n, count(*) FILTER (t_us < onset_us) AS n_before, round(max(std), 6) AS max_std, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(max(std) FILTER (t_us < onset_us), 6) AS max_std_before FROM s JOIN o USING (vehicle_id) GROUP BY 1, 2")
def signal_degradation(spark, sf_dir):
    return rounded(trajectory.signal_degradation(msgs(spark, sf_dir, "rtk"), 1.5))


@query("SELECT vehicle_id, seq, round(x - ((qw*qw - qz*qz) * 0.1 - 2 * qw * qz * 0.42), 6) + 0 AS x, round(y - (2 * qw * qz * 0.1 + (qw*qw - qz*qz) * 0.42), 6) + 0 AS y, round(z + 0.15, 6) AS z FROM fx_msgs WHERE topic = 'truth' AND t_us > 0")
def extract_ground_truth(spark, sf_dir):
    return rounded(trajectory.extract_ground_truth(msgs(spark, sf_dir, "truth"), (0.10, 0.42, -0.15)).select("vehicle_id", "seq", "x", "y", "z"))


@query("SELECT scan_id, count(*) AS n, sum(seq)::BIGINT AS seqs FROM fx_points WHERE NOT (x > -3 AND x < 0 AND y > -0.5 AND y < 0.5 AND z > -0.8 AND z < 1) AND seq % 2 = 0 AND x*x + y*y + z*z > 4 GROUP BY 1")
def clean_scan(spark, sf_dir):
    return cloud.clean_scan(points(spark, sf_dir), 2, 2.0, (-3.0, 0.0, -0.5, 0.5, -0.8, 1.0)).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("WITH v AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS i FROM fx_points WHERE ring < 6 AND (tag & 48) IN (0, 16)) SELECT scan_id, seq FROM v WHERE i % 3 = 0")
def tagged_ring_decimate(spark, sf_dir):
    return cloud.decimate(cloud.return_tag_filter(cloud.ring_filter(points(spark, sf_dir), 6)), 3, "valid").select("scan_id", "seq")


@query("WITH k AS (SELECT *, seq % 4 <> 0 AS kept FROM fx_points), p AS (SELECT *, lag(CASE WHEN kept THEN x ELSE 0 END, 1, 0) OVER w AS px, lag(CASE WHEN kept THEN y ELSE 0 END, 1, 0) OVER w AS py, lag(CASE WHEN kept THEN z ELSE 0 END, 1, 0) OVER w AS pz FROM k WINDOW w AS (PARTITION BY scan_id ORDER BY seq)) SELECT scan_id, count(*) AS n, sum(seq)::BIGINT AS seqs FROM p WHERE kept AND (abs(x - px) > 0.5 OR abs(y - py) > 0.5 OR abs(z - pz) > 0.5) GROUP BY 1")
def drop_consecutive_duplicates(spark, sf_dir):
    return cloud.drop_consecutive_duplicates(points(spark, sf_dir), F.col("seq") % 4 != 0, 0.5).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("WITH g AS (SELECT *, (lead(x) OVER w - x)**2 + (lead(y) OVER w - y)**2 + (lead(z) OVER w - z)**2 AS gap FROM fx_points WINDOW w AS (PARTITION BY scan_id, ring ORDER BY seq)) SELECT scan_id, ring, count(gap) AS n, round(avg(gap), 3) AS mean_gap, round(max(sqrt(x*x + y*y)), 3) AS max_planar FROM g GROUP BY 1, 2")
def ring_geometry(spark, sf_dir):
    df = cloud.ring_geometry(points(spark, sf_dir))
    return rounded(df.groupBy("scan_id", "ring").agg(F.count("gap").alias("n"), F.avg("gap").alias("mean_gap"), F.max("planar").alias("max_planar")), 3)


@query("SELECT scan_id, floor(x / 2)::BIGINT AS cx, floor(y / 2)::BIGINT AS cy, floor(z / 2)::BIGINT AS cz, count(*) AS n, round(avg(x), 5) + 0 AS x, round(avg(y), 5) + 0 AS y, round(avg(z), 5) + 0 AS z, round(avg(intensity), 5) AS intensity FROM fx_points GROUP BY 1, 2, 3, 4")
def voxel_centroid(spark, sf_dir):
    return rounded(spatial.voxel_centroid(points(spark, sf_dir), 2.0), 5)


@query("SELECT floor((x + 79.5017) / 0.5)::INT AS ix, floor((y + 8.40812) / 0.5)::INT AS iy, count(*) AS hits FROM fx_points GROUP BY 1, 2")
def occupancy_raster(spark, sf_dir):
    return spatial.occupancy_raster(points(spark, sf_dir), 0.5, (-79.5017, -8.40812))


def map_points(spark, sf_dir):
    return table(spark, sf_dir, "fx_map").select("point_id", "label", "x", "y", "z")


def scan_queries(spark, sf_dir):
    return points(spark, sf_dir).select(F.struct("scan_id", "seq").alias("query_id"), *((F.col(c) / 10).alias(c) for c in "xyz"))


PAIRS = "q AS (SELECT scan_id, seq, x / 10 AS x, y / 10 AS y, z / 10 AS z FROM fx_points), p AS (SELECT q.scan_id, q.seq, m.point_id, (q.x - m.x)**2 + (q.y - m.y)**2 + (q.z - m.z)**2 AS d2, m.x AS mx FROM q, fx_map m)"


@query(f"WITH {PAIRS} SELECT scan_id, seq, count(*) AS n, sum(point_id)::BIGINT AS ids, round(sum(d2), 6) AS d2 FROM p WHERE d2 <= 1.5 * 1.5 GROUP BY 1, 2")
def radius_join(spark, sf_dir):
    """All points of all scans; each with the number of its neighbours, and the sums of their ids and distances."""
    near = spatial.radius_counts(scan_queries(spark, sf_dir), map_points(spark, sf_dir), 1.5)
    return rounded(near.select("query_id.*", "n", "ids", "d2"))


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, seq ORDER BY d2, mx, point_id) AS rank FROM p) SELECT scan_id, seq, point_id, rank::INT AS rank, round(d2, 6) AS d2 FROM r WHERE rank <= 5")
def knn_join(spark, sf_dir):
    """All points of all scans."""
    return rounded(spatial.knn_join(scan_queries(spark, sf_dir), map_points(spark, sf_dir), 5, 2.0).select("query_id.scan_id", "query_id.seq", "point_id", "rank", "d2"))


def map_queries(spark, sf_dir):
    return map_points(spark, sf_dir).where("point_id % 50 = 0").select(F.col("point_id").alias("query_id"), "x", "y", "z")


MAP_PAIRS = "q AS (SELECT point_id AS query_id, x, y, z FROM fx_map WHERE point_id % 50 = 0), p AS (SELECT q.query_id, m.point_id, (q.x - m.x)**2 + (q.y - m.y)**2 + (q.z - m.z)**2 AS d2, m.x AS mx FROM q, fx_map m)"


@query(f"WITH {MAP_PAIRS} SELECT query_id, point_id, round(d2, 6) AS d2 FROM p WHERE d2 <= 1.5 * 1.5")
def radius_join_map(spark, sf_dir):
    return rounded(spatial.radius_join(map_queries(spark, sf_dir), map_points(spark, sf_dir), 1.5).select("query_id", "point_id", "d2"))


@query(f"WITH {MAP_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, mx, point_id) AS rank FROM p) SELECT query_id, point_id, rank::INT AS rank, round(d2, 6) AS d2 FROM r WHERE rank <= 5")
def knn_join_map(spark, sf_dir):
    return rounded(spatial.knn_join(map_queries(spark, sf_dir), map_points(spark, sf_dir), 5, 2.0).select("query_id", "point_id", "rank", "d2"))


@query("WITH b AS (SELECT label AS box_id, min(floor(x / 5) * 5) AS x0, min(floor(y / 5) * 5) AS y0, min(floor(z / 5) * 5) AS z0 FROM fx_map GROUP BY 1) SELECT box_id, point_id FROM b, fx_map m WHERE x >= x0 AND x < x0 + 10 AND y >= y0 AND y < y0 + 10 AND z >= z0 AND z < z0 + 10")
def box_join(spark, sf_dir):
    m = map_points(spark, sf_dir)
    boxes = m.groupBy(F.col("label").alias("box_id")).agg(*((F.min(F.floor(F.col(c) / 5) * 5)).cast("double").alias(f"{c}0") for c in "xyz"))
    boxes = boxes.withColumns({f"{c}1": F.col(f"{c}0") + 10 for c in "xyz"})
    return spatial.box_join(boxes, m.drop("label")).select("box_id", "point_id")


@query("WITH u AS (SELECT *, (point_id % 3 = 0)::INT AS is_new, floor(x / 2) AS cx, floor(y / 2) AS cy, floor(z / 2) AS cz FROM fx_map), r AS (SELECT *, max(is_new) OVER w AS touched, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY (x - (cx + 0.5) * 2)**2 + (y - (cy + 0.5) * 2)**2 + (z - (cz + 0.5) * 2)**2, is_new DESC, point_id) AS rank FROM u WINDOW w AS (PARTITION BY cx, cy, cz)) SELECT point_id, is_new FROM r WHERE touched = 0 OR rank = 1")
def voxel_keep_center(spark, sf_dir):
    m = map_points(spark, sf_dir).drop("label")
    return spatial.voxel_keep_center(m.where("point_id % 3 <> 0"), m.where("point_id % 3 = 0"), 2.0).select("point_id", "is_new")


@query("SELECT count(*) AS n, " + ", ".join(f"round({f}({c}), 6) AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + " FROM fx_map")
def map_extent(spark, sf_dir):
    return rounded(spatial.map_extent(map_points(spark, sf_dir)))


NMEA = """p AS (SELECT *, string_split(split_part(sentence, '*', 1), ',') AS p FROM fx_nmea),
 n AS (SELECT vehicle_id, seq, recv_us, CASE WHEN p[1] = '$GNGGA' THEN (floor(p[3]::DOUBLE / 100) + (p[3]::DOUBLE - floor(p[3]::DOUBLE / 100) * 100) / 60) END AS lat,
 CASE WHEN p[1] = '$GNGGA' THEN (floor(p[5]::DOUBLE / 100) + (p[5]::DOUBLE - floor(p[5]::DOUBLE / 100) * 100) / 60) END AS lon, CASE WHEN p[1] = '$GNGGA' THEN p[7]::INT END AS quality, CASE WHEN p[1] = '$GNGGA' THEN p[10]::DOUBLE END AS alt,
 CASE WHEN p[1] = '$GNGST' THEN p[7]::DOUBLE END AS sigma_lat, CASE WHEN p[1] = '$GNGSA' THEN len(list_filter(p[4:15], lambda s: s <> '')) END AS satellites, CASE WHEN p[1] = '$GNHDT' THEN p[2]::DOUBLE END AS heading FROM p)"""


@query(f"WITH {NMEA} SELECT vehicle_id, seq, round(lat, 6) AS lat, round(lon, 6) AS lon, quality, alt, sigma_lat, satellites::INT AS satellites, heading FROM n")
def parse_nmea(spark, sf_dir):
    return rounded(gnss.parse_nmea(table(spark, sf_dir, "fx_nmea")).select("vehicle_id", "seq", "lat", "lon", "quality", "alt", "sigma_lat", "satellites", "heading"))


@query(f"WITH {NMEA}, s AS (SELECT *, coalesce(last_value(sigma_lat IGNORE NULLS) OVER w, 1) AS sl, last_value(heading IGNORE NULLS) OVER w AS h FROM n WINDOW w AS (PARTITION BY vehicle_id ORDER BY recv_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), y AS (SELECT *, 176.25 - h AS y0 FROM s) SELECT vehicle_id, seq, round(lat, 6) AS lat, quality, sl AS sigma_lat, h AS heading, (CASE WHEN y0 > 180 THEN y0 - 360 WHEN y0 < -180 THEN y0 + 360 ELSE y0 END)::DOUBLE AS yaw FROM y WHERE lat IS NOT NULL")
def gnss_to_fix(spark, sf_dir):
    return rounded(gnss.gnss_to_fix(table(spark, sf_dir, "fx_nmea")).select("vehicle_id", "seq", "lat", "quality", "sigma_lat", "heading", "yaw"))


@query("SELECT scan_id, count(*) AS n, sum(seq)::BIGINT AS seqs FROM fx_points WHERE seq % 5 <> 0 AND seq % 7 <> 0 GROUP BY 1")
def drop_nonfinite(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"x": F.when(F.col("seq") % 5 == 0, float("nan")).otherwise(F.col("x")), "z": F.when(F.col("seq") % 7 == 0, float("-inf")).otherwise(F.col("z"))})
    return cloud.drop_nonfinite(p).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("SELECT scan_id, count(*) AS n, sum(seq)::BIGINT AS seqs FROM fx_points WHERE NOT ((seq * 37) % 36000 > 35000 OR (seq * 37) % 36000 < 1000) GROUP BY 1")
def azimuth_sector_mask(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("azimuth", (F.col("seq") * 37) % 36000)
    return cloud.azimuth_sector_mask(p, 35000, 1000).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


UTM = """u AS (SELECT *, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE floor((lon + 180) / 6)::INT % 60 + 1 END AS zone FROM g),
 k AS (SELECT *, sin(radians(lat)) AS s, radians(lon - (6 * zone - 183)) AS d, sqrt(0.00669437999014131651) AS e FROM u),
 c AS (SELECT *, (s / sqrt(1 - s * s) * sqrt(1 + sg * sg) - sg * sqrt(1 + s * s / (1 - s * s))) AS t FROM (SELECT *, sinh(e * atanh(e * s)) AS sg FROM k)),
 x AS (SELECT *, atan2(t, cos(d)) AS xi, asinh(sin(d) / sqrt(t * t + cos(d) * cos(d))) AS eta FROM c),
 utm AS (SELECT *, 500000 + {r} * (eta + {east}) AS east, {r} * (xi + {north}) + CASE WHEN lat < 0 THEN 1e7 ELSE 0 END AS north FROM x)""".format(
    r=f"{geodesy.SCALE * geodesy.RADIUS:.16e}",
    east=" + ".join(f"{k:.16e} * cos({2 * i} * xi) * sinh({2 * i} * eta)" for i, k in enumerate(geodesy.FORWARD, 1)),
    north=" + ".join(f"{k:.16e} * sin({2 * i} * xi) * cosh({2 * i} * eta)" for i, k in enumerate(geodesy.FORWARD, 1)),
)
PLACES = "g AS (SELECT event_id AS seq, (event_id * 7919 % 16000) / 1e2 - 79 AS lat, (event_id * 104729 % 36000) / 1e2 - 180 AS lon FROM events WHERE (event_id * 7919 % 16000) / 1e2 - 79 < 80)"


def places(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = e.select(F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 16000 / 1e2 - 79).alias("lat"), (F.col("event_id") * 104729 % 36000 / 1e2 - 180).alias("lon"))
    return at.where("lat < 80")


@query(f"WITH {PLACES}, {UTM} SELECT seq, zone, round(east, 2) AS x, round(north, 2) AS y FROM utm")
def utm_forward(spark, sf_dir):
    df = places(spark, sf_dir).withColumn("u", geodesy.utm_forward(F.col("lat"), F.col("lon")))
    return rounded(df.select("seq", "u.zone", "u.x", "u.y"), 2)


@query(f"WITH {PLACES} SELECT seq, round(lat, 7) + 0 AS lat, round(lon, 7) + 0 AS lon FROM g")
def utm_inverse(spark, sf_dir):
    u = geodesy.utm_forward(F.col("lat"), F.col("lon"))
    df = places(spark, sf_dir).select("seq", u.alias("u")).select("seq", geodesy.utm_inverse(*(F.col(f"u.{c}") for c in ("zone", "north", "x", "y"))).alias("p"))
    return rounded(df.select("seq", "p.lat", "p.lon"), 7)


@query("WITH p AS (SELECT scan_id, seq, x / 20 AS x, y / 20 AS y, z / 20 AS z FROM fx_points), a AS (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM p) SELECT scan_id, seq, round(1 + 2 * cos(n), 6) + 0 AS trace, round(CASE WHEN n > 0 THEN 2 * sin(n) / n * z ELSE 0 END, 6) + 0 AS skew, round(CASE WHEN n > pi() THEN 2 * pi() - n ELSE n END + 1.37e-5, 4) + 0 AS angle FROM a")
def so3_log_of_exp(spark, sf_dir):
    """Trace and skew part of the rotation by a vector, as sine and cosine give them, and the angle that its logarithm finds."""
    m = rotation.so3_exp(tuple(F.col(c) / 20 for c in "xyz"))
    p = points(spark, sf_dir).select("scan_id", "seq", *(v.alias(f"m{i}") for i, v in enumerate(m)))
    back = rotation.so3_log(tuple(F.col(f"m{i}") for i in range(9)))
    p = p.withColumns({f"b{i}": v for i, v in enumerate(back)})
    angle = F.sqrt(sum((F.col(f"b{i}") * F.col(f"b{i}") for i in (1, 2)), F.col("b0") * F.col("b0")))
    return p.select("scan_id", "seq", *((F.round(v, d) + 0.0).alias(c) for c, v, d in (("trace", F.col("m0") + F.col("m4") + F.col("m8"), 6), ("skew", F.col("m3") - F.col("m1"), 6), ("angle", angle + 1.37e-5, 4))))


@query("SELECT scan_id, seq, round(x / 20, 5) + 0 AS x, round(y / 20, 5) + 0 AS y, round(z / 20, 5) + 0 AS z FROM fx_points")
def so3_log_of_exp_all(spark, sf_dir):
    back = rotation.so3_log(rotation.so3_exp(tuple(F.col(c) / 20 for c in "xyz")))
    return rounded(points(spark, sf_dir).select("scan_id", "seq", *(v.alias(c) for c, v in zip("xyz", back))), 5)


PACKET = "('0x' || substr(packet_hex, {0} + 3, 2) || substr(packet_hex, {0} + 1, 2))::INT"


def packets_of(spark, sf_dir):
    return table(spark, sf_dir, "fx_packets").withColumn("data", F.unhex("packet_hex"))


@query("SELECT device, seq, len(list_filter(range(12), lambda b: substr(packet_hex, (b * 200 + 1)::INT, 4) = 'FFEE')) = 12 AS valid FROM fx_packets")
def packet_validity(spark, sf_dir):
    return packets_of(spark, sf_dir).select("device", "seq", packets.packet_valid(F.col("data")).alias("valid"))


@query(f"""WITH p AS (SELECT *, coalesce(stamp_us - lag(stamp_us) OVER (PARTITION BY device ORDER BY seq), 0) AS gap FROM fx_packets), v AS (SELECT * FROM p WHERE len(list_filter(range(12), lambda b: substr(packet_hex, (b * 200 + 1)::INT, 4) = 'FFEE')) = 12),
 b AS (SELECT *, {PACKET.format("b * 200 + 4")} AS az FROM (SELECT *, unnest(range(12))::INT AS b FROM v)),
 s AS (SELECT *, CASE WHEN b < 11 THEN lead(az) OVER w - az ELSE az - lag(az) OVER w END AS st FROM b WINDOW w AS (PARTITION BY device, seq ORDER BY b)),
 f AS (SELECT *, unnest(range(32))::INT AS k FROM s), o AS (SELECT *, b * 200 + 8 + k * 6 AS o, CASE WHEN st < 0 THEN st + 36000 ELSE st END AS step FROM f)
 SELECT device, seq, b AS block, count(*) AS n, sum((az + (k * step) // 32) % 36000)::BIGINT AS azimuths, round(sum({PACKET.format("o")} * 4e-3), 3) AS distances, sum(('0x' || substr(packet_hex, o + 5, 2))::INT)::BIGINT AS intensities,
 round(sum((stamp_us - (383 - b * 32 - k) * (gap / 384)) / 1e6), 3) + 0 AS times FROM o GROUP BY 1, 2, 3""")
def decode_lidar_firings(spark, sf_dir):
    f = packets.firings(packets_of(spark, sf_dir))
    return rounded(f.groupBy("device", "seq", "block").agg(F.count("*").alias("n"), F.sum("azimuth").alias("azimuths"), F.sum("distance").alias("distances"), F.sum("intensity").alias("intensities"), F.sum(F.col("t_us") / 1e6).alias("times")), 3)


@query("""WITH b AS (SELECT *, list_transform(range(11), lambda i: ('0x' || substr(frame_hex, (i * 2 + 1)::INT, 2))::INT) AS v FROM fx_imu_frames), g AS (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY recv_us, seq) AS i, v[2] AS kind,
 list_transform([3, 5, 7, 9], lambda o: (v[o] + 256 * v[o + 1] + 32768) % 65536 - 32768) AS n FROM b WHERE v[1] = 85 AND list_sum(v[1:10]) % 256 = v[11]),
 s AS (SELECT *, last_value(CASE WHEN kind = 81 THEN n END IGNORE NULLS) OVER u AS acc, max(CASE WHEN kind = 81 THEN i END) OVER u AS ai, last_value(CASE WHEN kind = 89 THEN n END IGNORE NULLS) OVER u AS q, lag(CASE WHEN kind = 82 THEN i END IGNORE NULLS) OVER (PARTITION BY vehicle_id ORDER BY i) AS gi
 FROM g WINDOW u AS (PARTITION BY vehicle_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT vehicle_id, seq, round(acc[1] * 16 * 9.80665e0 / 32768, 6) + 0 AS ax, round(n[3] * 2000 * pi() / 180 / 32768, 6) + 0 AS gz, round(coalesce(q[2] / 32768, 0), 6) + 0 AS qx, round(coalesce(q[1] / 32768, 1), 6) + 0 AS qw FROM s WHERE kind = 82 AND ai > coalesce(gi, 0)""")
def decode_imu(spark, sf_dir):
    frames = table(spark, sf_dir, "fx_imu_frames").withColumn("frame", F.unhex("frame_hex"))
    return rounded(imu.decode_imu(frames).select("vehicle_id", "seq", "ax", "gz", "qx", "qw"))


FLAGGED = "m AS (SELECT *, FALSE AS deleted, point_id % 7 = 0 AS downsampled FROM fx_map), a AS (SELECT *, x >= -5 AND x < 5 AND y >= -5 AND y < 5 AND z >= -5 AND z < 5 AS d, x >= 0 AND x < 9 AND y >= -9 AND y < 9 AND z >= -9 AND z < 9 AS r FROM m)"


@query(f"WITH {FLAGGED} SELECT point_id, d AND (NOT r OR downsampled) AS deleted FROM a")
def delete_and_restore_boxes(spark, sf_dir):
    def box(*c):
        return spark.createDataFrame([(1, *map(float, c))], "box_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")

    m = map_points(spark, sf_dir).drop("label").withColumns({"deleted": F.lit(False), "downsampled": F.col("point_id") % 7 == 0})
    gone = store.delete_boxes(m, box(-5, 5, -5, 5, -5, 5)).drop("newly")
    return store.restore_boxes(gone, box(0, 9, -9, 9, -9, 9)).select("point_id", "deleted")


@query("SELECT point_id, point_id % 3 = 0 AS deleted FROM fx_map")
def delete_points(spark, sf_dir):
    m = map_points(spark, sf_dir).drop("label").withColumns({"deleted": F.lit(False), "downsampled": F.lit(False)})
    asked = m.where("point_id % 3 = 0").select(F.col("point_id").alias("request_id"), *((F.col(c) + 5e-7).alias(c) for c in "xyz"))
    return store.delete_points(m, asked).select("point_id", "deleted")


@query("""WITH RECURSIVE m AS (SELECT point_id, round(x / 3) * 3 + point_id % 2 * 0.1e0 AS x, round(y / 3) * 3 AS y, round(z / 3) * 3 AS z FROM fx_map),
 q AS (SELECT row_number() OVER (ORDER BY point_id) AS i, x + 0.04e0 * (point_id % 5 - 2) AS x, y, z FROM m WHERE point_id % 4 = 1 OR point_id % 9 = 2),
 r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS gone UNION ALL SELECT r.i + 1, list_append(gone, (SELECT arg_min(point_id, {'d': (m.x - q.x)**2 + (m.y - q.y)**2 + (m.z - q.z)**2, 'p': point_id}) FROM m, q WHERE q.i = r.i + 1 AND abs(m.x - q.x) <= 0.15e0 AND abs(m.y - q.y) <= 0.15e0 AND abs(m.z - q.z) <= 0.15e0 AND NOT list_contains(gone, point_id))) FROM r WHERE r.i < (SELECT count(*) FROM q)),
 g AS (SELECT DISTINCT unnest(gone) AS point_id FROM r WHERE i = (SELECT count(*) FROM q))
 SELECT m.point_id, g.point_id IS NOT NULL AS deleted FROM m LEFT JOIN g ON m.point_id = g.point_id""")
def delete_contested_points(spark, sf_dir):
    """Requests that compete for points of clusters; each takes one that is left."""
    x, y, z = ((F.round(F.col(c) / 3) * 3).alias(c) for c in "xyz")
    m = map_points(spark, sf_dir).select("point_id", (x + F.col("point_id") % 2 * 0.1).alias("x"), y, z).withColumns({"deleted": F.lit(False), "downsampled": F.lit(False)})
    p = F.col("point_id")
    asked = m.where((p % 4 == 1) | (p % 9 == 2)).select(p.alias("request_id"), (F.col("x") + 0.04 * (p % 5 - 2)).alias("x"), "y", "z")
    return store.delete_points(m, asked, 0.15).select("point_id", "deleted")
