"""Queries of packets, motion, navigation, maps and makers' clouds, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waypath.functions import binary, geodesy, pose, rotation
from waypath.operators import cloud, features, filtering, imu, lidar, mapping, motion, navigation, packets, scans, spatial, store, trajectory, vendors
from waypath.sources import packets as sources
from waypath.streaming.runs import shared_folder
from waypath.registry import PACKET, QUERIES, UTM, map_points, msgs, packets_of, points, query, rounded, table

ANGLES = ", ".join(f"{float(v)}e0" for v in lidar.VERTICAL["c32_2"])


def words(offset: int, signed: bool = False) -> str:
    """SQL of a big-endian pair of bytes in packet_hex."""
    v = f"('0x' || substr(packet_hex, {2 * offset + 1}, 4))::INT"
    return f"(CASE WHEN {v} > 32767 THEN {v} - 65535 ELSE {v} END)" if signed else v


FIRED = f"""p AS (SELECT *, coalesce(stamp_us - lag(stamp_us) OVER (PARTITION BY device ORDER BY seq), 0) AS gap FROM fx_packets), v AS (SELECT * FROM p WHERE len(list_filter(range(12), lambda b: substr(packet_hex, (b * 200 + 1)::INT, 4) = 'FFEE')) = 12),
 b AS (SELECT *, {PACKET.format("b * 200 + 4")} AS az FROM (SELECT *, unnest(range(12))::INT AS b FROM v)),
 s AS (SELECT *, CASE WHEN b < 11 THEN lead(az) OVER w - az ELSE az - lag(az) OVER w END AS st FROM b WINDOW w AS (PARTITION BY device, seq ORDER BY b)),
 f AS (SELECT *, unnest(range(32))::INT AS k FROM s), o AS (SELECT *, b * 200 + 8 + k * 6 AS o, CASE WHEN st < 0 THEN st + 36000 ELSE st END AS step FROM f),
 a AS (SELECT device, seq, b * 32 + k AS i, k, (az + (k * step) // 32) % 36000 AS raw, {PACKET.format("o")} * 4e-3 AS distance, ('0x' || substr(packet_hex, o + 5, 2))::INT AS intensity, stamp_us - (383 - b * 32 - k) * (gap / 384) AS t_us FROM o),
 l AS (SELECT *, coalesce(lag(raw) OVER (PARTITION BY device ORDER BY seq, i) - raw > 35000, FALSE) AS fell FROM a),
 n AS (SELECT *, fell AND count(*) FILTER (fell) OVER (PARTITION BY device, seq ORDER BY i) = 1 AS opens FROM l),
 w AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY device ORDER BY seq, i) AS sweep FROM n)"""


@query(f"""WITH {FIRED}, t AS (SELECT device, arg_min([{words(186, True)}, {words(190, True)}], seq) AS c FROM fx_packets WHERE seq % 3 = 0 GROUP BY 1 HAVING count(*) >= 2),
 c AS (SELECT w.*, (raw + CASE WHEN c[2] - c[1] > 300 AND c[2] - c[1] < 460 THEN CASE WHEN k % 4 <= 1 THEN c[2] ELSE c[1] END WHEN k % 2 = 0 THEN c[1] ELSE -c[1] END) AS turned, [{ANGLES}][k + 1] AS vertical, k // 2 + CASE WHEN k % 2 = 0 THEN 0 ELSE 16 END AS ring FROM w JOIN t ON w.device = t.device WHERE sweep > 0 AND distance >= 0.15e0 AND distance < 100),
 m AS (SELECT *, ((turned % 36000) + 36000) % 36000 AS azimuth, count(*) OVER (PARTITION BY device, sweep) AS size FROM c)
 SELECT device, sweep, seq, i, ring::INT AS ring, azimuth, round(distance, 4) AS distance, intensity, round(distance * cos(radians(vertical)) * cos(radians(azimuth * 0.01e0)) + 0.0494e0 * cos(radians(azimuth * 0.01e0 - 12.98e0)), 5) + 0 AS x,
 round(-distance * cos(radians(vertical)) * sin(radians(azimuth * 0.01e0)) - 0.0494e0 * sin(radians(azimuth * 0.01e0 - 12.98e0)), 5) + 0 AS y, round(distance * sin(radians(vertical)), 5) + 0 AS z, round(t_us, 2) + 0 AS t_us
 FROM m WHERE size >= 65 AND NOT (azimuth > 9000 AND azimuth < 12000)""")
def decode_lidar_packets(spark, sf_dir):
    """Points with the corrections of each device's own status packets, which every third packet's bytes are read as."""
    p = packets_of(spark, sf_dir)
    out = lidar.decode_lidar_packets(p, lidar.device_status(status_packets(p)), most=100.0, sector=(9000, 12000))
    return out.select("device", "sweep", "seq", "i", "ring", "azimuth", F.round("distance", 4).alias("distance"), "intensity", *((F.round(c, 5) + 0.0).alias(c) for c in "xyz"), (F.round("t_us", 2) + 0.0).alias("t_us"))


def status_packets(p):
    """Every third packet with a status packet's first bytes; the others as they are."""
    return p.withColumn("data", F.when(F.col("seq") % 3 == 0, F.concat(F.unhex(F.lit(lidar.MAGIC)), F.substr("data", F.lit(5), F.lit(1202)))).otherwise(F.col("data")))


@query("WITH s AS (SELECT device, seq, 'A5FF005A' || substr(packet_hex, 9) AS packet_hex FROM fx_packets WHERE seq % 3 = 0), r AS (SELECT device, seq, [" + ", ".join(words(o, True) for o in (186, 190, 188, 192)) + "] AS corrections, " + "greatest(" + ", ".join(f"abs({words(245 + 2 * (i // 2 + i % 2 * 16), True)} * 0.01e0 - {float(v)}e0)" for i, v in enumerate(lidar.VERTICAL["c32_2"])) + ") <= 3 AS near_, [" + ", ".join(f"('0x' || substr(packet_hex, {2 * (57 - i) + 1}, 2))::INT" for i in range(6)) + "] AS date FROM s) SELECT device, count(*) AS n, arg_min(array_to_string(corrections, ','), seq) AS corrections, arg_min(near_, seq) AS configured, arg_max(array_to_string(date, ','), seq) AS date FROM r GROUP BY 1")
def device_status(spark, sf_dir):
    p = status_packets(packets_of(spark, sf_dir))
    text = {c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("corrections", "date")}
    return lidar.device_status(p).select("device", "n", text["corrections"], F.col("angles").isNotNull().alias("configured"), text["date"])


@query("""WITH RECURSIVE q AS (SELECT device, seq, row_number() OVER (PARTITION BY device ORDER BY seq) AS i, stamp_us // 8 + 20000000 AS t FROM fx_packets),
 f AS (SELECT device, seq, i, t + CASE WHEN t % 1000000 < 100000 AND seq % 3 <> 1 THEN -1000000 WHEN t % 1000000 > 900000 AND seq % 3 <> 2 THEN 1000000 WHEN seq % 7 = 3 THEN 950000 ELSE 0 END AS t FROM q),
 r AS (SELECT device, seq, i, t FROM f WHERE i = 1 UNION ALL SELECT f.device, f.seq, f.i, f.t + CASE WHEN f.t - r.t < 0 AND f.t - r.t > -1000000 AND f.t % 1000000 < 100000 THEN 1000000 WHEN f.t - r.t > 1000000 AND f.t - r.t < 1200000 AND f.t % 1000000 > 900000 THEN -1000000 ELSE 0 END FROM r JOIN f ON f.device = r.device AND f.i = r.i + 1)
 SELECT device, seq, t AS t_us FROM r""")
def gps_second_repair(spark, sf_dir):
    """Times (an eighth of the stamps') of which many near a full second have the wrong one, and some others are late."""
    t, s = F.floor(F.col("stamp_us") / 8) + 20_000_000, F.col("seq")
    part = t % 1_000_000
    wrong = F.when((part < 100_000) & (s % 3 != 1), -1_000_000).when((part > 900_000) & (s % 3 != 2), 1_000_000).when(s % 7 == 3, 950_000).otherwise(0)
    return lidar.gps_second_repair(table(spark, sf_dir, "fx_packets").select("device", "seq", (t + wrong).alias("t_us")))


@query("""WITH RECURSIVE h AS (SELECT vehicle_id, string_agg(read_hex, '' ORDER BY seq) AS x FROM fx_imu_reads GROUP BY 1),
 e AS (SELECT vehicle_id, seq, recv_us, sum(len(read_hex) // 2) OVER (PARTITION BY vehicle_id ORDER BY seq) - 1 AS last FROM fx_imu_reads WHERE read_hex <> ''),
 p AS (SELECT vehicle_id, x, unnest(range(len(x) // 2 - 10)) AS pos FROM h),
 v AS (SELECT vehicle_id, pos, list_transform(range(11), lambda i: ('0x' || substr(x, (2 * (pos + i) + 1)::INT, 2))::INT) AS b FROM p WHERE substr(x, (2 * pos + 1)::INT, 2) = '55'),
 k AS (SELECT * FROM v WHERE list_sum(b[1:10]) % 256 = b[11]),
 n AS MATERIALIZED (SELECT vehicle_id, pos, min(pos) OVER (PARTITION BY vehicle_id ORDER BY pos RANGE BETWEEN 11 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM k),
 r AS (SELECT vehicle_id, min(pos) AS pos FROM k GROUP BY 1 UNION ALL SELECT r.vehicle_id, n.next FROM r JOIN n ON r.vehicle_id = n.vehicle_id AND r.pos = n.pos WHERE n.next IS NOT NULL),
 f AS (SELECT k.vehicle_id, k.pos, b[2] AS kind, list_transform([3, 5, 7, 9], lambda i: CASE WHEN b[i] + 256 * b[i + 1] > 32767 THEN b[i] + 256 * b[i + 1] - 65536 ELSE b[i] + 256 * b[i + 1] END) AS q FROM r JOIN k ON r.vehicle_id = k.vehicle_id AND r.pos = k.pos),
 a AS (SELECT *, last_value(CASE WHEN kind = 81 THEN {'pos': pos, 'q': q} END IGNORE NULLS) OVER w AS acc, last_value(CASE WHEN kind = 89 THEN q END IGNORE NULLS) OVER w AS quat, last_value(CASE WHEN kind = 82 THEN pos END IGNORE NULLS) OVER w AS turned
  FROM f WINDOW w AS (PARTITION BY vehicle_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT * FROM a WHERE kind = 82 AND acc IS NOT NULL AND acc.pos > coalesce(turned, -1))
 SELECT g.vehicle_id, g.pos AS place, e.seq, e.recv_us, round(acc.q[1] * 16 * 9.80665e0 / 32768, 6) + 0 AS ax, round(g.q[3] * 2000 * pi() / 180 / 32768, 6) + 0 AS gz, round(coalesce(quat[2] / 32768e0, 0), 6) + 0 AS qx, round(coalesce(quat[1] / 32768e0, 1), 6) + 0 AS qw
 FROM g ASOF JOIN e ON g.vehicle_id = e.vehicle_id AND g.pos + 10 <= e.last""")
def decode_imu_stream(spark, sf_dir):
    """Samples from raw reads of a serial line with garbage, false headers and frames cut by reads."""
    reads = table(spark, sf_dir, "fx_imu_reads").select("vehicle_id", "seq", "recv_us", F.unhex("read_hex").alias("data"))
    return rounded(imu.decode_imu_stream(reads).select("vehicle_id", F.col("at").alias("place"), "seq", "recv_us", "ax", "gz", "qx", "qw"))


@query("SELECT device, seq, packet_hex FROM fx_packets")
def read_packets(spark, sf_dir):
    """The packets, written as dumps of 50 each and read again in ranges of 20."""
    path = shared_folder(spark, "dumps")
    sources.write_packets(packets_of(spark, sf_dir), path, 50)
    rows = sources.read_packets(spark, path, split=20 * 1206)
    name = F.regexp_extract("device", r"(\d+)-(\d+)\.bin$", 1), F.regexp_extract("device", r"(\d+)-(\d+)\.bin$", 2)
    return rows.select(name[0].cast("long").alias("device"), (name[1].cast("long") * 50 + F.col("seq")).alias("seq"), F.hex("data").alias("packet_hex"))


@query("SELECT device, seq, epoch_us(make_timestamp(2000 + (24 + seq % 3), 1 + seq % 12, 1 + seq % 28, seq % 24, seq % 60, (seq % 50)::DOUBLE)) + ('0x' || substr(packet_hex, 2407, 2) || substr(packet_hex, 2405, 2) || substr(packet_hex, 2403, 2) || substr(packet_hex, 2401, 2))::BIGINT AS t_us FROM fx_packets")
def gps_time(spark, sf_dir):
    s = F.col("seq")
    date = F.array(*(v.cast("int") for v in (s % 50, s % 60, s % 24, 1 + s % 28, 1 + s % 12, 24 + s % 3)))
    return packets_of(spark, sf_dir).select("device", "seq", lidar.gps_time(F.col("data"), date).alias("t_us"))


@query(f"SELECT device, seq, {words(100)} AS u16, {words(102, True)} AS i16, ('0x' || substr(packet_hex, 215, 2) || substr(packet_hex, 213, 2) || substr(packet_hex, 211, 2) || substr(packet_hex, 209, 2))::BIGINT AS u32 FROM fx_packets")
def packet_numbers(spark, sf_dir):
    d = F.col("data")
    return packets_of(spark, sf_dir).select("device", "seq", binary.u16be(d, 100).alias("u16"), binary.i16be(d, 102, True).alias("i16"), binary.u32le(d, 104).alias("u32"))


@query(f"SELECT scan_id, seq, ((tag % 32) // 2 + CASE WHEN tag % 2 = 0 THEN 0 ELSE 16 END)::INT AS ring, [{ANGLES}][tag % 32 + 1] AS vertical FROM fx_points")
def ring_angle_lookup(spark, sf_dir):
    return lidar.ring_angle_lookup(points(spark, sf_dir).select("scan_id", "seq", (F.col("tag") % 32).alias("laser")), "c32_2").select("scan_id", "seq", "ring", "vertical")


def azimuth():
    return (F.col("seq") * 1237) % 36000


@query("WITH p AS (SELECT scan_id, seq, 1439 - floor((seq * 1237) % 36000 * 0.01e0 / 0.25e0)::INT AS bin, sqrt(x * x + y * y) AS distance, intensity FROM fx_points WHERE ring = 3) SELECT scan_id, bin, round(arg_max(distance, seq), 6) AS range, arg_max(intensity, seq) AS intensity FROM p GROUP BY 1, 2")
def laserscan_raster(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"azimuth": azimuth(), "distance": F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))})
    return rounded(lidar.laserscan_raster(p, 3))


@query("WITH l AS (SELECT scan_id AS device, seq, coalesce(lag((seq * 1237) % 36000) OVER (PARTITION BY scan_id ORDER BY seq) - (seq * 1237) % 36000 > 35000, FALSE) AS fell FROM fx_points), s AS (SELECT device, seq, count(*) FILTER (fell) OVER (PARTITION BY device ORDER BY seq) AS sweep FROM l), n AS (SELECT *, count(*) OVER (PARTITION BY device, sweep) AS size FROM s) SELECT device, seq, sweep FROM n WHERE sweep > 0 AND size >= 20")
def sweep_segment(spark, sf_dir):
    return cloud.sweep_segment(points(spark, sf_dir).select(F.col("scan_id").alias("device"), "seq", azimuth().alias("azimuth")), 20).select("device", "seq", "sweep")


# ---- motion

POSES = "o AS (SELECT vehicle_id, arg_min(x, (t_us, seq)) AS px, arg_min(y, (t_us, seq)) AS py, arg_min(z, (t_us, seq)) AS pz, arg_min(qz, (t_us, seq)) AS qz, arg_min(qw, (t_us, seq)) AS qw FROM fx_msgs WHERE topic = 'truth' GROUP BY 1)"
QUARTER = ((0, -1, 0, 1, 0, 0, 0, 0, 1), (0.1, -0.2, 0.3))


def poses(spark, sf_dir):
    first = msgs(spark, sf_dir, "truth").groupBy("vehicle_id").agg(F.min_by(F.struct("x", "y", "z", "qx", "qy", "qz", "qw"), F.struct("t_us", "seq")).alias("p"))
    return first.select("vehicle_id", *(F.col(f"p.{c}").alias(f"p{c}") for c in "xyz"), *(f"p.q{c}" for c in "xyzw"))


@query(f"WITH {POSES}, b AS (SELECT scan_id, seq, scan_id % 8 AS vehicle_id, -y + 0.1e0 AS bx, x - 0.2e0 AS by_, z + 0.3e0 AS bz FROM fx_points) SELECT scan_id, seq, round((qw*qw - qz*qz) * bx - 2 * qw * qz * by_ + px, 5) + 0 AS x, round(2 * qw * qz * bx + (qw*qw - qz*qz) * by_ + py, 5) + 0 AS y, round(bz + pz, 5) + 0 AS z FROM b JOIN o ON b.vehicle_id = o.vehicle_id")
def transform_cloud(spark, sf_dir):
    p = points(spark, sf_dir).select("scan_id", "seq", (F.col("scan_id") % 8).alias("vehicle_id"), "x", "y", "z")
    return rounded(motion.transform_cloud(p, F.broadcast(poses(spark, sf_dir)), QUARTER, "vehicle_id").select("scan_id", "seq", "x", "y", "z"), 5)


@query("""WITH k AS (SELECT scan_id, seq, time_s AS t, y / 25 AS th, intensity / 50 AS w, x / 10 AS a, z AS v, y / 5 AS p FROM fx_points WHERE tag < 6),
 e AS (SELECT scan_id, arg_max(th, (t, seq)) AS eth, arg_max(p, (t, seq)) AS ep FROM k GROUP BY 1), g AS (SELECT *, lead(t) OVER o AS tt, lead(w) OVER o AS tw, lead(a) OVER o AS ta FROM k WINDOW o AS (PARTITION BY scan_id ORDER BY t, seq)),
 m AS (SELECT p.scan_id, p.seq, p.time_s - g.t AS dt, g.th, g.tw, g.ta, g.v, g.p, row_number() OVER (PARTITION BY p.scan_id, p.seq ORDER BY g.t DESC, g.seq DESC) AS rn FROM fx_points p JOIN g ON p.scan_id = g.scan_id AND g.t < p.time_s AND g.tt IS NOT NULL),
 r AS (SELECT q.scan_id, q.seq, q.x, q.y, q.z, dt, th + tw * dt AS a, p + v * dt + 0.5e0 * ta * dt * dt - ep AS s, eth, -q.y + 0.1e0 AS bx, q.x - 0.2e0 AS by_ FROM fx_points q LEFT JOIN m ON q.scan_id = m.scan_id AND q.seq = m.seq AND rn = 1 LEFT JOIN e ON q.scan_id = e.scan_id),
 w AS (SELECT *, cos(a) * bx - sin(a) * by_ + s AS wx, sin(a) * bx + cos(a) * by_ + 2 * s AS wy FROM r), u AS (SELECT *, cos(eth) * wx + sin(eth) * wy - 0.1e0 AS ux, -sin(eth) * wx + cos(eth) * wy + 0.2e0 AS uy FROM w)
 SELECT scan_id, seq, round(CASE WHEN dt IS NULL THEN x ELSE uy END, 5) + 0 AS x, round(CASE WHEN dt IS NULL THEN y ELSE -ux END, 5) + 0 AS y, round(z, 5) + 0 AS z FROM u""")
def undistort(spark, sf_dir):
    p = points(spark, sf_dir)
    th, zero, one = F.col("y") / 25, F.lit(0.0), F.lit(1.0)
    rot = F.array(F.cos(th), -F.sin(th), zero, F.sin(th), F.cos(th), zero, zero, zero, one)
    knots = p.where("tag < 6").select("scan_id", "seq", F.col("time_s").alias("t"), F.array(F.col("x") / 10, F.col("x") / 5, zero).alias("acc"), F.array(zero, zero, F.col("intensity") / 50).alias("gyr"), F.array(F.col("z"), F.col("z") * 2, zero).alias("vel"), F.array(F.col("y") / 5, F.col("y") / 5 * 2, zero).alias("pos"), rot.alias("rot"))
    return rounded(motion.undistort(p.select("scan_id", "seq", F.col("time_s").alias("t"), "x", "y", "z"), knots, QUARTER).select("scan_id", "seq", "x", "y", "z"), 5)


def turned(scale: float):
    return rotation.so3_exp(tuple(F.col(c) / scale for c in "xyz"))


@query("WITH p AS (SELECT *, sqrt(x*x + y*y + z*z) / 20 AS a FROM fx_points), q AS (SELECT *, CASE WHEN a > 1e-7 THEN sin(a / 2) / a ELSE 0.5e0 END / 20 AS k FROM p) SELECT scan_id, seq, round(x * k, 6) + 0 AS qx, round(y * k, 6) + 0 AS qy, round(z * k, 6) + 0 AS qz, round(cos(a / 2), 6) + 0 AS qw FROM q")
def matrix_to_quat(spark, sf_dir):
    rows = points(spark, sf_dir).select("scan_id", "seq", *(v.alias(f"r{i}") for i, v in enumerate(turned(20))))
    names = tuple(f"q{c}" for c in "xyzw")
    return rounded(rotation.with_quat(rows, tuple(F.col(f"r{i}") for i in range(9)), names).select("scan_id", "seq", *names))


@query("SELECT scan_id, seq, round(z, 5) + 0 AS px, round(x, 5) + 0 AS py, round(y, 5) + 0 AS pz, round(y / 30, 5) + 0 AS wx, round(z / 30, 5) + 0 AS wy, round(x / 30, 5) + 0 AS wz FROM fx_points")
def rigid_motions(spark, sf_dir):
    """What takes a pose to its product with another is that other, by composition, inverse and relative pose."""
    # Each step is columns of its own: written into one another, the expressions grow manifold with every step.
    rows = points(spark, sf_dir).select("scan_id", "seq", "x", "y", "z")
    for k, m in (("a", turned(20)), ("b", rotation.so3_exp(tuple(F.col(c) / 30 for c in "yzx")))):
        rows = rows.withColumns({f"m{i}": v for i, v in enumerate(m)})
        rows = rotation.with_quat(rows, tuple(F.col(f"m{i}") for i in range(9)), tuple(f"{k}q{c}" for c in "xyzw"))

    def kept(k: str, motion) -> tuple:
        nonlocal rows
        rows = rows.withColumns(dict(zip((*(f"{k}{c}" for c in "xyz"), *(f"{k}q{c}" for c in "xyzw")), (*motion[0], *motion[1]))))
        return pose.vec(k), pose.quat(k)

    a, b = (pose.vec(), pose.quat("a")), (tuple(F.col(c) for c in "zxy"), pose.quat("b"))
    there = kept("t", pose.relative_pose(*a, *kept("p", pose.rigid_compose(*a, *b))))
    back = kept("j", pose.rigid_inverse(*kept("i", pose.rigid_inverse(*there))))
    rows = rows.select("scan_id", "seq", *(v.alias(f"p{c}") for v, c in zip(back[0], "xyz")), *(v.alias(f"m{i}") for i, v in enumerate(rotation.quat_to_matrix(back[1]))))
    w = rotation.so3_log(tuple(F.col(f"m{i}") for i in range(9)))
    return rounded(rows.select("scan_id", "seq", "px", "py", "pz", *(v.alias(f"w{c}") for v, c in zip(w, "xyz"))), 5)


@query("SELECT scan_id, seq, round(z, 5) + 0 AS d0, round(x, 5) + 0 AS d1, round(y, 5) + 0 AS d2, round(y / 30, 5) + 0 AS d3, round(z / 30, 5) + 0 AS d4, round(x / 30, 5) + 0 AS d5, round(x / 7, 5) + 0 AS d6 FROM fx_points")
def state_boxminus(spark, sf_dir):
    """The difference of a state and the state moved by a delta is the delta."""
    c = F.col
    delta = (c("z"), c("x"), c("y"), c("y") / 30, c("z") / 30, c("x") / 30, c("x") / 7)
    rows = points(spark, sf_dir).select("scan_id", "seq", "x", "y", "z", *(v.alias(f"r{i}") for i, v in enumerate(turned(20))))
    state = (pose.vec(), tuple(c(f"r{i}") for i in range(9)), (c("x") * c("y"),))
    there = rotation.state_boxplus(*state, delta)
    rows = rows.select("*", *(v.alias(f"p{i}") for i, v in enumerate(there[0])), *(v.alias(f"m{i}") for i, v in enumerate(there[1])), there[2][0].alias("o"))
    out = rotation.state_boxminus((tuple(c(f"p{i}") for i in range(3)), tuple(c(f"m{i}") for i in range(9)), (c("o"),)), state)
    return rounded(rows.select("scan_id", "seq", *(v.alias(f"d{i}") for i, v in enumerate(out))), 5)


@query("SELECT scan_id, seq, round(x / 20, 6) + 0 AS roll, round(y / 20, 6) + 0 AS pitch, round(z / 2, 6) + 0 AS yaw FROM fx_points")
def rotm_to_euler(spark, sf_dir):
    a, b, g = F.col("x") / 20, F.col("y") / 20, F.col("z") / 2
    o, i = F.lit(0.0), F.lit(1.0)
    m = rotation.mat_mul(rotation.mat_mul((F.cos(g), -F.sin(g), o, F.sin(g), F.cos(g), o, o, o, i), (F.cos(b), o, F.sin(b), o, i, o, -F.sin(b), o, F.cos(b))), (i, o, o, o, F.cos(a), -F.sin(a), o, F.sin(a), F.cos(a)))
    return rounded(points(spark, sf_dir).select("scan_id", "seq", *(v.alias(n) for v, n in zip(rotation.rotm_to_euler(m), ("roll", "pitch", "yaw")))))


@query("WITH q AS (SELECT scan_id, seq, x / 30 AS x, y / 30 AS y, z / 30 AS z, 1e0 AS w FROM fx_points), t AS (SELECT *, x*x + y*y + z*z + w*w AS u, w*y - z*x AS t FROM q) SELECT scan_id, seq, round(57.3e0 * CASE WHEN abs(t) > 0.49999e0 * u THEN sign(t) * 2 * atan2(x, w) ELSE atan2(2 * (x*w + y*z), w*w + z*z - x*x - y*y) END, 6) + 0 AS roll, round(57.3e0 * CASE WHEN abs(t) > 0.49999e0 * u THEN sign(t) * pi() / 2 ELSE asin(2 * t / u) END, 6) + 0 AS pitch, round(57.3e0 * CASE WHEN abs(t) > 0.49999e0 * u THEN 0 ELSE atan2(2 * (z*w + x*y), w*w + x*x - y*y - z*z) END, 6) + 0 AS yaw FROM t")
def quat_to_euler_deg(spark, sf_dir):
    q = (*(F.col(c) / 30 for c in "xyz"), F.lit(1.0))
    return rounded(points(spark, sf_dir).select("scan_id", "seq", *(v.alias(n) for v, n in zip(rotation.quat_to_euler_deg(q), ("roll", "pitch", "yaw")))))


@query("SELECT scan_id, seq, round(x * 3.14159265358e0 / 180, 9) + 0 AS radians, round(y * 180 / 3.14159265358e0, 6) + 0 AS degrees, least(greatest(z, -1e0), 2e0) AS clamped FROM fx_points")
def angles(spark, sf_dir):
    return points(spark, sf_dir).select("scan_id", "seq", (F.round(pose.deg2rad(F.col("x")), 9) + 0.0).alias("radians"), (F.round(pose.rad2deg(F.col("y")), 6) + 0.0).alias("degrees"), pose.clamp(F.col("z"), -1, 2).alias("clamped"))


# ---- navigation

EVERYWHERE = "g AS (SELECT event_id AS seq, (event_id * 7919 % 18001) / 1e2 - 90 AS lat, (event_id * 104729 % 36000) / 1e2 - 180 AS lon FROM events)"
CAP = f"""e AS (SELECT *, {geodesy.ECCENTRICITY:.16e} AS ec, sin(radians(abs(lat))) AS sl FROM utm), cap AS (SELECT *, {geodesy.CAP_RADIUS:.16e} * sqrt((1 - sl) / (1 + sl)) * pow((1 + ec * sl) / (1 - ec * sl), ec / 2) AS rho, lat >= 84 OR lat < -80 AS polar FROM e)"""


def everywhere(spark, sf_dir):
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    return e.select(i.alias("seq"), (i * 7919 % 18001 / 1e2 - 90).alias("lat"), (i * 104729 % 36000 / 1e2 - 180).alias("lon"))


@query(f"WITH {EVERYWHERE}, {UTM}, {CAP} SELECT seq, CASE WHEN polar THEN 0 ELSE zone END AS zone, lat >= 0 AS north, round(CASE WHEN polar THEN 2e6 + rho * sin(radians(lon)) ELSE east END, 2) AS x, round(CASE WHEN polar THEN 2e6 - sign(lat) * rho * cos(radians(lon)) ELSE north END, 2) AS y FROM cap")
def grid_forward(spark, sf_dir):
    g = geodesy.with_grid(everywhere(spark, sf_dir))
    return rounded(g.select("seq", "zone", "north", F.col("grid_x").alias("x"), F.col("grid_y").alias("y")), 2)


@query(f"WITH {EVERYWHERE} SELECT seq, round(lat, 6) + 0 AS lat, CASE WHEN abs(lat) = 90 THEN 0 ELSE round(lon, 6) + 0 END AS lon FROM g")
def grid_inverse(spark, sf_dir):
    u = everywhere(spark, sf_dir).withColumn("u", geodesy.grid_forward(F.col("lat"), F.col("lon")))
    p = u.withColumn("p", geodesy.grid_inverse(*(F.col(f"u.{c}") for c in ("zone", "north", "x", "y"))))
    return rounded(p.select("seq", "p.lat", F.when(F.abs("lat") == 90, 0.0).otherwise(F.col("p.lon")).alias("lon")), 6)


FIX = """p AS (SELECT *, string_split(split_part(sentence, '*', 1), ',') AS p FROM fx_nmea),
 n AS (SELECT vehicle_id, seq, recv_us, CASE WHEN p[1] = '$GNGGA' THEN (floor(p[3]::DOUBLE / 100) + (p[3]::DOUBLE - floor(p[3]::DOUBLE / 100) * 100) / 60) END AS lat, CASE WHEN p[1] = '$GNGGA' THEN (floor(p[5]::DOUBLE / 100) + (p[5]::DOUBLE - floor(p[5]::DOUBLE / 100) * 100) / 60) END AS lon,
  CASE WHEN p[1] = '$GNGGA' THEN p[7]::INT END AS quality, CASE WHEN p[1] = '$GNGGA' THEN p[10]::DOUBLE END AS alt, CASE WHEN p[1] = '$GNGST' THEN [p[7]::DOUBLE, p[8]::DOUBLE, p[9]::DOUBLE] END AS sigmas, CASE WHEN p[1] = '$GNHDT' THEN p[2]::DOUBLE END AS heading FROM p),
 st AS (SELECT * EXCLUDE (sigmas, heading), last_value(sigmas IGNORE NULLS) OVER w AS sig, last_value(heading IGNORE NULLS) OVER w AS h FROM n WINDOW w AS (PARTITION BY vehicle_id ORDER BY recv_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 g AS (SELECT * FROM st WHERE lat IS NOT NULL)"""
YAW = "CASE WHEN {0} > 180 THEN {0} - 360 WHEN {0} < -180 THEN {0} + 360 ELSE {0} END"
ODOMETRY = "SELECT vehicle_id, seq, round(east - {ox}, 3) + 0 AS x, round(north - {oy}, 3) + 0 AS y, round(alt - {oz}, 3) + 0 AS z, round(coalesce(sin(radians({yaw}) / 2), 0), 6) + 0 AS qz, round(coalesce(cos(radians({yaw}) / 2), 1), 6) + 0 AS qw, round(coalesce(sig[1], {s[0]}) ** 2, 9) AS c0, round(coalesce(sig[2], {s[1]}) ** 2, 9) AS c7, round(coalesce(sig[3], {s[2]}) ** 2, 9) AS c14, CASE WHEN h IS NOT NULL THEN {turn} ELSE 0e0 END AS c35"


def odometry(spark, sf_dir, mode):
    got = navigation.gnss_to_odometry(table(spark, sf_dir, "fx_nmea"), mode)
    return got.select("vehicle_id", "seq", *((F.round(c, 3) + 0.0).alias(c) for c in "xyz"), *((F.round(c, 6) + 0.0).alias(c) for c in ("qz", "qw")), *(F.round(F.get("covariance", F.lit(i)), 9).alias(f"c{i}") for i in (0, 7, 14, 35)))


@query(f"WITH {FIX}, {UTM}, o AS (SELECT DISTINCT ON (vehicle_id) vehicle_id AS v, recv_us AS ou, seq AS os, east AS ox, north AS oy, alt AS oz FROM utm WHERE quality >= 4 ORDER BY vehicle_id, recv_us, seq) " + ODOMETRY.format(ox="ox", oy="oy", oz="oz", yaw=YAW.format("(90 - h + 86.25e0)"), s=("1e0", "1e0", "2e0"), turn="0.01e0") + " FROM utm JOIN o ON vehicle_id = v WHERE quality >= 1 AND (recv_us, seq) >= (ou, os)")
def gnss_to_odometry(spark, sf_dir):
    return odometry(spark, sf_dir, "local")


@query(f"WITH {FIX}, {UTM} " + ODOMETRY.format(ox="0", oy="0", oz="0", yaw=YAW.format("(90 - h)"), s=("0.01e0", "0.01e0", "0.02e0"), turn="1e-6") + " FROM utm WHERE quality >= 1")
def gnss_to_odometry_absolute(spark, sf_dir):
    return odometry(spark, sf_dir, "absolute")


@query(f"WITH {FIX} SELECT vehicle_id, seq, heading, round({YAW.format('(90 - heading)')}, 6) + 0 AS yaw, round(sin(radians({YAW.format('(90 - heading)')}) / 2), 6) + 0 AS qz, round(cos(radians({YAW.format('(90 - heading)')}) / 2), 6) + 0 AS qw FROM n WHERE heading IS NOT NULL")
def heading_rows(spark, sf_dir):
    return rounded(navigation.heading_rows(table(spark, sf_dir, "fx_nmea")).select("vehicle_id", "seq", "heading", "yaw", "qz", "qw"))


@query(f"WITH {FIX}, {UTM} SELECT DISTINCT ON (vehicle_id) vehicle_id, round(lat, 6) AS lat, round(lon, 6) AS lon, alt, zone || CASE WHEN lat >= 0 THEN ' N' ELSE ' S' END AS utm_zone, round(east, 3) AS utm_x, round(north, 3) AS utm_y, alt AS utm_z FROM utm WHERE quality >= 4 ORDER BY vehicle_id, recv_us, seq")
def map_origins(spark, sf_dir):
    o = navigation.map_origins(navigation.fixes_of(table(spark, sf_dir, "fx_nmea")))
    return o.select("vehicle_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "alt", "utm_zone", F.round("utm_x", 3).alias("utm_x"), F.round("utm_y", 3).alias("utm_y"), "utm_z")


@query("SELECT vehicle_id, topic, seq FROM (SELECT *, t_us - first_value(t_us) OVER (PARTITION BY vehicle_id, topic ORDER BY seq) AS e FROM fx_msgs) WHERE topic <> 'rtk' OR ((e % 30000000) + 30000000) % 30000000 < 20000000")
def simulate_outage_messages(spark, sf_dir):
    return trajectory.simulate_outage(msgs(spark, sf_dir), "rtk").select("vehicle_id", "topic", "seq")


@query("WITH e AS (SELECT vehicle_id, t_us - first_value(t_us) OVER (PARTITION BY vehicle_id ORDER BY seq) AS e FROM fx_msgs WHERE topic = 'rtk') SELECT vehicle_id, count(*) FILTER (((e % 30000000) + 30000000) % 30000000 < 20000000) AS kept, count(*) FILTER (((e % 30000000) + 30000000) % 30000000 >= 20000000) AS dropped FROM e GROUP BY 1")
def outage_counts(spark, sf_dir):
    return trajectory.outage_counts(msgs(spark, sf_dir), "rtk")


@query("WITH s AS (SELECT *, sqrt(std_x**2 + std_y**2) AS std, row_number() OVER (PARTITION BY vehicle_id ORDER BY t_us, seq) AS i, count(*) OVER (PARTITION BY vehicle_id) AS n FROM fx_msgs WHERE topic = 'rtk'), o AS (SELECT vehicle_id, coalesce(min(t_us) FILTER (std > 1.5), min(t_us) FILTER (i = n // 2 + 1)) AS onset_us FROM s GROUP BY 1), r AS (SELECT vehicle_id, onset_us, count(*) AS n, max(std) AS max_std, max(std) FILTER (t_us < onset_us) AS max_std_before, " + ", ".join(f"{f}({c}){w} AS {f}_{c}{e}" for c in "xy" for f in ("min", "max") for w, e in (("", ""), (" FILTER (t_us < onset_us)", "_before"))) + " FROM s JOIN o USING (vehicle_id) GROUP BY 1, 2) SELECT vehicle_id, onset_us, n, " + ", ".join(f"round({c}, 6) + 0 AS {c}" for c in ("max_std", "max_std_before", *(f"{f}_{c}{e}" for c in "xy" for f in ("min", "max") for e in ("", "_before")))) + ", " + ", ".join(f"round(CASE WHEN max_{c} > min_{c} THEN (max_{c} - min_{c}) * 0.15e0 ELSE 0.5e0 END, 6) AS margin_{c}" for c in "xy") + ", round(max_std * 1.15e0, 6) AS top, round(max_std_before * 1.5e0, 6) AS top_before FROM r")
def uncertainty_summary(spark, sf_dir):
    return rounded(trajectory.uncertainty_summary(msgs(spark, sf_dir, "rtk"), 1.5))


@query("SELECT vehicle_id, arg_min(seq, (t_us, seq)) AS seq FROM fx_msgs GROUP BY vehicle_id, floor(t_us / 1e6)")
def throttle(spark, sf_dir):
    return trajectory.throttle(msgs(spark, sf_dir)).select("vehicle_id", "seq")


# ---- makers' clouds

MAKER = {"livox": ("intensity AS reflectivity", "ring AS line", "time_s * 1e9 AS offset_time", "tag"), "velodyne": ("intensity", "ring", "time_s AS time"), "ouster": ("intensity", "ring", "time_s * 1e9 AS t"), "leishen": ("intensity", "ring", "time_s * 1e3 AS time"), "sim": ("intensity",)}
UNIT = {"velodyne": "SEC", "ouster": "NS", "leishen": "MS"}
BOX = (-3.0, 0.0, -0.5, 0.5, -0.8, 1.0)
INSIDE = "(x > -3 AND x < 0 AND y > -0.5 AND y < 0.5 AND z > -0.8 AND z < 1)"
FAR = "x*x + y*y + z*z"


def normal(spark, sf_dir, maker):
    raw = points(spark, sf_dir).selectExpr("scan_id", "seq", "x", "y", "z", *MAKER[maker])
    return vendors.normalize_points(raw, maker, UNIT.get(maker, "SEC"))


@query("SELECT maker, scan_id, seq, CASE WHEN maker = 'sim' THEN 0 ELSE ring END AS ring, intensity, round(CASE WHEN maker = 'sim' THEN 0 ELSE time_s * 1e3 END, 6) AS t_ms FROM fx_points, (VALUES ('livox'), ('velodyne'), ('ouster'), ('leishen'), ('sim')) m(maker)")
def normalize_points(spark, sf_dir):
    out = None
    for maker in MAKER:
        one = normal(spark, sf_dir, maker).select(F.lit(maker).alias("maker"), "scan_id", "seq", "ring", "intensity", F.round("t_ms", 6).alias("t_ms"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH u AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS i FROM fx_points WHERE seq > 0 AND ring < 6 AND (tag & 48) IN (0, 16) AND NOT {INSIDE}), k AS (SELECT p.*, u.i IS NOT NULL AND u.i % 3 = 0 AS slot FROM fx_points p LEFT JOIN u ON p.scan_id = u.scan_id AND p.seq = u.seq), l AS (SELECT *, lag(CASE WHEN slot THEN x ELSE 0 END, 1, 0) OVER w AS px, lag(CASE WHEN slot THEN y ELSE 0 END, 1, 0) OVER w AS py, lag(CASE WHEN slot THEN z ELSE 0 END, 1, 0) OVER w AS pz FROM k WINDOW w AS (PARTITION BY scan_id ORDER BY seq)) SELECT scan_id, seq FROM l WHERE slot AND (abs(x - px) > 1e-7 OR abs(y - py) > 1e-7 OR abs(z - pz) > 1e-7) AND {FAR} > 4")
def clean_scan_livox(spark, sf_dir):
    return vendors.clean_vendor_scan(normal(spark, sf_dir, "livox"), "livox", 3, 2.0, BOX).select("scan_id", "seq")


@query(f"SELECT scan_id, seq FROM fx_points WHERE NOT {INSIDE} AND seq % 2 = 0 AND {FAR} >= 4")
def clean_scan_ouster(spark, sf_dir):
    return vendors.clean_vendor_scan(normal(spark, sf_dir, "ouster"), "ouster", 2, 2.0, BOX).select("scan_id", "seq")


@query(f"SELECT scan_id, seq FROM fx_points WHERE NOT {INSIDE} AND {FAR} >= 4")
def clean_scan_sim(spark, sf_dir):
    return vendors.clean_vendor_scan(normal(spark, sf_dir, "sim"), "sim", 2, 2.0, BOX).select("scan_id", "seq")


@query(f"SELECT scan_id, seq, round(x, 6) + 0 AS x, round(time_s * 1e3, 6) AS t_ms FROM fx_points WHERE NOT {INSIDE} AND seq % 2 = 0 AND {FAR} > 4")
def clean_scan_points(spark, sf_dir):
    return rounded(cloud.clean_scan(points(spark, sf_dir), 2, 2.0, BOX).select("scan_id", "seq", "x", "t_ms"))


@query("WITH p AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 1.7e9 + time_s - 0.01e0 - 1.7e9 ELSE time_s * 3 END AS t FROM fx_points WHERE seq % 5 <> 0) SELECT scan_id, seq, round(CASE WHEN t < 0 THEN 0 WHEN t > 0.2e0 THEN 0.1e0 ELSE t END, 5) AS time_s FROM p")
def convert_vendor_cloud(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"x": F.when(F.col("seq") % 5 == 0, float("nan")).otherwise(F.col("x")), "time_s": F.when(F.col("seq") % 3 == 0, F.lit(1.7e9) + F.col("time_s") - 0.01).otherwise(F.col("time_s") * 3)})
    return rounded(vendors.convert_vendor_cloud(p, F.lit(1.7e9)).select("scan_id", "seq", "time_s"), 5)


@query("WITH k AS (SELECT *, seq % 4 <> 0 AS kept FROM fx_points), p AS (SELECT *, lag(CASE WHEN kept THEN x ELSE 0 END, 1, 0) OVER w AS px, lag(CASE WHEN kept THEN y ELSE 0 END, 1, 0) OVER w AS py, lag(CASE WHEN kept THEN z ELSE 0 END, 1, 0) OVER w AS pz FROM k WINDOW w AS (PARTITION BY scan_id ORDER BY seq)) SELECT scan_id, seq FROM p WHERE kept AND (abs(x - px) > 0.5 OR abs(y - py) > 0.5 OR abs(z - pz) > 0.5)")
def drop_consecutive_duplicates_points(spark, sf_dir):
    return cloud.drop_consecutive_duplicates(points(spark, sf_dir), F.col("seq") % 4 != 0, 0.5).select("scan_id", "seq")


@query("SELECT scan_id, seq FROM fx_points WHERE NOT ((seq * 37) % 36000 > 35000 OR (seq * 37) % 36000 < 1000)")
def azimuth_sector_mask_points(spark, sf_dir):
    return cloud.azimuth_sector_mask(points(spark, sf_dir).withColumn("azimuth", (F.col("seq") * 37) % 36000), 35000, 1000).select("scan_id", "seq")


@query("SELECT scan_id, seq FROM fx_points WHERE seq % 5 <> 0 AND seq % 7 <> 0")
def drop_nonfinite_points(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"x": F.when(F.col("seq") % 5 == 0, float("nan")).otherwise(F.col("x")), "z": F.when(F.col("seq") % 7 == 0, float("-inf")).otherwise(F.col("z"))})
    return cloud.drop_nonfinite(p).select("scan_id", "seq")


@query("SELECT scan_id, ring, seq, round(sqrt(x*x + y*y), 6) AS planar, round((lead(x) OVER w - x)**2 + (lead(y) OVER w - y)**2 + (lead(z) OVER w - z)**2, 6) AS gap FROM fx_points WINDOW w AS (PARTITION BY scan_id, ring ORDER BY seq)")
def ring_geometry_points(spark, sf_dir):
    return rounded(cloud.ring_geometry(points(spark, sf_dir)).select("scan_id", "ring", "seq", "planar", "gap"))


# ---- maps

@query("SELECT scan_id, seq, z >= 0.15e0 AND z <= 1.5e0 AND sqrt(x*x + y*y) <= 5 AS mark, z >= -2 AND z <= 2 AND sqrt(x*x + y*y) <= 6 AS clear FROM fx_points")
def height_band(spark, sf_dir):
    return mapping.height_band(points(spark, sf_dir)).select("scan_id", "seq", "mark", "clear")


@query("SELECT scan_id, seq FROM (SELECT scan_id, seq, x / 5 AS x, y / 5 AS y, z / 5 AS z FROM fx_points) p WHERE EXISTS (SELECT 1 FROM fx_map m WHERE (m.x - p.x)**2 + (m.y - p.y)**2 + (m.z - p.z)**2 <= 1)")
def crop_near_trajectory(spark, sf_dir):
    p = points(spark, sf_dir).select("scan_id", "seq", *((F.col(c) / 5).alias(c) for c in "xyz"))
    return mapping.crop_near_trajectory(p, map_points(spark, sf_dir), 1.0).select("scan_id", "seq")


@query("SELECT scan_id, seq, min(sqrt((t.x - p.x / 2)**2 + (t.y - p.y / 2)**2))::DECIMAL(18, 6)::DOUBLE AS distance FROM fx_points p, fx_trees t GROUP BY 1, 2")
def nearest_tree(spark, sf_dir):
    p = points(spark, sf_dir).select(F.struct("scan_id", "seq").alias("query_id"), (F.col("x") / 2).alias("x"), (F.col("y") / 2).alias("y"))
    return rounded(mapping.nearest_tree(p, table(spark, sf_dir, "fx_trees")).select("query_id.scan_id", "query_id.seq", "distance"))


@query("SELECT a.tree_id, round(min(sqrt((a.x - b.x)**2 + (a.y - b.y)**2)), 6) AS distance FROM fx_trees a JOIN fx_trees b ON a.tree_id <> b.tree_id GROUP BY 1")
def tree_spacing(spark, sf_dir):
    return rounded(mapping.tree_spacing(table(spark, sf_dir, "fx_trees")).select("tree_id", "distance"))


FIT = """gg AS (SELECT tree_id, x, y, radians(lat) AS la, radians(lon) AS lo, 6378137e0 / sqrt(1 - 0.006694379990141317e0 * sin(radians(lat))**2) AS nn FROM fx_trees),
 cc AS (SELECT *, nn * cos(la) * cos(lo) AS cx, nn * cos(la) * sin(lo) AS cy, nn * (1 - 0.006694379990141317e0) * sin(la) AS cz FROM gg),
 oo AS (SELECT arg_min({'la': la, 'lo': lo, 'x': cx, 'y': cy, 'z': cz}, tree_id) AS o FROM cc),
 en AS (SELECT x, y, cos(o.lo) * (cy - o.y) - sin(o.lo) * (cx - o.x) AS east, cos(o.la) * (cz - o.z) - sin(o.la) * (cos(o.lo) * (cx - o.x) + sin(o.lo) * (cy - o.y)) AS north FROM cc, oo),
 mm AS (SELECT *, avg(x) OVER () AS mx, avg(y) OVER () AS my, avg(east) OVER () AS me, avg(north) OVER () AS mn FROM en),
 ab AS (SELECT any_value(mx) AS mx, any_value(my) AS my, any_value(me) AS me, any_value(mn) AS mn, count(*) AS trees, sum((x - mx) * (east - me) + (y - my) * (north - mn)) AS a, sum((x - mx) * (north - mn) - (y - my) * (east - me)) AS b, sum((x - mx)**2 + (y - my)**2) AS s FROM mm),
 tt AS (SELECT mx AS ax, my AS ay, me AS ae, mn AS an, trees, atan2(b, a) AS turn, sqrt(a * a + b * b) / s AS scale FROM ab),
 fit AS (SELECT any_value(ax) AS mx, any_value(ay) AS my, any_value(ae) AS me, any_value(an) AS mn, any_value(trees) AS trees, any_value(turn) AS turn, any_value(scale) AS scale, sqrt(avg((east - ae - scale * (cos(turn) * (x - ax) - sin(turn) * (y - ay)))**2 + (north - an - scale * (sin(turn) * (x - ax) + cos(turn) * (y - ay)))**2)) AS residual FROM en, tt)"""


@query(f"WITH {FIT} SELECT trees, round(turn, 6) AS turn, round(scale, 8) AS scale, round(me - scale * (cos(turn) * mx - sin(turn) * my), 4) AS shift_x, round(mn - scale * (sin(turn) * mx + cos(turn) * my), 4) AS shift_y, round(residual, 4) AS residual FROM fit")
def georeference_fit(spark, sf_dir):
    f = mapping.georeference_fit(table(spark, sf_dir, "fx_trees"))
    return f.select("trees", F.round("turn", 6).alias("turn"), F.round("scale", 8).alias("scale"), *(F.round(c, 4).alias(c) for c in ("shift_x", "shift_y", "residual")))


@query(f"""WITH {FIT.replace("FROM fx_trees", "FROM (SELECT tree_id, x, y, lat, lon + 0.6075e0 AS lon FROM fx_trees)")}, ee AS (SELECT tree_id, 23.5915e0 + (x * 0.17e0 - y * 0.98e0) / 110800e0 AS lat, 114e0 + (y * 0.17e0 - x * 0.98e0) / 102000e0 AS lon FROM fx_trees) SELECT tree_id, lon >= 114 AS east_of_border, residual < 80 AND trees = count(*) OVER () AS good FROM ee, fit""")
def georeference_across_zones(spark, sf_dir):
    """Trees on both sides of a grid's border, all fitted, and placed on earth again within the fit's residual."""
    t = table(spark, sf_dir, "fx_trees").withColumn("lon", F.col("lon") + 0.6075)
    fit = mapping.georeference_fit(t)
    placed = mapping.georeference(t.select("tree_id", "x", "y", F.col("lat").alias("own_lat"), F.col("lon").alias("own_lon")), fit)
    off = F.sqrt(F.pow((F.col("lat") - F.col("own_lat")) * 110_800, 2) + F.pow((F.col("lon") - F.col("own_lon")) * 102_000, 2))
    n = F.count("*").over(Window.partitionBy())
    return placed.crossJoin(F.broadcast(fit.select("residual", "trees"))).select("tree_id", (F.col("own_lon") >= 114).alias("east_of_border"), ((off < 80) & (F.col("trees") == n)).alias("good"))


@query(f"WITH {FIT}, sp AS (SELECT min(d) AS least, avg(d) AS mean, max(d) AS most FROM (SELECT min(sqrt((p.x - q.x)**2 + (p.y - q.y)**2)) AS d FROM fx_trees p JOIN fx_trees q ON p.tree_id <> q.tree_id GROUP BY p.tree_id)), ex AS (SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM fx_trees) SELECT n, round(min_x, 4) AS min_x, round(max_x, 4) AS max_x, round(min_y, 4) AS min_y, round(max_y, 4) AS max_y, round(least, 4) AS least_spacing, round(mean, 4) AS mean_spacing, round(most, 4) AS most_spacing, round(turn, 4) AS turn, round(residual, 3) AS residual FROM fit, sp, ex")
def tree_map_report(spark, sf_dir):
    r = mapping.tree_map_report(table(spark, sf_dir, "fx_trees"))
    return r.select("n", *(F.round(c, 3 if c == "residual" else 4).alias(c) for c in r.columns if c != "n"))


@query("SELECT count(*) AS n, count(*) FILTER (point_id % 3 <> 0) AS live FROM fx_map")
def map_size(spark, sf_dir):
    return mapping.map_size(map_points(spark, sf_dir).withColumn("deleted", F.col("point_id") % 3 == 0))


@query("SELECT point_id FROM fx_map WHERE x >= -5 AND x < 5 AND y >= -5 AND y < 5 AND z >= -5 AND z < 5 AND point_id % 7 <> 0")
def removed_points(spark, sf_dir):
    m = map_points(spark, sf_dir).drop("label").withColumns({"deleted": F.lit(False), "downsampled": F.col("point_id") % 7 == 0})
    box = m.agg(F.lit(1).cast("long").alias("box_id"), *(F.lit(v).alias(f"{c}{i}") for c in "xyz" for i, v in ((0, -5.0), (1, 5.0))))
    return store.removed_points(store.delete_boxes(m, box)).select("point_id")


@query("WITH u AS (SELECT *, (point_id % 3 = 0)::INT AS is_new, floor(x / 2) AS cx, floor(y / 2) AS cy, floor(z / 2) AS cz FROM fx_map), r AS (SELECT *, max(is_new) OVER w AS touched, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY (x - (cx + 0.5) * 2)**2 + (y - (cy + 0.5) * 2)**2 + (z - (cz + 0.5) * 2)**2, is_new DESC, point_id) AS rank FROM u WINDOW w AS (PARTITION BY cx, cy, cz)) SELECT point_id, is_new FROM r WHERE (touched = 0 OR rank = 1) AND x >= -6 AND x < 8 AND y >= -7 AND y < 7 AND z >= -8 AND z < 6")
def maintain_map(spark, sf_dir):
    m = map_points(spark, sf_dir).drop("label")
    return mapping.maintain_map(m.where("point_id % 3 <> 0"), m.where("point_id % 3 = 0"), 2.0, (1.0, 0.0, -1.0), 14.0).select("point_id", "is_new")


TERMS = ["nx", "ny", "nz", "y * mz - z * my", "z * mx - x * mz", "x * my - y * mx"]


@query(f"WITH {POSES}, b AS (SELECT scan_id, x, y, z, x / 50 AS nx, y / 50 AS ny, z / 50 AS nz, intensity / 100 AS d, qw*qw - qz*qz AS c, 2 * qw * qz AS s, px, py, pz FROM fx_points JOIN o ON scan_id % 8 = vehicle_id), m AS (SELECT *, c * nx + s * ny AS mx, -s * nx + c * ny AS my, nz AS mz, nx * (c * x - s * y + px) + ny * (s * x + c * y + py) + nz * (z + pz) + d AS r FROM b) SELECT scan_id, count(*) AS n, round(sum(r * r), 3) AS cost, " + ", ".join(f"round(sum(({TERMS[i]}) * ({TERMS[j]})), 3) + 0 AS h{i}{j}" for i in range(6) for j in range(i, 6)) + ", " + ", ".join(f"round(sum(({TERMS[i]}) * r), 3) + 0 AS g{i}" for i in range(6)) + " FROM m GROUP BY 1")
def point_to_plane_normal_equations(spark, sf_dir):
    p = points(spark, sf_dir).select("scan_id", (F.col("scan_id") % 8).alias("vehicle_id"), "x", "y", "z", *((F.col(c) / 50).alias(f"n{c}") for c in "xyz"), (F.col("intensity") / 100).alias("d"))
    return rounded(mapping.point_to_plane_normal_equations(p.join(F.broadcast(poses(spark, sf_dir)), "vehicle_id")), 3)  # a row a vehicle, with which no scan is moved


def without_sql(f):
    """Registers a query that SQL can't express; tests hold it against plain Python."""
    QUERIES[f.__name__] = f
    return f


@without_sql
def umeyama_align(spark, sf_dir):
    from waypath.registry import fused

    return mapping.umeyama_align(fused(spark, sf_dir))


def runs(spark, sf_dir):
    """Inertial samples, scans of half a second and an initial state for each vehicle, from the messages."""
    imu = msgs(spark, sf_dir, "imu").select("vehicle_id", "seq", (F.col("t_us") / 1e6).alias("t"), (F.col("x") / 10).alias("ax"), (F.col("y") / 10).alias("ay"), (F.col("z") + 9.81).alias("az"), (F.col("std_x") / 10).alias("gx"), (F.col("std_y") / 10).alias("gy"), (F.col("qz") / 10).alias("gz"))
    scans = msgs(spark, sf_dir, "lio").groupBy("vehicle_id", F.floor(F.col("t_us") / 500_000).alias("scan_id")).agg((F.min("t_us") / 1e6).alias("beg"), (F.max("t_us") / 1e6).alias("end"))
    means = imu.groupBy("vehicle_id").agg(*(F.avg(c).alias(c) for c in ("ax", "ay", "az", "gx", "gy", "gz")))
    norm = F.sqrt(F.expr("ax * ax + ay * ay + az * az"))
    init = means.select("vehicle_id", *((-F.col(f"a{c}") / norm * 9.81).alias(f"gravity_{c}") for c in "xyz"), *(F.col(f"g{c}").alias(f"bias_{c}") for c in "xyz"), norm.alias("norm"))
    return imu, scans, init


@without_sql
def imu_propagate(spark, sf_dir):
    imu, scans, init = runs(spark, sf_dir)
    return motion.imu_propagate(imu.drop("seq"), scans, init)


@without_sql
def label_ring_features(spark, sf_dir):
    return features.label_ring_features(points(spark, sf_dir)).select("scan_id", "ring", "seq", "label")


@without_sql
def eskf_trajectory(spark, sf_dir):
    imu, _, init = runs(spark, sf_dir)
    fixes = msgs(spark, sf_dir, "rtk").select("vehicle_id", (F.col("t_us") / 1e6).alias("t"), "x", "y", "z", *((F.col(c) + 0.01).alias(n) for c, n in (("std_x", "sx"), ("std_y", "sy"), ("std_x", "sz"))))
    return filtering.eskf_trajectory(imu.drop("seq"), fixes, init, (-0.3, 0.45, 0.13)).select("vehicle_id", "t", "x", "y", "z", "sigma")


@without_sql
def scan_to_map_register(spark, sf_dir):
    """Every scan against the whole map, from poses at the origin."""
    from waypath.streaming.runs import shared_folder

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark, "rounds"))
    p = points(spark, sf_dir).select("scan_id", "seq", *((F.col(c) / 5).alias(c) for c in "xyz"))
    start = p.select("scan_id").distinct().select("scan_id", *(F.lit(0.0).alias(c) for c in ("px", "py", "pz", "qx", "qy", "qz")), F.lit(1.0).alias("qw"))
    return mapping.scan_to_map_register(p, start, map_points(spark, sf_dir), most=0.5)


@query("WITH d AS (SELECT *, (t_us - lag(t_us) OVER w) / 1e6 AS dt, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) AS step, atan2(sin(2 * atan2(qz, qw)), cos(2 * atan2(qz, qw))) AS yaw FROM fx_msgs WHERE topic = 'truth' WINDOW w AS (PARTITION BY vehicle_id ORDER BY t_us, seq)), g AS (SELECT vehicle_id, count(*) AS n, sum(step) AS length FROM d GROUP BY 1 HAVING count(*) >= 10), r AS (SELECT vehicle_id, dt, yaw - lag(yaw) OVER (PARTITION BY vehicle_id ORDER BY t_us, seq) AS dy FROM d), q AS (SELECT vehicle_id, abs((dy + pi() - 2 * pi() * floor((dy + pi()) / (2 * pi())) - pi()) / dt) AS rate FROM r WHERE dt >= 0.05), s AS (SELECT vehicle_id, count(*) AS n_rates, avg(rate) AS mean_rate FROM q WHERE rate < 3.0 GROUP BY 1) SELECT g.vehicle_id, n, round(length, 6) AS length, n_rates, round(mean_rate, 6) AS mean_rate FROM g LEFT JOIN s ON g.vehicle_id = s.vehicle_id")
def evaluate_navigation(spark, sf_dir):
    return rounded(trajectory.evaluate_navigation(msgs(spark, sf_dir, "truth")).select("vehicle_id", "n", "length", "n_rates", "mean_rate"))


def fused_rows(spark, sf_dir) -> dict:
    """x, y, z, fx, fy, fz of each vehicle's fused positions, as arrays: for tests."""
    import numpy as np

    from waypath.registry import fused

    out: dict = {}
    for r in fused(spark, sf_dir).collect():
        out.setdefault(r.vehicle_id, []).append((r.x, r.y, r.z, r.fx, r.fy, r.fz))
    return {k: np.array(v) for k, v in out.items()}


@query(f"""WITH p AS (SELECT *, coalesce(max(seq % 17 = 5) OVER (PARTITION BY device ORDER BY seq), FALSE) AS dual FROM fx_packets), v AS (SELECT * FROM p WHERE len(list_filter(range(12), lambda b: substr(packet_hex, (b * 200 + 1)::INT, 4) = 'FFEE')) = 12),
 b AS (SELECT *, {PACKET.format("b * 200 + 4")} AS az FROM (SELECT *, unnest(range(12))::INT AS b FROM v)),
 s AS (SELECT *, CASE WHEN dual THEN CASE WHEN b < 10 THEN lead(az, 2) OVER w - az ELSE az - lag(az, 2) OVER w END ELSE CASE WHEN b < 11 THEN lead(az) OVER w - az ELSE az - lag(az) OVER w END END AS st FROM b WINDOW w AS (PARTITION BY device, seq ORDER BY b)),
 f AS (SELECT *, unnest(range(32))::INT AS k, CASE WHEN st < 0 THEN st + 36000 ELSE st END AS step FROM s) SELECT device, seq, b AS block, k AS laser, (az + (k * step) // 32) % 36000 AS azimuth FROM f""")
def dual_return_azimuths(spark, sf_dir):
    p = packets_of(spark, sf_dir)
    mode = scans.return_mode(p.select("device", "seq", F.when(F.col("seq") % 17 == 5, 0x39).otherwise(0).alias("factory")))
    return packets.firings(p.join(mode, ["device", "seq"])).select("device", "seq", "block", "laser", "azimuth")


@query("WITH s AS (SELECT vehicle_id, seq AS scan_id, t_us AS beg_us FROM fx_msgs WHERE topic = 'lio'), i AS (SELECT vehicle_id, seq, t_us FROM fx_msgs WHERE topic = 'imu') SELECT s.vehicle_id, scan_id, i.seq AS imu_seq, FALSE AS first FROM s JOIN i ON s.vehicle_id = i.vehicle_id AND t_us BETWEEN beg_us AND beg_us + 500000 UNION ALL SELECT s.vehicle_id, scan_id, arg_max(i.seq, (t_us, i.seq)), TRUE FROM s JOIN i ON s.vehicle_id = i.vehicle_id AND t_us < beg_us GROUP BY 1, 2")
def scan_imu_groups(spark, sf_dir):
    lio = msgs(spark, sf_dir, "lio").select("vehicle_id", F.col("seq").alias("scan_id"), F.col("t_us").alias("beg_us"), (F.col("t_us") + 500_000).alias("end_us"))
    return scans.scan_groups(lio, msgs(spark, sf_dir, "imu").select("vehicle_id", "seq", "t_us")).select("vehicle_id", "scan_id", "imu_seq", "first")


@query("WITH c AS (SELECT floor((x + 79.5017) / 0.5)::INT AS ix, floor((y + 8.40812) / 0.5)::INT AS iy, count(*) AS hits FROM fx_points GROUP BY 1, 2), m AS (SELECT *, hits / (max(hits) OVER ())::DOUBLE AS p FROM c) SELECT ix, iy, CASE WHEN p > 0.65e0 THEN 'occupied' WHEN p < 0.196e0 THEN 'free' ELSE 'unknown' END AS class FROM m")
def occupancy_classes(spark, sf_dir):
    cells = spatial.occupancy_raster(points(spark, sf_dir), 0.5, (-79.5017, -8.40812))
    most = cells.agg(F.max("hits").alias("most"))
    return spatial.occupancy_classes(cells.crossJoin(F.broadcast(most)).withColumn("p", F.col("hits") / F.col("most"))).select("ix", "iy", "class")  # one row


@query("SELECT vehicle_id, seq, round(sqrt(std_x**2 + std_y**2), 6) AS std FROM fx_msgs WHERE topic = 'rtk'")
def unpack_covariance(spark, sf_dir):
    c = F.array(*(F.col("std_x") ** 2 if i == 0 else F.col("std_y") ** 2 if i == 7 else F.lit(0.0) for i in range(36)))
    return rounded(trajectory.unpack_covariance(msgs(spark, sf_dir, "rtk").withColumn("covariance", c)).select("vehicle_id", "seq", "std"))
