"""Tables of sensor records shaped from the driver's tables, in Spark's dialect and DuckDB's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "fx_msgs": r"""
SELECT e.user_id % 8 AS vehicle_id, e.event_id AS seq,
 CASE e.event_type WHEN 'click' THEN 'truth' WHEN 'view' THEN 'rtk' WHEN 'purchase' THEN 'lio' WHEN 'error' THEN 'imu' ELSE 'nmea' END AS topic,
 CAST(floor((unix_micros(CAST(e.ts AS TIMESTAMP)) - 1704067200000000) / 86400e0) AS BIGINT) AS t_us,
 CAST(get_json_object(e.props,'$.k') AS INT) AS k,
 e.value / 10e0 AS x, CAST(get_json_object(e.props,'$.k') AS INT) / 4e0 AS y, (e.user_id % 5) / 10e0 AS z,
 CAST(0 AS DOUBLE) AS qx, CAST(0 AS DOUBLE) AS qy,
 sin(radians(CAST(get_json_object(e.props,'$.k') AS INT) * 3.6e0 - 180e0) / 2) AS qz, cos(radians(CAST(get_json_object(e.props,'$.k') AS INT) * 3.6e0 - 180e0) / 2) AS qw,
 (e.event_id % 97) / 60e0 AS std_x, (e.event_id % 89) / 80e0 AS std_y
FROM events e
""",
    "fx_points": r"""
SELECT l_orderkey % 200 AS scan_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS seq,
 l_linenumber AS ring, l_quantity - 25e0 AS x, (l_partkey % 2000) / 40e0 - 25e0 AS y, l_tax * 50e0 - 2e0 AS z,
 l_discount * 1000e0 AS intensity, (l_suppkey % 100) / 1000e0 AS time_s,
 CAST(l_partkey % 64 AS INT) AS tag
FROM lineitem
""",
    "fx_map": r"""
SELECT vec_id AS point_id, label, CAST(embedding[0] AS DOUBLE) * 10e0 AS x, CAST(embedding[1] AS DOUBLE) * 10e0 AS y, CAST(embedding[2] AS DOUBLE) * 10e0 AS z FROM embeddings
""",
    "fx_trees": r"""
SELECT point_id AS tree_id, x, y, 23.5915e0 + (x * 0.17e0 - y * 0.98e0) / 110800e0 AS lat, 113.3925e0 + (y * 0.17e0 - x * 0.98e0) / 102000e0 AS lon FROM (SELECT vec_id AS point_id, CAST(embedding[0] AS DOUBLE) * 10e0 AS x, CAST(embedding[1] AS DOUBLE) * 10e0 AS y FROM embeddings) t
""",
    "fx_nmea": r"""
SELECT e.user_id % 8 AS vehicle_id, e.event_id AS seq, CAST(floor((unix_micros(CAST(e.ts AS TIMESTAMP)) - 1704067200000000) / 86400e0) AS BIGINT) AS recv_us,
 CASE CAST(get_json_object(e.props,'$.k') AS INT) % 4
 WHEN 0 THEN concat('$GNGGA,120000.00,23', lpad(CAST(e.event_id % 60 AS VARCHAR(9)),2,'0'), '.', lpad(CAST(e.event_id % 10000 AS VARCHAR(9)),4,'0'), ',N,113', lpad(CAST(e.user_id % 60 AS VARCHAR(9)),2,'0'), '.', lpad(CAST((e.event_id * 7) % 10000 AS VARCHAR(9)),4,'0'), ',E,', CAST(e.event_id % 6 AS VARCHAR(9)), ',12,0.8,', CAST(e.event_id % 50 AS VARCHAR(9)), '.5,M,-3.0,M,,*5A')
 WHEN 1 THEN concat('$GNGST,120000.00,,,,,0.', lpad(CAST(e.event_id % 100 AS VARCHAR(9)),2,'0'), ',0.', lpad(CAST(e.user_id % 100 AS VARCHAR(9)),2,'0'), ',0.05*41')
 WHEN 2 THEN concat('$GNGSA,A,3,01,02,03,', CASE WHEN e.event_id % 2 = 0 THEN '04' ELSE '' END, ',,,,,,,,,1.5,0.9,1.2*2C')
 ELSE concat('$GNHDT,', CAST(e.event_id % 360 AS VARCHAR(9)), '.25,T*1B') END AS sentence
FROM events e
""",
    "fx_imu_frames": r"""
WITH b AS (SELECT e.user_id % 8 AS vehicle_id, e.event_id AS seq, CAST(floor((unix_micros(CAST(e.ts AS TIMESTAMP)) - 1704067200000000) / 86400e0) AS BIGINT) AS recv_us,
 CASE CAST(get_json_object(e.props,'$.k') AS INT) % 3 WHEN 0 THEN 81 WHEN 1 THEN 82 ELSE 89 END AS ty, e.event_id % 256 AS lo, e.user_id % 256 AS hi, CASE WHEN e.event_id % 11 = 0 THEN 1 ELSE 0 END AS bad FROM events e)
SELECT vehicle_id, seq, recv_us, concat('55', lpad(hex(CAST(ty AS BIGINT)),2,'0'), lpad(hex(CAST(lo AS BIGINT)),2,'0'), lpad(hex(CAST(hi AS BIGINT)),2,'0'), lpad(hex(CAST(lo AS BIGINT)),2,'0'), lpad(hex(CAST(hi AS BIGINT)),2,'0'), lpad(hex(CAST(lo AS BIGINT)),2,'0'), lpad(hex(CAST(hi AS BIGINT)),2,'0'), lpad(hex(CAST(lo AS BIGINT)),2,'0'), lpad(hex(CAST(hi AS BIGINT)),2,'0'), lpad(hex(CAST((85 + ty + 4*lo + 4*hi + bad) % 256 AS BIGINT)),2,'0')) AS frame_hex FROM b
""",
    "fx_packets": r"""
WITH e AS (SELECT user_id % 8 AS device, event_id, ts, CAST(floor((unix_micros(CAST(e.ts AS TIMESTAMP)) - 1704067200000000) / 86400e0) AS BIGINT) AS stamp_us FROM events e),
 n AS (SELECT device, stamp_us DIV 100000 AS part, count(*) AS own FROM e GROUP BY ALL),
 u AS (SELECT device, part, sum(own) OVER (PARTITION BY device ORDER BY part) - own AS upto FROM n),
 r AS (SELECT e.device, event_id, stamp_us, CAST(upto + row_number() OVER (PARTITION BY e.device, part ORDER BY ts, event_id) - 1 AS BIGINT) AS rn FROM e JOIN u ON e.device <=> u.device AND stamp_us DIV 100000 <=> part),
 b AS (SELECT device, CAST(floor(rn / 12e0) AS BIGINT) AS seq, CAST(rn % 12 AS INT) AS blk, stamp_us, CAST((rn * 400) % 36000 AS INT) AS az, CAST(100 + event_id % 30000 AS INT) AS d, CAST(event_id % 256 AS INT) AS inten FROM r),
 h AS (SELECT device, seq, max(stamp_us) AS stamp_us, array_sort(collect_list(struct(blk, az, d, inten))) AS blocks FROM b GROUP BY device, seq HAVING count(*) = 12)
SELECT device, seq, stamp_us, concat(array_join(transform(blocks, s -> concat(CASE WHEN seq % 13 = 12 AND s.blk = 5 THEN 'FFED' ELSE 'FFEE' END, lpad(hex(CAST(s.az % 256 AS BIGINT)),2,'0'), lpad(hex(CAST(floor(s.az / 256e0) AS BIGINT)),2,'0'),
  repeat(concat(lpad(hex(CAST(s.d % 256 AS BIGINT)),2,'0'), lpad(hex(CAST(floor(s.d / 256e0) AS BIGINT)),2,'0'), lpad(hex(CAST(s.inten AS BIGINT)),2,'0')), 32))),''), '000000003700') AS packet_hex FROM h
""",
}

DUCKDB = {
    "fx_msgs": r"""
SELECT e.user_id % 8 AS vehicle_id, e.event_id AS seq,
 CASE e.event_type WHEN 'click' THEN 'truth' WHEN 'view' THEN 'rtk' WHEN 'purchase' THEN 'lio' WHEN 'error' THEN 'imu' ELSE 'nmea' END AS topic,
 CAST(floor((epoch_us(e.ts) - 1704067200000000) / 86400e0) AS BIGINT) AS t_us,
 CAST(json_extract_string(e.props,'$.k') AS INT) AS k,
 e.value / 10e0 AS x, CAST(json_extract_string(e.props,'$.k') AS INT) / 4e0 AS y, (e.user_id % 5) / 10e0 AS z,
 CAST(0 AS DOUBLE) AS qx, CAST(0 AS DOUBLE) AS qy,
 sin(radians(CAST(json_extract_string(e.props,'$.k') AS INT) * 3.6e0 - 180e0) / 2) AS qz, cos(radians(CAST(json_extract_string(e.props,'$.k') AS INT) * 3.6e0 - 180e0) / 2) AS qw,
 (e.event_id % 97) / 60e0 AS std_x, (e.event_id % 89) / 80e0 AS std_y
FROM events e
""",
    "fx_points": r"""
SELECT l_orderkey % 200 AS scan_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS BIGINT) AS seq,
 l_linenumber AS ring, l_quantity - 25e0 AS x, (l_partkey % 2000) / 40e0 - 25e0 AS y, l_tax * 50e0 - 2e0 AS z,
 l_discount * 1000e0 AS intensity, (l_suppkey % 100) / 1000e0 AS time_s,
 CAST(l_partkey % 64 AS INT) AS tag
FROM lineitem
""",
    "fx_map": r"""
SELECT vec_id AS point_id, label, CAST(embedding[1] AS DOUBLE) * 10e0 AS x, CAST(embedding[2] AS DOUBLE) * 10e0 AS y, CAST(embedding[3] AS DOUBLE) * 10e0 AS z FROM embeddings
""",
    "fx_trees": r"""
SELECT point_id AS tree_id, x, y, 23.5915e0 + (x * 0.17e0 - y * 0.98e0) / 110800e0 AS lat, 113.3925e0 + (y * 0.17e0 - x * 0.98e0) / 102000e0 AS lon FROM (SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) * 10e0 AS x, CAST(embedding[2] AS DOUBLE) * 10e0 AS y FROM embeddings) t
""",
    "fx_nmea": r"""
SELECT e.user_id % 8 AS vehicle_id, e.event_id AS seq, CAST(floor((epoch_us(e.ts) - 1704067200000000) / 86400e0) AS BIGINT) AS recv_us,
 CASE CAST(json_extract_string(e.props,'$.k') AS INT) % 4
 WHEN 0 THEN concat('$GNGGA,120000.00,23', lpad(CAST(e.event_id % 60 AS VARCHAR(9)),2,'0'), '.', lpad(CAST(e.event_id % 10000 AS VARCHAR(9)),4,'0'), ',N,113', lpad(CAST(e.user_id % 60 AS VARCHAR(9)),2,'0'), '.', lpad(CAST((e.event_id * 7) % 10000 AS VARCHAR(9)),4,'0'), ',E,', CAST(e.event_id % 6 AS VARCHAR(9)), ',12,0.8,', CAST(e.event_id % 50 AS VARCHAR(9)), '.5,M,-3.0,M,,*5A')
 WHEN 1 THEN concat('$GNGST,120000.00,,,,,0.', lpad(CAST(e.event_id % 100 AS VARCHAR(9)),2,'0'), ',0.', lpad(CAST(e.user_id % 100 AS VARCHAR(9)),2,'0'), ',0.05*41')
 WHEN 2 THEN concat('$GNGSA,A,3,01,02,03,', CASE WHEN e.event_id % 2 = 0 THEN '04' ELSE '' END, ',,,,,,,,,1.5,0.9,1.2*2C')
 ELSE concat('$GNHDT,', CAST(e.event_id % 360 AS VARCHAR(9)), '.25,T*1B') END AS sentence
FROM events e
""",
    "fx_imu_frames": r"""
WITH b AS (SELECT e.user_id % 8 AS vehicle_id, e.event_id AS seq, CAST(floor((epoch_us(e.ts) - 1704067200000000) / 86400e0) AS BIGINT) AS recv_us,
 CASE CAST(json_extract_string(e.props,'$.k') AS INT) % 3 WHEN 0 THEN 81 WHEN 1 THEN 82 ELSE 89 END AS ty, e.event_id % 256 AS lo, e.user_id % 256 AS hi, CASE WHEN e.event_id % 11 = 0 THEN 1 ELSE 0 END AS bad FROM events e)
SELECT vehicle_id, seq, recv_us, concat('55', lpad(to_hex(CAST(ty AS BIGINT)),2,'0'), lpad(to_hex(CAST(lo AS BIGINT)),2,'0'), lpad(to_hex(CAST(hi AS BIGINT)),2,'0'), lpad(to_hex(CAST(lo AS BIGINT)),2,'0'), lpad(to_hex(CAST(hi AS BIGINT)),2,'0'), lpad(to_hex(CAST(lo AS BIGINT)),2,'0'), lpad(to_hex(CAST(hi AS BIGINT)),2,'0'), lpad(to_hex(CAST(lo AS BIGINT)),2,'0'), lpad(to_hex(CAST(hi AS BIGINT)),2,'0'), lpad(to_hex(CAST((85 + ty + 4*lo + 4*hi + bad) % 256 AS BIGINT)),2,'0')) AS frame_hex FROM b
""",
    "fx_packets": r"""
WITH r AS (SELECT user_id % 8 AS device, event_id, CAST(floor((epoch_us(e.ts) - 1704067200000000) / 86400e0) AS BIGINT) AS stamp_us, CAST(row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) - 1 AS BIGINT) AS rn FROM events e),
 b AS (SELECT device, CAST(floor(rn / 12e0) AS BIGINT) AS seq, rn % 12 AS blk, stamp_us, (rn * 400) % 36000 AS az, 100 + event_id % 30000 AS d, event_id % 256 AS inten FROM r),
 h AS (SELECT device, seq, blk, stamp_us, concat(CASE WHEN seq % 13 = 12 AND blk = 5 THEN 'FFED' ELSE 'FFEE' END, lpad(to_hex(CAST(az % 256 AS BIGINT)),2,'0'), lpad(to_hex(CAST(CAST(floor(az / 256e0) AS BIGINT) AS BIGINT)),2,'0'), repeat(concat(lpad(to_hex(CAST(d % 256 AS BIGINT)),2,'0'), lpad(to_hex(CAST(CAST(floor(d / 256e0) AS BIGINT) AS BIGINT)),2,'0'), lpad(to_hex(CAST(inten AS BIGINT)),2,'0')), 32)) AS hx FROM b)
SELECT device, seq, max(stamp_us) AS stamp_us, concat(string_agg(hx,'' ORDER BY blk), '000000003700') AS packet_hex FROM h GROUP BY device, seq HAVING count(*) = 12
""",
}

#: Reads of a serial line: frames with garbage and false headers before some, cut within frames.
READS = r"""
WITH s AS (SELECT vehicle_id, recv_us, row_number() OVER (PARTITION BY vehicle_id ORDER BY recv_us, seq) AS seq, concat(CASE seq % 7 WHEN 0 THEN '5501' WHEN 3 THEN '55' WHEN 5 THEN '0A55510B' ELSE '' END, frame_hex) AS hx, CAST(2 * (seq % 11) AS INT) AS cut FROM ({frames}))
SELECT vehicle_id, CAST(seq AS BIGINT) AS seq, recv_us, concat(coalesce(lag(substr(hx, cut + 1)) OVER (PARTITION BY vehicle_id ORDER BY seq), ''), substr(hx, 1, cut)) AS read_hex FROM s
"""
for _dialect in (SPARK, DUCKDB):
    _dialect["fx_imu_reads"] = READS.replace("{frames}", _dialect["fx_imu_frames"].strip())

#: The table that each is made from.
SOURCE = {"fx_points": "lineitem", "fx_map": "embeddings", "fx_trees": "embeddings"}


def table_of(spark: SparkSession, name: str, src: DataFrame) -> DataFrame:
    """The table made from rows of its source."""
    source = SOURCE.get(name, "events")
    return spark.sql(SPARK[name].replace(f"FROM {source}", "FROM {src}", 1), src=src)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table_of(spark, name, spark.read.parquet(f"{sf_dir}/{SOURCE.get(name, 'events')}.parquet"))


def with_tables(sql: str) -> str:
    """DuckDB SQL with the tables that it names in front."""
    own = [f"{n} AS ({q.strip()})" for n, q in DUCKDB.items() if n in sql]
    if not own:
        return sql
    head, rest = "WITH", sql.lstrip()
    if rest.upper().startswith("WITH RECURSIVE "):
        head, rest = "WITH RECURSIVE", f"WITH {rest[15:]}"
    return f"{head} {', '.join(own)} {',' if rest.upper().startswith('WITH ') else ''} {rest[5:] if rest.upper().startswith('WITH ') else rest}"
