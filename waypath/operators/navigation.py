"""Navigation sentences to poses: quality, map origin, heading, covariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.functions.geodesy import with_grid
from waypath.functions.pose import yaw_to_quat
from waypath.operators.gnss import heading_to_yaw, located, parse_nmea

#: By mode: standard deviations before any is received, turn added to the heading (degrees), variance of a known heading.
MODES = {"local": ((1.0, 1.0, 2.0), 90 - 3.75, 0.01), "absolute": ((0.01, 0.01, 0.02), 0.0, 1e-6)}
ORIGIN = ("lat", "lon", "alt", "utm_zone", "utm_x", "utm_y", "utm_z")


def fix_quality_gate(fixes: DataFrame, least: int = 1) -> DataFrame:
    """Fixes of at least that quality; 0 is none, and an origin needs 4."""
    return fixes.where(F.col("quality") >= least)


def position_covariance(sigmas: tuple[Column, Column, Column], size: int = 36, heading: Column | None = None, turn: float = 0.01) -> Column:
    """Row-major covariance of size numbers (9 or 36): variances of the three axes on the diagonal, and of a known heading at the end."""
    at = {i * (4 if size == 9 else 7): s * s for i, s in enumerate(sigmas)}
    if size == 36 and heading is not None:
        at[35] = F.when(heading.isNotNull(), turn).otherwise(0.0)
    return F.array(*(at.get(i, F.lit(0.0)) for i in range(size)))


def fixes_of(lines: DataFrame, mode: str = "local") -> DataFrame:
    """lines (vehicle_id, seq, recv_us, sentence) to a fix for each position, with the state received before it and grid coordinates (null out of range)."""
    sigmas, _, _ = MODES[mode]
    state = dict(zip(("sigma_lat", "sigma_lon", "sigma_alt"), sigmas))
    rows = with_grid(located(lines, state))
    zone = F.concat(F.col("zone").cast("string"), F.when(F.col("north"), " N").otherwise(" S"))
    return rows.select("vehicle_id", "seq", "recv_us", "lat", "lon", "alt", "quality", *state, "heading", zone.alias("utm_zone"), F.col("grid_x").alias("utm_x"), F.col("grid_y").alias("utm_y"), F.col("alt").alias("utm_z"))


def map_origins(fixes: DataFrame) -> DataFrame:
    """(vehicle_id, origin_us, origin_seq, ORIGIN): each run's first fix of quality 4 or more."""
    first = fix_quality_gate(fixes, 4).where("abs(lat) <= 90 and lon is not null").groupBy("vehicle_id").agg(F.min(F.struct(F.col("recv_us").alias("origin_us"), F.col("seq").alias("origin_seq"), *ORIGIN)).alias("o"))
    return first.select("vehicle_id", "o.*")


def write_map_origin(origins: DataFrame, path: str) -> None:
    """One row a run; numbers keep six decimals."""
    origins.select("vehicle_id", *(F.round(c, 6).alias(c) if c != "utm_zone" else c for c in ORIGIN)).write.mode("overwrite").parquet(path)


def read_map_origin(spark: SparkSession, path: str) -> DataFrame:
    """Origins that hold for whole runs, from before their first fix."""
    return spark.read.parquet(path).withColumns({"origin_us": F.lit(None).cast("long"), "origin_seq": F.lit(None).cast("long")})


def gnss_to_odometry(lines: DataFrame, mode: str = "local", origins: DataFrame | None = None) -> DataFrame:
    """Poses from navigation sentences: vehicle_id, seq, recv_us, x, y, z, qx..qw, covariance (36).

    local: relative to the run's origin (the first fix of quality 4 or more, or what `origins` holds); fixes before it, and runs without
    one, have no pose. absolute: grid coordinates. Fixes of quality 0 or out of the grid's range have none in either. Without a heading the
    orientation is the identity.
    """
    _, bias, turn = MODES[mode]
    fixes = fixes_of(lines, mode)
    rows = fix_quality_gate(fixes).where("abs(lat) <= 90 and lon is not null")
    if mode == "local":
        o = (map_origins(fixes) if origins is None else origins).select("vehicle_id", "origin_us", "origin_seq", *(F.col(f"utm_{c}").alias(f"o{c}") for c in "xyz"))
        rows = rows.join(o, "vehicle_id").where("origin_us is null or recv_us > origin_us or recv_us = origin_us and seq >= origin_seq")
    else:
        rows = rows.withColumns({f"o{c}": F.lit(0.0) for c in "xyz"})
    yaw = F.radians(heading_to_yaw(F.col("heading"), bias))
    pose = [F.coalesce(q, F.lit(d)).alias(f"q{c}") for q, d, c in zip(yaw_to_quat(yaw), (0.0, 0.0, 0.0, 1.0), "xyzw")]
    covariance = position_covariance(tuple(F.col(f"sigma_{a}") for a in ("lat", "lon", "alt")), 36, F.col("heading"), turn)
    return rows.select("vehicle_id", "seq", "recv_us", *((F.col(f"utm_{c}") - F.col(f"o{c}")).alias(c) for c in "xyz"), *pose, covariance.alias("covariance"))


def heading_rows(lines: DataFrame) -> DataFrame:
    """A row for each heading sentence: yaw (degrees, without bias) and its quaternion."""
    rows = parse_nmea(lines).where("heading is not null").withColumn("yaw", heading_to_yaw(F.col("heading")))
    return rows.select("vehicle_id", "seq", "recv_us", "heading", "yaw", *(q.alias(f"q{c}") for q, c in zip(yaw_to_quat(F.radians("yaw")), "xyzw")))
