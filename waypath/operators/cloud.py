"""Cleaning of laser scans. Points carry scan_id, seq (unique in a scan), ring, x, y, z."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_scan():
    return Window.partitionBy("scan_id").orderBy("seq")


def drop_nonfinite(points: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in "xyz":
        ok &= ~F.isnan(c) & (F.abs(c) < math.inf)
    return points.where(ok)


def relative_point_time(points: DataFrame, header_s: Column) -> DataFrame:
    """Absolute times become relative to the header; below 0 is 0, over 0.2 is 0.1."""
    t = F.when(F.col("time_s") > 1e9, F.col("time_s") - header_s).otherwise(F.col("time_s"))
    return points.withColumn("time_s", F.when(t < 0, 0.0).when(t > 0.2, 0.1).otherwise(t))


def inside(box: tuple[float, ...]) -> Column:
    x0, x1, y0, y1, z0, z1 = box
    return (F.col("x") > x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") < y1) & (F.col("z") > z0) & (F.col("z") < z1)


def self_filter_bbox(points: DataFrame, box: tuple[float, ...]) -> DataFrame:
    return points.where(~inside(box))


def range2() -> Column:
    return F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")


def blind_range_filter(points: DataFrame, blind: float, vendor: str = "velodyne") -> DataFrame:
    """Strictly beyond the blind range; for ouster and sim the range itself stays."""
    return points.where(range2() >= blind * blind if vendor in ("ouster", "sim") else range2() > blind * blind)


def ring_filter(points: DataFrame, n_scans: int) -> DataFrame:
    return points.where(F.col("ring") < n_scans)


def return_tag_filter(points: DataFrame) -> DataFrame:
    return points.where(F.col("tag").bitwiseAND(0x30).isin(0, 16))


def decimate(points: DataFrame, n: int, basis: str = "raw") -> DataFrame:
    """Every n-th point: by raw index, or by the running count of the points that are left."""
    if basis == "raw":
        return points.where(F.col("seq") % n == 0)
    return points.withColumn("_i", F.row_number().over(by_scan())).where(F.col("_i") % n == 0).drop("_i")


def drop_consecutive_duplicates(points: DataFrame, kept: Column, eps: float = 1e-7) -> DataFrame:
    """Of the rows where kept holds, those that differ from the slot before; a slot not kept counts as zeros."""
    before = [F.lag(F.when(kept, F.col(c)).otherwise(0.0), 1, 0.0).over(by_scan()) for c in "xyz"]
    moved = F.lit(False)
    for c, b in zip("xyz", before):
        moved |= F.abs(F.col(c) - b) > eps
    return points.withColumn("_moved", moved).where(kept & F.col("_moved")).drop("_moved")


def clean_scan(points: DataFrame, n: int = 2, blind: float = 2.0, box: tuple[float, ...] | None = None) -> DataFrame:
    """Spinning-scanner order: self filter, raw index, blind range; time in milliseconds."""
    points = self_filter_bbox(points, box) if box else points
    return blind_range_filter(decimate(points, n), blind).withColumn("t_ms", F.col("time_s") * 1e3)


def ring_geometry(points: DataFrame, squared: bool = True) -> DataFrame:
    """Planar range, and distance to the next point of the ring (squared for spinning scanners)."""
    w = Window.partitionBy("scan_id", "ring").orderBy("seq")
    d = sum((F.lead(c).over(w) - F.col(c)) ** 2 for c in "xyz")
    return points.withColumns({"planar": F.sqrt(F.col("x") ** 2 + F.col("y") ** 2), "gap": d if squared else F.sqrt(d)})


def azimuth_sector_mask(points: DataFrame, low: int, high: int, azimuth: str = "azimuth") -> DataFrame:
    """Drops a sector of hundredths of degrees, which may pass north."""
    low, high, a = low % 36000, high % 36000, F.col(azimuth)
    return points.where(~((a > low) & (a < high)) if low <= high else ~((a > low) | (a < high)))


def sweep_segment(points: DataFrame, least: int = 65) -> DataFrame:
    """points (device, seq, azimuth) with a sweep number: a new one where azimuth falls by over 350 degrees.

    The partial first sweep and sweeps of fewer points than `least` go.
    """
    w = Window.partitionBy("device").orderBy("seq")
    rows = points.withColumn("_new", (F.lag("azimuth").over(w) - F.col("azimuth") > 35000).cast("int"))
    rows = rows.withColumn("sweep", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    size = rows.where("sweep > 0").groupBy("device", "sweep").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return rows.join(size, ["device", "sweep"], "left_semi")
