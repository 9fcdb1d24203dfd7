"""Points of several makers on one schema, and their cleaning in each maker's own order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.operators.cloud import blind_range_filter, decimate, drop_consecutive_duplicates, drop_nonfinite, inside, relative_point_time, return_tag_filter, ring_filter, self_filter_bbox

#: Milliseconds in each unit of time; any other counts as milliseconds.
SCALE = {"SEC": 1e3, "MS": 1.0, "US": 1e-3, "NS": 1e-6}
#: Fixed column names by maker: what holds intensity, ring and time; whose intensities and times are always in the unit given.
COLUMNS = {"livox": ("reflectivity", "line", "offset_time"), "velodyne": ("intensity", "ring", "time"), "ouster": ("intensity", "ring", "t"), "leishen": ("intensity", "ring", "time"), "sim": ("intensity", None, None)}
#: Columns that filters need later.
KEPT = ("tag",)


def normalize_points(points: DataFrame, maker: str, unit: str = "SEC") -> DataFrame:
    """scan_id, seq, ring, x, y, z, intensity, t_ms (and tag where there is one) of a maker's points.

    livox times are nanoseconds whatever the unit; simulated points have ring 0 and time 0.
    """
    intensity, ring, time = COLUMNS[maker]
    scale = 1e-6 if maker == "livox" else SCALE.get(unit.upper(), 1.0)
    t = F.lit(0.0) if time is None else F.col(time).cast("double") * scale
    at = F.lit(0) if ring is None else F.col(ring).cast("int")
    kept = [c for c in KEPT if c in points.columns]
    return points.select("scan_id", "seq", at.alias("ring"), *(F.col(c).cast("double").alias(c) for c in "xyz"), F.col(intensity).cast("double").alias("intensity"), t.alias("t_ms"), *kept)


def clean_vendor_scan(points: DataFrame, maker: str, n: int = 2, blind: float = 2.0, box: tuple[float, ...] | None = None, n_scans: int = 6, eps: float = 1e-7) -> DataFrame:
    """Normalised points cleaned in the maker's order.

    livox: point 0 is never read; lines, return tags and the box come before counting, every n-th of those left is a slot, and a slot
    equal to the one right before it in the raw order (zeros where that was left out) goes. ouster, velodyne: box, raw index, blind range
    (whose edge stays for ouster). sim: box and blind range only.
    """
    if maker == "livox":
        usable = (F.col("seq") > 0) & (F.col("ring") < n_scans) & F.col("tag").bitwiseAND(0x30).isin(0, 16)
        slots = decimate(points.where(usable & ~inside(box) if box else usable), n, "valid").select("scan_id", "seq", F.lit(True).alias("_slot"))
        rows = points.join(slots, ["scan_id", "seq"], "left").withColumn("_slot", F.coalesce("_slot", F.lit(False)))
        return blind_range_filter(drop_consecutive_duplicates(rows, F.col("_slot"), eps).drop("_slot"), blind, maker)
    points = self_filter_bbox(points, box) if box else points
    return blind_range_filter(points if maker == "sim" else decimate(points, n), blind, maker)


def convert_vendor_cloud(points: DataFrame, header_s: Column) -> DataFrame:
    """Finite points with times relative to the header's."""
    return relative_point_time(drop_nonfinite(points), header_s)


def feature_input(points: DataFrame, n_scans: int = 6) -> DataFrame:
    """livox points for feature labels: by line and return tag, without decimation."""
    return return_tag_filter(ring_filter(points, n_scans))
