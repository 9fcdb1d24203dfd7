"""Scanner packets to points: device status, sweeps, calibration, ring angles, coordinates, and the planar scan of one ring."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.functions.binary import i16be, u32le
from waypath.operators.asof import last_seen, running_sum
from waypath.operators.automaton import finite_scan
from waypath.operators.cloud import azimuth_sector_mask
from waypath.operators.packets import BLOCKS, FIRINGS, SPAN, batches_of, with_gap

#: Fixed values of the devices: vertical angles in degrees by laser.
VERTICAL = {
    "c16_1": (-10, 0.665, -8.665, 2, -7.33, 3.33, -6, 4.665, -4.665, 6, -3.33, 7.33, -2, 8.665, -0.665, 10),
    "c16_2": (-15, 1, -13, 3, -11, 5, -9, 7, -7, 9, -5, 11, -3, 13, -1, 15),
    "c32_1": (-18, -1, -15, -0.66, -12, -0.33, -10, 0, -8, 0.33, -7, 0.66, -6, 1, -5, 1.33, -4, 1.66, -3.33, 2, -3, 3, -2.66, 4, -2.33, 6, -2, 8, -1.66, 11, -1.33, 14),
    "c32_1_26": (-18, -15, -12, -10, -8, -7, -6, -5, -4, -3.33, -2.66, -3, -2.33, -2, -1.33, -1.66, -1, -0.66, 0, -0.33, 0.33, 0.66, 1.33, 1, 1.66, 2, 3, 4, 6, 8, 11, 14),
    "c32_2": (-16, 0, -15, 1, -14, 2, -13, 3, -12, 4, -11, 5, -10, 6, -9, 7, -8, 8, -7, 9, -6, 10, -5, 11, -4, 12, -3, 13, -2, 14, -1, 15),
    "c32_2_26": tuple(range(-16, 16)),
}
#: Radius (metres) and angle (degrees) of the beam's origin, by lasers of the device.
ORIGIN = {16: (0.04319, 14.68), 32: (0.0494, 12.98)}
#: The correction (and its sign) that each laser takes, by model and firmware.
CORRECTION = {
    ("c32_1", 3): {(3, 1): (0, 1, 4, 8, 9, 12, 16, 17, 21, 24, 25, 29), (2, 1): (2, 3, 6, 10, 11, 14, 18, 19, 23, 26, 27, 31), (1, 1): (5, 13, 20, 28), (0, 1): (7, 15, 22, 30)},
    ("c32_1", 2): {(0, 1): (10, 14, 18, 22), (0, -1): (11, 15, 19, 23), (1, 1): (0, 2, 4, 6, 8, 12, 16, 20, 24, 26, 28, 30), (1, -1): (1, 3, 5, 7, 9, 13, 17, 21, 25, 27, 29, 31)},
}
#: Fixed layout of a status packet: its first bytes, and by (lasers, firmware) where angles start and the four corrections are.
MAGIC = "A5FF005A"
ANGLES_AT = {(16, 2): 234, (16, 3): 245, (32, 3): 245, (32, 2): 882}
CORRECTIONS_AT = {3: (186, 190, 188, 192), 2: (34, 42, 66, 68)}
#: How far (degrees) configured angles may be from nominal ones, by lasers.
TOLERANCE = {16: 1.5, 32: 3.0}


def lasers(model: str) -> int:
    return int(model[1:3])


def vertical(model: str, fpga: int) -> tuple[float, ...]:
    """Nominal angles by laser."""
    return VERTICAL[f"{model}_26" if fpga == 2 and lasers(model) == 32 else model]


def ring_of(laser: Column, model: str, fpga: int) -> Column:
    """Rings from the lowest: even lasers are the lower half; lasers of firmware 2 are in order."""
    n = lasers(model)
    return laser if n == 32 and fpga == 2 else F.floor(laser / 2).cast("int") + F.when(laser % 2 == 0, 0).otherwise(n // 2)


def ring_angle_lookup(points: DataFrame, model: str, fpga: int = 3, configured: str | None = None) -> DataFrame:
    """points (laser) with ring and vertical: the nominal angle, or that of the array column `configured` where it is not null."""
    nominal = F.get(F.array(*(F.lit(float(v)) for v in vertical(model, fpga))), F.col("laser"))
    angle = F.coalesce(F.get(configured, F.col("laser")), nominal) if configured else nominal
    return points.withColumns({"ring": ring_of(F.col("laser"), model, fpga), "vertical": angle})


def range_gate(points: DataFrame, least: float = 0.15, most: float = 150.0) -> DataFrame:
    """Distances in [least, most)."""
    return points.where((F.col("distance") >= least) & (F.col("distance") < most))


def polar_to_xyz(distance: Column, azimuth: Column, angle: Column, n_lasers: int = 32, x_forward: bool = True) -> tuple[Column, Column, Column]:
    """Coordinates of a firing; azimuth in hundredths of degrees, 0 along x (x_forward) or along y."""
    radius, at = ORIGIN[n_lasers]
    a, v, o = F.radians(azimuth * 0.01), F.radians(angle), F.radians(azimuth * 0.01 - at)
    along, across = distance * F.cos(v) * F.cos(a) + radius * F.cos(o), distance * F.cos(v) * F.sin(a) + radius * F.sin(o)
    return (along, -across, distance * F.sin(v)) if x_forward else (across, along, distance * F.sin(v))


def azimuth_calibrate(azimuth: Column, laser: Column, corrections: Column, model: str, fpga: int = 3) -> Column:
    """azimuth with the laser's correction of the array `corrections` (four), in [0, 36000); devices of 16 lasers have none."""
    c = [F.get(corrections, F.lit(i)) for i in range(4)]
    if model == "c32_2":
        swapped = F.when(laser % 4 <= 1, c[1]).otherwise(c[0]) if fpga == 3 else F.lit(0)
        shift = F.when((c[1] - c[0] > 300) & (c[1] - c[0] < 460), swapped).otherwise(F.when(laser % 2 == 0, c[0]).otherwise(-c[0]))
    elif model == "c32_1":
        shift = F.lit(0)
        for (which, sign), of in CORRECTION[model, fpga].items():
            shift = F.when(laser.isin(*of), c[which] * sign).otherwise(shift)
    else:
        return azimuth
    return F.pmod(azimuth + F.coalesce(shift, F.lit(0)), F.lit(36000))


def device_status(packets: DataFrame, model: str = "c32_2", fpga: int = 3, compat: bool = True) -> DataFrame:
    """One row a device from its status packets (device, seq, data); others are ignored.

    n counts them. corrections and angles are of the first one; angles (degrees by laser) is null unless all are near the nominal
    ones. date (second, minute, hour, day, month, year) is of the last one. compat: negative numbers are one too high, as the devices' driver has them.
    """
    n = lasers(model)
    at, data = ANGLES_AT[n, fpga], F.col("data")
    raw = [i16be(data, at + 2 * i, compat) * 0.01 for i in range(n)]
    if n == 32 and fpga == 3:
        raw = [raw[i // 2 + (i % 2) * 16] for i in range(n)]
    off = F.greatest(*(F.abs(r - v) for r, v in zip(raw, vertical(model, fpga))))
    corrections = F.array(*(i16be(data, i, compat) for i in CORRECTIONS_AT[fpga])) if n == 32 else F.lit(None).cast("array<int>")
    date_at = 36 if n == 16 and fpga == 2 else 52
    date = F.array(*(F.conv(F.hex(F.substr(data, F.lit(date_at + 6 - i), F.lit(1))), 16, 10).cast("int") for i in range(6)))
    rows = packets.where(F.hex(F.substr(data, F.lit(1), F.lit(4))) == MAGIC).select("device", "seq", corrections.alias("corrections"), F.when(off <= TOLERANCE[n], F.array(*raw)).alias("angles"), date.alias("date"))
    return rows.groupBy("device").agg(F.count("*").alias("n"), F.min_by(F.struct("corrections", "angles"), "seq").alias("first"), F.max_by("date", "seq").alias("date")).select("device", "n", "first.corrections", "first.angles", "date")


def gps_time(data: Column, date: Column, size: int = 1206) -> Column:
    """A packet's time: the microsecond count in its tail, with the date of its own (1212 bytes) or of the last status packet (six numbers)."""
    at = size - 6
    if size == 1212:
        part = [F.conv(F.hex(F.substr(data, F.lit(1201 + i), F.lit(1))), 16, 10).cast("int") for i in range(6)]
    else:
        part = [F.get(date, F.lit(5 - i)) for i in range(6)]
    whole = F.make_timestamp(part[0] + 2000, part[1], part[2], part[3], part[4], part[5].cast("decimal(8,6)"))
    return F.unix_micros(whole) + u32le(data, at)


def gps_second_repair(packets: DataFrame, span: int = SPAN) -> DataFrame:
    """packets (device, seq, t_us and others) with t_us mended where the second and its fraction came from different moments.

    A step back of under a second just after a full second gains one; a step of 1 to 1.2 s just before one loses it. Compared is the time
    before as it was mended, so a packet's correction (-1, 0 or +1 s) depends on that of the packet before: a scan over three states.
    Rows without a time stay so and are passed over. Only (device, seq, t_us) is shuffled for it; what was mended, a few packets, is joined back.
    """
    second = 1_000_000
    rows = last_seen(packets.where("t_us is not null").select("device", "seq", "t_us"), {"_before": F.col("t_us")}, ("seq",), "device", before=True, span_us=span)
    part = F.pmod(F.col("t_us"), F.lit(second))

    def after(correction: int) -> Column:
        step = F.col("t_us") - (F.col("_before") + correction * second)
        gains, loses = (step < 0) & (step > -second) & (part < 100_000), (step > second) & (step < 1.2 * second) & (part > 900_000)
        return F.when(gains, 2).when(loses, 0).otherwise(1)

    state = finite_scan(rows, F.array(*(after(c) for c in (-1, 0, 1))), "seq", "device", 1, span)
    mended = state.where("state <> 1").select("device", "seq", ((F.col("state") - 1) * second).alias("_shift"))
    out = packets.join(mended, ["device", "seq"], "left").withColumn("t_us", F.col("t_us") + F.coalesce("_shift", F.lit(0)))
    return out.select(*(F.col(f"`{c}`") for c in packets.columns))


def packet_sweeps(packets: DataFrame, least: float, most: float, unit: float, span: int = SPAN) -> DataFrame:
    """A narrow row for each valid packet (device, seq, data): split, the first of its firings in a new sweep, or null; sweep, that of the firings from it
    on (counted from 0 by device); and size_before and size_after, how many of its firings in the range of distances lie before and from the split on.

    A sweep starts where azimuth falls by over 350 degrees from one firing to the next, at most once a packet. Packets are taken apart where they are;
    their few numbers are ordered by device in ranges of seq.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, b in batches_of(batches):
            azimuth = b.azimuths()
            fell = azimuth[:, :-1] - azimuth[:, 1:] > 35000
            inner = np.where(fell.any(axis=1), fell.argmax(axis=1) + 1, -1)
            distance = b.units * (0.01 * unit)
            upto = np.concatenate([np.zeros((len(b.row), 1), np.int64), np.cumsum((distance >= least) & (distance < most), axis=1)], axis=1)
            at = pa.array(b.row)
            values = [azimuth[:, 0], azimuth[:, -1], inner, upto[np.arange(len(b.row)), np.maximum(inner, 0)], upto[:, -1]]
            yield pa.record_batch([piece.column("device").take(at), piece.column("seq").take(at), *(pa.array(v.astype(np.int32)) for v in values)], names=["device", "seq", "begin", "final", "inner", "early", "whole"])

    kinds = dict(packets.dtypes)
    rows = packets.select("device", "seq", "data").mapInArrow(summary, f"device {kinds['device']}, seq {kinds['seq']}, begin int, final int, inner int, early int, whole int")
    rows = last_seen(rows, {"_last": F.col("final")}, ("seq",), "device", before=True, span_us=span)
    split = F.when(F.coalesce(F.col("_last") - F.col("begin") > 35000, F.lit(False)), 0).when(F.col("inner") >= 0, F.col("inner"))
    rows = rows.withColumn("split", split)
    rows = running_sum(rows, "sweep", F.col("split").isNotNull().cast("long"), ("seq",), "device", span)
    before = F.when(F.col("split") == 0, 0).when(F.col("split") > 0, F.col("early")).otherwise(0)
    return rows.select("device", "seq", "split", "sweep", before.alias("size_before"), (F.col("whole") - before).alias("size_after"))


def whole_sweeps(packets: DataFrame, fewest: int) -> DataFrame:
    """packet_sweeps with keep_before and keep_after: whether the sweep before the split, and the one from it on, count from 1 and have `fewest` points."""
    rows = packets.withColumn("part", F.explode(F.array(F.struct((F.col("sweep") - F.col("split").isNotNull().cast("long")).alias("s"), F.col("size_before").alias("n")), F.struct(F.col("sweep").alias("s"), F.col("size_after").alias("n")))))
    full = rows.groupBy("device", F.col("part.s").alias("s")).agg(F.sum("part.n").alias("n")).where((F.col("s") > 0) & (F.col("n") >= fewest)).select(F.col("device").alias("_d"), "s")
    earlier, later = full.select("_d", F.col("s").alias("_e")), full.select(F.col("_d").alias("_c"), F.col("s").alias("_l"))
    out = packets.join(earlier, (F.col("device") == F.col("_d")) & (F.col("sweep") - F.col("split").isNotNull().cast("long") == F.col("_e")), "left")
    out = out.join(later, (F.col("device") == F.col("_c")) & (F.col("sweep") == F.col("_l")), "left")
    return out.select("device", "seq", "split", "sweep", F.col("_e").isNotNull().alias("keep_before"), F.col("_l").isNotNull().alias("keep_after"))


def decode_lidar_packets(packets: DataFrame, status: DataFrame | None = None, model: str = "c32_2", fpga: int = 3, unit: float = 0.4, least: float = 0.15, most: float = 150.0, sector: tuple[int, int] | None = None, x_forward: bool = True, fewest: int = 65, span: int = SPAN) -> DataFrame:
    """packets (device, seq, stamp_us, data) to points: device, sweep, seq, i, ring, azimuth, distance, intensity, x, y, z, t_us.

    status is what device_status gives: devices without two status packets have no points. The firings before a device's first sweep and sweeps of
    fewer than `fewest` points go; the last sweep stays, though it may be partial. Sweeps are told by the azimuths before calibration; the
    range gate and the sector come after. Invalid packets are left out. Packets are shuffled once, beside their sweeps, and taken apart last: no firing is shuffled.
    """
    n, kinds = lasers(model), dict(packets.dtypes)
    own = packets.select("device", "seq", "stamp_us", "data")
    beside = whole_sweeps(packet_sweeps(own, least, most, unit, span), fewest).where("keep_before or keep_after")
    if status is not None:
        beside = beside.join(status.where("n >= 2").select("device"), "device", "left_semi")
    number = np.arange(BLOCKS * FIRINGS)

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, b in batches_of(batches):
            split, sweep, before, after, stamp, gap = (piece.column(c).to_numpy(zero_copy_only=False)[b.row] for c in ("split", "sweep", "keep_before", "keep_after", "stamp_us", "gap"))
            split = np.nan_to_num(split.astype(np.float64), nan=-1).astype(np.int64)[:, None]
            late = number >= split  # also where there is no split: then all firings are of `sweep`
            distance = b.units * (0.01 * unit)
            keep = np.where(late, after.astype(bool)[:, None], before.astype(bool)[:, None]) & (distance >= least) & (distance < most)
            row, i = np.nonzero(keep)
            at = pa.array(b.row[row])
            t = stamp.astype(np.float64)[row] - (len(number) - 1 - i) * (gap.astype(np.float64) / len(number))[row]
            values = [(sweep[row] - ~late[row, i]).astype(np.int64), i.astype(np.int32), (i % n).astype(np.int32), b.azimuths()[row, i].astype(np.int32), distance[row, i], b.intensity[row, i].astype(np.int32), t]
            yield pa.record_batch([piece.column("device").take(at), piece.column("seq").take(at), *map(pa.array, values)], names=["device", "seq", "sweep", "i", "laser", "azimuth", "distance", "intensity", "t_us"])

    rows = with_gap(own, span).join(beside, ["device", "seq"])
    rows = rows.mapInArrow(fire, f"device {kinds['device']}, seq {kinds['seq']}, sweep long, i int, laser int, azimuth int, distance double, intensity int, t_us double")
    if status is None:
        rows = rows.withColumns({"corrections": F.lit(None).cast("array<int>"), "angles": F.lit(None).cast("array<double>")})
    else:  # one row a device, which Spark broadcasts while it is small
        rows = rows.join(status.select("device", "corrections", "angles"), "device")
    rows = rows.withColumn("azimuth", azimuth_calibrate(F.col("azimuth"), F.col("laser"), F.col("corrections"), model, fpga))
    rows = ring_angle_lookup(rows, model, fpga, "angles")
    x, y, z = polar_to_xyz(F.col("distance"), F.col("azimuth"), F.col("vertical"), n, x_forward)
    rows = rows.select("device", "sweep", "seq", "i", "ring", "azimuth", "distance", "intensity", x.alias("x"), y.alias("y"), z.alias("z"), "t_us")
    return azimuth_sector_mask(rows, *sector) if sector else rows


def laserscan_raster(points: DataFrame, ring: int, resolution: float = 0.25, x_forward: bool = True, key: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """The planar scan of one ring (key, bin, range, intensity) of points (key, seq, ring, azimuth in hundredths of degrees, distance, intensity).

    Bins of `resolution` degrees run against the azimuth; the last point of a bin stays. Bins without a point have no row.
    """
    bins = math.ceil(360 / resolution)
    turned = F.col("azimuth") * 0.01 if x_forward else F.pmod(450 - F.col("azimuth") * 0.01, F.lit(360.0))
    at = F.floor(turned / resolution).cast("int")
    rows = points.where(F.col("ring") == ring).withColumn("bin", bins - 1 - at if x_forward else at).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    return rows.groupBy(*key, "bin").agg(F.max_by(F.struct("distance", "intensity"), "seq").alias("p")).select(*key, "bin", F.col("p.distance").alias("range"), "p.intensity")


def laserscan_arrays(raster: DataFrame, resolution: float = 0.25, key: tuple[str, ...] = ("scan_id",)) -> DataFrame:
    """(key, ranges, intensities): arrays of all bins, NaN where there is no point."""
    bins = math.ceil(360 / resolution)
    rows = raster.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("range", "intensity")))).alias("m"))

    def array(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i)[name].cast("float"), F.lit(float("nan")).cast("float")))

    return rows.select(*key, array("range").alias("ranges"), array("intensity").alias("intensities"))


def write_laserscan(raster: DataFrame, path: str, resolution: float = 0.25, key: tuple[str, ...] = ("scan_id",)) -> None:
    laserscan_arrays(raster, resolution, key).write.parquet(path)


