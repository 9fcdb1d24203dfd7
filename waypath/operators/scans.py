"""Scans and the inertial samples around them: knots, intervals, initial state, planes, runs of labels, point times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypath.operators.asof import last_seen

GRAVITY = 9.81


def followed(knots: DataFrame, value: str = "v") -> DataFrame:
    """(scan_id, seq, t, head, tail, end): the knots of each scan that have a successor, in order of t, then seq; head, tail and end hold t and v of a knot, the next one and the scan's last."""
    w = Window.partitionBy("scan_id").orderBy("t", "seq", value)
    knot = F.struct("t", F.col(value).alias("v"))
    rows = knots.where("scan_id is not null and t is not null").select("scan_id", "seq", "t", knot.alias("head"), F.lead(knot).over(w).alias("tail"), F.last(knot).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    return rows.where("tail is not null")


def bracketed(points: DataFrame, heads: DataFrame, name: str) -> DataFrame:
    """points (scan_id, t and others) with the struct `name` of heads (scan_id, seq, t, name) as the last of them strictly before t has it; null where there is none.

    Points and heads of a scan are put in one order of time and passed once, so no row holds more than one head.
    """
    point, head = F.struct(*points.columns), F.col(name)
    rows = points.select("scan_id", "t", F.lit(0).alias("_kind"), F.lit(None).cast(heads.schema["seq"].dataType).alias("_seq"), point.alias("_point"), F.lit(None).cast(heads.schema[name].dataType).alias(name))
    rows = rows.unionByName(heads.select("scan_id", F.col("t").cast(points.schema["t"].dataType).alias("t"), F.lit(1).alias("_kind"), F.col("seq").alias("_seq"), F.lit(None).cast(rows.schema["_point"].dataType).alias("_point"), head))
    w = Window.partitionBy("scan_id").orderBy("t", "_kind", "_seq", name).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("_kind = 0").select("_point.*", name)


def asof_bracket(points: DataFrame, knots: DataFrame) -> DataFrame:
    """points (scan_id, seq, t) with `head`, the last knot strictly before t that has a successor, and `tail`, that one.

    knots (scan_id, seq, t, v); equal times go by seq. Points at or before the first knot are left out, as are scans of
    fewer than two knots.
    """
    heads = followed(knots).select("scan_id", "seq", "t", F.struct("head", "tail").alias("_m"))
    return bracketed(points.select("scan_id", "seq", "t"), heads, "_m").where("_m is not null").select("scan_id", "seq", "t", "_m.head", "_m.tail")


def interval_join(scans: DataFrame, imu: DataFrame, bucket_us: int = 200_000) -> DataFrame:
    """Samples of imu (vehicle_id, seq, t_us) in each scan's [beg_us, end_us], with the scan (vehicle_id, scan_id).

    A scan is repeated for the buckets of time that it touches, so that the join is on equal buckets. Samples of a bucket wait in order of time as lists of at most TOGETHER, which
    are joined with each scan as they are and taken apart last: both sides move once, and only the rows asked for grow with the density of times.
    """
    first, last = (F.floor(F.col(c) / bucket_us) for c in ("beg_us", "end_us"))
    # Little is shuffled and many rows are made: a number that is given is not lessened by the tables' small size.
    parts, bucket = int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["vehicle_id", "_b"]
    asked = scans.where("vehicle_id is not null").withColumn("_b", F.explode(F.sequence(first, last))).repartition(parts, *bucket)
    samples = imu.select("vehicle_id", F.col("seq").alias("imu_seq"), F.col("t_us").alias("imu_us")).where("vehicle_id is not null and imu_us is not null")
    samples = samples.withColumn("_b", F.floor(F.col("imu_us") / bucket_us)).repartition(parts, *bucket)
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy("imu_us", "imu_seq")) - 1
    lists = samples.withColumn("_piece", F.floor(place / TOGETHER)).groupBy(*bucket, "_piece").agg(F.sort_array(F.collect_list(F.struct("imu_us", "imu_seq"))).alias("_samples"))
    rows = asked.join(lists, bucket).withColumn("_sample", F.explode("_samples")).where("_sample.imu_us between beg_us and end_us")
    return rows.select(*scans.columns, "_sample.imu_seq", "_sample.imu_us")


#: Samples of a list.
TOGETHER = 1000


def scan_groups(scans: DataFrame, imu: DataFrame, bucket_us: int = 200_000) -> DataFrame:
    """interval_join, and for each scan the last sample before its begin as well (where there is one); first is true for that one."""
    inside = interval_join(scans, imu, bucket_us).withColumn("first", F.lit(False))
    at = scans.withColumns({"t_us": F.col("beg_us"), "seq": F.lit(-1).cast("long"), "_imu": F.lit(None).cast("struct<imu_seq:bigint,imu_us:bigint>")})
    samples = imu.select("vehicle_id", "t_us", "seq", F.struct(F.col("seq").cast("long").alias("imu_seq"), F.col("t_us").alias("imu_us")).alias("_imu"))
    seen = last_seen(at.unionByName(samples, allowMissingColumns=True), {"_last": F.col("_imu")}, before=True).where("seq = -1 and _last is not null")
    return inside.unionByName(seen.select(*scans.columns, "_last.imu_seq", "_last.imu_us").withColumn("first", F.lit(True)), allowMissingColumns=True)


def imu_init(imu: DataFrame, least: int = 10) -> DataFrame:
    """Initial state of each vehicle from its first whole groups that hold `least` samples together.

    imu: vehicle_id, grp, seq, ax, ay, az, gx, gy, gz. Gives n, the mean acceleration turned to gravity, the mean turn
    rate as bias, and the accelerations' covariance about the running mean. Vehicles with fewer samples use them all.
    """
    sizes = imu.groupBy("vehicle_id", "grp").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("vehicle_id").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = sizes.withColumn("before", before).where(F.col("before") < least).select("vehicle_id", "grp")
    upto = Window.partitionBy("vehicle_id").orderBy("grp", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = imu.join(used, ["vehicle_id", "grp"], "left_semi").withColumn("k", F.row_number().over(upto))
    rows = rows.withColumns({f"m{c}": F.avg(f"a{c}").over(upto) for c in "xyz"})
    var = [(F.sum((F.col(f"a{c}") - F.col(f"m{c}")) ** 2 * (F.col("k") - 1) / F.col("k")) / F.count("*")).alias(f"cov_{c}") for c in "xyz"]
    means = [F.avg(f"{s}{c}").alias(f"{s}{c}") for s in "ag" for c in "xyz"]
    out = rows.groupBy("vehicle_id").agg(F.count("*").alias("n"), *means, *var)
    norm = F.sqrt(sum((F.col(f"a{c}") ** 2 for c in "yz"), F.col("ax") ** 2))
    return out.select("vehicle_id", "n", *(F.when(norm > 0, -F.col(f"a{c}") / norm * GRAVITY).alias(f"gravity_{c}") for c in "xyz"), *(F.col(f"g{c}").alias(f"bias_{c}") for c in "xyz"), *(f"cov_{c}" for c in "xyz"))


def det3(a: list[list[Column]]) -> Column:
    return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])


def plane_fit(neighbours: DataFrame, key: str = "query_id", most: float = 0.1, singular: float = 1e-6, least: int = 1) -> DataFrame:
    """(key, nx, ny, nz, d): the plane n.p + d = 0 nearest to each group of points, by least squares of A n = -1.

    Groups of fewer than `least` points, that are nearly singular, or with a point further than `most` from their plane, are left out.
    """
    products = {f"{a}{b}": F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    sums = neighbours.groupBy(key).agg(*(e.alias(f"s{n}") for n, e in products.items()), *(F.sum(c).alias(f"s{c}") for c in "xyz"), F.collect_list(F.struct("x", "y", "z")).alias("points"))
    m = [[F.col("s" + "".join(sorted(a + b))) for b in "xyz"] for a in "xyz"]
    det = det3(m)
    scale = ((F.col("sxx") + F.col("syy") + F.col("szz")) / 3) ** 3
    solved = [det3([[-F.col(f"s{'xyz'[r]}") if c == i else m[r][c] for c in range(3)] for r in range(3)]) / F.col("det") for i in range(3)]
    out = sums.where(F.size("points") >= least).withColumn("det", det).where(F.abs("det") > singular * scale).withColumns(dict(zip(("ux", "uy", "uz"), solved)))
    norm = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2 + F.col("uz") ** 2)
    out = out.withColumn("norm", norm).where("norm > 0").select(key, "points", *((F.col(f"u{c}") / F.col("norm")).alias(f"n{c}") for c in "xyz"), (1 / F.col("norm")).alias("d"))
    near = F.forall("points", lambda p: F.abs(F.col("nx") * p["x"] + F.col("ny") * p["y"] + F.col("nz") * p["z"] + F.col("d")) <= most)
    return out.where(near).drop("points")


def run_average(labels: DataFrame, n: int = 4) -> DataFrame:
    """Plane points (scan_id, ring, seq, plane, x, y, z) thinned: each run of them, ended by another point, becomes its mean.

    Where a run reaches n points the n-th stands for them and a new run starts. What is open at a ring's end is dropped.
    """
    w = Window.partitionBy("scan_id", "ring").orderBy("seq")
    rows = labels.select("scan_id", "ring", "seq", "plane", "x", "y", "z", F.row_number().over(w).alias("i"))
    # All in one order: how far a point is from the last one that isn't of a plane, the points before it, and whether its run ends behind it.
    before = F.coalesce(F.last(F.when(~F.coalesce("plane", F.lit(False)), F.col("i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    ends = ~F.coalesce(F.lead("plane").over(w), F.isnull(F.lead("i").over(w)))
    rows = rows.select("*", ((F.col("i") - before - 1) % n).alias("at"), ends.alias("ends"), *(F.lag(c, k).over(w).alias(f"{c}{k}") for k in range(1, n - 1) for c in "xyz"))
    out = rows.where(F.col("plane") & ((F.col("at") == n - 1) | F.col("ends")))
    sums = {c: sum((F.when(F.col("at") >= k, F.coalesce(f"{c}{k}", F.lit(0.0))).otherwise(0.0) for k in range(1, n - 1)), F.coalesce(c, F.lit(0.0))) for c in "xyz"}
    held = {c: sum((F.when((F.col("at") >= k) & F.col(f"{c}{k}").isNotNull(), 1).otherwise(0) for k in range(1, n - 1)), F.col(c).isNotNull().cast("int")) for c in "xyz"}
    return out.select("scan_id", "ring", "seq", *(F.when(F.col("at") == n - 1, F.col(c)).when(held[c] > 0, sums[c] / held[c]).alias(c) for c in "xyz"))


#: Cells of a tile's side.
TILE = 256


def column_distances(mask: np.ndarray, reach: int) -> np.ndarray:
    """How many cells lie between each cell and the nearest one of the mask in its column; reach + 1 beyond that."""
    n = len(mask)
    rows = np.arange(n)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -reach - n - 1), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, 2 * n + reach + 1)[::-1], axis=0)[::-1]
    return np.minimum(np.minimum(rows - above, below - rows), reach + 1)


def squared_distances(mask: np.ndarray, reach: int) -> np.ndarray:
    """Squared distance to the nearest cell of the mask within reach cells each way, exactly: first by columns, then along rows."""
    high = column_distances(mask, reach)
    far = 2 * (reach + 1) ** 2
    high = np.where(high > reach, far, high * high)
    out = high.copy()
    for dx in range(1, reach + 1):
        np.minimum(out[:, dx:], high[:, :-dx] + dx * dx, out=out[:, dx:])
        np.minimum(out[:, :-dx], high[:, dx:] + dx * dx, out=out[:, :-dx])
    return out


def inflated(costs: np.ndarray, reach: int, factor: np.ndarray) -> np.ndarray:
    """The largest cost * factor[squared distance] at each cell; NaN where a cell has no cost, or none within reach. factor is NaN from beyond the radius.

    A cost that many cells share reaches a cell from the nearest of these, so each level of cost is one distance transform. Where levels are many, or
    costs negative, all offsets are taken one by one.
    """
    out = np.full(costs.shape, np.nan)
    levels = np.unique(costs[~np.isnan(costs)])
    if not len(levels):
        return out
    if len(levels) <= max(1, reach) and levels[0] >= 0:
        far = len(factor) - 1
        for level in levels:
            out = np.fmax(out, level * factor[np.minimum(squared_distances(costs == level, reach), far)])
        return out
    n, m = costs.shape
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            f = factor[min(dx * dx + dy * dy, len(factor) - 1)]
            if not np.isnan(f) and abs(dy) < n and abs(dx) < m:
                to = out[max(0, dy) : n + min(0, dy), max(0, dx) : m + min(0, dx)]
                np.fmax(to, f * costs[max(0, -dy) : n + min(0, -dy), max(0, -dx) : m + min(0, -dx)], out=to)
    return out


def inflate_cells(cells: DataFrame, size: float = 0.5, radius: float = 1.0, k: float = 2.0) -> DataFrame:
    """Costs of a grid (map_id, ix, iy, cost) spread to all cells within radius, falling by exp(-k * distance); the largest stays.

    The grid is cut in tiles; a cell is sent to those that it can reach (four at most, but for radii beyond a tile) and each tile is an array of its own. Cells without
    a cost are left out, of repeated ones the largest cost holds.
    """
    reach = int(radius / size + 1e-9)
    tile = max(TILE, reach)
    d2 = np.arange(2 * reach * reach + 2)
    factor = np.where((size * np.sqrt(d2) <= radius) & (d2 <= 2 * reach * reach), np.exp(-k * size * np.sqrt(d2)), np.nan)
    kind = cells.schema["map_id"].dataType.simpleString()

    def spread(group: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(group["tx"].iloc[0]) * tile - reach, int(group["ty"].iloc[0]) * tile - reach
        costs = np.full((tile + 2 * reach, tile + 2 * reach), -np.inf)
        np.maximum.at(costs, (group["ix"].to_numpy() - tx, group["iy"].to_numpy() - ty), group["cost"].to_numpy())
        out = inflated(np.where(np.isinf(costs), np.nan, costs), reach, factor)[reach : reach + tile, reach : reach + tile]
        x, y = np.nonzero(~np.isnan(out))
        return pd.DataFrame({"map_id": group["map_id"].iloc[0], "ix": (x + tx + reach).astype(np.int64), "iy": (y + ty + reach).astype(np.int64), "cost": out[x, y]})

    dealt = cells.where("cost is not null").select("map_id", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("cost").cast("double").alias("cost"))
    for c in "xy":
        dealt = dealt.withColumn(f"t{c}", F.explode(F.sequence(F.floor((F.col(f"i{c}") - reach) / tile), F.floor((F.col(f"i{c}") + reach) / tile))))
    out = dealt.groupBy("map_id", "tx", "ty").applyInPandas(spread, f"map_id {kind}, ix long, iy long, cost double")
    kinds = dict(cells.dtypes)
    return out.select("map_id", *(F.col(c).cast(kinds[c]).alias(c) for c in ("ix", "iy")), "cost")


def ring_times(points: DataFrame, rate: float = 10.0) -> DataFrame:
    """Times in ms from the azimuth, for scans whose last point carries none (scan_id, ring, seq, x, y, time_s).

    The first point of a ring has time 0 and is dropped; from where the time falls within a ring a turn is added.
    Directions count as equal within a billionth of a degree, as points in one line with the scanner may have angles that differ in their last bit.
    """
    omega = 0.361 * rate
    timed = F.max_by("time_s", "seq").over(Window.partitionBy("scan_id"))
    w = Window.partitionBy("scan_id", "ring").orderBy("seq")
    yaw = F.degrees(F.atan2("y", "x"))
    rows = points.withColumn("timed", timed).where("timed <= 0").withColumns({"yaw": yaw, "i": F.row_number().over(w)})
    behind = F.round(F.first("yaw").over(w) - F.col("yaw"), 9)
    rows = rows.withColumn("raw", F.when(behind >= 0, behind).otherwise(behind + 360) / omega)
    fell = F.coalesce((F.col("raw") < F.lag("raw").over(w)).cast("int"), F.lit(0))
    rows = rows.withColumn("fell", fell).withColumn("turned", F.max("fell").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("i > 1").select("scan_id", "ring", "seq", (F.col("raw") + F.col("turned") * (360 / omega)).alias("ms"))


def return_mode(packets: DataFrame) -> DataFrame:
    """packets (device, seq, factory) with `dual`: true from the first packet whose factory byte says so."""
    first = packets.where(F.col("factory") == 0x39).groupBy("device").agg(F.min("seq").alias("_from"))
    return packets.select("device", "seq").join(first, "device", "left").select("device", "seq", F.coalesce(F.col("seq") >= F.col("_from"), F.lit(False)).alias("dual"))


def local_enu(positions: DataFrame, origins: DataFrame) -> DataFrame:
    """positions (vehicle_id, seq, x, y, z) less their vehicle's origin (vehicle_id, ox, oy, oz); others are left out."""
    return positions.join(origins, "vehicle_id").select("vehicle_id", "seq", *((F.col(c) - F.col(f"o{c}")).alias(n) for c, n in zip("xyz", ("east", "north", "up"))))
