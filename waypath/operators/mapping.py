"""Maps: obstacle bands, crops, upkeep, alignment and registration of scans, trees and their place on earth."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waypath.functions.geodesy import A, geocentric, geodetic, tangent_forward, tangent_inverse
from waypath.functions.pose import quat
from waypath.functions.rotation import mat_t_vec, mat_vec, quat_to_matrix
from waypath.operators.scans import det3
from waypath.operators.spatial import around, box_candidates, box_join, in_cells, knn_join, map_extent, voxel_keep_center, write_index
from waypath.streaming.runs import shared_folder


def height_band(points: DataFrame, mark: tuple[float, float] = (0.15, 1.5), clear: tuple[float, float] = (-2.0, 2.0), mark_range: float = 5.0, clear_range: float = 6.0) -> DataFrame:
    """points with mark and clear: whether the height lies in the band and the planar distance within the range (limits belong to both)."""
    flat = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return points.withColumns({"mark": F.col("z").between(*mark) & (flat <= mark_range), "clear": F.col("z").between(*clear) & (flat <= clear_range)})


def crop_near_trajectory(points: DataFrame, trajectory: DataFrame, radius: float) -> DataFrame:
    """points at most radius from any pose (x, y, z) of the trajectory. Poses of one cell are joined as one place a cell around them."""
    poses = around(trajectory.select("x", "y", "z"), radius).select("cx", "cy", "cz", *(F.col(c).alias(f"m_{c}") for c in "xyz"))
    near = sum((F.col(c) - F.col(f"m_{c}")) ** 2 for c in "xyz") <= radius * radius
    left = in_cells(points, radius)
    return left.join(poses, (left["cx"] == poses["cx"]) & (left["cy"] == poses["cy"]) & (left["cz"] == poses["cz"]) & near, "left_semi").drop("cx", "cy", "cz")


def flat(trees: DataFrame, key: str) -> DataFrame:
    return trees.select(F.col("tree_id").alias(key), "x", "y", F.lit(0.0).alias("z"))


def nearest_tree(points: DataFrame, trees: DataFrame) -> DataFrame:
    """(query_id, tree_id, distance) of points (query_id, x, y): the nearest tree (tree_id, x, y) in the plane."""
    near = knn_join(points.select("query_id", "x", "y", F.lit(0.0).alias("z")), flat(trees, "point_id"), 1)
    return near.select("query_id", F.col("point_id").alias("tree_id"), F.sqrt("d2").alias("distance"))


def tree_spacing(trees: DataFrame) -> DataFrame:
    """(tree_id, nearest_id, distance) of each tree and the other nearest to it."""
    near = knn_join(flat(trees, "query_id"), flat(trees, "point_id"), 2).where("query_id <> point_id")
    near = near.groupBy("query_id").agg(F.min(F.struct("rank", "point_id", "d2")).alias("n"))
    return near.select(F.col("query_id").alias("tree_id"), F.col("n.point_id").alias("nearest_id"), F.sqrt("n.d2").alias("distance"))


def georeference_fit(trees: DataFrame) -> DataFrame:
    """One row: the planar turn (radians), scale and shift that take local x, y to east and north in the plane that touches the earth at lat0, lon0, by least squares, and
    the residual's root mean square. That place is the tree of least tree_id that has one; all trees with coordinates take part, wherever they
    are. The scale is that of the grid in which a local map was made (about 1.0003 some degrees from a zone's middle), else 1."""
    rows = trees.select("tree_id", "x", "y", "lat", "lon").where("x is not null and y is not null and lat is not null and lon is not null")
    origin = rows.agg(F.min_by(F.struct(F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "tree_id").alias("o")).select("o.*")
    rows = rows.crossJoin(F.broadcast(origin))  # one row
    east, north, _ = tangent_forward(geocentric(F.col("lat"), F.col("lon")), F.col("lat0"), F.col("lon0"))
    rows = rows.select("lat0", "lon0", "x", "y", east.alias("e"), north.alias("n"))
    mean = rows.agg(*(F.avg(c).alias(f"m{c}") for c in ("x", "y", "e", "n")))
    rows = rows.crossJoin(F.broadcast(mean)).select("lat0", "lon0", *(f"m{c}" for c in ("x", "y", "e", "n")), *((F.col(c) - F.col(f"m{c}")).alias(c) for c in ("x", "y", "e", "n")))  # one row
    sums = rows.groupBy("lat0", "lon0", "mx", "my", "me", "mn").agg(F.count("*").alias("trees"), F.sum(F.expr("x * e + y * n")).alias("a"), F.sum(F.expr("x * n - y * e")).alias("b"), F.sum(F.expr("x * x + y * y")).alias("s"))
    scale = F.when(F.col("s") > 0, F.sqrt(F.expr("a * a + b * b")) / F.col("s")).otherwise(1.0)
    out = sums.withColumns({"turn": F.atan2("b", "a"), "scale": scale})
    out = out.withColumns({"shift_x": F.expr("me - scale * (cos(turn) * mx - sin(turn) * my)"), "shift_y": F.expr("mn - scale * (sin(turn) * mx + cos(turn) * my)")})
    # The residual from the rows themselves: as a difference of sums of squares it would lose the millimetres.
    fit = out.select("lat0", "lon0", "trees", "turn", "scale", "shift_x", "shift_y")
    left = rows.crossJoin(F.broadcast(fit.select("turn", "scale"))).agg(F.sum(F.expr("pow(e - scale * (cos(turn) * x - sin(turn) * y), 2) + pow(n - scale * (sin(turn) * x + cos(turn) * y), 2)")).alias("_s"))  # one row
    return fit.crossJoin(F.broadcast(left)).withColumn("residual", F.sqrt(F.col("_s") / F.col("trees"))).drop("_s")


def georeference(points: DataFrame, fit: DataFrame) -> DataFrame:
    """points (x, y) with lat and lon by the one row of fit."""
    rows = points.crossJoin(F.broadcast(fit.select("lat0", "lon0", "turn", "scale", "shift_x", "shift_y")))  # one row
    rows = rows.withColumns({"_e": F.expr("shift_x + scale * (cos(turn) * x - sin(turn) * y)"), "_n": F.expr("shift_y + scale * (sin(turn) * x + cos(turn) * y)")})
    # The plane lies above the ellipsoid, by the square of the distance over twice the earth's radius.
    up = -(F.col("_e") * F.col("_e") + F.col("_n") * F.col("_n")) / (2 * A)
    place = tangent_inverse(F.col("_e"), F.col("_n"), up, F.col("lat0"), F.col("lon0"))
    rows = rows.withColumns({f"_{k}": v for k, v in zip("abc", place)})
    rows = rows.withColumn("_at", geodetic(F.col("_a"), F.col("_b"), F.col("_c")))
    return rows.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).drop("_at", "_e", "_n", "_a", "_b", "_c", "lat0", "lon0", "turn", "scale", "shift_x", "shift_y")


def tree_map_report(trees: DataFrame) -> DataFrame:
    """One row: number, extent, least, mean and largest spacing, and the georeference's turn and residual."""
    spacing = tree_spacing(trees).agg(F.min("distance").alias("least_spacing"), F.avg("distance").alias("mean_spacing"), F.max("distance").alias("most_spacing"))
    size = map_extent(flat(trees, "point_id")).drop("min_z", "max_z")
    return size.crossJoin(spacing).crossJoin(georeference_fit(trees).select("turn", "residual"))  # one row each


def map_size(points: DataFrame) -> DataFrame:
    """n of all points, live of those not deleted."""
    return points.agg(F.count("*").alias("n"), F.count_if(~F.col("deleted")).alias("live"))


def maintain_map(stored: DataFrame, new: DataFrame, size: float, centre: tuple[float, float, float], side: float = 400.0) -> DataFrame:
    """stored and new points, one a voxel where new ones came, without those outside the cube of `side` around the centre (upper faces are outside)."""
    rows = voxel_keep_center(stored, new, size)
    for c, m in zip("xyz", centre):
        rows = rows.where((F.col(c) >= m - side / 2) & (F.col(c) < m + side / 2))
    return rows


def umeyama_align(pairs: DataFrame, key: str = "vehicle_id") -> DataFrame:
    """(key, n, rot, shift): the rigid motion that takes fx, fy, fz closest to x, y, z in each run; Spark sums, a task solves one 3x3 row a run."""
    names = ["x", "y", "z", "fx", "fy", "fz"]
    mean = pairs.groupBy(key).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in names))
    rows = pairs.join(mean, key)
    cross = [F.sum((F.col(a) - F.col(f"m{a}")) * (F.col(f"f{b}") - F.col(f"mf{b}"))).alias(f"c{a}{b}") for a in "xyz" for b in "xyz"]
    sums = rows.groupBy(key, "n", *(f"m{c}" for c in names)).agg(*cross)
    kind = pairs.schema[key].dataType.simpleString()

    def solve(batches):
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                u, _, vt = np.linalg.svd(np.array([[r[f"c{a}{b}"] for b in "xyz"] for a in "xyz"]))
                rot = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt)) or 1]) @ vt
                out.append((r[key], r["n"], rot.ravel().tolist(), (np.array([r[f"m{c}"] for c in "xyz"]) - rot @ np.array([r[f"mf{c}"] for c in "xyz"])).tolist()))
            yield pd.DataFrame(out, columns=[key, "n", "rot", "shift"])

    return sums.mapInPandas(solve, f"{key} {kind}, n long, rot array<double>, shift array<double>")


def point_to_plane_normal_equations(matches: DataFrame, key: str = "scan_id") -> DataFrame:
    """(key, n, cost, h00..h55 (upper half), g0..g5) of matches: key, x, y, z (body), nx, ny, nz, d (plane in the world), px..pz, qx..qw (pose).

    The residual is the moved point's distance from its plane; its derivatives are by position (world), then by rotation (body, on the right).
    """
    rot = quat_to_matrix(quat())
    n = tuple(F.col(f"n{c}") for c in "xyz")
    p = tuple(F.col(c) for c in "xyz")
    world = tuple(a + F.col(f"p{c}") for a, c in zip(mat_vec(rot, p), "xyz"))
    residual = n[0] * world[0] + n[1] * world[1] + n[2] * world[2] + F.col("d")
    m = mat_t_vec(rot, n)
    turn = (p[1] * m[2] - p[2] * m[1], p[2] * m[0] - p[0] * m[2], p[0] * m[1] - p[1] * m[0])
    rows = matches.select(key, residual.alias("r"), *(v.alias(f"j{i}") for i, v in enumerate((*n, *turn))))
    sums: list[Column] = [F.sum(F.col(f"j{a}") * F.col(f"j{b}")).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)]
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("cost"), *sums, *(F.sum(F.col(f"j{a}") * F.col("r")).alias(f"g{a}") for a in range(6)))


def step_poses(poses: DataFrame, equations: DataFrame, key: str = "scan_id", limit: float = 1e-3) -> DataFrame:
    """poses (key, px..pz, qx..qw, done) after one step of their normal equations; done where every part of it is within limit. One row a scan is solved in Python."""
    names = [key, "px", "py", "pz", "qx", "qy", "qz", "qw", "done"]
    rows = poses.join(equations, key, "left")

    def solve(batches):
        for df in batches:
            out = []
            for r in df.to_dict("records"):
                if r["done"] or not r["n"] > 0:
                    out.append([r[c] for c in names])
                    continue
                h = np.array([[r[f"h{min(a, b)}{max(a, b)}"] for b in range(6)] for a in range(6)])
                dx = -np.linalg.lstsq(h, np.array([r[f"g{a}"] for a in range(6)]), rcond=1e-10)[0]
                half = np.linalg.norm(dx[3:]) / 2
                x, y, z = dx[3:] * (np.sin(half) / (2 * half) if half > 1e-12 else 0.5)
                w, (ax, ay, az, aw) = np.cos(half), (r[f"q{c}"] for c in "xyzw")
                q = np.array([aw * x + ax * w + ay * z - az * y, aw * y - ax * z + ay * w + az * x, aw * z + ax * y - ay * x + az * w, aw * w - ax * x - ay * y - az * z])
                out.append([r[key], *(r[f"p{c}"] + d for c, d in zip("xyz", dx)), *(q / np.linalg.norm(q)), bool((np.abs(dx) <= limit).all())])
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(solve, poses.select(*names).schema)


#: Distances that a task holds at once; places of a cube that one task takes.
TOGETHER, CROWDED = 250_000, 100_000


def nearest_few(held: np.ndarray, places: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The k nearest of held to each place, some of the places at a time; of equally near ones those that come first.

    What is farther from the box around all places than its farthest corner is from k others is left aside at first.
    """
    low, high = places.min(axis=0), places.max(axis=0)
    gap = np.maximum(np.maximum(low - held, held - high), 0)
    corner = np.maximum(held - low, high - held)
    most = np.partition((corner * corner).sum(axis=1), k - 1)[k - 1]
    held = held[(gap * gap).sum(axis=1) <= most * (1 + 1e-9)]
    step = max(1, TOGETHER // len(held))
    for i in range(0, len(places), step):
        own = places[i : i + step]
        away = [own[:, j, None] - held[None, :, j] for j in range(3)]
        d2 = away[0] * away[0] + away[1] * away[1] + away[2] * away[2]
        at = np.argpartition(d2, k - 1, axis=1)[:, :k]
        tied = np.count_nonzero(d2 <= np.take_along_axis(d2, at, axis=1).max(axis=1)[:, None], axis=1) > k
        if tied.any():
            at[tied] = np.argsort(d2[tied], axis=1, kind="stable")[:, :k]
        yield held[at]


def plane_through(points: np.ndarray, most: float, singular: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Which groups of points (group, point, axis) have a plane, and nx, ny, nz, d of these, as plane_fit has them."""
    sums = {f"{a}{b}": (points[:, :, i] * points[:, :, j]).sum(axis=1) for i, a in enumerate("xyz") for j, b in enumerate("xyz") if i <= j}
    m, one = [[sums["".join(sorted(a + b))] for b in "xyz"] for a in "xyz"], points.sum(axis=1)
    with np.errstate(all="ignore"):
        det = det3(m)
        fit = np.abs(det) > singular * ((m[0][0] + m[1][1] + m[2][2]) / 3) ** 3
        u = np.stack([det3([[-one[:, r] if c == i else m[r][c] for c in range(3)] for r in range(3)]) / det for i in range(3)], axis=1)
        norm = np.sqrt((u * u).sum(axis=1))
        plane = np.concatenate([u, np.ones((len(u), 1))], axis=1) / norm[:, None]
        off = np.abs((points * plane[:, None, :3]).sum(axis=2) + plane[:, 3, None])
        fit &= (norm > 0) & (off <= most).all(axis=1)
    return fit, plane[fit]


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cubes with x, y, z of their points (m_x, m_y, m_z), one point after the other, as bytes."""
    for batch in batches:
        held = [np.stack([own.values.field(f"m_{c}").to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], axis=1).tobytes() for own in batch.column("points")]
        yield pa.record_batch([*(batch.column(c) for c in ("cx", "cy", "cz")), pa.array(held, pa.binary())], names=["cx", "cy", "cz", "points"])


#: Of a scan's matches: their number, squared residuals, products of derivatives (upper half), products with the residual.
PAIRS = [(a, b) for a in range(6) for b in range(a, 6)]
SUMS = ["n", "cost", *(f"h{a}{b}" for a, b in PAIRS), *(f"g{a}" for a in range(6))]


def sums_by_cube(k: int, most: float, origin: tuple[float, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(scan_id, SUMS) of places (scan_id, x, y, z) against the planes through their k nearest map points, with turns about origin in the world; many rows a scan.

    Places of a cube come behind a row with the map's points around it (points: x, y, z of each as bytes).
    """

    def sums(scan: np.ndarray, at: np.ndarray, plane: np.ndarray) -> pa.RecordBatch:
        n = plane[:, :3]
        r = (n * at).sum(axis=1) + plane[:, 3]
        j = np.concatenate([n, np.cross(at - np.array(origin), n)], axis=1).T
        of, place = np.unique(scan, return_inverse=True)
        terms = [np.ones(len(r)), r * r, *(j[a] * j[b] for a, b in PAIRS), *(j[a] * r for a in range(6))]
        return pa.record_batch([pa.array(of), *(pa.array(np.bincount(place, t, len(of))) for t in terms)], names=["scan_id", *SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3))
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
            maps, rows, planes = batch.column("points"), [], []
            heads = np.flatnonzero(maps.is_valid().to_numpy(zero_copy_only=False))
            for head, a, b in zip([-1, *heads], [0, *heads + 1], [*heads, batch.num_rows]):
                if head >= 0:
                    held = np.frombuffer(maps[head].as_buffer()).reshape(-1, 3)
                if a == b or len(held) < k:
                    continue
                for near in nearest_few(held, places[a:b], k):
                    fit, plane = plane_through(near, most)
                    rows.append(a + np.flatnonzero(fit))
                    planes.append(plane)
                    a += len(near)
            if rows and len(at := np.concatenate(rows)):
                yield sums(batch.column("scan_id").take(pa.array(at)).to_numpy(zero_copy_only=False), places[at], np.concatenate(planes))

    return run


def about_poses(sums: DataFrame, poses: DataFrame, origin: tuple[float, ...]) -> DataFrame:
    """SUMS of scans with turns about origin in the world, as point_to_plane_normal_equations has them for their poses (px..pz, rotation r0..r8). One row a scan is turned in Python."""

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for row in df.to_dict("records"):
                rot = np.array([row[f"r{i}"] for i in range(9)]).reshape(3, 3)
                x, y, z = (o - row[f"p{c}"] for o, c in zip(origin, "xyz"))
                t = np.eye(6)
                t[3:, :3], t[3:, 3:] = rot.T @ np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]), rot.T
                h = t @ np.array([[row[f"h{min(a, b)}{max(a, b)}"] for b in range(6)] for a in range(6)]) @ t.T
                out.append([row["scan_id"], row["n"], row["cost"], *(h[a, b] for a, b in PAIRS), *(t @ np.array([row[f"g{a}"] for a in range(6)]))])
            yield pd.DataFrame(out, columns=["scan_id", *SUMS])

    return sums.join(poses, "scan_id").mapInPandas(turn, sums.schema)


def scan_to_map_register(scans: DataFrame, poses: DataFrame, points: DataFrame, rounds: int = 3, k: int = 5, size: float = 2.0, most: float = 0.1, limit: float = 1e-3) -> DataFrame:
    """Poses (scan_id, px..pz, qx..qw, done) of scans (scan_id, seq, x, y, z) against a map (point_id, x, y, z), from the poses given.

    Each round moves all points of all scans, finds the k nearest map points of every place among them and the planes through these, and steps every pose that is not done. Places are sorted by small cubes; the map
    points that may be near a place in a cube are looked up once a cube, and written for the rounds that follow. Between rounds the poses are written (one row a scan). Points
    without k neighbours or a plane within `most` have no part. The map is written once, bucketed by cell, and never shuffled again: rounds move poses and points only.
    """
    spark, cube = points.sparkSession, ["cx", "cy", "cz"]
    folder = shared_folder(spark, "registration")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    # Of points at one place only the k first by point_id can be among the k nearest of any place.
    copies = F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("point_id"))
    index = write_index(points.select("point_id", "x", "y", "z").withColumn("_copy", copies).where(F.col("_copy") <= k).drop("_copy"), size)
    side = index.size / 2
    now = poses.select("scan_id", *(f"p{c}" for c in "xyz"), *(f"q{c}" for c in "xyzw")).withColumn("done", F.lit(False))
    maps: DataFrame | None = None
    for i in range(rounds):
        motion = now.where("not done").withColumns({f"r{i}": e for i, e in enumerate(quat_to_matrix(quat()))})
        moved = scans.select("scan_id", *(F.col(c).cast("double").alias(f"b{c}") for c in "xyz")).join(motion, "scan_id")
        world = mat_vec(tuple(F.col(f"r{i}") for i in range(9)), tuple(F.col(f"b{c}") for c in "xyz"))
        moved = moved.select("scan_id", *((a + F.col(f"p{c}")).alias(c) for a, c in zip(world, "xyz")))
        for c, o in zip("xyz", index.low):
            moved = moved.where(F.abs(F.col(c)) < F.lit(float("inf"))).withColumn(f"c{c}", F.floor((F.col(c) - float(o)) / side))
        counts = stored(moved.groupBy(*cube).agg(F.count("*").alias("n")), f"cubes-{i}")
        new = counts if maps is None else counts.join(maps.select(*cube), cube, "left_anti")
        added = box_candidates(new.select(*cube), index, k, side).mapInArrow(as_bytes, "cx long, cy long, cz long, points binary")
        added = stored(added, f"maps-{i}")
        maps = added if maps is None else maps.unionByName(added)
        # A cube with very many places is dealt to several tasks.
        blocks = F.floor((F.col("n") - 1) / CROWDED) + 1
        heads = counts.join(maps, cube, "left").select(*cube, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.coalesce("points", F.lit(b"")).alias("points"))
        dealt = moved.join(F.broadcast(counts.where(F.col("n") > CROWDED)), cube, "left")  # at most a row for CROWDED points
        dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64("scan_id", "x", "y", "z"), blocks), F.lit(0).cast("long"))).drop("n")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = dealt.unionByName(heads, allowMissingColumns=True).repartition(parts, *cube, "block").sortWithinPartitions(*cube, "block", F.col("points").isNull())
        sums = rows.select("scan_id", "x", "y", "z", "points").mapInArrow(sums_by_cube(k, most, index.low), f"scan_id {dict(scans.dtypes)['scan_id']}, " + ", ".join(f"{c} double" for c in SUMS))
        sums = sums.groupBy("scan_id").agg(*(F.sum(c).alias(c) for c in SUMS))
        now = stored(step_poses(now, about_poses(sums, motion, index.low), limit=limit), f"poses-{i}")
        if now.where("not done").isEmpty():
            break
    index.drop()
    return now


def evict(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points in none of the half-open boxes."""
    return points.join(box_join(boxes, points.select("point_id", "x", "y", "z")).select("point_id").distinct(), "point_id", "left_anti")
