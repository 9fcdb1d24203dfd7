"""Joins and aggregates on a grid of cells, so that none compares all points with all."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waypath.streaming.runs import shared_folder

#: Rows of a bucket of a written map index, once there are more than Spark's own partitions take.
BUCKET_ROWS = 5_000_000
#: Map points of a part of the largest cell.
PART_ROWS = 8192


def cell(size: float, axis: str) -> Column:
    return F.floor(F.col(axis) / size)


def around(df: DataFrame, size: float, reach: int = 1) -> DataFrame:
    """df once for each of the cells within reach of its own."""
    for c in "xyz":
        df = df.withColumn(f"c{c}", F.explode(F.sequence(cell(size, c) - reach, cell(size, c) + reach)))
    return df


def in_cells(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({f"c{c}": cell(size, c) for c in "xyz"})


def distance2(a: str = "", b: str = "m_") -> Column:
    away = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz"]
    return away[0] * away[0] + away[1] * away[1] + away[2] * away[2]


def radius_join(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Pairs of a query and a map point at most radius apart, with d2."""
    right = in_cells(points.select("point_id", "x", "y", "z"), radius).withColumnsRenamed({c: f"m_{c}" for c in "xyz"})
    return around(queries, radius).join(right, ["cx", "cy", "cz"]).withColumn("d2", distance2()).where(F.col("d2") <= radius * radius).drop("cx", "cy", "cz")


def radius_counts(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """queries (x, y, z and others) that have points (point_id, x, y, z) at most radius away, with their number n, the sum of their ids and that of d2.

    Equal places are looked up once, in cells of half the radius: a point is sent to the cells whose places it may reach.
    """
    size = radius / 2
    right = around(points.select("point_id", "x", "y", "z"), size, 2).withColumnsRenamed({c: f"m_{c}" for c in "xyz"})
    # How far the point is from the cell, by axis; the cells at the corners are out of reach.
    gaps = [F.greatest(F.lit(0.0), F.col(f"c{c}") * size - F.col(f"m_{c}"), F.col(f"m_{c}") - (F.col(f"c{c}") + 1) * size) for c in "xyz"]
    right = right.where(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] <= radius * radius * (1 + 1e-9))
    places = in_cells(queries.select("x", "y", "z").distinct(), size)
    # Little is shuffled and much compared: a number that is given is not lessened by the tables' small size.
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places, right = (t.repartition(parts, "cx", "cy", "cz") for t in (places, right))
    near = places.join(right, ["cx", "cy", "cz"]).withColumn("d2", distance2()).where(F.col("d2") <= radius * radius)
    found = near.groupBy("x", "y", "z").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"), F.sum("d2").alias("d2"))
    return queries.join(found, ["x", "y", "z"])


def at_levels(points: DataFrame, size: float, levels: range, low: tuple[float, ...]) -> DataFrame:
    """points (point_id, m_x, m_y, m_z) once for each level, with their cell: of size * 2^level, counted from low."""
    rows = points.select("point_id", *(F.col(c).alias(f"m_{c}") for c in "xyz")).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    side = size * F.pow(F.lit(2.0), F.col("level"))
    return rows.withColumns({f"c{c}": F.floor((F.col(f"m_{c}") - o) / side) for c, o in zip("xyz", low)})


CELLS = ("level", "cx", "cy", "cz")


@dataclass(frozen=True)
class MapIndex:
    """A map for nearest neighbours: its points once for each level with their cell (stored), cells with their counts (full), its extent and number of levels.

    Written by write_index, both are tables bucketed by cell, so joins on cells move only the other side.
    """

    stored: DataFrame
    full: DataFrame
    n: int
    low: tuple[float, ...]
    high: tuple[float, ...]
    top: int
    size: float
    tables: tuple[str, ...] = ()

    def drop(self) -> None:
        """Takes the tables out of the catalog; their files stay in the shared folder."""
        for t in self.tables:
            self.stored.sparkSession.sql(f"DROP TABLE IF EXISTS {t}")


#: Points that share a cell of the smallest size with a point, itself included, on average; halvings that one pass tries.
CROWD, HALVINGS = 16, 4


def fitting_size(points: DataFrame, size: float, low: tuple[float, ...]) -> float:
    """size, halved until a point shares its cell with CROWD points on average, or until halving no longer parts them (as with copies)."""
    crowd = None
    while True:
        cells = at_levels(points, size, range(0, -HALVINGS - 1, -1), low).groupBy(*CELLS).agg(F.count("*").alias("_n"))
        found = cells.groupBy("level").agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("crowd")).collect()  # a row a level
        for level, crowded in sorted(((r["level"], r["crowd"]) for r in found), reverse=True):
            if crowded <= CROWD:
                return size * 2.0**level
        if not found or crowd is not None and crowded > crowd / 2:
            return size
        size, crowd = size * 2.0**-HALVINGS, crowded


def map_index(points: DataFrame, size: float = 2.0) -> MapIndex:
    """The index of points (point_id, x, y, z) in cells of size (halved where the map is dense), twice that and so on, up to one cell.

    One pass finds the extent and a few find the smallest size; nothing is written.
    """
    spread = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    low, high = (tuple(spread[f"{n}{c}"] or 0.0 for c in "xyz") for n in ("lo", "hi"))
    width = max(h - o for h, o in zip(high, low))
    size = fitting_size(points, size, low)
    top = max(0, math.ceil(math.log2(max(width, size) / size)) + 1)
    stored = at_levels(points, size, range(top + 1), low)
    return MapIndex(stored, stored.groupBy(*CELLS).agg(F.count("*").alias("_n")), spread.n, low, high, top, size)


def write_index(points: DataFrame, size: float = 2.0, buckets: int | None = None) -> MapIndex:
    """map_index as two tables in the shared folder, bucketed and sorted by cell: a map is dealt by cell once, however often it is joined."""
    index, spark = map_index(points, size), points.sparkSession
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.n * (index.top + 1) // BUCKET_ROWS)
    names = []
    for kind, df in (("points", index.stored), ("cells", index.full)):
        names.append(f"map_{kind}_{uuid.uuid4().hex}")
        dealt = df.repartition(buckets, *CELLS)
        dealt.write.bucketBy(buckets, *CELLS).sortBy(*CELLS).option("path", shared_folder(spark, kind)).saveAsTable(names[-1])
    return replace(index, stored=spark.table(names[0]), full=spark.table(names[1]), tables=tuple(names))


#: Distances that a task holds at once.
HELD = 2_000_000


def spread_by_level(index: MapIndex, most: int) -> Column:
    """most for the largest cell, a fourth of it for the next smaller ones and so on; 1 at least."""
    return F.greatest(F.lit(1), F.floor(most / F.pow(F.lit(4.0), index.top - F.col("level"))).cast("int"))


def blocks_of(spark: SparkSession, index: MapIndex) -> Column:
    """The block of a place among those of its cell: far places share the few large cells, so these are dealt to many."""
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64("x", "y", "z"), spread_by_level(index, tasks))


def in_blocks(places: DataFrame, block: Column) -> DataFrame:
    """places (x, y, z, r, with their cell) as arrays, a row for each cell and block."""
    # Little is shuffled and much compared: a number that is given is not lessened by the table's small size.
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.withColumn("_block", block).repartition(parts, *CELLS, "_block").groupBy(*CELLS, "_block").agg(F.collect_list(F.struct("x", "y", "z", "r")).alias("places"))


def in_parts(index: MapIndex) -> DataFrame:
    """The map's points as arrays, ordered by m_x, then point_id, a row for each cell and part of it. A written index isn't shuffled for it."""
    part = F.pmod(F.xxhash64("point_id"), spread_by_level(index, max(1, index.n // PART_ROWS)))
    rows = index.stored.groupBy(*CELLS, part.alias("_part")).agg(F.sort_array(F.collect_list(F.struct("m_x", "point_id", "m_y", "m_z"))).alias("points"))
    return rows.drop("_part")


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.StructArray, np.ndarray]]:
    """Of each row's places and points: some of the places (x, y, z, r), the points and their squared distances, a line a place."""
    for batch in batches:
        for places, points in zip(batch.column("places"), batch.column("points")):
            asked = np.stack([places.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "z", "r")], axis=1)
            xyz = [points.values.field(f"m_{c}").to_numpy(zero_copy_only=False).astype(float) for c in "xyz"]
            step = max(1, HELD // len(xyz[0]))
            for i in range(0, len(asked), step):
                own = asked[i : i + step]
                away = [own[:, j, None] - xyz[j][None] for j in range(3)]
                yield own, points.values, away[0] * away[0] + away[1] * away[1] + away[2] * away[2]


def reaches(need: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Squared distances from each place to its nth (`need`) and to its farthest point; no nth where there are fewer points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, d2 in met(batches):
            nth = pa.array(np.partition(d2, need - 1, axis=1)[:, need - 1]) if 1 <= need <= d2.shape[1] else pa.nulls(len(own), pa.float64())
            yield pa.record_batch([*(pa.array(own[:, j]) for j in range(3)), nth, pa.array(d2.max(axis=1))], names=["x", "y", "z", "nth", "most"])

    return run


def nearest(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the points within r of each place the k nearest; the first ones of equally near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, points, d2 in met(batches):
            row, at = np.nonzero(d2 <= (own[:, 3] * own[:, 3])[:, None])
            far = d2[row, at]
            order = np.lexsort((at, far, row))
            row, at, far = row[order], at[order], far[order]
            first = np.searchsorted(row, np.arange(len(own)))
            kept = np.arange(len(row)) - first[row] < k
            row, found = row[kept], points.take(pa.array(at[kept]))
            names = ["point_id", "m_x", "m_y", "m_z"]
            yield pa.record_batch([*(pa.array(own[row, j]) for j in range(3)), *(found.field(c) for c in names), pa.array(far[kept])], names=["x", "y", "z", *names, "d2"])

    return run


def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points within r of each place, as a list."""
    for own, points, d2 in met(batches):
        row, at = np.nonzero(d2 <= (own[:, 3] * own[:, 3])[:, None])
        ends = pa.array(np.searchsorted(row, np.arange(len(own) + 1)), pa.int32())
        yield pa.record_batch([*(pa.array(own[:, j]) for j in range(3)), pa.ListArray.from_arrays(ends, points.take(pa.array(at)))], names=["x", "y", "z", "points"])


def cell_of(index: MapIndex, axis: str, shift: Column | float) -> Column:
    """The map's cell, of the row's level, that is nearest to axis + shift."""
    o, h = (float(limit["xyz".index(axis)]) for limit in (index.low, index.high))
    return F.floor((F.least(F.greatest(F.col(axis) + shift, F.lit(o)), F.lit(h)) - o) / (index.size * F.pow(F.lit(2.0), F.col("level"))))


def around_places(reach: DataFrame, index: MapIndex) -> DataFrame:
    """(places, points) of places (x, y, z, r): arrays that together hold each place beside all points within r, which lie in at most 27 cells of that order."""
    reach = reach.withColumn("level", F.least(F.lit(index.top), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("r"), F.lit(1e-300)) / index.size)).cast("int"))))
    for c in "xyz":
        reach = reach.withColumn(f"c{c}", F.explode(F.sequence(cell_of(index, c, -F.col("r")), cell_of(index, c, F.col("r")))))
    return in_blocks(reach, blocks_of(reach.sparkSession, index)).join(in_parts(index), list(CELLS)).select("places", "points")


def box_candidates(boxes: DataFrame, index: MapIndex, k: int, side: float) -> DataFrame:
    """(cx, cy, cz, points) of cubes (cx, cy, cz) of that side, counted from the map's low end: all points that are among the k nearest of any place in the cube, and some more; ordered by m_x, then point_id.

    A place is at most half the diagonal from the centre, so its kth point is at most that much farther than the centre's, and its k nearest are at most the whole diagonal farther from the centre.
    """
    centres = boxes.select(*(((F.col(f"c{c}") + 0.5) * side + float(o)).alias(c) for c, o in zip("xyz", index.low)))
    far = knn_join(centres.withColumn("query_id", F.lit(0)), index, k).groupBy("x", "y", "z").agg(F.max("d2").alias("d2"))
    reach = far.select("x", "y", "z", ((F.sqrt("d2") + side * math.sqrt(3)) * (1 + 1e-9) + 1e-12).alias("r"))
    point = dict(index.stored.dtypes)
    kind = f"array<struct<m_x:{point['m_x']},point_id:{point['point_id']},m_y:{point['m_y']},m_z:{point['m_z']}>>"
    found = around_places(reach, index).mapInArrow(within, f"x double, y double, z double, points {kind}")
    found = found.groupBy("x", "y", "z").agg(F.sort_array(F.flatten(F.collect_list("points"))).alias("points"))
    return found.select(*(F.floor((F.col(c) - float(o)) / side).alias(f"c{c}") for c, o in zip("xyz", index.low)), "points")


def knn_join(queries: DataFrame, points: DataFrame | MapIndex, k: int = 5, size: float = 2.0, max_dist: float | None = None) -> DataFrame:
    """The k nearest map points of each query (query_id, x, y, z), by distance, then m_x, then point_id; fewer where the map or max_dist has fewer.

    The map is counted in cells of size (halved where it is dense), twice size and so on, up to one cell. A query starts in the smallest cell around it (or around the
    map's nearest place to it) with k points; these give the radius in which its k nearest lie, and a radius join in at most 27 cells of
    that order finds them. Two joins settle all queries, dense or far away; queries at one place are settled once. Both sides are joined as arrays, places of a cell
    with the cell's points, and only what is among the k nearest of a part becomes rows. points may be a MapIndex, whose size then holds; one that was written
    is not shuffled again.
    """
    index = points if isinstance(points, MapIndex) else map_index(points, size)
    need, cells, place = min(k, index.n), list(CELLS), ["x", "y", "z"]
    full = index.full.where(F.col("_n") >= need).drop("_n")
    asked = queries.select(*(F.col(c).cast("double").alias(c) for c in place)).distinct()
    start = asked.withColumn("level", F.explode(F.array(*map(F.lit, range(index.top + 1)))))
    start = start.withColumns({f"c{c}": cell_of(index, c, 0.0) for c in "xyz"}).join(full, cells)
    start = start.groupBy(*place).agg(F.min(F.struct(*cells)).alias("s")).select(*place, "s.*")
    held, blocks = in_parts(index), blocks_of(queries.sparkSession, index)
    kind = index.stored.schema
    reach = in_blocks(start.withColumn("r", F.lit(float("inf"))), blocks).join(held, cells).select("places", "points").mapInArrow(reaches(need), "x double, y double, z double, nth double, most double")
    # A part's own nth place is no nearer than the cell's, so the least of these is far enough; where every part has too few, the farthest place is.
    reach = reach.groupBy(*place).agg(F.coalesce(F.min("nth"), F.max("most")).alias("d2")).withColumn("r", F.sqrt("d2") * (1 + 1e-9) + 1e-12)
    if max_dist is not None:
        reach = reach.withColumn("r", F.least("r", F.lit(float(max_dist))))
    near = around_places(reach, index)
    near = near.mapInArrow(nearest(k), "x double, y double, z double, " + ", ".join(f"{c} {kind[c].dataType.simpleString()}" for c in ("point_id", "m_x", "m_y", "m_z")) + ", d2 double")
    if max_dist is not None:
        near = near.where(F.col("d2") <= max_dist * max_dist)
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("d2", "m_x", "point_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return queries.join(near, place).select("query_id", *near.columns, *(c for c in queries.columns if c not in ("query_id", *place)))


def box_join(boxes: DataFrame, points: DataFrame, size: float = 5.0) -> DataFrame:
    """Pairs of a box (box_id, x0, x1, y0, y1, z0, z1) and a point in it: lower faces belong to it, upper ones don't.

    A box is looked up in cells no smaller than itself, of size, twice size and so on, so it has at most eight; a point is sent once for each
    of the sizes that boxes need. Empty boxes hold nothing.
    """
    extent = F.greatest(*(F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"))
    left = boxes.where(F.least(*(F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz")) > 0)
    left = left.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(extent / size)).cast("int")))
    levels = [r[0] for r in left.select("_level").distinct().collect()]  # one a power of two
    side = size * F.pow(F.lit(2.0), F.col("_level"))
    for c in "xyz":
        left = left.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / side), F.floor(F.col(f"{c}1") / side))))
    right = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    right = right.withColumns({f"c{c}": F.floor(F.col(c) / side) for c in "xyz"})
    rows = left.join(right, ["_level", "cx", "cy", "cz"])
    for c in "xyz":
        rows = rows.where((F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1")))
    return rows.drop("_level", "cx", "cy", "cz")


def voxel_centroid(points: DataFrame, size: float) -> DataFrame:
    return in_cells(points, size).groupBy("scan_id", "cx", "cy", "cz").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("x", "y", "z", "intensity")))


def voxel_keep_center(stored: DataFrame, new: DataFrame, size: float) -> DataFrame:
    """stored and new points (point_id, x, y, z): of each voxel with a new point the one closest to its centre stays, a new one of equals; others stay all."""
    d2 = sum((F.col(c) - (F.col(f"c{c}") + 0.5) * size) ** 2 for c in "xyz")
    both = in_cells(stored.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1))), size)
    w = Window.partitionBy("cx", "cy", "cz")
    rows = both.withColumns({"touched": F.max("is_new").over(w), "rank": F.row_number().over(w.orderBy(d2, F.desc("is_new"), "point_id"))})
    return rows.where("touched = 0 or rank = 1").select("point_id", "x", "y", "z", "is_new")


def occupancy_raster(points: DataFrame, resolution: float, origin: tuple[float, float]) -> DataFrame:
    ix, iy = (F.floor((F.col(c) - o) / resolution).cast("int") for c, o in zip("xy", origin))
    return points.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count("*").alias("hits"))


def occupancy_classes(cells: DataFrame, occupied: float = 0.65, free: float = 0.196) -> DataFrame:
    """cells (p, from 0 to 1) with class: occupied above the first limit, free below the second, unknown between."""
    return cells.withColumn("class", F.when(F.col("p") > occupied, "occupied").when(F.col("p") < free, "free").otherwise("unknown"))


def map_extent(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in "xyz" for k, f in (("min", F.min), ("max", F.max))))
