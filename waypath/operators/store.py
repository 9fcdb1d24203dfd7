"""Deletion and restoring of map points, as flags of the map table (point_id, x, y, z, deleted, downsampled)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.operators.spatial import box_join
from waypath.streaming.runs import shared_folder


def _hit(points: DataFrame, boxes: DataFrame) -> DataFrame:
    return box_join(boxes, points.select("point_id", "x", "y", "z")).select("point_id").distinct().withColumn("_hit", F.lit(True))


def delete_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points in any of the half-open boxes are deleted; newly is true for those that were not before."""
    rows = points.join(_hit(points, boxes), "point_id", "left").withColumn("newly", F.col("_hit").isNotNull() & ~F.col("deleted"))
    return rows.withColumn("deleted", F.col("deleted") | F.col("_hit").isNotNull()).drop("_hit")


def restore_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Deleted points in the boxes come back, except those that down-sampling removed."""
    rows = points.join(_hit(points, boxes), "point_id", "left")
    return rows.withColumn("deleted", F.col("deleted") & (F.col("_hit").isNull() | F.col("downsampled"))).drop("_hit")


def removed_points(points: DataFrame) -> DataFrame:
    return points.where("deleted and not downsampled")


def candidates(points: DataFrame, places: DataFrame, eps: float) -> DataFrame:
    """(place, point_id, d2) of the live points within eps on every axis of each place (place, qx, qy, qz)."""
    size = max(1e-3, 2 * eps)
    asked = places
    for c in "xyz":
        cells = F.array_distinct(F.array(F.floor((F.col(f"q{c}") - eps) / size), F.floor((F.col(f"q{c}") + eps) / size)))
        asked = asked.withColumn(f"c{c}", F.explode(cells))
    live = points.where("not deleted").select("point_id", "x", "y", "z", *(F.floor(F.col(c) / size).alias(f"c{c}") for c in "xyz"))
    near = asked.join(live, ["cx", "cy", "cz"])
    for c in "xyz":
        near = near.where(F.abs(F.col(c) - F.col(f"q{c}")) <= eps)
    d2 = sum(((F.col(c) - F.col(f"q{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("qx")) ** 2)
    return near.select("place", "point_id", d2.alias("d2"))


def meeting(near: DataFrame, steps: int = 2) -> DataFrame:
    """(place, tile) of the places of near (place, point_id): places that have a point in common, or each one with a third, mostly share a tile."""
    tiles = near.select("place").distinct().withColumn("tile", F.xxhash64("place"))
    for _ in range(steps):
        points = near.join(tiles, "place").groupBy("point_id").agg(F.min("tile").alias("tile"))
        tiles = near.join(points, "point_id").groupBy("place").agg(F.min("tile").alias("tile"))
    return tiles


def looped(asked: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """The loop over requests (request_id, place) by request_id: each takes the first point (place, point_id, d2, other) of its list that neither it nor an earlier one holds."""
    lists = lists.sort_values(["place", "d2", "point_id"])
    own = {place: (g["point_id"].tolist(), g["other"].tolist()) for place, g in lists.groupby("place", sort=False)}
    at, taken = dict.fromkeys(own, 0), {}
    asked = asked.sort_values("request_id")
    for request, place in zip(asked["request_id"].tolist(), asked["place"].tolist()):
        points, others = own.get(place, ([], []))
        i = at.get(place, 0)
        while i < len(points) and (points[i] in taken or others[i] < request):
            i += 1
        if i < len(points):
            taken[points[i]] = request
        at[place] = i + 1
    return pd.DataFrame({"point_id": list(taken.keys()), "request_id": list(taken.values())}, dtype="int64")


def assigned(requests: DataFrame, near: DataFrame, tile: Column | None = None) -> DataFrame:
    """(point_id, request_id): what a loop over the requests by request_id gives in which each takes the first point of its place's list that is left.

    requests: request_id, place. near: place, point_id, d2, a list by d2, then point_id. tile is an expression of place; a task loops over the requests of a tile. A point
    keeps the least request_id of those that ever took it, and a tile whose requests lost points to another's loops again, until nothing changes. A point is only ever
    taken over by earlier requests, so this has one outcome, that of the loop. Rounds follow only where tiles compete for points.
    """
    spark, number = requests.sparkSession, F.xxhash64("place") if tile is None else tile
    asked = requests.select(number.alias("tile"), "request_id", F.col("place").cast("string").alias("place"))
    lists = near.select(number.alias("tile"), F.col("place").cast("string").alias("place"), "point_id", "d2")
    kinds = f"tile {dict(asked.dtypes)['tile']}, point_id long, request_id long"

    def settle(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = looped(left, right)
        out.insert(0, "tile", pd.Series([key[0]] * len(out)))
        return out

    kept = None
    while True:
        held = lists.withColumn("holder", F.lit(None).cast("long")) if kept is None else lists.join(kept.select("point_id", F.col("request_id").alias("holder"), F.col("tile").alias("_of")), "point_id", "left")
        other = F.lit(None).cast("long") if kept is None else F.when(F.col("_of") != F.col("tile"), F.col("holder"))
        held = held.select("tile", "place", "point_id", "d2", F.coalesce(other, F.lit(2**63 - 1)).alias("other"))
        found = asked.groupBy("tile").cogroup(held.groupBy("tile")).applyInPandas(settle, kinds).withColumn("new", F.lit(True))
        both = found if kept is None else kept.withColumn("new", F.lit(False)).unionByName(found)
        # Of equal claims the one known before counts, so that a round without changes has no new ones.
        best = both.groupBy("point_id").agg(F.min(F.struct("request_id", "new", "tile")).alias("b")).select("point_id", "b.*")
        path = shared_folder(spark, "assigned")
        best.write.parquet(path)
        best = spark.read.schema(best.schema).parquet(path)
        kept = best.drop("new")
        if best.where("new").isEmpty():
            return kept.drop("tile")


def delete_points(points: DataFrame, requests: DataFrame, eps: float = 1e-6) -> DataFrame:
    """points of which, for each request (request_id, x, y, z) in the order of request_id, one live point within eps on every axis is deleted.

    It is the nearest that no earlier request took, then the one of least point_id. Requests without any left delete nothing.
    """
    asked = requests.select("request_id", F.struct(*((F.col(c).cast("double") + 0.0).alias(f"q{c}") for c in "xyz")).alias("place"))
    path = shared_folder(points.sparkSession, "candidates")
    near = candidates(points, asked.select("place").distinct().select("place", "place.*"), eps)
    near.write.parquet(path)
    near = points.sparkSession.read.schema(near.schema).parquet(path)
    tiles = shared_folder(points.sparkSession, "tiles")
    meeting(near).write.parquet(tiles)
    tiles = points.sparkSession.read.schema("place struct<qx:double,qy:double,qz:double>, tile long").parquet(tiles)
    gone = assigned(asked.join(tiles, "place"), near.join(tiles, "place"), F.col("tile")).select("point_id", F.lit(True).alias("_hit"))
    return points.join(gone, "point_id", "left").withColumn("deleted", F.col("deleted") | F.col("_hit").isNotNull()).drop("_hit")
