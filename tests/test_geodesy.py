"""Earth-centred coordinates and tangent planes: known places, round trips, and a map on both sides of a grid's border."""

import math

from pyspark.sql import functions as F

from waypath.functions import geodesy
from waypath.operators import mapping


def test_known_places(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (90.0, 10.0, 0.0), (-90.0, 0.0, 100.0), (0.0, 90.0, 5.0), (48.8562, 2.3508, 67.4)], "lat double, lon double, h double")
    want = [(6378137.0, 0, 0), (0, 0, 6356752.314245), (0, 0, -6356852.314245), (0, 6378142.0, 0), (4200996.7896, 172460.3215, 4780102.8309)]
    out = rows.select("*", *(c.alias(n) for n, c in zip("xyz", geodesy.geocentric(F.col("lat"), F.col("lon"), F.col("h"))))).collect()
    assert all(abs(a - b) < 1e-3 for r, w in zip(out, want) for a, b in zip((r.x, r.y, r.z), w))


def test_round_trips(spark):
    rows = spark.range(400).select((F.col("id") * 0.449 - 89.8).alias("lat"), (F.col("id") * 7.77 % 360 - 180).alias("lon"), (F.col("id") * 53.0 % 9000 - 400).alias("h"))
    place = rows.select("*", *(c.alias(n) for n, c in zip("xyz", geodesy.geocentric(F.col("lat"), F.col("lon"), F.col("h")))))
    back = place.select("*", geodesy.geodetic(F.col("x"), F.col("y"), F.col("z")).alias("g")).agg(*(F.max(F.abs(F.col(f"g.{a}") - F.col(b))) for a, b in (("lat", "lat"), ("lon", "lon"), ("height", "h")))).first()
    assert back[0] < 1e-11 and back[1] < 1e-11 and back[2] < 1e-6
    o = (F.lit(23.5), F.lit(114.0))
    plane = place.where("lat between 23 and 24").select("x", "y", "z", *(c.alias(n) for n, c in zip("enu", geodesy.tangent_forward((F.col("x"), F.col("y"), F.col("z")), *o))))
    again = plane.select(*((c - F.col(n)).alias(n) for n, c in zip("xyz", geodesy.tangent_inverse(F.col("e"), F.col("n"), F.col("u"), *o)))).collect()
    assert again and all(abs(v) < 1e-6 for r in again for v in r)


def test_fit_across_a_border(spark):
    """Trees 40 km apart around the meridian between two zones, turned and shifted; rows without coordinates have no part."""
    turn, trees = math.radians(170), []
    for i in range(60):
        e, n = (i % 8 - 4) * 5000.0 + i, (i // 8 - 4) * 700.0 - i
        x, y = math.cos(turn) * (e - 30) + math.sin(turn) * (n + 12), -math.sin(turn) * (e - 30) + math.cos(turn) * (n + 12)
        trees.append((i, x, y, e, n))
    df = spark.createDataFrame(trees, "tree_id long, x double, y double, e double, n double")
    up = -(F.col("e") * F.col("e") + F.col("n") * F.col("n")) / (2 * geodesy.A)
    df = df.select("*", geodesy.geodetic(*geodesy.tangent_inverse(F.col("e"), F.col("n"), up, F.lit(23.59), F.lit(114.0))).alias("g")).select("tree_id", "x", "y", "g.lat", "g.lon")
    df = df.unionByName(spark.createDataFrame([(-1, 1.0, 1.0, None, 3.0)], df.schema))
    fit = mapping.georeference_fit(df).first()
    # Up to the angle between the planes at the first tree and at the place used here, some metres at 20 km.
    assert fit.trees == 60 and abs(math.degrees(fit.turn) - 170) < 0.1 and abs(fit.scale - 1) < 1e-4 and fit.residual < 1
    placed = mapping.georeference(df.where("tree_id >= 0").withColumnsRenamed({"lat": "a", "lon": "b"}), mapping.georeference_fit(df))
    off = placed.agg(F.max(F.abs(F.col("lat") - F.col("a")) * 111_000), F.max(F.abs(F.col("lon") - F.col("b")) * 102_000), F.count_if(F.col("b") < 114), F.count_if(F.col("b") >= 114)).first()
    assert off[0] < 2 and off[1] < 2 and off[2] > 20 and off[3] > 20


def test_caps_antimeridian_has_one_sign(spark):
    places = spark.range(600).select((84 + F.col("id") / 100).alias("lat"), F.lit(-180.0).alias("lon"))
    u = places.select(geodesy.grid_forward(F.col("lat"), F.col("lon")).alias("u"))
    lons = [r.lon for r in u.select(geodesy.grid_inverse(*(F.col(f"u.{c}") for c in ("zone", "north", "x", "y")))["lon"].alias("lon")).collect()]
    assert len(lons) == 600 and max(lons) < -179.999999
