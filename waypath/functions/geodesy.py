"""Latitude and longitude (WGS84) to universal transverse Mercator coordinates and back, by the Krueger series; earth-centred coordinates and tangent planes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ROOT = 2 * N**0.5 / (1 + N)
#: Fixed coefficients of the series, to the third flattening's fourth power (below 0.1 micrometres beyond).
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
INVERSE = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
LATITUDE = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def series(terms: tuple[float, ...], f: Callable[[Column], Column], a: Column, g: Callable[[Column], Column] | None = None, b: Column | None = None) -> Column:
    parts = [k * f(2 * (i + 1) * a) * (F.lit(1.0) if g is None else g(2 * (i + 1) * b)) for i, k in enumerate(terms)]
    return sum(parts[1:], parts[0])


def utm_zone(lat: Column, lon: Column) -> Column:
    """1 to 60, with the wider zones of Norway and Svalbard; null outside -80 to 84 degrees (the caps have no zone)."""
    east = F.pmod(lon + 180, F.lit(360.0))
    zone = F.floor(east / 6).cast("int") + 1
    norway = lat.between(56, 63.999999999) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lon >= 0) & (lon < 42)
    north = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return F.when((lat >= -80) & (lat <= 84), F.when(norway, 32).when(svalbard, north).otherwise(zone))


def meridian(zone: Column) -> Column:
    return F.radians(6.0 * zone - 183)


def utm_forward(lat: Column, lon: Column) -> Column:
    """struct<zone, north, x, y>; south of the equator y has 10,000,000 added. All null outside the zones."""
    zone = utm_zone(lat, lon)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - ROOT * F.atanh(ROOT * s))
    away = F.radians(lon) - meridian(zone)
    xi = F.atan2(t, F.cos(away))
    eta = F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x = 500_000 + SCALE * RADIUS * (eta + series(FORWARD, F.cos, xi, F.sinh, eta))
    y = SCALE * RADIUS * (xi + series(FORWARD, F.sin, xi, F.cosh, eta)) + F.when(lat < 0, 1e7).otherwise(0.0)
    return F.struct(zone.alias("zone"), F.when(zone.isNotNull(), lat >= 0).alias("north"), x.alias("x"), y.alias("y"))


def utm_inverse(zone: Column, north: Column, x: Column, y: Column) -> Column:
    """struct<lat, lon> in degrees."""
    xi = (y - F.when(north, 0.0).otherwise(1e7)) / (SCALE * RADIUS)
    eta = (x - 500_000) / (SCALE * RADIUS)
    a = xi - series(INVERSE, F.sin, xi, F.cosh, eta)
    b = eta - series(INVERSE, F.cos, xi, F.sinh, eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi + series(LATITUDE, F.sin, chi)
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(meridian(zone) + F.atan2(F.sinh(b), F.cos(a))).alias("lon"))


#: Scale and false origin of the polar caps' projection.
CAP_SCALE, CAP_ORIGIN = 0.994, 2_000_000.0
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Distance from the pole per unit of the tangent of half the conformal co-latitude.
CAP_RADIUS = 2 * A * CAP_SCALE / math.sqrt((1 + ECCENTRICITY) ** (1 + ECCENTRICITY) * (1 - ECCENTRICITY) ** (1 - ECCENTRICITY))


def ups_forward(lat: Column, lon: Column) -> Column:
    """struct<zone, north, x, y> by polar stereographic projection, zone 0; north by the sign of lat."""
    s = F.sin(F.radians(F.abs(lat)))
    t = F.sqrt((1 - s) / (1 + s)) * F.pow((1 + ECCENTRICITY * s) / (1 - ECCENTRICITY * s), F.lit(ECCENTRICITY / 2))
    rho = CAP_RADIUS * t
    y = F.when(lat >= 0, -rho * F.cos(F.radians(lon))).otherwise(rho * F.cos(F.radians(lon)))
    return F.struct(F.lit(0).alias("zone"), (lat >= 0).alias("north"), (CAP_ORIGIN + rho * F.sin(F.radians(lon))).alias("x"), (CAP_ORIGIN + y).alias("y"))


def grid_forward(lat: Column, lon: Column) -> Column:
    """utm_forward between -80 and 84 degrees, ups_forward (zone 0) beyond; null out of range."""
    utm, ok = utm_forward(lat, lon), (F.abs(lat) <= 90) & lon.isNotNull()
    return F.when(ok, F.when((lat >= -80) & (lat < 84), utm).otherwise(ups_forward(lat, lon)))


def grid_inverse(zone: Column, north: Column, x: Column, y: Column) -> Column:
    """struct<lat, lon> of grid_forward's results; on a cap's antimeridian lon is -180."""
    dx, dy = x - CAP_ORIGIN, F.when(north, CAP_ORIGIN - y).otherwise(y - CAP_ORIGIN)
    chi = math.pi / 2 - 2 * F.atan(F.sqrt(dx * dx + dy * dy) / CAP_RADIUS)
    lat = chi + series(LATITUDE, F.sin, chi)
    cap = F.struct((F.degrees(lat) * F.when(north, 1.0).otherwise(-1.0)).alias("lat"), F.when((dx == 0) & (dy < 0), -180.0).otherwise(F.degrees(F.atan2(dx, dy))).alias("lon"))
    return F.when(zone == 0, cap).otherwise(utm_inverse(zone, north, x, y))


def with_grid(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with zone, north, grid_x and grid_y, as grid_forward gives them.

    Step by step, so that no expression holds another many times over: for use where the coordinates come from long expressions themselves.
    """
    la, lo = F.col(lat), F.col(lon)
    df = df.withColumns({"_s": F.sin(F.radians(la)), "zone": F.when((la >= 84) & (la <= 90) | (la < -80) & (la >= -90), 0).otherwise(utm_zone(la, lo)), "north": la >= 0})
    df = df.withColumns({"_t": F.sinh(F.atanh("_s") - ROOT * F.atanh(ROOT * F.col("_s"))), "_away": F.radians(lo) - meridian(F.col("zone")), "_a": F.abs("_s")})
    df = df.withColumns({"_xi": F.atan2("_t", F.cos("_away")), "_eta": F.atanh(F.sin("_away") / F.sqrt(1 + F.col("_t") * F.col("_t")))})
    rho = CAP_RADIUS * F.sqrt((1 - F.col("_a")) / (1 + F.col("_a"))) * F.pow((1 + ECCENTRICITY * F.col("_a")) / (1 - ECCENTRICITY * F.col("_a")), F.lit(ECCENTRICITY / 2))
    xi, eta, cap = F.col("_xi"), F.col("_eta"), F.col("zone") == 0
    x = 500_000 + SCALE * RADIUS * (eta + series(FORWARD, F.cos, xi, F.sinh, eta))
    y = SCALE * RADIUS * (xi + series(FORWARD, F.sin, xi, F.cosh, eta)) + F.when(la < 0, 1e7).otherwise(0.0)
    df = df.withColumn("_rho", rho)
    known = F.col("zone").isNotNull() & lo.isNotNull()
    polar_y = F.when(F.col("north"), -F.col("_rho")).otherwise(F.col("_rho")) * F.cos(F.radians(lo))
    df = df.withColumns({"grid_x": F.when(known, F.when(cap, CAP_ORIGIN + F.col("_rho") * F.sin(F.radians(lo))).otherwise(x)), "grid_y": F.when(known, F.when(cap, CAP_ORIGIN + polar_y).otherwise(y))})
    return df.drop("_s", "_t", "_a", "_away", "_xi", "_eta", "_rho")


E2 = FLATTENING * (2 - FLATTENING)


def geocentric(lat: Column, lon: Column, height: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """Earth-centred x, y, z in metres."""
    la, lo = F.radians(lat), F.radians(lon)
    normal = A / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    return (normal + height) * F.cos(la) * F.cos(lo), (normal + height) * F.cos(la) * F.sin(lo), (normal * (1 - E2) + height) * F.sin(la)


def geodetic(x: Column, y: Column, z: Column) -> Column:
    """struct<lat, lon, height> of earth-centred coordinates. Three rounds of Bowring's formula: below a micrometre up to satellites' heights; not at the earth's centre.

    Names come from arrays of one, so that no expression holds another many times over.
    """
    b = A * (1 - FLATTENING)

    def latitude(p: Column, tan: Column) -> Column:
        return F.atan2(p["z"] + E2 / (1 - E2) * b * F.pow(F.sin(tan), 3), p["flat"] - E2 * A * F.pow(F.cos(tan), 3))

    def reduced(lat: Column) -> Column:
        return F.atan2((1 - FLATTENING) * F.sin(lat), F.cos(lat))

    def named(value: Column, f: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(value), f)[0]

    def place(p: Column) -> Column:
        tan = F.aggregate(F.sequence(F.lit(1), F.lit(2)), F.atan2(p["z"] * A, p["flat"] * b), lambda t, _: named(latitude(p, t), reduced))

        def shown(lat: Column) -> Column:
            height = p["flat"] * F.cos(lat) + p["z"] * F.sin(lat) - A * F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
            return F.struct(F.degrees(lat).alias("lat"), p["lon"].alias("lon"), height.alias("height"))

        return named(named(tan, lambda t: latitude(p, t)), shown)

    return named(F.struct(F.sqrt(x * x + y * y).alias("flat"), z.alias("z"), F.degrees(F.atan2(y, x)).alias("lon")), place)


def tangent_axes(lat: Column, lon: Column) -> tuple[tuple[Column, Column, Column], ...]:
    """East, north and up at a place, as earth-centred directions."""
    s, c, so, co = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))
    return (-so, co, F.lit(0.0)), (-s * co, -s * so, c), (c * co, c * so, s)


def tangent_forward(at: tuple[Column, Column, Column], lat0: Column, lon0: Column) -> tuple[Column, ...]:
    """East, north and up in the plane that touches the ellipsoid at lat0, lon0, of an earth-centred place."""
    d = [a - o for a, o in zip(at, geocentric(lat0, lon0))]
    return tuple(axis[0] * d[0] + axis[1] * d[1] + axis[2] * d[2] for axis in tangent_axes(lat0, lon0))


def tangent_inverse(east: Column, north: Column, up: Column, lat0: Column, lon0: Column) -> tuple[Column, ...]:
    """The earth-centred place of east, north and up."""
    e, n, u = tangent_axes(lat0, lon0)
    return tuple(o + e[i] * east + n[i] * north + u[i] * up for i, o in enumerate(geocentric(lat0, lon0)))
