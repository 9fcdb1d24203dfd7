"""Satellite-navigation sentences to fixes, headings and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waypath.operators.asof import last_seen


def nmea_fields(line: Column) -> Column:
    """Comma-separated fields before the checksum, which is not verified."""
    return F.split(F.substring_index(line, "*", 1), ",")


def nmea_degrees(value: Column, side: Column) -> Column:
    """ddmm.mmmm to degrees; south and west are negative."""
    v = value.try_cast("double")
    d = F.when(v >= 0, F.floor(v / 100)).otherwise(F.ceil(v / 100))
    return (d + (v - d * 100) / 60) * F.when(side.isin("S", "W"), -1.0).otherwise(1.0)


def parse_nmea(lines: DataFrame) -> DataFrame:
    """lines (sentence) with the type and the values of its kind, null elsewhere; malformed numbers are null."""
    p = nmea_fields(F.col("sentence"))
    rows = lines.where(F.col("sentence").startswith("$")).withColumn("p", p).withColumn("type", F.substr(F.element_at("p", 1), F.lit(2)))

    def field(i: int) -> Column:
        return F.get("p", F.lit(i))

    gga = F.col("type").isin("GNGGA", "GPGGA") & (F.size("p") >= 10)
    gst = F.col("type").isin("GNGST", "GPGST") & (F.size("p") >= 9)
    gsa = F.col("type").isin("GNGSA", "GPGSA") & (F.size("p") >= 17)
    heading = F.col("type").contains("HDT") | F.col("type").contains("THS")
    values = {
        "lat": F.when(gga, nmea_degrees(field(2), field(3))), "lon": F.when(gga, nmea_degrees(field(4), field(5))), "quality": F.when(gga, field(6).try_cast("int")), "alt": F.when(gga, field(9).try_cast("double")),
        "sigma_lat": F.when(gst, field(6).try_cast("double")), "sigma_lon": F.when(gst, field(7).try_cast("double")), "sigma_alt": F.when(gst, field(8).try_cast("double")),
        "hdop": F.when(gsa, field(16).try_cast("double")), "satellites": F.when(gsa, F.size(F.filter(F.slice("p", 4, 12), lambda s: s != ""))), "heading": F.when(heading, field(1).try_cast("double")),
    }
    return rows.withColumns(values).drop("p")


def heading_to_yaw(heading: Column, bias: float = 0.0) -> Column:
    """Degrees east of north to degrees north of east, in [-180, 180]."""
    y = 90 - heading + bias
    return F.when(y > 180, y - 360).when(y < -180, y + 360).otherwise(y)


def located(lines: DataFrame, sigmas: dict[str, float]) -> DataFrame:
    """The position sentences of lines, parsed, each with the errors (or those of sigmas) and the heading last received before it, found in one pass."""
    known = {c: F.when(F.col("sigma_lat").isNotNull(), F.col(c)) for c in sigmas} | {"heading": F.col("heading")}
    rows = last_seen(parse_nmea(lines), known, ("recv_us", "seq")).where("lat is not null")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in sigmas.items()})


def gnss_to_fix(lines: DataFrame) -> DataFrame:
    """A fix for each position sentence, with the error and heading last received before it."""
    sigmas = {"sigma_lat": 1.0, "sigma_lon": 1.0, "sigma_alt": 2.0}
    return located(lines, sigmas).select("vehicle_id", "seq", "recv_us", "lat", "lon", "alt", "quality", *sigmas, "heading", heading_to_yaw(F.col("heading"), 90 - 3.75).alias("yaw"))
