"""As-of joins and what was last seen, in ranges of time: no task holds a whole run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a range of time: a second, which holds about a thousand rows of the fastest sensors, and still few where many of them share a key.
SPAN_US = 1_000_000


def asof_nearest(left: DataFrame, right: DataFrame, tolerance_us: int, name: str, key: str = "vehicle_id", span_us: int = SPAN_US) -> DataFrame:
    """left with a struct column `name`: the row of right nearest in t_us, at most tolerance_us away, or null.

    The later of two equally near rows wins, and of rows with one time the last by seq. Both have key, t_us, seq. Time is cut in ranges of span_us; a row of
    right goes to every range that it may be near to, so each range is settled by itself.
    """
    payload = F.struct(*[F.col(c) for c in right.columns if c != key])
    kind = right.select(payload.alias("p")).schema["p"].dataType
    tagged = left.withColumns({"_tag": F.lit(0), "_span": F.floor(F.col("t_us") / span_us), name: F.lit(None).cast(kind)})
    spans = F.explode(F.sequence(F.floor((F.col("t_us") - tolerance_us) / span_us), F.floor((F.col("t_us") + tolerance_us) / span_us)))
    tagged = tagged.unionByName(right.select(key, "t_us", "seq", F.lit(1).alias("_tag"), spans.alias("_span"), payload.alias(name)), allowMissingColumns=True)
    back = Window.partitionBy(key, "_span").orderBy("t_us", "_tag", "seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key, "_span").orderBy(F.desc("t_us"), F.desc("_tag"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    tagged = tagged.withColumns({"_b": F.last(name, ignorenulls=True).over(back), "_a": F.last(name, ignorenulls=True).over(ahead)})
    to_b, to_a = F.col("t_us") - F.col("_b.t_us"), F.col("_a.t_us") - F.col("t_us")
    best = F.when(F.coalesce(to_a <= to_b, F.col("_b").isNull()), F.col("_a")).otherwise(F.col("_b"))
    near = F.when(F.abs(best["t_us"] - F.col("t_us")) <= tolerance_us, best)
    return tagged.where("_tag = 0").withColumn(name, near).drop("_tag", "_span", "_a", "_b")


def last_seen(rows: DataFrame, values: dict[str, Column], order: tuple[str, ...] = ("t_us", "seq"), key: str = "vehicle_id", before: bool = False, span_us: int = SPAN_US) -> DataFrame:
    """rows with each value as last seen (not null) in its key up to the row, or before the row itself.

    order starts with a time in microseconds. A range of time hands on what it saw last; only these, one row a range, are ordered by whole runs.
    """
    held = rows.withColumns({"_span": F.coalesce(F.floor(F.col(order[0]) / span_us), F.lit(-(2**62))), **{f"_v_{c}": v for c, v in values.items()}})
    at = F.struct(*order)
    seen = held.groupBy(key, "_span").agg(*(F.max_by(F.when(F.col(f"_v_{c}").isNotNull(), F.col(f"_v_{c}")), F.when(F.col(f"_v_{c}").isNotNull(), at)).alias(f"_s_{c}") for c in values))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.select(key, "_span", *(F.last(f"_s_{c}", ignorenulls=True).over(earlier).alias(f"_s_{c}") for c in values))
    w = Window.partitionBy(key, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    held = held.withColumns({f"_v_{c}": F.last(f"_v_{c}", ignorenulls=True).over(w) for c in values}).join(seen, [key, "_span"], "left")
    out = {c: F.coalesce(f"_v_{c}", f"_s_{c}") for c in values}
    return held.withColumns(out).drop("_span", *(f"_{k}_{c}" for k in "vs" for c in values))


def running_sum(rows: DataFrame, name: str, value: Column, order: tuple[str, ...] = ("t_us", "seq"), key: str = "vehicle_id", span_us: int = SPAN_US) -> DataFrame:
    """rows with the sum of value over its key up to the row: by ranges of time, then within a range. Nulls add nothing."""
    held = rows.withColumns({"_span": F.floor(F.col(order[0]) / span_us), "_v": value})
    sums = held.groupBy(key, "_span").agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("_own"))
    sums = sums.select(key, "_span", (F.sum("_own").over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own")).alias("_before"))
    w = Window.partitionBy(key, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_v", F.coalesce(F.sum("_v").over(w), F.lit(0))).join(sums, [key, "_span"], "left")
    return held.withColumn(name, F.col("_v") + F.coalesce("_before", F.lit(0))).drop("_span", "_v", "_before")


def nth_row(rows: DataFrame, rank: Callable[[Column], Column], order: tuple[str, ...] = ("t_us", "seq"), key: str = "vehicle_id", span_us: int = SPAN_US) -> DataFrame:
    """Of each key the row at place rank(n) of its n rows, counted from 1, in the order. Ranges of time are counted; only the rows of the range that holds the place are ordered."""
    held = rows.withColumn("_span", F.coalesce(F.floor(F.col(order[0]) / span_us), F.lit(-(2**62))))
    runs = Window.partitionBy(key)
    counts = held.groupBy(key, "_span").agg(F.count("*").alias("_own"))
    counts = counts.withColumns({"_upto": F.sum("_own").over(runs.orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)), "_rank": rank(F.sum("_own").over(runs)).cast("long")})
    chosen = counts.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_own"))).select(key, "_span", (F.col("_rank") - F.col("_upto") + F.col("_own")).alias("_rank"))
    inside = F.row_number().over(Window.partitionBy(key, "_span").orderBy(*order))
    return held.join(chosen, [key, "_span"]).withColumn("_i", inside).where("_i = _rank").drop("_i", "_rank", "_span")


def asof_backward_state(events: DataFrame, state: str, keep: dict[str, object], key: str = "vehicle_id") -> DataFrame:
    """events with each column of keep as last seen in rows where `state` held, up to the row; the dict's value before any."""
    rows = last_seen(events, {c: F.when(F.expr(state), F.col(c)) for c in keep}, ("recv_us", "seq"), key)
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in keep.items() if v is not None})
