"""Evaluation of trajectories: fusion errors, smoothness, outages, degradation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypath.functions.pose import quat, quat_rotate, quat_to_yaw, relative_translation, vec, wrap_pi
from waypath.operators.asof import asof_nearest, last_seen, nth_row, running_sum

ORDER = ("t_us", "seq")


def naive_fusion(truth: DataFrame, rtk: DataFrame, lio: DataFrame, rtk_us: int = 150_000, lio_us: int = 100_000) -> DataFrame:
    """truth with fused position fx, fy, fz: RTK where there is some, else dead reckoning from the last anchors.

    The odometry anchor moves only at rows that have both RTK and odometry, so the two anchors may be of different
    rows. Rows with neither RTK nor both anchors and odometry are left out.
    """
    pose = ["vehicle_id", "t_us", "seq", "x", "y", "z", "qx", "qy", "qz", "qw"]
    rows = asof_nearest(asof_nearest(truth.select(pose), rtk.select(pose), rtk_us, "rtk"), lio.select(pose), lio_us, "lio")
    rows = last_seen(rows, {"ra": F.col("rtk"), "la": F.when(F.col("rtk").isNotNull(), F.col("lio"))})
    step = quat_rotate(quat("ra."), relative_translation(vec("la."), quat("la."), vec("lio.")))
    fused = {f"f{c}": F.when(F.col("rtk").isNotNull(), F.col(f"rtk.{c}")).otherwise(F.col(f"ra.{c}") + s) for c, s in zip("xyz", step)}
    return rows.withColumns(fused).where("fx is not null").select("vehicle_id", "t_us", "seq", "x", "y", "z", "fx", "fy", "fz", F.col("rtk").isNotNull().alias("direct"))


def ape_stats(pairs: DataFrame) -> DataFrame:
    e = F.sqrt(sum((F.col(f"f{c}") - F.col(c)) ** 2 for c in "xyz"))
    return pairs.withColumn("e", e).groupBy("vehicle_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"), F.max("e").alias("max"))


def delta_columns(traj: DataFrame) -> DataFrame:
    """traj with dt, step (planar) and dyaw to the row before."""
    rows = traj.withColumn("yaw", quat_to_yaw(quat()))
    rows = last_seen(rows, {"_p": F.struct("t_us", "x", "y", "yaw")}, before=True)
    dx, dy = (F.col(c) - F.col(f"_p.{c}") for c in "xy")
    return rows.withColumns({"dt": (F.col("t_us") - F.col("_p.t_us")) / 1e6, "step": F.sqrt(dx * dx + dy * dy), "dyaw": wrap_pi(F.col("yaw") - F.col("_p.yaw"))}).drop("_p")


def path_summary(traj: DataFrame) -> DataFrame:
    """Length, end-to-end distance, closure and efficiency of runs of ten rows or more."""
    ends = {f"{c}{i}": f(F.col(c), F.struct(*ORDER)) for c in "xy" for i, f in ((0, F.min_by), (1, F.max_by))}
    run = delta_columns(traj).groupBy("vehicle_id").agg(F.count("*").alias("n"), F.sum("step").alias("length"), *(e.alias(k) for k, e in ends.items())).where("n >= 10")
    run = run.withColumn("distance", F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2))
    run = run.withColumn("closed", (F.col("distance") < 5) & (F.col("length") > 20))
    ratio = F.when(F.col("distance") == 0, 1.0).otherwise(F.col("length") / F.col("distance"))
    return run.select("vehicle_id", "n", "length", "distance", "closed", F.when(~F.col("closed"), ratio).alias("efficiency"))


def yaw_rate_stats(traj: DataFrame, min_dt: float = 0.05, max_rate: float = 3.0) -> DataFrame:
    rows = delta_columns(traj).where(F.col("dt") >= min_dt).withColumn("rate", F.abs(F.col("dyaw") / F.col("dt"))).where(F.col("rate") < max_rate)
    return rows.groupBy("vehicle_id").agg(F.count("*").alias("n"), F.avg("rate").alias("mean_rate"), F.stddev_pop("rate").alias("std_rate"))


def cumulative_distance(traj: DataFrame) -> DataFrame:
    return running_sum(delta_columns(traj), "travelled", F.col("step"))


def elapsed_since_first(msgs: DataFrame, key: tuple[str, ...] = ("vehicle_id", "topic")) -> DataFrame:
    """Microseconds since the first message of each run and topic in log order (seq)."""
    first = msgs.groupBy(*key).agg(F.min_by("t_us", "seq").alias("_first"))
    return msgs.join(first, list(key)).withColumn("elapsed_us", F.col("t_us") - F.col("_first")).drop("_first")


def simulate_outage(msgs: DataFrame, topic: str, keep_s: int = 20, drop_s: int = 10) -> DataFrame:
    """Messages of one topic only in the first keep_s of each keep_s + drop_s seconds from its first message; all others."""
    phase = F.pmod(F.col("elapsed_us"), F.lit((keep_s + drop_s) * 1_000_000))
    return elapsed_since_first(msgs).where((F.col("topic") != topic) | (phase < keep_s * 1_000_000)).drop("elapsed_us")


def outage_segments(msgs: DataFrame, gap_us: int) -> DataFrame:
    """Spans of over gap_us between messages of one run."""
    rows = last_seen(msgs, {"from_us": F.col("t_us")}, before=True)
    return rows.where(F.col("t_us") - F.col("from_us") > gap_us).select("vehicle_id", "from_us", F.col("t_us").alias("to_us"))


def signal_degradation(msgs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Onset (first standard deviation over the threshold, else the middle row's time) and extents before and overall."""
    rows = msgs.withColumn("std", F.sqrt(F.col("std_x") ** 2 + F.col("std_y") ** 2))
    over = rows.groupBy("vehicle_id").agg(F.min(F.when(F.col("std") > threshold, F.col("t_us"))).alias("over"))
    middle = nth_row(rows.select("vehicle_id", *ORDER), lambda n: F.floor(n / 2) + 1).select("vehicle_id", "t_us")
    rows = rows.join(over.join(middle, "vehicle_id").select("vehicle_id", F.coalesce("over", "t_us").alias("onset_us")), "vehicle_id")
    low = F.col("t_us") < F.col("onset_us")
    return rows.groupBy("vehicle_id", "onset_us").agg(F.count("*").alias("n"), F.count_if(low).alias("n_before"), F.max("std").alias("max_std"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.max(F.when(low, F.col("std"))).alias("max_std_before"))


def extract_ground_truth(msgs: DataFrame, lever: tuple[float, float, float]) -> DataFrame:
    """Positions moved from the antenna to the body: p - R(q) * lever; uncorrected where the quaternion is zero. Header times <= 0 go."""
    turned = quat_rotate(quat(), tuple(F.lit(float(v)) for v in lever))
    return msgs.where("t_us > 0").withColumns({c: F.coalesce(F.col(c) - t, F.col(c)) for c, t in zip("xyz", turned)})


def outage_counts(msgs: DataFrame, topic: str, keep_s: int = 20, drop_s: int = 10) -> DataFrame:
    """(vehicle_id, kept, dropped): how many messages of the topic a simulated outage keeps and drops."""
    phase = F.pmod(F.col("elapsed_us"), F.lit((keep_s + drop_s) * 1_000_000)) < keep_s * 1_000_000
    rows = elapsed_since_first(msgs.where(F.col("topic") == topic))
    return rows.groupBy("vehicle_id").agg(F.count_if(phase).alias("kept"), F.count_if(~phase).alias("dropped"))


def uncertainty_summary(msgs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Extents and largest deviation of each run, overall and before the onset, with the margins that a chart of them has.

    The margin of an axis is 15 % of its extent, or half a unit where that is nothing; deviations get 15 and 50 % more.
    """
    onset = signal_degradation(msgs, threshold).select("vehicle_id", "onset_us")
    rows = msgs.withColumn("std", F.sqrt(F.col("std_x") ** 2 + F.col("std_y") ** 2)).join(onset, "vehicle_id")
    low = F.col("t_us") < F.col("onset_us")
    own = [f(F.when(w, F.col(c))).alias(f"{n}_{c}{e}") for c in "xy" for n, f in (("min", F.min), ("max", F.max)) for w, e in ((F.lit(True), ""), (low, "_before"))]
    out = rows.groupBy("vehicle_id", "onset_us").agg(F.count("*").alias("n"), *own, F.max("std").alias("max_std"), F.max(F.when(low, F.col("std"))).alias("max_std_before"))
    for c in "xy":
        wide = F.col(f"max_{c}") - F.col(f"min_{c}")
        out = out.withColumn(f"margin_{c}", F.when(wide > 0, wide * 0.15).otherwise(0.5))
    return out.withColumns({"top": F.col("max_std") * 1.15, "top_before": F.col("max_std_before") * 1.5})


def unpack_covariance(msgs: DataFrame) -> DataFrame:
    """msgs (covariance, 36 numbers) with std: the root of the first two variances' sum."""
    return msgs.withColumn("std", F.sqrt(F.get("covariance", F.lit(0)) + F.get("covariance", F.lit(7))))


def throttle(rows: DataFrame, period_us: int = 1_000_000, key: str = "vehicle_id") -> DataFrame:
    """The first row (by t_us, then seq) of each period of each key."""
    names = [F.col(c) for c in rows.columns]
    first = F.min_by(F.struct(*names), F.struct("t_us", "seq")).alias("r")
    return rows.groupBy(key, F.floor(F.col("t_us") / period_us).alias("_period")).agg(first).select("r.*")


def evaluate_navigation(traj: DataFrame) -> DataFrame:
    """path_summary with yaw_rate_stats (null without usable steps) of each run of ten rows or more."""
    rates = yaw_rate_stats(traj).withColumnRenamed("n", "n_rates")
    return path_summary(traj).join(rates, "vehicle_id", "left")
