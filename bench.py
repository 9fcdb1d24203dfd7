"""Times headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR, warm, median of three (of one where a run takes over 15 s), and prints one JSON line.

Operators on points, packets and map points read fixtures that are written before, so that the fixtures' own cost is left out.
"""

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", folder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from waypath.operators import cloud, lidar, motion, spatial
    from waypath.plans.fixtures import table
    from waypath.registry import QUERIES, map_points, packets_of

    def fixed(name, df):
        df.repartition(int(CPUS)).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    points = fixed("points", table(spark, SF, "fx_points"))
    packets = fixed("packets", packets_of(spark, SF))
    stored = fixed("map", map_points(spark, SF).drop("label"))
    zero, one, th = F.lit(0.0), F.lit(1.0), F.col("y") / 25
    knots = fixed("knots", points.where("tag < 2").select("scan_id", "seq", F.col("time_s").alias("t"), F.array(F.col("x") / 10, zero, zero).alias("acc"), F.array(zero, zero, F.col("intensity") / 50).alias("gyr"), F.array(F.col("z"), zero, zero).alias("vel"), F.array(F.col("y"), zero, zero).alias("pos"), F.array(F.cos(th), -F.sin(th), zero, F.sin(th), F.cos(th), zero, zero, zero, one).alias("rot")))
    asked = points.where("scan_id % 10 = 0").select(F.struct("scan_id", "seq").alias("query_id"), *((F.col(c) / 5).alias(c) for c in "xyz"))
    new = points.select(F.xxhash64("scan_id", "seq").alias("point_id"), "x", "y", "z")
    runs = {
        "evaluate_fusion": (lambda: QUERIES["evaluate_fusion"](spark, SF), None, ""),
        "clean_scan": (lambda: cloud.clean_scan(points, 2, 2.0), points, "points"),
        "clean_scan_and_undistort": (lambda: motion.undistort(cloud.clean_scan(points, 2, 2.0).withColumn("t", F.col("time_s")), knots), points, "points"),
        "knn_join": (lambda: spatial.knn_join(asked, stored, 5), asked, "queries"),
        "voxel_keep_center": (lambda: spatial.voxel_keep_center(stored, new, 0.4), new, "points"),
        "voxel_centroid": (lambda: spatial.voxel_centroid(points, 2.0), points, "points"),
        "radius_join": (lambda: spatial.radius_join(asked, stored, 1.5), asked, "queries"),
        "decode_lidar_packets": (lambda: lidar.decode_lidar_packets(packets), packets, "packets"),
        "gnss_to_fix": (lambda: QUERIES["gnss_to_fix"](spark, SF), None, ""),
    }
    times, rates = {}, {}
    for name, (make, rows, what) in runs.items():
        took = []
        for _ in range(4):  # the first one warms up
            start = time.time()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
            if len(took) == 2 and sum(took) > 30:
                break  # a long one: warm, but once
        times[name] = round(statistics.median(took[1:]), 3)
        if rows is not None:
            rates[name] = f"{rows.count() / times[name]:.0f} {what}/s"
        print(name, times[name], rates.get(name, ""), file=sys.stderr, flush=True)
    print(json.dumps({"metric": "seconds of headline queries, warm, median of three", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates": rates, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
