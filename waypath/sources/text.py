"""Text files: trajectories, navigation sentences, the tree inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSE = ("t", "x", "y", "z", "qx", "qy", "qz", "qw")
TREES = "Tree_ID int, Local_X double, Local_Y double, Latitude double, Longitude double"


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """run_id (the file) and the eight numbers of each line; comments and blank lines are left out, bad numbers are null."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    p = F.split(F.trim("value"), r"\s+")
    return lines.select(F.input_file_name().alias("run_id"), *(F.get(p, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(POSE)))


def write_tum(df: DataFrame, path: str, time_decimals: int = 9) -> None:
    """A folder of lines, in order of time, for each run_id."""
    line = F.format_string(f"%.{time_decimals}f" + " %.6f" * 7, *POSE)
    df.repartition("run_id").sortWithinPartitions("run_id", "t").select("run_id", line.alias("value")).write.partitionBy("run_id").text(path)


def read_nmea(spark: SparkSession, path: str) -> DataFrame:
    """Lines that start with $, as sentence."""
    return spark.read.text(path).select(F.rtrim("value").alias("sentence")).where(F.col("sentence").startswith("$"))


def read_tree_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREES).csv(path, header=True)


def write_cloud_by_interval(points: DataFrame, path: str, interval: int) -> None:
    """Scans in files of `interval` scans each; -1 puts all in one bucket."""
    bucket = F.lit(0) if interval < 0 else F.floor(F.col("scan_id") / interval)
    points.withColumn("file_bucket", bucket).write.partitionBy("file_bucket").parquet(path)


def read_messages(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """Messages of a table partitioned by topic; only the folders of the topics asked for are read."""
    rows = spark.read.parquet(path)
    return rows if topics is None else rows.where(F.col("topic").isin(topics))


def stream_nmea(spark: SparkSession, path: str) -> DataFrame:
    """read_nmea for files as they come."""
    return spark.readStream.text(path).select(F.rtrim("value").alias("sentence")).where(F.col("sentence").startswith("$"))
