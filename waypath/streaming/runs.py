"""Streams to tables: what a stream gives once all input there is has been taken."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypath.plans.fixtures import SOURCE, table_of


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; of this machine only where all of Spark runs on it."""
    base, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    base = base or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of fixtures as a stream of its source's files."""
    path = f"{sf_dir}/{SOURCE.get(name, 'events')}.parquet"
    files = f"{path.removesuffix('.parquet')}[.]parquet"  # a pattern, as a single file can't be a stream's folder
    return table_of(spark, name, spark.readStream.schema(spark.read.parquet(path).schema).parquet(files))


STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A time after all others, and a whole number of periods: 2096.
END_US = 4_000_000_000_000_000


def needs_rocksdb(spark: SparkSession) -> None:
    """Timers and lists in the state need Spark's RocksDB store; it is chosen where the session has none of its own."""
    if not spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKSDB)


class Ending:
    """A stream that can be ended: after its input a row with the time END_US, and no key, lets the watermark pass all rows.

    stream is the one given and that row's; settled() writes the row once the input has been taken.
    """

    def __init__(self, stream: DataFrame, key: str, time: str = "t_us"):
        spark, self.path = stream.sparkSession, shared_folder(stream.sparkSession, "end")
        self.row = spark.range(1).select(*(self.value(c, t, key, time).cast(t).alias(c) for c, t in stream.dtypes))
        self.row.where("false").write.parquet(self.path)
        self.stream = stream.unionByName(spark.readStream.schema(stream.schema).parquet(self.path))

    @staticmethod
    def value(name: str, kind: str, key: str, time: str) -> Column:
        """Numbers are 0 and texts begin like sentences, so that no condition on them takes the row out before its time is seen."""
        if name == time:
            return F.lit(END_US)
        return F.lit(None if name == key else "$" if kind == "string" else 0 if kind in ("int", "bigint", "double", "float") else None)

    def write(self) -> None:
        self.row.coalesce(1).write.mode("append").parquet(self.path)


def settled(stream: DataFrame, name: str, end: Ending | None = None) -> DataFrame:
    """The rows that a stream appends while it takes all its input, and, with an end, when it is over."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, name)

    def run() -> None:
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start(path).awaitTermination()

    run()
    if end:
        end.write()
        run()
    return spark.read.schema(stream.schema).parquet(path)
