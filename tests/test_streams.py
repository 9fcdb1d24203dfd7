"""Streams of rows in any order and any number of micro-batches, against the same rows in one batch."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waypath.operators import gnss, trajectory
from waypath.plans.fixtures import table
from waypath.streaming import operators
from waypath.streaming.runs import Ending, settled

SF = "/root/testdata/sf0.001"


def dealt(spark, df, path, time_column, files, late_us, seed=1):
    """df as files of micro-batches in which rows come up to late_us out of order."""
    rows = df.toPandas()
    rng = np.random.default_rng(seed)
    rows["_o"] = rows[time_column] + rng.integers(0, late_us, len(rows))
    rows = rows.sort_values("_o").drop(columns="_o").reset_index(drop=True)
    for i, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        spark.createDataFrame(rows.iloc[part].sample(frac=1, random_state=i), df.schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
        time.sleep(0.02)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def same(got, want):
    return sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))


@pytest.fixture(scope="module")
def messages(spark):
    return table(spark, SF, "fx_msgs").where("vehicle_id < 3").cache()


def test_fixes(spark, tmp_path):
    lines = table(spark, SF, "fx_nmea").where("vehicle_id < 3")
    end = Ending(dealt(spark, lines, f"{tmp_path}/in", "recv_us", 4, 2_000_000), "vehicle_id", "recv_us")
    got = settled(operators.nmea_fixes(end.stream, "3 seconds"), "fixes", end)
    want = gnss.gnss_to_fix(lines)
    assert got.count() > 50 and same(got.select(*want.columns).collect(), want.collect())


def test_outage(spark, messages, tmp_path):
    end = Ending(dealt(spark, messages, f"{tmp_path}/in", "t_us", 3, 1_500_000), "vehicle_id")
    got = settled(operators.outage(end.stream, "rtk", 2, 1, "2 seconds"), "outage", end)
    want = trajectory.simulate_outage(messages, "rtk", 2, 1).select("vehicle_id", "topic", "seq", "t_us")
    assert want.count() < messages.count() and same(got.collect(), want.collect())


def test_sweeps_and_inertial_state(spark, messages, tmp_path):
    firings = messages.select(F.col("vehicle_id").alias("device"), "seq", "t_us", F.when(F.col("seq") % 5 == 0, 100).otherwise(35_900).alias("azimuth"))
    end = Ending(dealt(spark, firings, f"{tmp_path}/in", "t_us", 3, 1_000_000), "device")
    got = settled(operators.sweeps(end.stream, "2 seconds"), "sweeps", end)
    want = []
    for _, own in firings.toPandas().sort_values(["t_us", "seq"]).groupby("device"):
        sweep = (own.azimuth.shift(1).fillna(own.azimuth.iloc[0]) - own.azimuth > 35000).cumsum()
        want += [(d, s, n) for d, s, n in zip(own.device, own.seq, sweep) if n > 0]
    assert len(want) > 100 and same(got.collect(), want)

    imu = messages.where("topic = 'imu'").select("vehicle_id", "seq", "t_us", *(F.col(a).alias(b) for a, b in zip(("x", "y", "z", "qz", "qw", "std_x"), ("ax", "ay", "az", "gx", "gy", "gz"))))
    one, many = (Ending(dealt(spark, imu, f"{tmp_path}/imu{n}", "t_us", n, 1_000_000, n), "vehicle_id") for n in (1, 3))
    a, b = (settled(operators.imu_state(e.stream, late="2 seconds"), "state", e).collect() for e in (one, many))
    assert len(a) == 3 and same(a, b)


def test_grid_of_all_periods(spark, messages, tmp_path):
    rows = messages.select("vehicle_id", "t_us", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), (F.col("t_us") % 10_000_000 / 5e6).alias("px"), F.lit(1.5).alias("py"))
    end = Ending(dealt(spark, rows, f"{tmp_path}/in", "t_us", 3, 500_000), "vehicle_id")
    grid = settled(operators.rolling_grid(end.stream.withColumn("ts", F.timestamp_micros("t_us")), late="1 second"), "grid", end)
    near = rows.where("abs(x - px) < 3 and abs(y - py) < 3").count()
    assert grid.agg(F.sum("hits")).first()[0] == near > 0


class Timers:
    """The parts of a stateful processor's handle that InOrder uses, held in lists."""

    def __init__(self):
        self.rows, self.value, self.timers = [], None, set()

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return Value()

    def registerTimer(self, ms):
        self.timers.add(ms)

    def appendList(self, rows):
        self.rows += rows

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []


class Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_order_expiry_and_timers():
    seen = []

    def step(held, rows):
        held["n"] = held.get("n", 0) + len(rows)
        seen.append((held["n"], rows.t.tolist()))
        return rows

    p, h = operators.InOrder(["t", "s"], ["t", "s"], step, 5_000_000), Timers()
    p.init(h)
    assert list(p.handleInputRows((1,), iter([pd.DataFrame({"t": [3_000_000, 1_000_000], "s": [1, 2]})]), Now(0))) == [] and h.timers == {1001}
    assert list(p.handleInputRows((None,), iter([pd.DataFrame({"t": [9], "s": [1]})]), Now(0))) == []
    assert list(p.handleExpiredTimer((1,), Now(900), None)) == [] and seen == []
    list(p.handleExpiredTimer((1,), Now(1001), None))
    assert seen == [(1, [1_000_000])] and 3001 in h.timers and len(h.rows) == 1
    list(p.handleInputRows((1,), iter([pd.DataFrame({"t": [2_000_000], "s": [9]})]), Now(1001)))
    list(p.handleExpiredTimer((1,), Now(3500), None))
    assert seen[1] == (3, [2_000_000, 3_000_000]) and h.rows == [] and 8001 in h.timers
    assert json.loads(p.held.get()[1]) == {"n": 3}
    list(p.handleExpiredTimer((1,), Now(7000), None))
    assert p.held.exists()
    list(p.handleExpiredTimer((1,), Now(8001), None))
    assert not p.held.exists()
