"""Streams: rows that wait in blocks, the clock of an outage, the join of scans with samples."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F
from test_streams import Now, Timers

from waypath import registry_streams
from waypath.registry import ORACLE_SQL
from waypath.streaming import operators


def test_rows_wait_in_small_blocks_and_come_in_portions(monkeypatch):
    monkeypatch.setattr(operators, "PORTION", 1000)
    sizes, seen = [], []

    def step(held, rows):
        sizes.append(len(rows))
        seen.extend(rows.t.tolist())
        held["n"] = held.get("n", 0) + len(rows)
        return rows

    p, h = operators.InOrder(["t", "s"], ["t", "s", "topic"], step, 10**12), Timers()
    p.init(h)
    frame = pd.DataFrame({"t": [1_000_000 + (i * 7919) % 10_000 for i in range(10_000)], "s": range(10_000), "topic": "rtk"})
    p.handleInputRows((1,), iter([frame[:6000], frame[6000:]]), Now(0))
    assert sum(len(r[1]) for r in h.rows) < 40 * len(frame)
    list(p.handleExpiredTimer((1,), Now(1005), None))
    list(p.handleExpiredTimer((1,), Now(2000), None))
    assert seen == sorted(frame.t) and max(sizes) <= 1000 and p.held.get()[1] == '{"n": 10000}'


def test_outage_by_the_first_message_in_time(spark, tmp_path):
    """The message of least seq is not the first one."""
    start = pd.Timestamp("2024-01-01")
    rows = [(i, (start + pd.Timedelta(days=1 + (i * 17 + 9) % 60)).to_pydatetime(), 8, "view", 1.0, '{"k": 3}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.seq for r in registry_streams.stream_outage(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view events as select * replace (ts::timestamp as ts) from '{tmp_path}/events.parquet/*.parquet'")
    want = {r[2] for r in db.execute(ORACLE_SQL["stream_outage"]).fetchall()}
    assert got == want and 0 < len(got) < 60


def test_stream_join_is_on_ranges_of_time(spark):
    rows = spark.readStream.format("rate").load().select(F.lit(1).alias("vehicle_id"), F.col("value").alias("seq"), F.col("timestamp").alias("ts"))
    plan = operators.scan_imu(rows.withColumnRenamed("seq", "scan_id"), rows, 500_000)._jdf.queryExecution().analyzed().toString()
    condition = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert condition.count(" = ") == 2
