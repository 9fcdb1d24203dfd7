"""Scans and samples at or before time 0 are met by the stream too."""

import duckdb
import pandas as pd

from waypath import registry_streams
from waypath.registry import ORACLE_SQL


def test_pairs_up_to_time_zero(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")  # 86,400 seconds are one of t_us
    rows = [(i, (start + pd.Timedelta(seconds=s)).to_pydatetime(), 8, kind, 1.0, '{"k": 3}') for i, (s, kind) in enumerate([(-30_000, "purchase"), (0, "purchase"), (0, "error"), (-10_000, "error"), (0.01, "error"), (20_000, "error"), (90_000, "purchase"), (100_000, "error")])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, registry_streams.stream_scan_imu(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"create view events as select * replace (ts::timestamp as ts) from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(ORACLE_SQL["stream_scan_imu"]).fetchall())
    assert got == want and len({(r[1], r[2]) for r in want} & {(0, 2), (1, 2), (1, 4)}) == 3
