"""Every query gives the rows of its DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import waypath.registry_more  # noqa: F401  (adds its queries)
import waypath.registry_scans  # noqa: F401
import waypath.registry_streams  # noqa: F401
from waypath.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert plain(df.select(*cols).collect()) == plain(want)


def test_ties_and_edges(spark):
    from waypath.operators.asof import asof_nearest

    left = spark.createDataFrame([(1, 1000, 1), (1, 200_000, 2)], "vehicle_id long, t_us long, seq long")
    right = spark.createDataFrame([(1, 900, 1), (1, 1100, 2), (1, 1100, 3), (1, 350_001, 4)], "vehicle_id long, t_us long, seq long")
    got = {r.seq: r.m and r.m.seq for r in asof_nearest(left, right, 150_000, "m").collect()}
    assert got == {1: 3, 2: None}  # the later of equally near rows, the last of equal times; one microsecond too far
