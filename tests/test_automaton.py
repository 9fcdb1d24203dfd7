"""Finite-state scans against sequential loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypath.operators import automaton, lidar


def test_prefixes_and_folds():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 61):
        moves = rng.integers(0, 4, (n, 4))
        for start in range(4):
            state, want = start, []
            for m in moves:
                state = m[state]
                want.append(state)
            assert automaton.prefixes(moves)[:, start].tolist() == want and automaton.whole_move(moves)[start] == state


@pytest.mark.parametrize("span", [3, 10, 1000])
def test_scan(spark, span):
    rng = np.random.default_rng(span)
    rows = [(key, int(i), [int(x) for x in rng.integers(0, 3, 3)]) for key in ("a", "b") for i in rng.choice(200, 60, replace=False) - 50]
    got = automaton.finite_scan(spark.createDataFrame(rows, "k string, i long, m array<int>"), F.col("m"), "i", "k", 1, span)
    want = {}
    for key in "ab":
        state = 1
        for _, i, m in sorted(r for r in rows if r[0] == key):
            state = want[key, i] = m[state]
    assert {(r.k, r.i): r.state for r in got.collect()} == want and got.count() == len(want)


def mended(times):
    out, before = [], None
    for t in times:
        step = None if before is None or t is None else t - before
        if step is not None:
            if -1_000_000 < step < 0 and t % 1_000_000 < 100_000:
                t += 1_000_000
            elif 1_000_000 < step < 1_200_000 and t % 1_000_000 > 900_000:
                t -= 1_000_000
        out.append(t)
        before = before if t is None else t
    return out


def test_repair_at_full_seconds(spark):
    """Single faults before, at and after a full second, faults in a row, and one whose neighbour is right."""
    runs = {
        0: [9_998_000, 10_999_500, 10_000_500, 10_001_100],  # the second of the fraction .9995 came early
        1: [9_999_000, 9_000_400, 10_001_000, 10_002_000],  # that of .0004 came late
        2: [9_900_000, 9_000_000, 9_050_000, 10_099_000, 10_200_000],  # two in a row
        3: [9_990_000, 10_995_000, 10_999_000, 10_002_000, 10_010_000],
        4: [5_000_000, 5_000_000, 4_999_999, 6_100_000, 7_300_000],
    }
    rng = np.random.default_rng(6)
    for device in range(5, 12):
        clean = np.cumsum(rng.integers(100, 60_000, 400)) + 3_000_000
        part = clean % 1_000_000
        wrong = np.where((part < 100_000) & (rng.random(400) < 0.6), -1_000_000, np.where((part > 900_000) & (rng.random(400) < 0.6), 1_000_000, 0))
        runs[device] = (clean + wrong).tolist()
    runs[12] = [None, 9_999_000, None, 9_000_400, None, 10_001_000, None]
    rows = [(d, i, t, "x") for d, run in runs.items() for i, t in enumerate(run)]
    for span in (4, 100_000):
        got = lidar.gps_second_repair(spark.createDataFrame(rows, "device long, seq long, t_us long, data string").repartition(5), span)
        assert got.columns == ["device", "seq", "t_us", "data"]
        out = {(r.device, r.seq): r.t_us for r in got.collect()}
        assert {d: [out[d, i] for i in range(len(run))] for d, run in runs.items()} == {d: mended(run) for d, run in runs.items()}
    assert mended(runs[0]) == [9_998_000, 9_999_500, 10_000_500, 10_001_100]
