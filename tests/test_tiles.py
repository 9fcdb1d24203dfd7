"""Requests that compete for points, tile by tile."""

from pyspark.sql import functions as F

from waypath.operators import store


def test_chain_of_losers_within_a_tile_takes_two_rounds(spark, monkeypatch):
    """Request i wants points i, then i + 1; each but the first loses its first one to the request before it."""
    asked = spark.createDataFrame([(i, i) for i in range(12)], "request_id long, place long")
    near = spark.createDataFrame([(i, max(i - 1 + k, 0), float(k)) for i in range(12) for k in (0, 1, 2)], "place long, point_id long, d2 double").distinct()
    lists, taken, want = {i: sorted((r.d2, r.point_id) for r in near.where(f"place = {i}").collect()) for i in range(12)}, set(), {}
    for i in range(12):
        free = [p for _, p in lists[i] if p not in taken]
        if free:
            taken.add(free[0])
            want[free[0]] = i
    rounds, folder = [], store.shared_folder
    monkeypatch.setattr(store, "shared_folder", lambda s, n: rounds.append(n) or folder(s, n))
    for tile, most in ((F.lit(1), 2), (F.floor(F.col("place") / 5), 8), (None, 16)):
        rounds.clear()
        got = {r.point_id: r.request_id for r in store.assigned(asked, near, tile).collect()}
        assert got == want and len(rounds) <= most
