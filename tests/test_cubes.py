"""Registration looks the map up by cubes of places, not by places."""

import numpy as np

from waypath.operators import mapping, spatial


def test_nearest_few_with_ties():
    rng = np.random.default_rng(4)
    held = np.round(rng.random((60, 3)) * 4) / 4
    held = held[np.lexsort((np.arange(60), held[:, 0]))]
    places = np.round(rng.random((200, 3)) * 4) / 4
    got = np.concatenate(list(mapping.nearest_few(held, places, 5)))
    for place, near in zip(places, got):
        want = held[np.argsort(((held - place) ** 2).sum(axis=1), kind="stable")[:5]]
        assert sorted(map(tuple, near)) == sorted(map(tuple, want))


def test_places_of_a_cube_share_one_search(spark, monkeypatch, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    asked = []

    def counted(queries, *rest):
        asked.append(queries.count())
        return search(queries, *rest)

    search = spatial.knn_join
    for module in (spatial, mapping):
        monkeypatch.setattr(module, "knn_join", counted)
    rng = np.random.default_rng(5)
    wall = np.concatenate([np.stack(np.meshgrid(*(np.arange(0, 3, 0.5) if i != j else [0.0] for i in range(3))), axis=-1).reshape(-1, 3) for j in range(3)]) + 2.0
    m = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(wall)], "point_id long, x double, y double, z double")
    body = rng.random((2000, 3)) * 2.5 + 2.0
    body[np.arange(2000), rng.integers(0, 3, 2000)] = 2.0
    scans = spark.createDataFrame([(s, i, *map(float, p + 0.02)) for s in (1, 2) for i, p in enumerate(body[s::2])], "scan_id long, seq long, x double, y double, z double")
    start = spark.createDataFrame([(s, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for s in (1, 2)], "scan_id long, px double, py double, pz double, qx double, qy double, qz double, qw double")
    whole = {r.scan_id: np.array(r[1:8]) for r in mapping.scan_to_map_register(scans, start, m, 2, size=0.5).collect()}
    assert 0 < sum(asked) < scans.count() / 2
    monkeypatch.setattr(mapping, "CROWDED", 7)
    dealt = {r.scan_id: np.array(r[1:8]) for r in mapping.scan_to_map_register(scans, start, m, 2, size=0.5).collect()}
    assert all(np.allclose(whole[s], dealt[s], atol=1e-9) and np.allclose(whole[s][:3], -0.02, atol=0.01) for s in (1, 2))
