"""Clusters beside plain rounds from the same seeds."""

import numpy as np

from millrace.operators import clusters as G
from millrace.operators.sampling import seeded_sample


def lloyd(x, centres, rounds):
    centres, costs = centres.copy(), []
    for r in range(rounds + 1):
        apart = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        own = apart.argmin(1)
        costs.append(apart[np.arange(len(x)), own].sum())
        if r < rounds:
            for k in range(len(centres)):
                if (own == k).any():
                    centres[k] = x[own == k].mean(0)
    return centres, own, np.sqrt(apart[np.arange(len(x)), own]), costs


def blobs(seed, n, groups, size=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, size))
    return (middle[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, size))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "id long, v array<float>, cluster string").repartition(5)


def test_rounds_equal_plain_ones_and_lower_the_cost(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS", 64)
    x = blobs(1, 900, 9)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    df = frame(spark, x)
    seeds = sorted(r.id for r in seeded_sample(df.select("id"), "id", 7, 3).collect())
    out, levels = G.semantic_dedup(df, "id", "v", k=7, rounds=4, max_share=1.0, seed=3)
    centres, own, distance, costs = lloyd(unit, unit[seeds], 4)
    assert np.allclose(levels[0].centres[0], centres) and np.allclose(levels[0].costs, costs[:len(levels[0].costs)]) and len(levels) == 1
    assert all(b <= a for a, b in zip(levels[0].costs, levels[0].costs[1:])) and levels[0].costs[-1] < 0.9 * levels[0].costs[0]
    got = {r.id: r for r in out.collect()}
    assert all(got[i].cluster == own[i] * 9 and abs(got[i].distance - distance[i]) < 1e-6 for i in range(900))
    best = {min((i for i in range(900) if own[i] == k), key=lambda i: (distance[i], i)) for k in set(own.tolist())}
    assert {i for i, r in got.items() if r.representative} == best and out.columns == ["id", "v", "cluster", "distance", "representative"]


def test_large_clusters_are_split(spark):
    x = np.concatenate([blobs(2, 200, 8), np.float32(5) + blobs(3, 700, 6) * np.float32(0.2)])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    out, levels = G.semantic_dedup(frame(spark, x), "id", "v", k=6, rounds=5, max_share=0.3, split=4, seed=1)
    first, second = levels
    large = {c for (_, c), n in first.sizes.items() if n > 0.3 * 900}
    assert large and set(second.centres) == {c + 1 for c in large} and second.costs[-1] < second.costs[0]
    got = {r.id: r for r in out.collect()}
    own = ((unit[:, None, :] - first.centres[0][None]) ** 2).sum(2).argmin(1)
    for i, r in got.items():
        assert r.cluster // 5 == own[i] and (r.cluster % 5 > 0) == (own[i] in large)
        if own[i] in large:
            inner = ((unit[i] - second.centres[own[i] + 1]) ** 2).sum(1)
            assert r.cluster % 5 == inner.argmin() + 1 and abs(r.distance - np.sqrt(inner.min())) < 1e-6
    assert sum(r.representative for r in got.values()) == len({r.cluster for r in got.values()})


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [0.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, "y") for i, v in rows], "id long, v array<double>, distance int, representative string").repartition(3)
    out, _ = G.semantic_dedup(df, "id", "v", k=2, rounds=3, max_share=0.5)
    got = out.collect()
    assert len(got) == len(rows) and {r.id for r in got if r.cluster is None} == {3, 4, 5, 6, 7, 8, 9} and all(r.representative for r in got if r.cluster is None)
    assert {r.id for r in got if r.representative and r.cluster is not None} <= {1, 2, 10, None}
    for bad in (df.limit(0), df.where("id in (3, 5)")):
        again, levels = G.semantic_dedup(bad, "id", "v", k=2)
        assert again.count() == bad.count() and not levels
