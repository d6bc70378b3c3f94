import hashlib

import numpy as np
import pandas as pd

from panelwatch.llm import vafile


def brute(rows, k, rounds, dims):
    """The same clustering by plain loops over whole numbers."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    name = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), i or 0)
    centroids = [list(v) for _, v in sorted(kept, key=lambda r: name(r[0]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for a, (_, v) in zip(at, kept) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    at = [nearest(v) for _, v in kept]
    sums = {j: sum(d for d, a in at if a == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, sums[j], sum(sums.values()), digest[j]) for (i, _), (d, j) in zip(kept, at)]


def result(df):
    return [(x.vec_id, x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in df.collect()]


def test_against_plain_loops(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=8) * r.choice([0.1, 1.0])).tolist()) for i in range(400)] + [(500 + i, [0.25] * 8) for i in range(60)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    for bits in (2, 6):
        got = result(vafile.cluster(df, k=7, rounds=4, dims=8, bits=bits, sample=100))
        assert sorted(got) == sorted(brute(rows, 7, 4, 8))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.1]), (1, [0.5, -0.1]), (1, [0.5, -0.1]), (2, None), (3, [nan, 0.0]), (4, [None, 0.0]), (5, [inf, 0.0]), (6, [1.0]), (7, [0.0, 0.0]), (8, [-3.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(result(vafile.cluster(df, k=3, rounds=2, dims=2))) == sorted(brute(rows, 3, 2, 2))
    assert sorted(result(vafile.cluster(df, k=50, rounds=2, dims=2))) == sorted(brute(rows, 50, 2, 2))  # more centroids than vectors
    assert vafile.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    nameless = spark.createDataFrame([(None, [0.1, 0.2]), (3, [0.3, 0.1])], "vec_id long, embedding array<double>")
    assert {x.vec_id for x in vafile.cluster(nameless, k=1, dims=2).collect()} == {None, 3}


def test_intervals_hold_every_distance_and_settle_some():
    r = np.random.default_rng(3)
    centres = np.floor(256 * r.normal(size=(12, 16))).astype(np.int64)
    x = centres[r.integers(0, 12, 3000)] + np.floor(r.normal(size=(3000, 16)) * 40).astype(np.int64)
    grid = vafile.Grid(x[:500], x.min(axis=0), x.max(axis=0), 5)
    cells = grid.cells(x)
    codes = pd.Series(grid.pack(cells))
    assert (grid.unpack(codes, 16) == cells).all() and len(codes[0]) == 10
    assert all((grid.low[d, cells[:, d]] <= x[:, d]).all() and (x[:, d] <= grid.high[d, cells[:, d]]).all() for d in range(16))
    bounds = vafile.Bounds(grid, centres)
    some = bounds.candidates(codes)
    nearest = ((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert some[np.arange(3000), nearest].all() and (some.sum(axis=1) == 1).mean() > 0.5
