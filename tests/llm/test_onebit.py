import numpy as np
from pyspark.sql import functions as F

from panelwatch.llm import onebit


def brute(rows, k, every):
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    norms = np.sqrt((x * x).sum(axis=1))
    out = {}
    for i, v in rows:
        if i % every == 0:
            score = (x @ v) / (norms * np.sqrt(v @ v))
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(10, 48))
    rows = [(i, centres[i % 10] + r.normal(size=48) * 0.6) for i in range(3000)]
    df = spark.createDataFrame([(i, v.tolist(), 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(4)
    got = {}
    for x in onebit.nearest(df, F.col("vec_id") % 50 == 0, block=700).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = brute(rows, 5, 50)
    assert set(got) == set(want) and all([a for a, *_ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({b for _, b, _ in v} & {b for b, _ in want[q]}) for q, v in got.items())
    assert hits >= 0.95 * 5 * len(want)
    lengths = dict(rows)
    for q, v in got.items():
        assert all(abs(s - lengths[q] @ lengths[b] / np.sqrt((lengths[q] @ lengths[q]) * (lengths[b] @ lengths[b]))) < 1e-12 for _, b, s in v)


def test_bound_holds():
    r = np.random.default_rng(3)
    x, q = r.normal(size=(2000, 64)), r.normal(size=(5, 64))
    turn = onebit.rotation(64)
    codes, fit = onebit.encode(x, turn)
    est, width = onebit.estimate(codes, fit, q, turn, 3.0)
    true = (x @ q.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1)))
    assert (np.abs(est - true) <= width[:, None]).mean() > 0.99 and codes.shape == (2000, 8)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert onebit.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [-1.0, 0.0]), (50, [0.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (1, [1.0, 0.0])]
    got = [(x.query_id, x["rank"], x.vec_id, x.score) for x in onebit.nearest(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0, k=5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (0, 4, 8, -1.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0), (50, 4, 8, 0.0)]
