import random
import zlib

import numpy as np

from panelwatch.llm import resampling


def brute_features(text, buckets):
    h = [zlib.crc32(w) for w in (text or "").encode().lower().split()]
    pairs = [((a * 0x9E3779B1 + b) % 2**64) % 4294967291 % buckets for a, b in zip(h, h[1:])]
    return [x % buckets for x in h] + pairs


def corpus(n=400):
    r = random.Random(5)
    good, poor = [f"g{i}" for i in range(50)], [f"p{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(n):
        fine = r.random() < 0.5
        rows.append((i, " ".join(r.choice(good if fine else poor) if r.random() < 0.7 else f"c{r.randint(0, 9)}" for _ in range(r.randint(5, 80)))))
        if i % 4 == 0:
            labels.append((i, int(fine), 0))
    return rows, labels


def test_weights_equal_brute_force_and_the_best_are_drawn(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, log_weight double").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    all_rows = {r.doc_id: r for r in resampling.resample(docs, marks, fraction=1.0, buckets=1000).collect()}
    assert len(all_rows) == len(rows)
    good = {i for i, q, _ in labels if q}
    raw, target = np.ones(1000), np.ones(1000)
    for i, t in rows:
        np.add.at(raw, brute_features(t, 1000), 1)
        if i in good:
            np.add.at(target, brute_features(t, 1000), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, t in rows:
        f = brute_features(t, 1000)
        assert abs(all_rows[i].log_weight - 200 * ratio[f].mean()) < 1e-6
    half = {r.doc_id: r.sample_key for r in resampling.resample(docs, marks, fraction=0.5, buckets=1000).collect()}
    keys = sorted((r.sample_key for r in all_rows.values()), reverse=True)
    assert sorted(half.values(), reverse=True) == keys[:200]
    fine = {i for i, t in rows if t.count("g") > t.count("p")}
    assert len(fine & set(half)) > 0.9 * min(len(fine), 200)


def test_gumbel_draws_follow_the_weights(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'a' AS text")
    got = resampling.resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), fraction=0.25)
    ids = np.array([r.doc_id for r in got.select("doc_id").collect()])
    assert len(ids) == 5000 and abs(ids.mean() - 10_000) < 300


def test_kth_largest(spark):
    r = random.Random(3)
    values = [r.gauss(0, 1) for _ in range(3000)] + [0.5] * 2000 + [1e12, -1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 2500, 4000, len(values)):
        assert resampling.kth_largest(df, "v", k, cells=16, few=50) == ordered[k - 1]


def test_odd_rows(spark):
    schema, marks = "doc_id long, text string", "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 0), (2, None, 0), (3, 1, 1)], marks)
    assert resampling.resample(spark.createDataFrame([], schema), labels).count() == 0
    rows = [(1, "good words"), (1, "good words"), (None, None), (5, ""), (6, "x " * 100_000)]
    got = resampling.resample(spark.createDataFrame(rows, schema), labels, fraction=1.0).collect()
    assert sorted((r.doc_id or 0, r.log_weight == 0) for r in got) == [(0, True), (1, False), (1, False), (5, True), (6, False)]
