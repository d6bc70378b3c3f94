import numpy as np
import pytest

from panelwatch import config as K
from panelwatch.operators import forecast as FC
from tests.conftest import months


def series_values(n=80, seed=3):
    rng = np.random.default_rng(seed)
    return 100 + np.cumsum(rng.normal(0.2, 1, n)) + 3 * np.sin(np.arange(n) * 2 * np.pi / 12)


def by_hand(y, x=None):
    """Refit at every origin with least squares, the rules of the operator."""
    n, out = len(y), []
    w = np.full(n, np.nan)
    w[13:] = y[13:] - y[12:-1] - y[1:-12] + y[:-13]
    dx = None
    if x is not None:
        dx = np.full(n, np.nan)
        dx[13:] = x[13:] - x[12:-1] - x[1:-12] + x[:-13]
    for t in range(n):
        if t == 0:
            out.append(np.nan)
            continue
        if t < 24:
            out.append(y[t - 1])
            continue
        p = 1 if t < 36 else 2
        cols = lambda i: [w[i - k] for k in range(1, p + 1)] + ([dx[i]] if x is not None else [])
        rows = [(cols(i), w[i]) for i in range(13 + p, t)]
        a, b = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        pred = y[t - 1] + y[t - 12] - y[t - 13] + np.array(cols(t)) @ beta
        ok = abs(pred - y[:t].mean()) <= 5 * (y[:t].max() - y[:t].min() + 1e-6)
        out.append(pred if ok else y[t - 1])
    return np.array(out)


def test_walk_forward_equals_refitting_every_origin(spark):
    y, x = series_values(), series_values(seed=9)
    df = spark.createDataFrame([("a", f"{m}-01", float(v), float(u)) for m, v, u in zip(months(2015, 80), y, x)], "series_id string, m string, y double, x double").selectExpr("series_id", "date(m) AS month", "y", "x")
    p = FC.walk_forward(df, "y", {"sig": "x"}).toPandas().sort_values("month")
    assert p.pred_seasonal.to_numpy(float)[1:] == pytest.approx(by_hand(y)[1:], abs=1e-7)
    assert p.pred_sig.to_numpy(float)[1:] == pytest.approx(by_hand(y, x)[1:], abs=1e-7)


def test_flat_series_falls_back_to_the_last_value(panel):
    df = panel([("a", m, 5) for m in months(2018, 40)], "y")
    p = FC.walk_forward(df, "y", {}).where("n_train > 0").select("pred_seasonal").distinct().collect()
    assert [r[0] for r in p] == [5.0]


def test_short_blocks_are_skipped(panel):
    df = panel([("a", m, i) for i, m in enumerate(months(2018, 40))], "y")  # ends 2021-04: block A 24 train, 16 test; B no test
    p = FC.backtest(df.withColumnRenamed("y", "ipc_level"), K.SHORT_WINDOWS, {})
    assert [r["block"] for r in p.select("block").distinct().collect()] == ["A"]
    late = panel([("a", m, i) for i, m in enumerate(months(2019, 30))], "ipc_level")
    assert FC.backtest(late, K.SHORT_WINDOWS, {}).count() == 0


def test_error_metrics_by_hand(spark):
    rows = [("s", i, m, y, p) for m, ps in {"naive": [1.0, 1.0, 3.0], "b": [2.0, 2.0, 2.0]}.items() for i, (y, p) in enumerate(zip([2.0, 0.0, 4.0], ps))]
    m = {r["model"]: r for r in FC.forecast_metrics(spark.createDataFrame(rows, "series_id string, month int, model string, y double, yhat double"), ["series_id"]).collect()}
    assert m["naive"]["rmse"] == pytest.approx(1.0) and m["naive"]["theils_u"] == 1.0
    assert m["naive"]["mape"] == pytest.approx((0.5 + 0.25) / 2 * 100)  # zero actual left out
    assert m["naive"]["mase"] == pytest.approx(1.0 / 3.0)  # mean |diff| of 2, 0, 4 is 3
    assert m["b"]["rmse"] == pytest.approx(np.sqrt(8 / 3)) and m["b"]["theils_u"] == pytest.approx(np.sqrt(8 / 3))


def test_theils_u_null_for_a_perfect_naive(spark):
    rows = [("s", 1, "naive", 1.0, 1.0), ("s", 1, "b", 1.0, 2.0)]
    m = {r["model"]: r["theils_u"] for r in FC.forecast_metrics(spark.createDataFrame(rows, "series_id string, month int, model string, y double, yhat double"), ["series_id"]).collect()}
    assert m == {"naive": 1.0, "b": None}


def test_windows_come_back_from_labels(spark):
    df = spark.createDataFrame([("2019-01-01", "train_A|train_B"), ("2020-01-01", "test_A|train_B"), ("2021-01-01", "test_B"), ("2022-01-01", "unused"), ("2023-01-01", "train_C")], "m string, split_label string").selectExpr("date(m) AS month", "split_label")
    w = {r["label"]: (str(r["train_start"]), str(r["train_end"]), str(r["test_start"])) for r in FC.derive_windows(df).collect()}
    assert w == {"A": ("2019-01-01", "2019-01-01", "2020-01-01"), "B": ("2019-01-01", "2020-01-01", "2021-01-01")}


def test_published_block_means():
    assert round((1.3763 + 1.8426) / 2, 4) == pytest.approx(1.6094, abs=1e-4)


def test_order_grid_prefers_the_true_order(spark):
    rng = np.random.default_rng(5)
    n = 400
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = -0.8 * w[t - 1] + rng.normal()
    y = np.zeros(n)
    y[:13] = rng.normal(size=13)
    for t in range(13, n):
        y[t] = y[t - 1] + y[t - 12] - y[t - 13] + w[t]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "series_id string, month int, y double")
    g = {r["ar_order"]: r for r in FC.order_grid(df, "y").collect()}
    assert sum(r["best"] for r in g.values()) == 1
    assert g[1]["aic"] < g[3]["aic"] + 4  # extra terms do not pay more than their penalty


def full_model(y, x, t):
    """The full seasonal forecast of row ``t``, by refitting every equation at its origin; null rules as documented."""
    n = len(y)
    w = [y[i] - y[i - 1] - y[i - 12] + y[i - 13] if i >= 13 else None for i in range(n)]
    d = [x[i] - x[i - 1] - x[i - 12] + x[i - 13] if i >= 13 else None for i in range(n)]
    lag = lambda v, i, k: v[i - k] if i >= k else None

    def fit(row_of, upto):
        rows = [(row_of(i), w[i]) for i in range(upto)]
        rows = [(r, v) for r, v in rows if v is not None and None not in r]
        k = len(row_of(0))
        if len(rows) <= k:
            return None
        a, b = np.array([r for r, _ in rows], float), np.array([v for _, v in rows])
        return np.linalg.solve(a.T @ a, a.T @ b) if np.linalg.matrix_rank(a) == k else None

    long, two = (lambda i: [lag(w, i, k) for k in (1, 2, 3, 12, 13)]), (lambda i: [lag(w, i, k) for k in (1, 2)])
    e = []
    for i in range(t + 1):
        found = 0.0
        for terms in (long, two):
            if w[i] is not None and None not in terms(i) and (b := fit(terms, i)) is not None:
                found = w[i] - float(np.dot(b, terms(i)))
                break
        e.append(found)
    past = lambda i, k: e[i - k] if i >= k else 0.0
    every = lambda i: [*two(i), *(past(i, k) for k in (1, 12, 13)), *([d[i]] if x is not None else [])]
    b = fit(every, t)
    return None if b is None else y[t - 1] + y[t - 12] - y[t - 13] + float(np.dot(b, every(t)))


def test_full_model_equals_refitting_at_every_origin(spark):
    r = np.random.default_rng(9)
    n = 75
    x = np.cumsum(r.normal(size=n))
    y = (100 + 0.4 * np.arange(n) + 5 * np.sin(np.arange(n) * np.pi / 6) + 0.5 * x + np.cumsum(r.normal(size=n)) * 0.3).tolist()
    rows = [("s", f"{2000 + i // 12}-{i % 12 + 1:02d}-01", y[i], float(x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, m string, y double, x double").selectExpr("series_id", "date(m) AS month", "y", "x")
    got = FC.walk_forward(df, "y", {}, full={"alone": None, "both": "x"}).orderBy("month").collect()
    assert {"pred_alone", "pred_both"} <= set(got[0].asDict()) and got[10].pred_both == y[9] == got[10].pred_alone
    for t in (40, 50, 61, 74):
        assert got[t].pred_both == pytest.approx(full_model(y, x.tolist(), t), rel=1e-6)
    simple = FC.walk_forward(df, "y", {}).orderBy("month").collect()
    assert all(a.pred_seasonal == b.pred_seasonal for a, b in zip(got, simple) if a.pred_seasonal is not None)
    assert all(got[t].pred_alone == pytest.approx(simple[t].pred_seasonal) for t in range(24, 30))  # one autoregressive term below 36 months
