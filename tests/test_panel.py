import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwatch.config import FULL_WINDOWS, SHORT_WINDOWS
from panelwatch.functions import columns as C
from panelwatch.operators import normalise as N, panel as P
from panelwatch.plans.q_panel import choose_windows
from tests.conftest import months


def values(df, col, order="month"):
    return [r[col] for r in df.orderBy(order).collect()]


def test_densify_fills_only_inside_the_series(panel):
    df = panel([("a", "2020-01", 1), ("a", "2020-04", 4), ("b", "2020-02", 5)])
    out = P.densify(df, ["v"])
    assert values(out.where("series_id = 'a'"), "v") == [1.0, None, None, 4.0]
    assert out.where("series_id = 'b'").count() == 1


def test_align_calendar_uses_the_given_bounds(panel):
    out = P.align_calendar(panel([("a", "2020-02", 1)]), ["v"], "2020-01-01", "2020-03-01")
    assert values(out, "v") == [None, 1.0, None]


def test_pct_change_null_and_zero_edges(panel):
    df = panel([("a", "2020-01", 100), ("a", "2020-02", 110), ("a", "2020-03", None), ("a", "2020-04", 0), ("a", "2020-05", 5)])
    out = values(df.withColumn("p", P.pct_change("v", 1)), "p")
    assert out[0] is None and out[1] == pytest.approx(10.0)
    assert out[2] is None and out[3] is None  # no padding over the gap
    assert out[4] is None  # zero base


def test_regime_keeps_null(panel):
    df = panel([("a", "2020-01", 2.0), ("a", "2020-02", 1.99), ("a", "2020-03", None)])
    assert values(df.withColumn("f", C.regime_flag("v")), "f") == [1.0, 0.0, None]


def test_dates(panel):
    r = panel([("a", "2024-02", 1)]).select(C.publication_date("month"), C.as_of_date("month"), C.available_at("month")).first()
    assert tuple(r) == (dt.date(2024, 3, 20), dt.date(2024, 2, 29), dt.date(2024, 3, 1))


def test_split_label_joins_windows_in_order(panel):
    df = panel([("a", m, 1) for m in ("2016-01", "2017-01", "2020-01", "2022-01", "2025-01")])
    assert values(df.withColumn("s", C.split_label("month", SHORT_WINDOWS)), "s") == ["unused", "train_A|train_B", "test_A|train_B", "test_B", "unused"]


def test_window_preset_by_start(spark):
    df = spark.sql("SELECT date(d) AS start FROM VALUES ('2010-01-01'), ('2012-01-01'), ('2012-02-01') t(d)")
    n = {r["start"]: r["n"] for r in choose_windows(df).groupBy("start").agg(F.count("*").alias("n")).collect()}
    assert list(n[k] for k in sorted(n)) == [len(FULL_WINDOWS), len(FULL_WINDOWS), len(SHORT_WINDOWS)]


def test_fill_and_interpolate(panel):
    df = panel([("a", m, v) for m, v in zip(months(2020, 8), [None, 1, None, None, None, None, 6, None])])
    assert values(df.withColumn("f", P.fill_gaps("v")), "f") == [1, 1, 1, 1, 1, 1, 6, 6]
    lim = values(P.interpolate_limited(df, "v", "i"), "i")
    assert lim == pytest.approx([1, 1, 2, 3, 4, 6, 6, 6])  # three linear, the fourth back filled, flat at the end
    t = values(P.interpolate_time(df, "v", "i"), "i")
    assert t[0] is None and t[7] == 6.0 and t[2] == pytest.approx(1 + 5 * 29 / 151)  # 2020-02 to 2020-07 in days


def test_lags_skip_absent_features(panel):
    out = P.add_lags(panel([("a", "2020-01", 1), ("a", "2020-02", 2)]), {"v": [0, 1], "none": [1]})
    assert out.columns == ["series_id", "month", "v", "v_lag1"]
    assert values(out, "v_lag1") == [None, 1.0]


def test_episodes_drop_the_open_run(panel):
    df = panel([("a", m, v) for m, v in zip(months(2020, 6), [0, 1, 1, 0, 1, 1])], "flag")
    out = P.episodes(df, "flag").collect()
    assert len(out) == 1 and out[0]["episode_start"] == dt.date(2020, 2, 1) and out[0]["n_months"] == 2


def test_lookback_needs_the_full_length(panel):
    out = P.lookback_windows(panel([("a", m, i) for i, m in enumerate(months(2020, 5))]), "v", [3])
    assert [r["values"] for r in out.orderBy("month").collect()] == [[0.0, 1.0, 2.0], [1.0, 2.0, 3.0]]


def test_decompose_recovers_a_pure_season(panel):
    df = panel([("a", m, 10 + (5 if i % 12 == 0 else 0) + 0.5 * i) for i, m in enumerate(months(2020, 48))])
    mid = P.decompose_classical(df, "v").where("trend IS NOT NULL")
    assert mid.count() == 36
    assert mid.agg(F.max(F.abs("resid"))).first()[0] < 1e-9


def test_constant_series_scalings(panel):
    df = panel([("a", m, v) for m, v in zip(months(2020, 3), [7, 7, None])])
    assert values(df.withColumn("s", N.minmax("v")), "s") == [0.0, 0.0, 0.0]
    assert values(N.robust_train(df, "v", "TRUE", "r"), "r") == [None, None, None]
    assert values(df.withColumn("z", N.zscore_train("v", "TRUE")), "z") == [0.0, 0.0, None]


def test_train_only_scaling_clips(panel):
    df = panel([("a", m, v) for m, v in zip(months(2020, 4), [0, 10, 20, -5])])
    s = df.withColumn("s", N.minmax_train("v", N.train_rows("2020-02-01")))
    assert values(s, "s") == [0.0, 1.0, 1.0, 0.0]
    none = df.withColumn("s", N.minmax_train("v", N.train_rows("2019-01-01")))
    assert values(none, "s") == [0.0] * 4


def test_rescale_batches_with_a_zero_anchor(spark):
    rows = [("2020-01", 0, "anchor", True, 10.0), ("2020-02", 0, "anchor", True, 20.0), ("2020-01", 0, "x", False, 1.0),
            ("2020-01", 1, "anchor", True, 5.0), ("2020-02", 1, "anchor", True, 0.0), ("2020-01", 1, "y", False, 3.0), ("2020-02", 1, "y", False, 4.0)]
    df = spark.createDataFrame([("s", f"{m}-01", b, k, a, v) for m, b, k, a, v in rows], "series_id string, m string, batch int, keyword string, is_anchor boolean, value double")
    out = P.rescale_batches(df.selectExpr("series_id", "date(m) AS month", "batch", "keyword", "is_anchor", "value"))
    got = {(r["keyword"], r["month"].month): r["value"] for r in out.collect()}
    assert got == {("anchor", 1): 10.0, ("anchor", 2): 20.0, ("x", 1): 1.0, ("y", 1): 6.0, ("y", 2): 8.0}


def test_anchor_batches_repeat_the_anchor_once(spark):
    df = spark.createDataFrame([(k, i + 1) for i, k in enumerate(["anchor", "b", "c", "d", "e"])], "keyword string, pos long")
    out = P.anchor_batches(df, "anchor").groupBy("batch").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).orderBy("batch").collect()
    assert [(r["n"], r["a"]) for r in out] == [(4, 1), (2, 1)]
