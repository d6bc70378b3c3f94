"""Queries on walk-forward forecasts and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwatch.config import ERROR_NOTES, PANEL_WINDOWS
from panelwatch.functions import columns as C
from panelwatch.operators import forecast as FC, panel as P
from panelwatch.plans import gold as G, inputs
from panelwatch.plans.q_gold import GOLD_COLS, NOT_DOUBLE
from panelwatch.plans.registry import cte, query, sql_dot, sql_solve
from panelwatch.plans.stages import staged

EXOG = {"behavioural": "behavioural_index_lag1", "hybrid": "hybrid_index_lag1"}
FULL = {"sarima": None, "sarimax": "behavioural_index_lag1"}  # with moving-average terms, alone and with a signal
MODELS = ["naive", "seasonal", *EXOG, *FULL]
BLOCK = ["series_id", "block"]


def r3(c):
    return F.round(C.as_col(c), 3)


def r4(c):
    return F.round(C.as_col(c), 4)


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "gold", G.gold)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Walk-forward predictions of all models and blocks, computed once and read by all evaluation steps."""
    return staged(spark, sf, "predictions", lambda s, d: FC.backtest(gold(s, d), PANEL_WINDOWS, EXOG, full=FULL))


# ---- oracle blocks ----

B = "(PARTITION BY series_id, block ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
O = "(PARTITION BY series_id, block ORDER BY month)"
cte("x_windows", """
  SELECT * FROM (VALUES ('A', DATE '1995-01-01', DATE '1998-12-01', DATE '1999-01-01', DATE '1999-12-01'),
     ('B', DATE '1995-01-01', DATE '1999-12-01', DATE '2000-01-01', DATE '2001-11-01')) v(block, train_start, train_end, test_start, test_end)""")
cte("x_blocks", """
  SELECT g.*, w.block, CASE WHEN g.month <= w.train_end THEN 'train' ELSE 'test' END AS part FROM x_gold g JOIN x_windows w
  ON g.month BETWEEN w.train_start AND w.train_end OR g.month BETWEEN w.test_start AND w.test_end""")


def _sql_fill(c: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id, block ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id, block ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


def sql_sums(specs: dict) -> list[str]:
    """Running products of each specification over the rows where all its terms are known, and their number."""
    out = []
    for tag, terms in specs.items():
        cond = " AND ".join(f"{t} IS NOT NULL" for t in terms + ["w"])
        out.append(f"count(*) FILTER ({cond}) OVER b AS {tag}_n")
        out += [f"sum({p} * {q}) FILTER ({cond}) OVER b AS {tag}_{p}_{q}" for i, p in enumerate(terms) for q in terms[i:] + ["w"]]
    return out


def sql_two(t, x):
    d = f"nullif({t}_w1_w1 * {t}_{x}_{x} - {t}_w1_{x} * {t}_w1_{x}, 0)"
    return f"CASE WHEN {t}_n > 2 THEN ({t}_w1_w * {t}_{x}_{x} - {t}_{x}_w * {t}_w1_{x}) / {d} * w1 + ({t}_{x}_w * {t}_w1_w1 - {t}_w1_w * {t}_w1_{x}) / {d} * {x} END"


def sql_three(t, x):
    a, b, c = f"{t}_w1_w1", f"{t}_w1_w2", f"{t}_w1_{x}"
    e, f, i = f"{t}_w2_w2", f"{t}_w2_{x}", f"{t}_{x}_{x}"
    p, q, r = f"{t}_w1_w", f"{t}_w2_w", f"{t}_{x}_w"
    det = f"nullif({a}*({e}*{i}-{f}*{f}) - {b}*({b}*{i}-{f}*{c}) + {c}*({b}*{f}-{e}*{c}), 0)"
    d1 = f"({p}*({e}*{i}-{f}*{f}) - {b}*({q}*{i}-{f}*{r}) + {c}*({q}*{f}-{e}*{r}))"
    d2 = f"({a}*({q}*{i}-{f}*{r}) - {p}*({b}*{i}-{f}*{c}) + {c}*({b}*{r}-{q}*{c}))"
    d3 = f"({a}*({e}*{r}-{q}*{f}) - {b}*({b}*{r}-{q}*{c}) + {p}*({b}*{f}-{e}*{c}))"
    return f"CASE WHEN {t}_n > 3 THEN {d1}/{det}*w1 + {d2}/{det}*w2 + {d3}/{det}*{x} END"


def sql_guard(s, f):
    pick = f"CASE WHEN n_train < 36 THEN {s} ELSE coalesce({f}, {s}) END"
    return f"CASE WHEN n_train < 24 THEN last_y WHEN abs({pick} - mean_y) <= 5 * (rng + 1e-6) THEN {pick} ELSE last_y END"


_LONG = ["w1", "w2", "w3", "w12", "w13"]
_MA = ["w1", "w2", "e1", "e12", "e13"]
#: Model and forecast pairs of all models, for a LATERAL (VALUES ...) list.
SQL_MODELS = ", ".join(f"('{m}', pred_{m})" for m in MODELS)


def _forecast_ctes(prefix: str, source: str) -> None:
    """Blocks {prefix}_w (differences), {prefix}_s (sums), {prefix}_p (forecasts) over (series_id, block, month)."""
    cte(f"{prefix}_w", f"""
      WITH f AS (SELECT series_id, block, month, part, ipc_level AS y, behavioural_index_lag1 AS xb, hybrid_index_lag1 AS xh,
          {_sql_fill('behavioural_index_lag1')} AS fb, {_sql_fill('hybrid_index_lag1')} AS fh FROM {source}),
      d AS (SELECT *, lag(y, 1) OVER o AS y1, lag(y, 12) OVER o AS y12, lag(y, 13) OVER o AS y13,
          fb - lag(fb, 1) OVER o - lag(fb, 12) OVER o + lag(fb, 13) OVER o AS db, fh - lag(fh, 1) OVER o - lag(fh, 12) OVER o + lag(fh, 13) OVER o AS dh
        FROM f WINDOW o AS {O}),
      w AS (SELECT *, y - y1 - y12 + y13 AS w FROM d)
      SELECT *, {', '.join(f'lag(w, {k}) OVER o AS w{k}' for k in (1, 2, 3, 12, 13))} FROM w WINDOW o AS {O}""")
    sums = sql_sums({"a": ["w1"], "c": ["w1", "w2"], "ab": ["w1", "db"], "cb": ["w1", "w2", "db"], "ah": ["w1", "dh"], "ch": ["w1", "w2", "dh"], "lo": _LONG})
    cte(f"{prefix}_s", f"""
      SELECT *, count(y) OVER b AS n_train, last_value(y IGNORE NULLS) OVER b AS last_y, avg(y) OVER b AS mean_y, max(y) OVER b - min(y) OVER b AS rng,
        count(xb) OVER b AS nb, count(xh) OVER b AS nh, {', '.join(sums)}
      FROM {prefix}_w WINDOW b AS {B}""")

    cte(f"{prefix}_e", f"""
      WITH e AS (SELECT *, coalesce(CASE WHEN lo_n > {len(_LONG)} THEN w - {sql_dot('lo', _LONG)} END, w - ({sql_two('c', 'w2')}), 0) AS e FROM {sql_solve(prefix + '_s', {'lo': _LONG})})
      SELECT * EXCLUDE (e), {', '.join(f'coalesce(lag(e, {k}) OVER o, 0) AS e{k}' for k in (1, 12, 13))} FROM e WINDOW o AS {O}""")
    cte(f"{prefix}_m", f"SELECT *, {', '.join(sql_sums({'m': _MA, 'mb': [*_MA, 'db']}))} FROM {prefix}_e WINDOW b AS {B}")
    cte(f"{prefix}_f", f"""
      SELECT *, CASE WHEN m_n > {len(_MA)} THEN y1 + y12 - y13 + {sql_dot('m', _MA)} END AS rm, CASE WHEN mb_n > {len(_MA) + 1} THEN y1 + y12 - y13 + {sql_dot('mb', [*_MA, 'db'])} END AS rmb
      FROM {sql_solve(prefix + '_m', {'m': _MA, 'mb': [*_MA, 'db']})}""")

    cte(f"{prefix}_p", f"""
      WITH r AS (SELECT *, CASE WHEN a_n > 1 THEN y1 + y12 - y13 + a_w1_w / nullif(a_w1_w1, 0) * w1 END AS ra, y1 + y12 - y13 + {sql_two('c', 'w2')} AS rc,
         y1 + y12 - y13 + {sql_two('ab', 'db')} AS rab, y1 + y12 - y13 + {sql_three('cb', 'db')} AS rcb,
         y1 + y12 - y13 + {sql_two('ah', 'dh')} AS rah, y1 + y12 - y13 + {sql_three('ch', 'dh')} AS rch FROM {prefix}_f)
      SELECT series_id, block, month, part, y, n_train, last_y AS pred_naive, {sql_guard('ra', 'rc')} AS pred_seasonal, {sql_guard('ra', 'ra')} AS pred_simple,
        CASE WHEN nb > 0 THEN {sql_guard('rab', 'rcb')} ELSE {sql_guard('ra', 'rc')} END AS pred_behavioural,
        CASE WHEN nh > 0 THEN {sql_guard('rah', 'rch')} ELSE {sql_guard('ra', 'rc')} END AS pred_hybrid,
        {sql_guard('ra', 'rm')} AS pred_sarima, CASE WHEN nb > 0 THEN {sql_guard('rab', 'rmb')} ELSE {sql_guard('ra', 'rm')} END AS pred_sarimax FROM r""")


cte("x_all_rows", "SELECT *, 'all' AS block, 'test' AS part FROM x_gold")
_forecast_ctes("x_bt", "x_blocks")
_forecast_ctes("x_wf", "x_all_rows")
cte("x_preds", f"""
  WITH t AS (SELECT *, min(n_train) OVER (PARTITION BY series_id, block) AS tr, count(y) OVER (PARTITION BY series_id, block) AS te FROM x_bt_p WHERE part = 'test' AND y IS NOT NULL)
  SELECT series_id, block, month, y, m.model, m.yhat FROM t, LATERAL (VALUES {SQL_MODELS}) m(model, yhat)
  WHERE tr >= 24 AND te >= 6""")


def sql_metrics(by: str, source: str = "x_preds") -> str:
    return f"""
  SELECT {by}, model, rmse, mae, mape, smape, mae / nullif(scale, 0) AS mase, n_test,
    CASE WHEN model = 'naive' THEN 1.0 ELSE rmse / nullif(max(CASE WHEN model = 'naive' THEN rmse END) OVER (PARTITION BY {by}), 0) END AS theils_u FROM (
    SELECT {by}, model, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae, avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100 AS mape,
      avg(CASE WHEN abs(y) + abs(yhat) <> 0 THEN 200 * abs(y - yhat) / (abs(y) + abs(yhat)) END) AS smape, avg(d) AS scale, count(*) AS n_test
    FROM (SELECT *, abs(y - lag(y) OVER (PARTITION BY {by}, model ORDER BY month)) AS d FROM {source}) WHERE yhat IS NOT NULL GROUP BY {by}, model)"""


cte("x_metrics", sql_metrics("series_id, block"))
METRICS = ["rmse", "mae", "mape", "smape", "mase", "theils_u"]


# ---- queries ----


@query("derive_windows", """
  SELECT w.block AS label, min(month) FILTER (part = 'train') AS train_start, max(month) FILTER (part = 'train') AS train_end,
    min(month) FILTER (part = 'test') AS test_start, max(month) FILTER (part = 'test') AS test_end FROM x_blocks w GROUP BY 1""")
def derive_windows(spark, sf):
    return FC.derive_windows(gold(spark, sf))


def _panel_forecast(spark, sf) -> DataFrame:
    g = gold(spark, sf).select("series_id", "month", "ipc_level", *EXOG.values())
    return FC.walk_forward(g, "ipc_level", EXOG, full=FULL)


@query("forecast_naive", "SELECT series_id, month, n_train, round(pred_naive, 4) AS pred_naive FROM x_wf_p")
def forecast_naive(spark, sf):
    b = "(PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return inputs.price_panel(spark, sf).selectExpr(
        "series_id", "month", f"count(ipc_level) OVER {b} AS n_train", f"round(last(ipc_level, true) OVER {b}, 4) AS pred_naive")


@query("forecast_ar_simple", "SELECT series_id, month, n_train, round(pred_seasonal, 3) AS pred_seasonal FROM x_wf_p")
def forecast_ar_simple(spark, sf):
    """One or two autoregressive terms on the double difference, all origins of all series in one window pass."""
    p = FC.walk_forward(inputs.price_panel(spark, sf), "ipc_level", {})
    return p.select("series_id", "month", "n_train", r3("pred_seasonal").alias("pred_seasonal"))


@query("forecast_arx", "SELECT series_id, month, n_train, round(pred_behavioural, 3) AS pred_behavioural, round(pred_hybrid, 3) AS pred_hybrid FROM x_wf_p")
def forecast_arx(spark, sf):
    p = _panel_forecast(spark, sf)
    return p.select("series_id", "month", "n_train", r3("pred_behavioural").alias("pred_behavioural"), r3("pred_hybrid").alias("pred_hybrid"))


@query("forecast_hr_ma", "SELECT series_id, month, n_train, round(pred_sarima, 3) AS pred_sarima, round(pred_sarimax, 3) AS pred_sarimax FROM x_wf_p")
def forecast_hr_ma(spark, sf):
    """The full seasonal model, alone and with the signal."""
    return _panel_forecast(spark, sf).select("series_id", "month", "n_train", r3("pred_sarima").alias("pred_sarima"), r3("pred_sarimax").alias("pred_sarimax"))


@query("walk_forward_all", f"""
  SELECT series_id, month, m.model, round(y, 4) AS y, round(m.yhat, 3) AS yhat FROM x_wf_p, LATERAL (VALUES {SQL_MODELS}) m(model, yhat) WHERE y IS NOT NULL""")
def walk_forward_all(spark, sf):
    p = FC.long_predictions(_panel_forecast(spark, sf), "ipc_level", MODELS, ["series_id", "month"])
    return p.where("y IS NOT NULL").select("series_id", "month", "model", r4("y").alias("y"), r3("yhat").alias("yhat"))


@query("forecast_yoy", """
  SELECT series_id, month, round((pred_naive / nullif(y12, 0) - 1) * 100, 3) AS yoy_naive, round((pred_seasonal / nullif(y12, 0) - 1) * 100, 3) AS yoy_seasonal
  FROM (SELECT *, lag(y, 12) OVER (PARTITION BY series_id ORDER BY month) AS y12 FROM x_wf_p)""")
def forecast_yoy(spark, sf):
    p = FC.walk_forward(inputs.price_panel(spark, sf), "ipc_level", {})
    p = FC.forecast_yoy(p, "ipc_level", ["naive", "seasonal"])
    return p.select("series_id", "month", r3("yoy_naive").alias("yoy_naive"), r3("yoy_seasonal").alias("yoy_seasonal"))


@query("backtest_results", f"SELECT series_id, block, model, {', '.join(f'round({m}, 3) AS {m}' for m in METRICS)}, n_test FROM x_metrics")
def backtest_results(spark, sf):
    m = FC.forecast_metrics(predictions(spark, sf), BLOCK)
    return m.select(*BLOCK, "model", *[r3(c).alias(c) for c in METRICS], "n_test")


@query("forecast_metrics", f"WITH g AS ({sql_metrics('series_id')}) SELECT series_id, model, {', '.join(f'round({m}, 3) AS {m}' for m in METRICS)}, n_test FROM g")
def forecast_metrics(spark, sf):
    """Errors pooled over the blocks of each series."""
    m = FC.forecast_metrics(predictions(spark, sf), ["series_id"])
    return m.select("series_id", "model", *[r3(c).alias(c) for c in METRICS], "n_test")


_NOTES = ", ".join(f"CASE WHEN {c} < {limit} THEN '{ERROR_NOTES[c]}' END" for c, limit in (("mape", 5), ("mase", 1), ("theils_u", 1)))
VERDICT_SQL = f"CASE WHEN concat_ws(' | ', {_NOTES}) = '' THEN '{ERROR_NOTES['none']}' ELSE concat_ws(' | ', {_NOTES}) END"


@query("error_verdict", f"SELECT series_id, block, model, {VERDICT_SQL} AS verdict FROM x_metrics")
def error_verdict(spark, sf):
    return FC.forecast_metrics(predictions(spark, sf), BLOCK).select(*BLOCK, "model", F.expr(FC.error_verdict_sql()).alias("verdict"))


@query("backtest_summary", f"""
  WITH m AS (SELECT series_id, model, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM x_metrics GROUP BY 1, 2)
  SELECT series_id, model, {', '.join(f'round({m}, 3) AS {m}' for m in METRICS)}, {VERDICT_SQL} AS verdict FROM m""")
def backtest_summary(spark, sf):
    """Mean of the block metrics (not pooled) per model, with the verdict."""
    m = FC.forecast_metrics(predictions(spark, sf), BLOCK).groupBy("series_id", "model").agg(*[F.avg(c).alias(c) for c in METRICS])
    return m.select("series_id", "model", *[r3(c).alias(c) for c in METRICS], F.expr(FC.error_verdict_sql()).alias("verdict"))


@query("best_model", """
  SELECT series_id, block, model, round(mape, 3) AS mape FROM (SELECT *, row_number() OVER (PARTITION BY series_id, block ORDER BY mape, model) AS rn FROM x_metrics) WHERE rn = 1""")
def best_model(spark, sf):
    """The model of lowest MAPE per block."""
    m = FC.forecast_metrics(predictions(spark, sf), BLOCK)
    best = m.groupBy(*BLOCK).agg(F.min(F.struct("mape", "model")).alias("b"))
    return best.select(*BLOCK, "b.model", r3("b.mape").alias("mape"))


@query("metrics_pivot", """
  SELECT series_id, model, round(max(rmse) FILTER (block = 'A'), 3) AS "A", round(max(rmse) FILTER (block = 'B'), 3) AS "B" FROM x_metrics GROUP BY 1, 2""")
def metrics_pivot(spark, sf):
    m = FC.forecast_metrics(predictions(spark, sf), BLOCK)
    p = m.groupBy("series_id", "model").pivot("block", ["A", "B"]).agg(F.max("rmse"))
    return p.select("series_id", "model", r3("A").alias("A"), r3("B").alias("B"))


@query("metrics_unpivot", """
  SELECT series_id, block, model, v.metric, round(v.value, 3) AS value FROM x_metrics, LATERAL (VALUES """ + ", ".join(f"('{m}', {m})" for m in METRICS) + ") v(metric, value)")
def metrics_unpivot(spark, sf):
    m = FC.forecast_metrics(predictions(spark, sf), BLOCK)
    return m.unpivot([*BLOCK, "model"], METRICS, "metric", "value").withColumn("value", r3("value"))


@query("metrics_grouping_sets", """
  SELECT model, coalesce(block, 'global') AS scope, count(*) AS n_obs, round(sqrt(avg((y - yhat) * (y - yhat))), 3) AS rmse, round(avg(abs(y - yhat)), 3) AS mae
  FROM x_preds GROUP BY GROUPING SETS ((model, block), (model))""")
def metrics_grouping_sets(spark, sf):
    """Per block and pooled in one aggregate."""
    p = predictions(spark, sf)
    g = p.groupingSets([["model", "block"], ["model"]], "model", "block").agg(
        F.count(F.lit(1)).alias("n_obs"), F.expr("round(sqrt(avg((y - yhat) * (y - yhat))), 3)").alias("rmse"), F.expr("round(avg(abs(y - yhat)), 3)").alias("mae"))
    return g.withColumn("scope", F.coalesce("block", F.lit("global"))).drop("block")


def _sql_rss(a, b, c, e, f, i, p, q, r, yy):
    det = f"({a}*({e}*{i}-{f}*{f}) - {b}*({b}*{i}-{f}*{c}) + {c}*({b}*{f}-{e}*{c}))"
    d1 = f"({p}*({e}*{i}-{f}*{f}) - {b}*({q}*{i}-{f}*{r}) + {c}*({q}*{f}-{e}*{r}))"
    d2 = f"({a}*({q}*{i}-{f}*{r}) - {p}*({b}*{i}-{f}*{c}) + {c}*({b}*{r}-{q}*{c}))"
    d3 = f"({a}*({e}*{r}-{q}*{f}) - {b}*({b}*{r}-{q}*{c}) + {p}*({b}*{f}-{e}*{c}))"
    return det, d3, f"({yy} - {d1}/{det}*{p} - {d2}/{det}*{q} - {d3}/{det}*{r})"


_DET, _D3, _RSS3 = _sql_rss("a", "b", "c", "e", "f", "i", "p", "q", "r", "yy")
_RSS2 = "(yy - (p*e - q*b)/(a*e - b*b)*p - (q*a - p*b)/(a*e - b*b)*q)"
_RSS1 = "(yy - p/a*p)"


def _gram_sql(x: str, source: str) -> str:
    cond = f"FILTER (w IS NOT NULL AND w1 IS NOT NULL AND w2 IS NOT NULL AND {x} IS NOT NULL)"
    parts = {"a": "w1*w1", "b": "w1*w2", "c": f"w1*{x}", "e": "w2*w2", "f": f"w2*{x}", "i": f"{x}*{x}", "p": "w1*w", "q": "w2*w", "r": f"{x}*w", "yy": "w*w"}
    return f"SELECT series_id, block, count(*) {cond} AS n, {', '.join(f'sum({v}) {cond} AS {k}' for k, v in parts.items())} FROM {source} GROUP BY 1, 2"


@query("model_ic", f"""
  WITH g AS ({_gram_sql('db', "(SELECT * FROM x_bt_w WHERE part = 'train')")}),
  s AS (SELECT series_id, block, n, {_RSS2} AS rb, {_RSS3} AS rf, {_D3}/{_DET} AS coef, (a*e - b*b)/{_DET} AS inv FROM g WHERE n > 5)
  SELECT series_id, block, n, round(n*ln(rb/n) + 4, 3) AS aic_base, round(n*ln(rf/n) + 6, 3) AS aic_full, round(n*ln(rb/n) + ln(n)*2, 3) AS bic_base, round(n*ln(rf/n) + ln(n)*3, 3) AS bic_full,
    round(n*ln(rb/n) + 4*ln(ln(n)), 3) AS hqic_base, round(n*ln(rf/n) + 6*ln(ln(n)), 3) AS hqic_full, round(coef, 3) AS coef, round(coef / sqrt(rf/(n-3)*inv), 3) AS t_stat FROM s""")
def model_ic(spark, sf):
    g = FC.eval_blocks(gold(spark, sf).select("series_id", "month", "ipc_level", "behavioural_index_lag1"), PANEL_WINDOWS)
    m = FC.model_ic(g.where("part = 'train'"), "ipc_level", "behavioural_index_lag1", BLOCK)
    return m.select(*BLOCK, "n", *[r3(c).alias(c) for c in m.columns if c[:3] in ("aic", "bic", "hqi")], r3("coef").alias("coef"), r3("t_stat").alias("t_stat"))


@query("order_grid", f"""
  WITH g AS ({_gram_sql('w3', 'x_wf_w')}),
  l AS (SELECT series_id, n, v.ar_order, v.aic FROM g, LATERAL (VALUES (1, n*ln({_RSS1}/n) + 2), (2, n*ln({_RSS2}/n) + 4), (3, n*ln({_RSS3}/n) + 6)) v(ar_order, aic) WHERE n > 5)
  SELECT series_id, n, ar_order, round(aic, 3) AS aic, row_number() OVER (PARTITION BY series_id ORDER BY aic, ar_order) = 1 AS best FROM l""")
def order_grid(spark, sf):
    return FC.order_grid(inputs.price_panel(spark, sf), "ipc_level").withColumn("aic", r3("aic"))


_LOOKBACK = [c for c in GOLD_COLS if c not in NOT_DOUBLE]


@query("lookback_windows", f"""
  WITH t AS (SELECT series_id, month, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _LOOKBACK)} FROM x_gold),
  u AS (SELECT * FROM t UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(_LOOKBACK)})))
  SELECT series_id, feature, month, l.n AS lookback, round(list_sum(vals), 3) AS total, round(vals[1], 4) AS oldest, round(vals[len(vals)], 4) AS newest
  FROM (SELECT series_id, feature, month, list(v) FILTER (v IS NOT NULL) OVER (PARTITION BY series_id, feature ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS v6,
         list(v) FILTER (v IS NOT NULL) OVER (PARTITION BY series_id, feature ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS v12,
         list(v) FILTER (v IS NOT NULL) OVER (PARTITION BY series_id, feature ORDER BY month ROWS BETWEEN 18 PRECEDING AND 1 PRECEDING) AS v18,
         list(v) FILTER (v IS NOT NULL) OVER (PARTITION BY series_id, feature ORDER BY month ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS v24 FROM u) p,
       LATERAL (VALUES (6, v6), (12, v12), (18, v18), (24, v24)) l(n, vals) WHERE len(vals) = n""")
def lookback_windows(spark, sf):
    """The previous months of every numeric feature of gold, in long form."""
    long = gold(spark, sf).select("series_id", "month", *[F.col(c).cast("double") for c in _LOOKBACK]).unpivot(["series_id", "month"], _LOOKBACK, "feature", "v")
    lb = P.lookback_windows(long, "v", [6, 12, 18, 24], keys=["series_id", "feature"])
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return lb.select("series_id", "feature", "month", "lookback", F.round(total, 3).alias("total"),
                     r4(F.col("values")[0]).alias("oldest"), r4(F.element_at("values", -1)).alias("newest"))


@query("forecast_daily", f"""
  WITH m AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, avg(value) AS y FROM events GROUP BY 1, 2),
  sp AS (SELECT series_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM m GROUP BY 1),
  d AS (SELECT sp.series_id, sp.day, y, lag(y, 1) OVER o AS y1, lag(y, 7) OVER o AS y7, lag(y, 8) OVER o AS y8 FROM sp LEFT JOIN m ON m.series_id = sp.series_id AND m.day = sp.day WINDOW o AS (PARTITION BY sp.series_id ORDER BY sp.day)),
  w AS (SELECT *, y - y1 - y7 + y8 AS w FROM d), l AS (SELECT *, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY series_id ORDER BY day)),
  s AS (SELECT *, count(y) OVER b AS n_train, last_value(y IGNORE NULLS) OVER b AS last_y, avg(y) OVER b AS mean_y, max(y) OVER b - min(y) OVER b AS rng,
     {', '.join(sql_sums({'a': ['w1'], 'c': ['w1', 'w2']}))} FROM l WINDOW b AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  p AS (SELECT *, CASE WHEN a_n > 1 THEN y1 + y7 - y8 + a_w1_w / nullif(a_w1_w1, 0) * w1 END AS ra, y1 + y7 - y8 + {sql_two('c', 'w2')} AS rc FROM s)
  SELECT series_id, day, n_train, round({sql_guard('ra', 'rc')}, 3) AS pred_seasonal FROM p""")
def forecast_daily(spark, sf):
    """The same operator on a daily panel with a weekly season."""
    p = FC.walk_forward(inputs.event_days(spark, sf), "value", {}, time="day", season=7)
    return p.select("series_id", "day", "n_train", r3("pred_seasonal").alias("pred_seasonal"))
