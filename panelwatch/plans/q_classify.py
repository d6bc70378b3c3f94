"""Queries on early-warning quality: row-level curves and panel signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwatch import config as K
from panelwatch.functions import columns as C
from panelwatch.operators import classify as CL, forecast as FC, index as X, normalise as N, panel as P, press
from panelwatch.plans import inputs
from panelwatch.plans.oracle_weights import lasso_blocks
from panelwatch.plans.q_forecast import BLOCK, EXOG, FULL, MODELS, SQL_MODELS, _sql_fill, gold, sql_guard, sql_sums, sql_three, sql_two
from panelwatch.plans.q_text import NEG, POS, STRONG, sql_any, sql_hits
from panelwatch.plans.registry import cte, query
from panelwatch.plans.stages import staged

SIGNALS = {"behavioural": "behavioural_index_lag1", "hybrid": "hybrid_index_lag1"}


def r4(c):
    return F.round(C.as_col(c), 4)


def r3(c):
    return F.round(C.as_col(c), 3)


# ---- row-level truth and score, scope = language and all together ----


def scoped_scores(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.labelled_scores(spark, sf).selectExpr("y", "score", "explode(array(scope, 'global')) AS scope")


def scoped_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The curve of each scope and of all together; the latter's counts are sums of the former's, so rows are counted once."""
    counts = CL.score_counts(inputs.labelled_scores(spark, sf), ["scope"])
    return CL.curve_of_counts(counts.withColumn("scope", F.explode(F.array("scope", F.lit("global")))), ["scope"])


def curve_sql(source: str, by: str) -> str:
    """Thresholds descending with running counts; ``source`` has y, score and the group columns."""
    return f"""
  SELECT {by}, threshold, n_pos, n_neg, tp, fp, n_pos - tp AS fn, n_neg - fp AS tn, tp - p AS prev_tp, fp - q AS prev_fp,
    coalesce(tp::DOUBLE / nullif(n_pos, 0), 0) AS recall, tp::DOUBLE / (tp + fp) AS precision, coalesce((n_neg - fp)::DOUBLE / nullif(n_neg, 0), 0) AS specificity,
    coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + n_pos - tp, 0), 0) AS f1
  FROM (SELECT {by}, threshold, p, q, sum(p) OVER (PARTITION BY {by} ORDER BY threshold DESC) AS tp, sum(q) OVER (PARTITION BY {by} ORDER BY threshold DESC) AS fp,
     sum(p) OVER (PARTITION BY {by}) AS n_pos, sum(q) OVER (PARTITION BY {by}) AS n_neg
    FROM (SELECT {by}, score AS threshold, sum(y) AS p, sum(1 - y) AS q FROM {source} WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY ALL))"""


def area_sql(source: str, by: str) -> str:
    return f"""
  SELECT {by}, CAST(max(n_pos) AS BIGINT) AS n_pos, CAST(max(n_pos) + max(n_neg) AS BIGINT) AS n_total,
    CASE WHEN max(n_pos) = 0 OR max(n_neg) = 0 THEN 0.5 ELSE sum((fp - prev_fp) * (tp + prev_tp))::DOUBLE / (2.0::DOUBLE * max(n_pos) * max(n_neg)) END AS auc,
    CASE WHEN max(n_pos) = 0 THEN 0.5 WHEN count(*) = 1 THEN max(precision) ELSE sum(CASE WHEN prev_tp + prev_fp > 0
      THEN (tp - prev_tp)::DOUBLE / nullif(n_pos, 0) * (precision + prev_tp::DOUBLE / (prev_tp + prev_fp)) / 2 ELSE 0 END) END AS ap
  FROM {source} GROUP BY {by}"""


cte("x_scoped", "SELECT scope, score, y FROM x_scores UNION ALL SELECT 'global', score, y FROM x_scores")
cte("x_curve", curve_sql("x_scoped", "scope"))
cte("x_areas", area_sql("x_curve", "scope"))


@query("confusion_at_threshold", """
  SELECT scope, tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS precision,
    round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 4) AS specificity, round(coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
    round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 4) AS bal_acc
  FROM (SELECT scope, count(*) FILTER (score >= 1500 AND y = 1) AS tp, count(*) FILTER (score >= 1500 AND y = 0) AS fp,
     count(*) FILTER (score < 1500 AND y = 1) AS fn, count(*) FILTER (score < 1500 AND y = 0) AS tn FROM x_scoped GROUP BY 1)""")
def confusion_at_threshold(spark, sf):
    m = CL.confusion(scoped_scores(spark, sf), ["scope"], "(score >= 1500D)")
    return m.select("scope", "tp", "fp", "fn", "tn", *[r4(c).alias(c) for c in CL.METRIC_SQL])


@query("roc_curve", """
  SELECT scope, 'threshold' AS point, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(recall, 4) AS tpr, round(coalesce(fp::DOUBLE / nullif(n_neg, 0), 0), 4) AS fpr FROM x_curve
  UNION ALL SELECT DISTINCT scope, 'start', NULL, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE FROM x_curve
  UNION ALL SELECT DISTINCT scope, 'end', NULL, CAST(n_pos AS BIGINT), CAST(n_neg AS BIGINT), 1.0::DOUBLE, 1.0::DOUBLE FROM x_curve""")
def roc_curve(spark, sf):
    """Points per distinct score, with the (0, 0) start and the (1, 1) end."""
    c = scoped_curve(spark, sf)
    pts = c.selectExpr("scope", "'threshold' AS point", "threshold", "tp", "fp", "round(recall, 4) AS tpr", f"round({CL.ratio0('fp', 'n_neg')}, 4) AS fpr")
    totals = c.groupBy("scope").agg(F.max("n_pos").alias("p"), F.max("n_neg").alias("q"))
    ends = totals.selectExpr("scope", "stack(2, 'start', 0L, 0L, 0D, 'end', p, q, 1D) AS (point, tp, fp, tpr)")
    return pts.unionByName(ends.selectExpr("scope", "point", "double(null) AS threshold", "tp", "fp", "tpr", "tpr AS fpr"))


@query("roc_auc", "SELECT scope, n_pos, n_total, round(auc, 4) AS auc FROM x_areas")
def roc_auc(spark, sf):
    a = CL.areas(scoped_curve(spark, sf), ["scope"])
    return a.select("scope", "n_pos", "n_total", r4("auc").alias("auc"))


@query("pr_curve", "SELECT scope, threshold, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM x_curve")
def pr_curve(spark, sf):
    c = scoped_curve(spark, sf)
    return c.select("scope", "threshold", *[r4(m).alias(m) for m in ("precision", "recall", "f1")])


@query("average_precision", "SELECT scope, n_pos, n_total, round(ap, 9) AS ap FROM x_areas")
def average_precision(spark, sf):
    a = CL.areas(scoped_curve(spark, sf), ["scope"])
    return a.select("scope", "n_pos", "n_total", F.round("ap", 9).alias("ap"))


def best_sql(source: str, by: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY f1 DESC, threshold DESC) AS rn FROM {source}"


@query("f1_optimal", f"""
  SELECT scope, round(f1, 4) AS f1_opt, threshold AS threshold_opt, round(coalesce(fp::DOUBLE / nullif(n_neg, 0), 0), 4) AS fpr_opt, round(recall, 4) AS recall_opt,
    round(precision, 4) AS precision_opt, round(n_pos::DOUBLE / (n_pos + n_neg), 4) AS baseline, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_pos + n_neg AS BIGINT) AS n_total
  FROM ({best_sql('x_curve', 'scope')}) WHERE rn = 1""")
def f1_optimal(spark, sf):
    o = CL.f1_optimal(scoped_curve(spark, sf), ["scope"])
    return o.select("scope", "threshold_opt", "n_pos", "n_total", *[r4(c).alias(c) for c in ("f1_opt", "fpr_opt", "recall_opt", "precision_opt", "baseline")])


# ---- panel signals against next month's stress ----

cte("x_next", "SELECT *, lead(inflation_yoy) OVER (PARTITION BY series_id ORDER BY month) AS nxt FROM x_gold")
cte("x_stress", f"""
  WITH b AS (SELECT n.*, w.block, CASE WHEN n.month <= w.train_end THEN 'train' ELSE 'test' END AS part FROM x_next n JOIN x_windows w
     ON n.month BETWEEN w.train_start AND w.train_end OR n.month BETWEEN w.test_start AND w.test_end),
  t AS (SELECT series_id, block, quantile_cont(inflation_yoy, 0.75) AS stress_threshold FROM b WHERE part = 'train' GROUP BY 1, 2),
  l AS (SELECT b.*, t.stress_threshold, CASE WHEN nxt >= t.stress_threshold THEN 1 ELSE 0 END AS y FROM b JOIN t USING (series_id, block) WHERE nxt IS NOT NULL AND t.stress_threshold IS NOT NULL),
  f AS (SELECT *, coalesce({_sql_fill('behavioural_index_lag1').replace('series_id, block', 'series_id, block, part')}, 0) AS sb,
     coalesce({_sql_fill('hybrid_index_lag1').replace('series_id, block', 'series_id, block, part')}, 0) AS sh FROM l)
  SELECT series_id, block, part, month, stress_threshold, y, s.signal, s.score FROM f, LATERAL (VALUES ('behavioural', sb), ('hybrid', sh)) s(signal, score)""")
cte("x_train_curve", curve_sql("(SELECT * FROM x_stress WHERE part = 'train')", "series_id, block, signal"))
cte("x_calib", """
  SELECT series_id, block, signal, CASE WHEN n_pos < 3 OR f1 <= 0 THEN 0.5 ELSE threshold END AS threshold
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id, block, signal ORDER BY f1 DESC, threshold) AS rn FROM x_train_curve) WHERE rn = 1""")
cte("x_judged", """
  WITH t AS (SELECT s.*, c.threshold, s.score >= c.threshold AS pred, sum(y) OVER (PARTITION BY series_id, block, signal) AS pos
    FROM (SELECT * FROM x_stress WHERE part = 'test') s JOIN x_calib c USING (series_id, block, signal))
  SELECT *, block AS scope FROM t WHERE pos >= 2 UNION ALL SELECT *, 'global' FROM t WHERE pos >= 2""")
cte("x_med", """
  SELECT series_id, signal, scope, quantile_cont(t, 0.5) AS threshold, quantile_cont(s, 0.5) AS stress_threshold FROM
    (SELECT series_id, signal, scope, block, max(threshold) AS t, max(stress_threshold) AS s FROM x_judged GROUP BY ALL) GROUP BY 1, 2, 3""")
cte("x_conf", """
  SELECT *, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity,
    coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, (coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2 AS bal_acc
  FROM (SELECT series_id, signal, scope, count(*) FILTER (pred AND y = 1) AS tp, count(*) FILTER (pred AND y = 0) AS fp, count(*) FILTER (NOT pred AND y = 1) AS fn,
     count(*) FILTER (NOT pred AND y = 0) AS tn FROM x_judged GROUP BY 1, 2, 3)""")
cte("x_test_curve", curve_sql("x_judged", "series_id, signal, scope"))
cte("x_test_areas", area_sql("x_test_curve", "series_id, signal, scope"))
cte("x_lead", """
  WITH d AS (SELECT j.series_id, j.signal, j.scope, j.month, j.y, j.score, m.threshold FROM x_judged j JOIN x_med m USING (series_id, signal, scope)),
  c AS (SELECT *, CASE WHEN y <> lag(y) OVER w THEN 1 ELSE 0 END AS chg, lead(y) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY series_id, signal, scope ORDER BY month)),
  r AS (SELECT *, sum(chg) OVER (PARTITION BY series_id, signal, scope ORDER BY month) AS run FROM c),
  e AS (SELECT series_id, signal, scope, run, min(month) AS start FROM r WHERE y = 1 GROUP BY 1, 2, 3, 4 HAVING max(CASE WHEN nxt = 0 THEN 1 ELSE 0 END) = 1),
  a AS (SELECT e.series_id, e.signal, e.scope, e.start, max(d.month) AS alert FROM e LEFT JOIN d ON d.series_id = e.series_id AND d.signal = e.signal AND d.scope = e.scope
     AND d.month >= e.start - INTERVAL 12 MONTH AND d.month < e.start AND d.score >= d.threshold GROUP BY 1, 2, 3, 4)
  SELECT series_id, signal, scope, count(*) AS n_episodes, count(alert) AS n_led, avg(date_diff('month', alert, start)) AS lead_time FROM a GROUP BY 1, 2, 3""")
cte("x_ew", """
  SELECT m.*, c.* EXCLUDE (series_id, signal, scope), a.n_pos, a.n_total, a.auc, a.ap, l.lead_time
  FROM x_med m JOIN x_conf c USING (series_id, signal, scope) JOIN x_test_areas a USING (series_id, signal, scope) LEFT JOIN x_lead l USING (series_id, signal, scope)""")


def stress(spark, sf) -> DataFrame:
    return CL.stress_rows(gold(spark, sf), K.PANEL_WINDOWS, SIGNALS)


@query("stress_labels", "SELECT DISTINCT series_id, block, part, month, round(stress_threshold, 4) AS stress_threshold, y FROM x_stress")
def stress_labels(spark, sf):
    rows = CL.stress_rows(gold(spark, sf), K.PANEL_WINDOWS, {"behavioural": SIGNALS["behavioural"]})
    return rows.select(*BLOCK, "part", "month", r4("stress_threshold").alias("stress_threshold"), "y")


@query("calibrate_threshold", "SELECT series_id, block, signal, round(threshold, 4) AS threshold FROM x_calib")
def calibrate_threshold(spark, sf):
    by = [*BLOCK, "signal"]
    c = CL.calibrate(CL.threshold_curve(stress(spark, sf).where("part = 'train'"), by, bounded=True), by)
    return c.withColumn("threshold", r4("threshold"))


@query("lead_time", """
  SELECT series_id, signal, CAST(n_episodes AS BIGINT) AS n_episodes, n_led, round(lead_time, 4) AS lead_time FROM x_lead WHERE scope = 'global' AND n_episodes > 0""")
def lead_time(spark, sf):
    """Over the pooled test months, at the median of the blocks' calibrated thresholds."""
    rows, by = stress(spark, sf), [*BLOCK, "signal"]
    cal = CL.calibrate(CL.threshold_curve(rows.where("part = 'train'"), by, bounded=True), by)
    test = rows.where("part = 'test'").withColumn("_pos", F.expr("sum(y) OVER (PARTITION BY series_id, block, signal)")).where("_pos >= 2")
    kept = cal.join(test.select(*by).distinct(), by, "left_semi")
    med = kept.groupBy("series_id", "signal").agg(F.expr("percentile(threshold, 0.5D)").alias("threshold"))
    lt = CL.lead_time(test.join(med, ["series_id", "signal"]), ["series_id", "signal"])
    return lt.where("n_episodes > 0").withColumn("lead_time", r4("lead_time"))


# areas are small rationals, often exact ties at four decimals; at nine there are none
DIGITS = {"auc": 9, "ap": 9, "delta": 9}
EW_VALUES = ["threshold", "stress_threshold", "recall", "precision", "f1", "specificity", "bal_acc", "auc", "ap"]


def warning_table(spark, sf) -> DataFrame:
    return staged(spark, sf, "early_warning", lambda s, d: CL.early_warning(stress(s, d)))


VERDICT = K.case_text(K.WARNING_VERDICTS, K.WARNING_DEFAULT)


@query("early_warning", f"""
  SELECT series_id, signal, scope, {', '.join(f'round({c}, {DIGITS.get(c, 4)}) AS {c}' for c in EW_VALUES)}, tp, fp, tn, fn, n_pos, n_total, round(lead_time, 2) AS lead_time, {VERDICT} AS verdict FROM x_ew""")
def early_warning(spark: SparkSession, sf: str) -> DataFrame:
    e = CL.early_warning(stress(spark, sf))
    return e.select("series_id", "signal", "scope", *[F.round(c, DIGITS.get(c, 4)).alias(c) for c in EW_VALUES], "tp", "fp", "tn", "fn", "n_pos", "n_total",
                    F.round("lead_time", 2).alias("lead_time"), F.expr(VERDICT).alias("verdict"))


@query("warning_verdict", f"SELECT signal, scope, {VERDICT} AS verdict, count(*) AS n_series FROM x_ew GROUP BY 1, 2, 3")
def warning_verdict(spark, sf):
    return warning_table(spark, sf).groupBy("signal", "scope", F.expr(VERDICT).alias("verdict")).agg(F.count(F.lit(1)).alias("n_series"))


@query("threshold_sweep", """
  WITH d AS (SELECT series_id, target_high_inflation_regime_t1 AS y, coalesce(
       coalesce(last_value(behavioural_index_lag1 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                first_value(behavioural_index_lag1 IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 0) AS score
     FROM x_gold WHERE target_high_inflation_regime_t1 IS NOT NULL),
  q AS (SELECT series_id, unnest(range(30, 96, 5)) AS percentile, unnest(quantile_cont(score, [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS threshold FROM d GROUP BY 1),
  c AS (SELECT series_id, percentile, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp,
     count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = 0) AS tn FROM d JOIN q USING (series_id) GROUP BY 1, 2, 3),
  m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity,
    coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c)
  SELECT series_id, CAST(percentile AS INTEGER) AS percentile, round(threshold, 4) AS threshold, round(recall, 4) AS recall, round(precision, 4) AS precision, round(specificity, 4) AS specificity,
    round(f1, 4) AS f1, round((recall + specificity) / 2, 4) AS bal_acc, row_number() OVER (PARTITION BY series_id ORDER BY f1 DESC, percentile) = 1 AS best FROM m""")
def threshold_sweep(spark, sf):
    g = gold(spark, sf).where("target_high_inflation_regime_t1 IS NOT NULL")
    rows = g.select("series_id", F.col("target_high_inflation_regime_t1").alias("y"), F.coalesce(P.fill_gaps("behavioural_index_lag1"), F.lit(0.0)).alias("score"))
    s = CL.threshold_sweep(rows, ["series_id"])
    return s.select("series_id", "percentile", "best", *[r4(c).alias(c) for c in ("threshold", *CL.METRIC_SQL)])


BIAS, AP_TEXT = K.case_text(K.ROC_BIAS, K.ROC_BIAS_DEFAULT), K.case_text(K.AP_VERDICTS, K.AP_DEFAULT)


@query("roc_pr_comparison", f"""
  WITH o AS (SELECT * FROM ({best_sql('x_test_curve', 'series_id, signal, scope')}) WHERE rn = 1),
  j AS (SELECT a.*, o.f1, o.threshold, o.recall, o.precision, a.auc - a.ap AS delta FROM x_test_areas a JOIN o USING (series_id, signal, scope))
  SELECT series_id, signal, scope, n_pos, n_total, round(n_pos::DOUBLE / n_total, 3) AS pos_share, round(auc, 9) AS auc, round(ap, 9) AS ap, round(delta, 9) AS delta, round(f1, 4) AS f1_opt,
    round(threshold, 4) AS threshold_opt, round(recall, 4) AS recall_opt, round(precision, 4) AS precision_opt, {BIAS} AS roc_bias, {AP_TEXT} AS ap_verdict FROM j""")
def roc_pr_comparison(spark, sf):
    rows = stress(spark, sf).where("part = 'test'").withColumn("_pos", F.expr("sum(y) OVER (PARTITION BY series_id, block, signal)")).where("_pos >= 2")
    by = ["series_id", "signal", "scope"]
    curve = CL.threshold_curve(rows.withColumn("scope", F.explode(F.array("block", F.lit("global")))), by, bounded=True)
    j = CL.areas(curve, by).join(CL.f1_optimal(curve, by).drop("n_pos", "n_total"), by).withColumn("delta", F.expr("auc - ap"))
    return j.select(*by, "n_pos", "n_total", F.expr("round(n_pos / n_total, 3)").alias("pos_share"), *[F.round(c, DIGITS.get(c, 4)).alias(c) for c in ("auc", "ap", "delta", "f1_opt", "threshold_opt", "recall_opt", "precision_opt")],
                    F.expr(BIAS).alias("roc_bias"), F.expr(AP_TEXT).alias("ap_verdict"))


HYP_SQL = K.HYPOTHESIS_RULES
HYP_INPUTS = {
    "auc_b": ("behavioural", "global", "auc"), "auc_h": ("hybrid", "global", "auc"), "recall_b": ("behavioural", "global", "recall"),
    "rec_b": ("behavioural", "B", "recall"), "rec_h": ("hybrid", "B", "recall"),
}


@query("hypothesis_verdicts", f"""
  WITH p AS (SELECT series_id, {', '.join(f"max({m}) FILTER (signal = '{s}' AND scope = '{sc}') AS {n}" for n, (s, sc, m) in HYP_INPUTS.items())} FROM x_ew GROUP BY 1)
  SELECT series_id, round(auc_b, 4) AS auc_behavioural, round(auc_h - auc_b, 4) AS delta_auc, {', '.join(f'{e} AS {n}' for n, e in HYP_SQL.items())} FROM p""")
def hypothesis_verdicts(spark, sf):
    """Both hypotheses by both rules: areas under the curve, and recall."""
    p = warning_table(spark, sf).groupBy("series_id").agg(*[
        F.max(F.when((F.col("signal") == s) & (F.col("scope") == sc), F.col(m))).alias(n) for n, (s, sc, m) in HYP_INPUTS.items()])
    return p.selectExpr("series_id", "round(auc_b, 4) AS auc_behavioural", "round(auc_h - auc_b, 4) AS delta_auc", *[f"{e} AS {n}" for n, e in HYP_SQL.items()])


@query("alerts_vs_episodes", """
  WITH g AS (SELECT g.series_id, m.threshold, behavioural_index_lag1 >= m.threshold AS alert, target_high_inflation_regime_t1 AS y FROM x_gold g
    JOIN x_med m ON m.series_id = g.series_id AND m.signal = 'behavioural' AND m.scope = 'global' WHERE behavioural_index_lag1 IS NOT NULL AND target_high_inflation_regime_t1 IS NOT NULL)
  SELECT series_id, round(threshold, 4) AS threshold, count(*) FILTER (alert AND y = 1) AS tp, count(*) FILTER (alert AND y = 0) AS fp, count(*) FILTER (NOT alert AND y = 1) AS fn,
    round(coalesce((count(*) FILTER (alert AND y = 1))::DOUBLE / nullif(count(*) FILTER (alert), 0), 0), 4) AS precision,
    round(coalesce((count(*) FILTER (alert AND y = 1))::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 0), 4) AS recall FROM g GROUP BY 1, 2""")
def alerts_vs_episodes(spark, sf):
    """Alerts of the delayed signal at the pooled threshold against the regime of next month."""
    thr = warning_table(spark, sf).where("signal = 'behavioural' AND scope = 'global'").select("series_id", "threshold")
    rows = gold(spark, sf).selectExpr("series_id", "behavioural_index_lag1 AS score", "target_high_inflation_regime_t1 AS y").where("score IS NOT NULL").join(thr, "series_id")
    m = CL.confusion(rows, ["series_id", "threshold"], "(score >= threshold)")
    return m.select("series_id", r4("threshold").alias("threshold"), "tp", "fp", "fn", r4("precision").alias("precision"), r4("recall").alias("recall"))


# ---- metrics by period ----

BREAK = "2000-01-01"
PERIODS = {"Bloc A": "split_label LIKE '%test_A%'", "Bloc B": "split_label LIKE '%test_B%'", "Pre": f"month < DATE '{BREAK}'", "Post": f"month >= DATE '{BREAK}'", "Global": "TRUE"}
cte("x_period_rows", f"""
  WITH t AS (SELECT series_id, quantile_cont(inflation_yoy, 0.75) AS thr FROM x_gold WHERE month < DATE '{BREAK}' GROUP BY 1),
  p AS (SELECT w.*, g.inflation_yoy, g.split_label, t.thr, lag(w.y, 12) OVER (PARTITION BY w.series_id ORDER BY w.month) AS y12 FROM x_wf_p w JOIN x_gold g USING (series_id, month) JOIN t USING (series_id)),
  l AS (SELECT series_id, month, split_label, inflation_yoy, thr, y, y12, m.model, m.yhat FROM p, LATERAL (VALUES {SQL_MODELS}) m(model, yhat)),
  s AS (SELECT *, CASE WHEN y IS NOT NULL THEN (yhat / nullif(y12, 0) - 1) * 100 END AS score, CASE WHEN inflation_yoy >= thr THEN 1 WHEN inflation_yoy < thr THEN 0 END AS stress FROM l)
  {' UNION ALL '.join(f"SELECT '{n}' AS period, * FROM s WHERE {c}" for n, c in PERIODS.items())}""")
cte("x_period_curve", curve_sql("(SELECT series_id, period, model, stress AS y, score FROM x_period_rows)", "series_id, period, model"))
cte("x_period_areas", area_sql("x_period_curve", "series_id, period, model"))
cte("x_periods", """
  WITH r AS (SELECT series_id, period, model, max(thr) AS stress_threshold, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae, avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100 AS mape,
     avg(inflation_yoy) AS inflation_yoy_mean, count(*) FILTER (stress IS NOT NULL AND score IS NOT NULL) AS n_obs,
     count(*) FILTER (score >= thr AND stress = 1) AS tp, count(*) FILTER (score >= thr AND stress = 0) AS fp, count(*) FILTER (score < thr AND stress = 1) AS fn FROM x_period_rows GROUP BY 1, 2, 3)
  SELECT r.*, CASE WHEN n_obs > 0 THEN coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) END AS recall, CASE WHEN n_obs > 0 THEN coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) END AS precision,
    CASE WHEN n_obs > 0 THEN coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) END AS f1, (tp + fn) * 100.0::DOUBLE / nullif(n_obs, 0) AS stress_pct,
    a.auc, CASE WHEN a.n_pos = 0 OR a.n_pos = a.n_total THEN a.n_pos::DOUBLE / a.n_total ELSE a.ap END AS ap
  FROM r LEFT JOIN x_period_areas a USING (series_id, period, model)""")
PERIOD_VALUES = ["rmse", "mae", "mape", "recall", "precision", "f1", "auc", "ap", "stress_pct", "inflation_yoy_mean", "stress_threshold"]


def period_table(g: DataFrame) -> DataFrame:
    """Regression and warning metrics of all models over overlapping periods."""
    thr = f"percentile(CASE WHEN month < DATE '{BREAK}' THEN inflation_yoy END, {K.STRESS_QUANTILE}D) OVER (PARTITION BY series_id) AS thr"
    g = g.selectExpr("series_id", "month", "ipc_level", "inflation_yoy", "split_label", *EXOG.values(), thr)
    fc = FC.forecast_yoy(FC.walk_forward(g, "ipc_level", EXOG, full=FULL), "ipc_level", MODELS)
    tags = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in PERIODS.items())
    pairs = ", ".join(f"'{m}', pred_{m}, yoy_{m}" for m in MODELS)
    long = fc.selectExpr("series_id", "ipc_level AS y", "inflation_yoy", "thr", f"array_compact(array({tags})) AS _periods", f"stack({len(MODELS)}, {pairs}) AS (model, yhat, yoy_hat)")
    rows = long.selectExpr("series_id", "explode(_periods) AS period", "model", "y", "yhat", "inflation_yoy", "thr", "CASE WHEN y IS NOT NULL THEN yoy_hat END AS score",
                           "CASE WHEN inflation_yoy >= thr THEN 1 WHEN inflation_yoy < thr THEN 0 END AS stress")
    by = ["series_id", "period", "model"]
    base = rows.groupBy(*by).agg(
        F.max("thr").alias("stress_threshold"), F.expr("sqrt(avg((y - yhat) * (y - yhat)))").alias("rmse"), F.expr("avg(abs(y - yhat))").alias("mae"),
        F.expr("avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100D").alias("mape"), F.avg("inflation_yoy").alias("inflation_yoy_mean"),
        F.expr("count_if(stress IS NOT NULL AND score IS NOT NULL)").alias("n_obs"))
    scored = rows.selectExpr(*by, "stress AS y", "score", "thr").where("score IS NOT NULL")
    conf = CL.confusion(scored, by, "(score >= thr)").selectExpr(*by, "recall", "precision", "f1", "(tp + fn) * 100D / (tp + fp + fn + tn) AS stress_pct")
    areas = CL.areas(CL.threshold_curve(scored, by, bounded=True), by).selectExpr(
        *by, "auc", "CASE WHEN n_pos = 0 OR n_pos = n_total THEN double(n_pos) / n_total ELSE ap END AS ap")
    return base.join(conf, by, "left").join(areas, by, "left")


def periods(spark, sf) -> DataFrame:
    """The period table, computed once and read by both of its queries."""
    return staged(spark, sf, "periods", lambda s, d: period_table(gold(s, d)))


@query("metrics_by_period", f"SELECT series_id, period, model, list_position([{', '.join(repr(p) for p in PERIODS)}], period) - 1 AS period_rank, list_position({MODELS}, model) - 1 AS model_rank, n_obs, {', '.join(f'round({c}, 3) AS {c}' for c in PERIOD_VALUES)} FROM x_periods")
def metrics_by_period(spark, sf):
    t = periods(spark, sf)
    return t.select("series_id", "period", "model", C.declared_rank("period", list(PERIODS)).alias("period_rank"), C.declared_rank("model", MODELS).alias("model_rank"), "n_obs", *[r3(c).alias(c) for c in PERIOD_VALUES])


@query("period_notes", """
  WITH p AS (SELECT series_id, max(rmse) FILTER (period = 'Bloc B' AND model = 'seasonal') - max(rmse) FILTER (period = 'Bloc B' AND model = 'behavioural') AS delta_rmse_b,
      arg_min(model, struct_pack(r := rmse, m := model)) FILTER (period = 'Bloc A' AND rmse IS NOT NULL) AS best_model_a, min(rmse) FILTER (period = 'Bloc A') AS best_rmse_a,
      avg(auc) FILTER (period = 'Global') AS auc_global, avg(auc) FILTER (period = 'Bloc B') AS auc_b FROM x_periods GROUP BY 1)
  SELECT series_id, round(delta_rmse_b, 3) AS delta_rmse_b, CASE WHEN delta_rmse_b > 0 THEN 'signal model better on block B' WHEN delta_rmse_b IS NOT NULL THEN 'seasonal model keeps a slight lead on block B' END AS note_b,
    best_model_a, round(best_rmse_a, 3) AS best_rmse_a, round(auc_global, 9) AS auc_global, round(auc_b, 9) AS auc_b FROM p""")
def period_notes(spark, sf):
    t = periods(spark, sf)
    rmse_b = lambda m: f"max(CASE WHEN period = 'Bloc B' AND model = '{m}' THEN rmse END)"
    p = t.groupBy("series_id").agg(
        F.expr(f"{rmse_b('seasonal')} - {rmse_b('behavioural')}").alias("delta_rmse_b"),
        F.expr("min(CASE WHEN period = 'Bloc A' AND rmse IS NOT NULL THEN struct(rmse, model) END)").alias("_best"),
        F.expr("avg(CASE WHEN period = 'Global' THEN auc END)").alias("auc_global"), F.expr("avg(CASE WHEN period = 'Bloc B' THEN auc END)").alias("auc_b"))
    note = "CASE WHEN delta_rmse_b > 0 THEN 'signal model better on block B' WHEN delta_rmse_b IS NOT NULL THEN 'seasonal model keeps a slight lead on block B' END"
    return p.select("series_id", r3("delta_rmse_b").alias("delta_rmse_b"), F.expr(note).alias("note_b"), F.col("_best.model").alias("best_model_a"),
                    r3("_best.rmse").alias("best_rmse_a"), F.round("auc_global", 9).alias("auc_global"), F.round("auc_b", 9).alias("auc_b"))  # small rationals, often exact ties at three digits


# ---- blends with the text signal ----

cte("x_text_panel", f"""
  WITH m AS (SELECT CAST(DATE '1995-01-01' + INTERVAL (CAST(doc_id % 83 AS INTEGER)) MONTH AS DATE) AS month,
     CAST(({sql_hits('t', NEG)}) - ({sql_hits('t', POS)}) AS DOUBLE) * CASE WHEN {sql_any('t', STRONG)} THEN 1.5::DOUBLE ELSE 1 END AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
  a AS (SELECT month, avg(score) AS s FROM m GROUP BY 1)
  SELECT month, greatest(0, least(1, (s - min(CASE WHEN month <= DATE '1998-12-01' THEN s END) OVER ()) / (max(CASE WHEN month <= DATE '1998-12-01' THEN s END) OVER () - min(CASE WHEN month <= DATE '1998-12-01' THEN s END) OVER ()))) AS text_norm FROM a""")
cte("x_blends", """
  SELECT g.series_id, g.month, g.ipc_level, g.behavioural_index, g.target_high_inflation_regime_t1, coalesce(t.text_norm, 0) AS text_norm, 0.7 * g.behavioural_index + 0.3 * coalesce(t.text_norm, 0) AS blend_fixed
  FROM x_gold g LEFT JOIN x_text_panel t ON t.month = g.month""")


def text_panel(spark, sf) -> DataFrame:
    """Monthly text score on the months of the price panel, scaled on the training part."""
    month = F.add_months(F.lit("1995-01-01").cast("date"), F.pmod("doc_id", F.lit(83)).cast("int"))
    docs = inputs.documents(spark, sf).select(month.alias("month"), "text")
    scored = press.with_scores(docs, NEG, POS, STRONG).groupBy("month").agg(F.avg("score").alias("s")).withColumn("series_id", F.lit("all"))
    return scored.select("month", N.minmax_train("s", N.train_rows(K.PANEL_TRAIN_END)).alias("text_norm"))


def blends(spark, sf) -> DataFrame:
    return staged(spark, sf, "blends", build_blends)


def build_blends(spark, sf) -> DataFrame:
    """Gold with the text signal (0 where there is none; one row per month) and the fixed blend."""
    g = gold(spark, sf).join(F.broadcast(text_panel(spark, sf)), "month", "left").withColumn("text_norm", F.coalesce("text_norm", F.lit(0.0)))
    return g.withColumn("blend_fixed", X.blend(F.col("behavioural_index"), F.col("text_norm")))


@query("blend_fixed", "SELECT series_id, month, round(behavioural_index, 4) AS behavioural_index, round(text_norm, 4) AS text_norm, round(blend_fixed, 4) AS blend_fixed FROM x_blends")
def blend_fixed(spark, sf):
    return blends(spark, sf).select("series_id", "month", *[r4(c).alias(c) for c in ("behavioural_index", "text_norm", "blend_fixed")])


def lasso_blend(spark, sf) -> DataFrame:
    """Blend weights per series from the positive lasso on the unscaled signals (null counts as 0)."""
    b = blends(spark, sf)
    feats = ["behavioural_index", "text_norm"]
    train = b.where(f"month <= DATE '{K.PANEL_TRAIN_END}' AND target_inflation_yoy_t1 IS NOT NULL").selectExpr(
        "series_id", "month", "coalesce(behavioural_index, 0D) AS behavioural_index", "text_norm", "target_inflation_yoy_t1 AS y")
    fits = X.fit_weights(X.gram_by_fold(train, feats, "y"), feats, "lasso", standardise=False)
    # all-zero coefficients put the whole weight on the behavioural index
    w = fits.selectExpr("series_id", "CASE WHEN method = 'equal' THEN 1D ELSE weight[0] END AS alpha", "CASE WHEN method = 'equal' THEN 0D ELSE weight[1] END AS beta")
    return b.join(w, "series_id").withColumn("blend_lasso", F.expr("alpha * behavioural_index + beta * text_norm"))


cte("x_blend_train", f"SELECT series_id, month, coalesce(behavioural_index, 0) AS behavioural_index, text_norm, lead_yoy AS y FROM (SELECT b.*, g.target_inflation_yoy_t1 AS lead_yoy FROM x_blends b JOIN x_gold g USING (series_id, month)) WHERE month <= DATE '{K.PANEL_TRAIN_END}' AND lead_yoy IS NOT NULL")
lasso_blocks("x_bl", "x_blend_train", ["behavioural_index", "text_norm"], standardise=False)
cte("x_blend_lasso", """
  SELECT b.*, CASE WHEN method = 'equal' THEN 1 ELSE g0 END AS alpha, CASE WHEN method = 'equal' THEN 0 ELSE g1 END AS beta, CASE WHEN method = 'equal' THEN behavioural_index ELSE g0 * behavioural_index + g1 * text_norm END AS blend_lasso
  FROM x_blends b JOIN x_bl_fit f ON f.series_id = b.series_id""")


@query("blend_lasso", "SELECT series_id, month, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(blend_lasso, 4) AS blend_lasso FROM x_blend_lasso")
def blend_lasso(spark, sf):
    return lasso_blend(spark, sf).select("series_id", "month", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), r4("blend_lasso").alias("blend_lasso"))


VARIANTS = {"behavioural": "behavioural_index_lag1", "blend": "blend_fixed_lag1", "text": "text_norm_lag1"}


def comparison(b: DataFrame, variants: dict[str, str] = VARIANTS) -> DataFrame:
    """Per series and signal variant on block B: AIC, RMSE, threshold metrics, AP, AIC difference to the first."""
    win = [w for w in K.PANEL_WINDOWS if w.label == "B"]
    b = P.add_lags(b.drop("behavioural_index_lag1"), {c.removesuffix("_lag1"): [1] for c in variants.values()})
    cols = list(variants.values())
    b = FC.eval_blocks(b.select("series_id", "month", "ipc_level", "target_high_inflation_regime_t1", *cols), win)
    fc = FC.walk_forward(b, "ipc_level", variants, BLOCK).where("part = 'test' AND ipc_level IS NOT NULL")
    preds = FC.long_predictions(fc, "ipc_level", list(variants), ["series_id"])
    rmse = preds.groupBy("series_id", F.col("model").alias("variant")).agg(F.expr("sqrt(avg((y - yhat) * (y - yhat)))").alias("rmse"))
    train = b.where("part = 'train'").na.fill(0.0, cols)  # the criterion takes a missing signal as zero
    ics = [FC.model_ic(train, "ipc_level", c, ["series_id"]).selectExpr("series_id", f"'{v}' AS variant", "aic_full AS aic") for v, c in variants.items()]
    ic = reduce(DataFrame.unionByName, ics)
    pairs = ", ".join(f"'{v}', coalesce({c}, 0D)" for v, c in variants.items())
    rows = b.where("target_high_inflation_regime_t1 IS NOT NULL").selectExpr("series_id", "part", "int(target_high_inflation_regime_t1) AS y", f"stack({len(variants)}, {pairs}) AS (variant, score)")
    by = ["series_id", "variant"]
    cal = CL.calibrate(CL.threshold_curve(rows.where("part = 'train'"), by, bounded=True), by)
    test = rows.where("part = 'test'")
    conf = CL.confusion(test.join(cal, by), [*by, "threshold"], "(score >= threshold)")
    ap = CL.areas(CL.threshold_curve(test, by, bounded=True), by).select(*by, "ap")
    out = rmse.join(ic, by, "left").join(conf, by).join(ap, by)
    return out.withColumn("aic_delta", F.expr("aic - max(CASE WHEN variant = 'behavioural' THEN aic END) OVER (PARTITION BY series_id)"))


def _variant_sql(x: str, source: str, variants: dict[str, str]) -> None:
    """Blocks ``{x}_...`` and ``{x}``: the comparison of signals ``variant: column`` of ``source``."""
    lags = ", ".join(f"lag({c}) OVER o AS v{i}" for i, c in enumerate(variants.values()))
    values = ", ".join(f"('{v}', v{i})" for i, v in enumerate(variants))
    cte(f"{x}_w", f"""
      WITH l AS (SELECT *, {lags} FROM {source} WINDOW o AS (PARTITION BY series_id ORDER BY month)),
      b AS (SELECT *, 'B' AS block, CASE WHEN month <= DATE '1999-12-01' THEN 'train' ELSE 'test' END AS part FROM l WHERE month BETWEEN DATE '1995-01-01' AND DATE '2001-11-01'),
      u AS (SELECT b.series_id, b.month, b.part, b.ipc_level AS y, b.target_high_inflation_regime_t1 AS cls, v.variant, v.x FROM b, LATERAL (VALUES {values}) v(variant, x)),
      f AS (SELECT *, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY series_id, variant ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         first_value(x IGNORE NULLS) OVER (PARTITION BY series_id, variant ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fx FROM u),
      d AS (SELECT *, lag(y, 1) OVER o AS y1, lag(y, 12) OVER o AS y12, lag(y, 13) OVER o AS y13, fx - lag(fx, 1) OVER o - lag(fx, 12) OVER o + lag(fx, 13) OVER o AS dx,
         coalesce(x, 0) - lag(coalesce(x, 0), 1) OVER o - lag(coalesce(x, 0), 12) OVER o + lag(coalesce(x, 0), 13) OVER o AS dz FROM f WINDOW o AS (PARTITION BY series_id, variant ORDER BY month)),
      w AS (SELECT *, y - y1 - y12 + y13 AS w FROM d)
      SELECT *, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY series_id, variant ORDER BY month)""")
    three = {"a": "w1*w1", "b": "w1*w2", "c": "w1*dz", "e": "w2*w2", "f": "w2*dz", "i": "dz*dz", "p": "w1*w", "q": "w2*w", "r": "dz*w", "yy": "w*w"}
    full = "FILTER (w IS NOT NULL AND w1 IS NOT NULL AND w2 IS NOT NULL AND dz IS NOT NULL)"
    det = "nullif(a*(e*i-f*f) - b*(b*i-f*c) + c*(b*f-e*c), 0)"
    d1, d2, d3 = "(p*(e*i-f*f) - b*(q*i-f*r) + c*(q*f-e*r))", "(a*(q*i-f*r) - p*(b*i-f*c) + c*(b*r-q*c))", "(a*(e*r-q*f) - b*(b*r-q*c) + p*(b*f-e*c))"
    cte(f"{x}_ic", f"""
      WITH g AS (SELECT series_id, variant, count(*) {full} AS n, {', '.join(f'sum({v}) {full} AS {k}' for k, v in three.items())} FROM {x}_w WHERE part = 'train' GROUP BY 1, 2)
      SELECT series_id, variant, n * ln((yy - {d1}/{det}*p - {d2}/{det}*q - {d3}/{det}*r) / n) + 6 AS aic FROM g WHERE n > 5""")
    specs = {"a": ["w1"], "c": ["w1", "w2"], "ax": ["w1", "dx"], "cx": ["w1", "w2", "dx"]}
    cte(f"{x}_rmse", f"""
      WITH s AS (SELECT *, count(y) OVER b AS n_train, last_value(y IGNORE NULLS) OVER b AS last_y, avg(y) OVER b AS mean_y, max(y) OVER b - min(y) OVER b AS rng, count(x) OVER b AS nx,
          {', '.join(sql_sums(specs))} FROM {x}_w WINDOW b AS (PARTITION BY series_id, variant ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      r AS (SELECT *, CASE WHEN a_n > 1 THEN y1 + y12 - y13 + a_w1_w / nullif(a_w1_w1, 0) * w1 END AS ra, y1 + y12 - y13 + {sql_two('c', 'w2')} AS rc,
          y1 + y12 - y13 + {sql_two('ax', 'dx')} AS rax, y1 + y12 - y13 + {sql_three('cx', 'dx')} AS rcx FROM s WHERE part = 'test' AND y IS NOT NULL)
      SELECT series_id, variant, sqrt(avg(power(y - CASE WHEN nx > 0 THEN {sql_guard('rax', 'rcx')} ELSE {sql_guard('ra', 'rc')} END, 2))) AS rmse FROM r GROUP BY 1, 2""")
    rows = f"(SELECT series_id, variant, part, CAST(cls AS INTEGER) AS y, coalesce(x, 0) AS score FROM {x}_w WHERE cls IS NOT NULL)"
    cte(f"{x}_rows", f"SELECT * FROM {rows}")
    cte(f"{x}_train", curve_sql(f"(SELECT * FROM {x}_rows WHERE part = 'train')", "series_id, variant"))
    cte(f"{x}_cal", f"""
      SELECT series_id, variant, CASE WHEN n_pos < 3 OR f1 <= 0 THEN 0.5 ELSE threshold END AS threshold
      FROM (SELECT *, row_number() OVER (PARTITION BY series_id, variant ORDER BY f1 DESC, threshold) AS rn FROM {x}_train) WHERE rn = 1""")
    cte(f"{x}_test", curve_sql(f"(SELECT * FROM {x}_rows WHERE part = 'test')", "series_id, variant"))
    cte(f"{x}_ap", area_sql(f"{x}_test", "series_id, variant"))
    cte(f"{x}_conf", f"""
      SELECT series_id, variant, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn
      FROM (SELECT * FROM {x}_rows WHERE part = 'test') JOIN {x}_cal USING (series_id, variant) GROUP BY 1, 2, 3""")
    cte(x, f"""
      SELECT r.series_id, r.variant, i.aic, r.rmse, c.threshold, c.tp, c.fp, c.fn, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
        coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, a.ap, i.aic - max(CASE WHEN r.variant = 'behavioural' THEN i.aic END) OVER (PARTITION BY r.series_id) AS aic_delta
      FROM {x}_rmse r LEFT JOIN {x}_ic i USING (series_id, variant) JOIN {x}_conf c USING (series_id, variant) JOIN {x}_ap a USING (series_id, variant)""")


_variant_sql("x_var", "x_blends", {"behavioural": "behavioural_index", "blend": "blend_fixed", "text": "text_norm"})
_variant_sql("x_vl", "x_blend_lasso", {"behavioural": "behavioural_index", "blend": "blend_fixed", "text": "text_norm", "lasso": "blend_lasso"})
VARIANT_VALUES = ["aic", "rmse", "recall", "precision", "f1", "ap", "threshold", "aic_delta"]


@query("signal_comparison", f"SELECT series_id, variant, {', '.join(f'round({c}, 3) AS {c}' for c in VARIANT_VALUES)}, tp, fp, fn FROM x_var")
def signal_comparison(spark, sf):
    return comparison(blends(spark, sf)).select("series_id", "variant", *[r3(c).alias(c) for c in VARIANT_VALUES], "tp", "fp", "fn")


@query("signal_verdict", """
  WITH p AS (SELECT series_id, max(aic) FILTER (variant = 'behavioural') AS a1, max(aic) FILTER (variant = 'blend') AS a2, max(recall) FILTER (variant = 'behavioural') AS r1, max(recall) FILTER (variant = 'blend') AS r2 FROM x_var GROUP BY 1)
  SELECT series_id, 0.3::DOUBLE AS beta, CASE WHEN a2 < a1 AND r2 >= r1 THEN 'A' ELSE 'B' END AS verdict FROM p""")
def signal_verdict(spark, sf):
    """A: the text adds to the signal; B: it does not pay; C: it has no weight. Here for the fixed weight 0.3."""
    return verdict(comparison(blends(spark, sf)).withColumn("beta", F.lit(0.3)))


def verdict(table: DataFrame, base: str = "behavioural", challenger: str = "blend") -> DataFrame:
    pick = lambda c, v: F.max(F.when(F.col("variant") == v, F.col(c)))
    p = table.groupBy("series_id", "beta").agg(pick("aic", base).alias("a1"), pick("aic", challenger).alias("a2"), pick("recall", base).alias("r1"), pick("recall", challenger).alias("r2"))
    return p.selectExpr("series_id", "beta", "CASE WHEN beta = 0 THEN 'C' WHEN a2 < a1 AND r2 >= r1 THEN 'A' ELSE 'B' END AS verdict")


@query("signal_comparison_lasso", f"""
  WITH p AS (SELECT series_id, max(aic) FILTER (variant = 'behavioural') AS a1, max(aic) FILTER (variant = 'lasso') AS a2, max(recall) FILTER (variant = 'behavioural') AS r1, max(recall) FILTER (variant = 'lasso') AS r2 FROM x_vl GROUP BY 1),
  b AS (SELECT series_id, max(beta) AS beta FROM x_blend_lasso GROUP BY 1)
  SELECT series_id, variant, {', '.join(f'round({c}, 3) AS {c}' for c in VARIANT_VALUES)}, tp, fp, fn, round(beta, 6) AS beta,
    CASE WHEN beta = 0 THEN 'C' WHEN a2 < a1 AND r2 >= r1 THEN 'A' ELSE 'B' END AS verdict FROM x_vl JOIN p USING (series_id) JOIN b USING (series_id)""")
def signal_comparison_lasso(spark, sf):
    """All four variants, the lasso blend included, with the verdict from its own weight."""
    b = staged(spark, sf, "blend_lasso", lasso_blend)
    table = comparison(b, {**VARIANTS, "lasso": "blend_lasso_lag1"}).join(b.groupBy("series_id").agg(F.max("beta").alias("beta")), "series_id")
    return table.select("series_id", "variant", *[r3(c).alias(c) for c in VARIANT_VALUES], "tp", "fp", "fn", F.round("beta", 6).alias("beta")).join(
        verdict(table, challenger="lasso").select("series_id", "verdict"), "series_id")
