"""Queries on forecast comparison, bootstrap intervals, series statistics and signal selection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwatch import config as K
from panelwatch.functions import columns as C
from panelwatch.functions.tails import f_pvalue, t_pvalue
from panelwatch.operators import inference as I, panel as P, select as S, stats as ST
from panelwatch.plans import gold as G, inputs
from panelwatch.plans.q_classify import BREAK, stress
from panelwatch.plans.q_forecast import MODELS, gold, predictions
from panelwatch.plans.q_gold import GOLD_COLS, NOT_DOUBLE
from panelwatch.plans.registry import cte, query, sql_dot, sql_f_tail, sql_solve, sql_t_tail
from panelwatch.plans.stages import folder, staged
from panelwatch.session import cut_lineage
from panelwatch.sources import landed


def r4(c):
    return F.round(C.as_col(c), 4)


def r3(c):
    return F.round(C.as_col(c), 3)


# ---- Diebold-Mariano ----

SQL_PHI = """(CASE WHEN {x} >= 0 THEN 0.5 * (1 + {e}) ELSE 0.5 * (1 - {e}) END)"""


def sql_phi(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return SQL_PHI.format(x=x, e=f"(1 - ({poly}) * exp(-({x}) * ({x}) / 2))")


cte("x_err", f"""
  SELECT series_id, block, month, {', '.join(f"max(y - yhat) FILTER (model = '{m}') AS e_{m}" for m in MODELS)} FROM x_preds GROUP BY 1, 2, 3""")
_PAIRS = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1:]]
cte("x_loss", f"""
  WITH p AS (SELECT series_id, block, month, v.* FROM x_err, LATERAL (VALUES {', '.join(f"('{a}', '{b}', e_{a}, e_{b})" for a, b in _PAIRS)}) v(model_1, model_2, e1, e2))
  SELECT series_id, block, month, model_1, model_2, l.loss, l.d FROM p, LATERAL (VALUES ('MSE', e1 * e1 - e2 * e2), ('MAE', abs(e1) - abs(e2))) l(loss, d)""")
cte("x_dm", """
  SELECT series_id, scope, model_1, model_2, loss, count(*) AS n_obs, avg(d) / nullif(sqrt(var_pop(d) / count(*)), 0) * sqrt((count(*) - 1)::DOUBLE / count(*)) AS dm_stat
  FROM (SELECT *, block AS scope FROM x_loss UNION ALL SELECT *, 'global' FROM x_loss) WHERE d IS NOT NULL GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 8""")


@query("diebold_mariano", """
  WITH d AS (SELECT series_id, month, e_naive * e_naive - e_seasonal * e_seasonal AS d, row_number() OVER w AS i FROM x_err WINDOW w AS (PARTITION BY series_id ORDER BY month)),
  m AS (SELECT *, d - avg(d) OVER (PARTITION BY series_id) AS c FROM d),
  l AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM m WINDOW w AS (PARTITION BY series_id ORDER BY month)),
  a AS (SELECT series_id, count(*) AS n, avg(d) AS mean, sum(c * c) / count(*) AS g0, sum(c * c1) / count(*) AS g1, sum(c * c2) / count(*) AS g2 FROM l GROUP BY 1)
  SELECT series_id, 1 AS h, n AS n_obs, round(CASE WHEN n >= 8 THEN mean / nullif(sqrt(g0 / n), 0) * sqrt((n - 1)::DOUBLE / n) END, 4) AS dm_stat FROM a
  UNION ALL SELECT series_id, 3, n, round(CASE WHEN n >= 8 THEN mean / sqrt(greatest(g0 + 2 * (2.0 / 3) * g1 + 2 * (1.0 / 3) * g2, 1e-12) / n) * sqrt((n - 5 + 6.0::DOUBLE / n) / n) END, 4) FROM a""")
def diebold_mariano(spark: SparkSession, sf: str) -> DataFrame:
    """Naive against seasonal over all test months, at horizons 1 and 3."""
    e = I.wide_errors(predictions(spark, sf), MODELS, ["series_id", "block", "month"]).withColumn("d", F.expr("e_naive * e_naive - e_seasonal * e_seasonal"))
    one, three = (I.dm_test(e, ["series_id"], h=h).withColumn("h", F.lit(h)) for h in (1, 3))
    return one.unionByName(three).select("series_id", "h", "n_obs", r4("dm_stat").alias("dm_stat"))


_T = K.DM_TEXT


@query("dm_pairwise", f"""
  WITH a AS (SELECT x_dm.*, v.alternative FROM x_dm, (VALUES ('two-sided'), ('one-sided')) v(alternative)),
  p AS (SELECT *, CASE WHEN dm_stat IS NULL THEN NULL ELSE greatest(0, least(1, CASE WHEN alternative = 'two-sided' THEN 2 * (1 - {sql_phi('abs(dm_stat)')}) ELSE 1 - {sql_phi('dm_stat')} END)) END AS p_value FROM a)
  SELECT series_id, scope, model_1, model_2, loss, alternative, n_obs, round(dm_stat, 4) AS dm_stat, round(p_value, 5) AS p_value,
    CASE WHEN p_value IS NULL THEN '{_T['few']}' WHEN alternative = 'one-sided' THEN CASE WHEN p_value < 0.05 THEN '{_T['one_yes']}' ELSE '{_T['one_no']}' END
      WHEN p_value < 0.05 THEN '{_T['two_yes']}' ELSE '{_T['two_no']}' END AS conclusion FROM p""")
def dm_pairwise(spark, sf):
    d = I.dm_pairwise(predictions(spark, sf), MODELS, ["series_id"])
    return d.withColumns({"dm_stat": r4("dm_stat"), "p_value": F.round("p_value", 5)})


# ---- bootstrap ----

HASH = "(((rep * 7919 + {pos} * 104729 + 42 * 1299721) % 2147483647) * 48271) % 2147483647"
cte("x_groups", """
  SELECT series_id, scope, model, y - yhat AS e, row_number() OVER (PARTITION BY series_id, scope, model ORDER BY block, month) - 1 AS idx, count(*) OVER (PARTITION BY series_id, scope, model) AS n
  FROM (SELECT *, block AS scope FROM x_preds UNION ALL SELECT *, 'global' FROM x_preds) WHERE yhat IS NOT NULL""")
cte("x_ns", "SELECT DISTINCT n FROM x_groups")


def sql_draws(source: str, reps: int) -> str:
    """(n, rep, pos, idx) for every distinct n of ``source``."""
    return f"""
  SELECT n, rep, blk * 6 + j AS pos, ({HASH.format(pos='blk')} % n + j) % n AS idx
  FROM {source}, (SELECT unnest(range(1, {reps + 1})) AS rep), (SELECT unnest(range(0, 100)) AS blk), (SELECT unnest(range(0, 6)) AS j)
  WHERE blk < ceil(n / 6.0) AND blk * 6 + j < n"""


cte("x_draws", sql_draws("x_ns", K.BOOTSTRAP_REPS))
cte("x_boot_err", """
  WITH r AS (SELECT g.series_id, g.scope, g.model, d.rep, sqrt(avg(g.e * g.e)) AS rmse, avg(abs(g.e)) AS mae FROM x_groups g JOIN x_draws d ON d.n = g.n AND d.idx = g.idx GROUP BY 1, 2, 3, 4)
  SELECT series_id, scope, model, quantile_cont(rmse, 0.025) AS rmse_lo, quantile_cont(rmse, 0.975) AS rmse_hi, quantile_cont(mae, 0.025) AS mae_lo, quantile_cont(mae, 0.975) AS mae_hi FROM r GROUP BY 1, 2, 3""")


@query("block_bootstrap_idx", f"""
  WITH s AS (SELECT series_id, block, count(*) AS n FROM x_preds WHERE model = 'naive' GROUP BY 1, 2), ns AS (SELECT DISTINCT n FROM s), d AS ({sql_draws('ns', K.BOOTSTRAP_REPS)})
  SELECT series_id, block, CAST(rep AS INTEGER) AS rep, CAST(pos AS INTEGER) AS pos, CAST(idx AS INTEGER) AS idx FROM s JOIN d USING (n)""")
def block_bootstrap_idx(spark, sf):
    n = predictions(spark, sf).where("model = 'naive'").groupBy("series_id", "block").agg(F.count(F.lit(1)).alias("n"))
    return I.block_bootstrap_indices(n, ["series_id", "block"])


def scoped_errors(spark, sf) -> DataFrame:
    """Error arrays per series, model and scope, spread over all cores for the replicate work."""
    rows = predictions(spark, sf).where("yhat IS NOT NULL").selectExpr("series_id", "model", "block", "month", "y - yhat AS e", "explode(array(block, 'global')) AS scope")
    by = ["series_id", "scope", "model"]
    return _spread(I.ordered_arrays(rows, by, ["e"], ["block", "month"]), by)


def _spread(arrays: DataFrame, by: list[str]) -> DataFrame:
    """One task per shuffle partition: the rows are few bytes, but each costs a thousand replicates."""
    return arrays.repartition(int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def error_table(spark, sf) -> DataFrame:
    """Error intervals of all series, models and scopes, computed once and read by all that compare them."""
    def build(s, d):
        found = scoped_errors(s, d).select("series_id", "scope", "model", F.size("e").cast("bigint").alias("n_obs"), I.error_intervals(F.col("e")).alias("b"))
        return found.select("series_id", "scope", "model", "n_obs", "b.*")

    return staged(spark, sf, "error_intervals", build)


@query("bootstrap_ci_error", """
  SELECT b.series_id, b.scope, b.model, p.n AS n_obs, round(p.rmse, 3) AS rmse, round(rmse_lo, 3) AS rmse_lo, round(rmse_hi, 3) AS rmse_hi, round(rmse_hi - rmse_lo, 3) AS rmse_width,
    round(p.mae, 3) AS mae, round(mae_lo, 3) AS mae_lo, round(mae_hi, 3) AS mae_hi, round(mae_hi - mae_lo, 3) AS mae_width
  FROM x_boot_err b JOIN (SELECT series_id, scope, model, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM x_groups GROUP BY 1, 2, 3) p USING (series_id, scope, model)""")
def bootstrap_ci_error(spark, sf):
    d = error_table(spark, sf)
    vals = ["rmse", "rmse_lo", "rmse_hi", "mae", "mae_lo", "mae_hi"]
    return d.select("series_id", "scope", "model", "n_obs", *[r3(v).alias(v) for v in vals], F.expr("round(rmse_hi - rmse_lo, 3)").alias("rmse_width"), F.expr("round(mae_hi - mae_lo, 3)").alias("mae_width"))


@query("bayes_bootstrap", f"""
  WITH w AS (SELECT rep, pos, -ln(({HASH.format(pos='pos')} + 0.5::DOUBLE) / 2147483647) AS w FROM (SELECT unnest(range(1, {K.BOOTSTRAP_REPS + 1})) AS rep), (SELECT unnest(range(0, 200)) AS pos) WHERE pos < (SELECT max(n) FROM x_groups)),
  r AS (SELECT g.series_id, g.scope, g.model, w.rep, sqrt(sum(w.w * g.e * g.e) / sum(w.w)) AS rmse FROM x_groups g JOIN w ON w.pos = g.idx GROUP BY 1, 2, 3, 4)
  SELECT series_id, scope, model, round(quantile_cont(rmse, 0.025), 3) AS rmse_bayes_lo, round(quantile_cont(rmse, 0.975), 3) AS rmse_bayes_hi FROM r GROUP BY 1, 2, 3""")
def bayes_bootstrap(spark, sf):
    d = error_table(spark, sf)
    return d.select("series_id", "scope", "model", r3("rmse_bayes_lo").alias("rmse_bayes_lo"), r3("rmse_bayes_hi").alias("rmse_bayes_hi"))


cte("x_cls", """
  SELECT series_id, scope, signal, y, score, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY series_id, scope, signal) AS n
  FROM (SELECT *, block AS scope FROM x_stress WHERE part = 'test' UNION ALL SELECT *, 'global' FROM x_stress WHERE part = 'test') WINDOW w AS (PARTITION BY series_id, scope, signal ORDER BY block, month)""")
cte("x_cls_ns", "SELECT DISTINCT n FROM x_cls")
cte("x_cls_draws", sql_draws("x_cls_ns", K.BOOTSTRAP_REPS) + " UNION ALL SELECT n, 0, pos, pos FROM x_cls_ns, (SELECT unnest(range(0, 600)) AS pos) WHERE pos < n")
cte("x_cls_boot", """
  WITH s AS (SELECT c.series_id, c.scope, c.signal, d.rep, c.score, sum(c.y) AS p, sum(1 - c.y) AS q FROM x_cls c JOIN x_cls_draws d ON d.n = c.n AND d.idx = c.idx GROUP BY ALL),
  r AS (SELECT *, sum(p) OVER o AS tp, sum(q) OVER o AS fp, sum(p) OVER g AS np, sum(q) OVER g AS nq FROM s WINDOW o AS (PARTITION BY series_id, scope, signal, rep ORDER BY score DESC), g AS (PARTITION BY series_id, scope, signal, rep)),
  f AS (SELECT *, (2 * tp)::DOUBLE / (tp + fp + np) AS f1 FROM r)
  SELECT series_id, scope, signal, rep, CASE WHEN max(np) = 0 OR max(nq) = 0 THEN 0.5::DOUBLE ELSE sum(q * (2 * tp - p))::DOUBLE / (2.0::DOUBLE * max(np) * max(nq)) END AS auc,
    CASE WHEN max(np) = 0 THEN 0 ELSE max(f1) END AS f1, CASE WHEN max(np) = 0 THEN 0 ELSE arg_max(tp::DOUBLE / nullif(np, 0), struct_pack(f := f1, s := -score)) END AS recall,
    CASE WHEN max(np) = 0 THEN 0 ELSE arg_max(tp::DOUBLE / (tp + fp), struct_pack(f := f1, s := -score)) END AS precision FROM f GROUP BY 1, 2, 3, 4""")
_CLS = ["auc", "f1", "recall", "precision"]
cte("x_cls_ci", f"""
  SELECT series_id, scope, signal, {', '.join(f'max({m}) FILTER (rep = 0) AS {m}, quantile_cont({m}, 0.025) FILTER (rep > 0) AS {m}_lo, quantile_cont({m}, 0.975) FILTER (rep > 0) AS {m}_hi' for m in _CLS)} FROM x_cls_boot GROUP BY 1, 2, 3""")


def class_table(spark, sf) -> DataFrame:
    """Intervals of the classification metrics, computed once."""
    return staged(spark, sf, "class_intervals", _class_table)


def _class_table(spark, sf) -> DataFrame:
    rows = stress(spark, sf).where("part = 'test'").selectExpr("series_id", "signal", "block", "month", "y", "score", "explode(array(block, 'global')) AS scope")
    by = ["series_id", "scope", "signal"]
    arrays = _spread(I.ordered_arrays(rows, by, ["y", "score"], ["block", "month"]), by)
    return arrays.select(*by, F.size("y").cast("bigint").alias("n_obs"), I.class_intervals(F.col("y"), F.col("score")).alias("b")).select(*by, "n_obs", "b.*")


@query("bootstrap_ci_class", f"""
  SELECT c.series_id, c.scope, c.signal, n.n AS n_obs, {', '.join(f'round({m}, 6) AS {m}, round({m}_lo, 6) AS {m}_lo, round({m}_hi, 6) AS {m}_hi' for m in _CLS)}
  FROM x_cls_ci c JOIN (SELECT DISTINCT series_id, scope, signal, n FROM x_cls) n USING (series_id, scope, signal)""")
def bootstrap_ci_class(spark, sf):
    return class_table(spark, sf).select("series_id", "scope", "signal", "n_obs", *[F.round(f"{m}{s}", 6).alias(f"{m}{s}") for m in _CLS for s in ("", "_lo", "_hi")])



@query("ci_overlap", f"""
  WITH l AS (SELECT series_id, scope, model, 'RMSE' AS metric, rmse_lo AS lo, rmse_hi AS hi FROM x_boot_err UNION ALL SELECT series_id, scope, model, 'MAE', mae_lo, mae_hi FROM x_boot_err
    {' '.join(f"UNION ALL SELECT series_id, scope, signal, '{m}', {m}_lo, {m}_hi FROM x_cls_ci" for m in _CLS)}),
  r AS (SELECT l.*, list_position({MODELS}, model) AS k FROM l)
  SELECT a.series_id, a.scope, a.metric, a.model AS model_a, b.model AS model_b, round(a.lo, 3) AS a_lo, round(a.hi, 3) AS a_hi, round(b.lo, 3) AS b_lo, round(b.hi, 3) AS b_hi,
    greatest(a.lo, b.lo) < least(a.hi, b.hi) AS overlap, NOT (greatest(a.lo, b.lo) < least(a.hi, b.hi)) AS significant_diff
  FROM r a JOIN r b ON a.series_id = b.series_id AND a.scope = b.scope AND a.metric = b.metric AND a.k < b.k""")
def ci_overlap(spark, sf):
    err = error_table(spark, sf).selectExpr("series_id", "scope", "model", "stack(2, 'RMSE', rmse_lo, rmse_hi, 'MAE', mae_lo, mae_hi) AS (metric, lo, hi)")
    parts = ", ".join(f"'{m}', {m}_lo, {m}_hi" for m in _CLS)
    cls = class_table(spark, sf).selectExpr("series_id", "scope", "signal AS model", f"stack(4, {parts}) AS (metric, lo, hi)")
    o = I.ci_overlap(err.unionByName(cls), ["series_id", "scope"], MODELS)
    return o.withColumns({c: r3(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi")})


# ---- series statistics ----

_PRE, _POST = f"FILTER (month < DATE '{BREAK}')", f"FILTER (month >= DATE '{BREAK}')"


@query("break_welch", f"""
  WITH a AS (SELECT series_id, count(inflation_yoy) {_PRE} AS n_pre, count(inflation_yoy) {_POST} AS n_post, avg(inflation_yoy) {_PRE} AS m1, avg(inflation_yoy) {_POST} AS m2,
    var_samp(inflation_yoy) {_PRE} AS v1, var_samp(inflation_yoy) {_POST} AS v2 FROM x_cpi GROUP BY 1)
  SELECT series_id, n_pre, n_post, round(m1, 4) AS mean_pre, round(m2, 4) AS mean_post, round(sqrt(v1), 4) AS std_pre, round(sqrt(v2), 4) AS std_post, round((m1 - m2) / sqrt(v1 / n_pre + v2 / n_post), 4) AS t_stat,
    round(power(v1 / n_pre + v2 / n_post, 2) / (v1 * v1 / (n_pre * n_pre * (n_pre - 1)) + v2 * v2 / (n_post * n_post * (n_post - 1))), 4) AS dof, round(m2 / greatest(m1, 0.01), 4) AS ratio FROM a""")
def break_welch(spark, sf):
    w = ST.break_welch(inputs.cpi(spark, sf), "inflation_yoy", BREAK)
    return w.select("series_id", "n_pre", "n_post", *[r4(c).alias(c) for c in ("mean_pre", "mean_post", "std_pre", "std_post", "t_stat", "dof", "ratio")])


@query("levene", f"""
  WITH d AS (SELECT series_id, month < DATE '{BREAK}' AS side, inflation_yoy AS v FROM x_cpi WHERE inflation_yoy IS NOT NULL),
  m AS (SELECT series_id, side, quantile_cont(v, 0.5) AS med FROM d GROUP BY 1, 2), z AS (SELECT d.series_id, d.side, abs(v - med) AS z FROM d JOIN m USING (series_id, side)),
  g AS (SELECT series_id, side, count(*) AS n, avg(z) AS zm FROM z GROUP BY 1, 2), t AS (SELECT series_id, count(*) AS n, avg(z) AS gm FROM z GROUP BY 1),
  w AS (SELECT z.series_id, sum(power(z.z - g.zm, 2)) AS within FROM z JOIN g USING (series_id, side) GROUP BY 1),
  b AS (SELECT g.series_id, sum(g.n * power(g.zm - t.gm, 2)) AS between_ FROM g JOIN t USING (series_id) GROUP BY 1)
  SELECT series_id, t.n AS n_obs, round((t.n - 2) * between_ / within, 4) AS w_stat FROM t JOIN w USING (series_id) JOIN b USING (series_id)""")
def levene(spark, sf):
    return ST.levene(inputs.cpi(spark, sf), "inflation_yoy", BREAK).select("series_id", "n_obs", r4("w_stat").alias("w_stat"))


def _rss_sql(f: str) -> str:
    return f"regr_syy(v, x) {f} - power(regr_sxy(v, x) {f}, 2) / regr_sxx(v, x) {f}"


@query("chow", f"""
  WITH d AS (SELECT series_id, month, inflation_yoy AS v, ((year(month) - 1970) * 12 + month(month))::DOUBLE AS x FROM x_cpi WHERE inflation_yoy IS NOT NULL),
  a AS (SELECT series_id, count(*) AS n, {_rss_sql('')} AS rc, {_rss_sql(_PRE)} AS r1, {_rss_sql(_POST)} AS r2 FROM d GROUP BY 1)
  SELECT series_id, n AS n_obs, round(rc, 3) AS rss_all, round(r1 + r2, 3) AS rss_split, round(((rc - r1 - r2) / 2) / ((r1 + r2) / (n - 4)), 4) AS f_stat FROM a""")
def chow(spark, sf):
    c = ST.chow(inputs.cpi(spark, sf), "inflation_yoy", BREAK)
    return c.select("series_id", "n_obs", r3("rss_all").alias("rss_all"), r3("rss_split").alias("rss_split"), r4("f_stat").alias("f_stat"))


cte("x_break_welch", f"""
  WITH a AS (SELECT series_id, count(inflation_yoy) {_PRE} AS n1, count(inflation_yoy) {_POST} AS n2, avg(inflation_yoy) {_PRE} AS m1, avg(inflation_yoy) {_POST} AS m2,
    var_samp(inflation_yoy) {_PRE} AS v1, var_samp(inflation_yoy) {_POST} AS v2 FROM x_cpi GROUP BY 1)
  SELECT series_id, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, power(v1 / n1 + v2 / n2, 2) / (v1 * v1 / (n1 * n1 * (n1 - 1)) + v2 * v2 / (n2 * n2 * (n2 - 1))) AS dof FROM a""")
cte("x_break_levene", f"""
  WITH d AS (SELECT series_id, month < DATE '{BREAK}' AS side, inflation_yoy AS v FROM x_cpi WHERE inflation_yoy IS NOT NULL),
  z AS (SELECT series_id, side, abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY series_id, side)) AS z FROM d),
  g AS (SELECT series_id, side, count(*) AS n, avg(z) AS zm, var_pop(z) * count(*) AS within FROM z GROUP BY 1, 2), t AS (SELECT series_id, count(*) AS n, avg(z) AS gm FROM z GROUP BY 1)
  SELECT series_id, any_value(t.n) - 2 AS dof, (any_value(t.n) - 2) * sum(g.n * power(g.zm - t.gm, 2)) / sum(within) AS w FROM g JOIN t USING (series_id) GROUP BY 1""")
cte("x_break_chow", f"""
  WITH d AS (SELECT series_id, month, inflation_yoy AS v, ((year(month) - 1970) * 12 + month(month))::DOUBLE AS x FROM x_cpi WHERE inflation_yoy IS NOT NULL),
  a AS (SELECT series_id, count(*) AS n, {_rss_sql('')} AS rc, {_rss_sql(_PRE)} AS r1, {_rss_sql(_POST)} AS r2 FROM d GROUP BY 1)
  SELECT series_id, n - 4 AS dof, ((rc - r1 - r2) / 2) / ((r1 + r2) / (n - 4)) AS f FROM a""")


@query("break_pvalues", f"""
  SELECT series_id, round(t, 4) AS t_stat, round({sql_t_tail('t', 'x_break_welch.dof')}, 6) AS p_welch, round(w, 4) AS w_stat, round({sql_f_tail('w', '1', 'x_break_levene.dof')}, 6) AS p_levene,
    round(f, 4) AS f_stat, round({sql_f_tail('f', '2', 'x_break_chow.dof')}, 6) AS p_chow FROM x_break_welch JOIN x_break_levene USING (series_id) JOIN x_break_chow USING (series_id)""")
def break_pvalues(spark, sf):
    """Tail probabilities of the three break tests, on their result rows."""
    cpi = inputs.cpi(spark, sf)
    w = ST.break_welch(cpi, "inflation_yoy", BREAK).select("series_id", "t_stat", t_pvalue("t_stat", "dof").alias("p_welch"))
    lv = ST.levene(cpi, "inflation_yoy", BREAK).select("series_id", "w_stat", f_pvalue("w_stat", "dof_1", "dof_2").alias("p_levene"))
    ch = ST.chow(cpi, "inflation_yoy", BREAK).select("series_id", "f_stat", f_pvalue("f_stat", "dof_1", "dof_2").alias("p_chow"))
    both = w.join(lv, "series_id", "full_outer").join(ch, "series_id", "full_outer")
    return both.withColumns({c: F.round(c, 6 if c[0] == "p" else 4) for c in both.columns[1:]})


def _granger_sql(max_lag: int = 4) -> str:
    """Both regressions of every order written out, solved on sums of products."""
    whole = "OVER (PARTITION BY series_id)"
    lags = ", ".join(f"lag({v}0, {k}) OVER w AS {v}{k}" for v in "yx" for k in range(1, max_lag + 1))
    out = []
    for p in range(1, max_lag + 1):
        own = ["c", *(f"y{k}" for k in range(1, p + 1))]
        every = [*own, *(f"x{k}" for k in range(1, p + 1))]
        pairs = lambda tag, terms: [f"sum({a} * {b}) AS {tag}_{a}_{b}" for i, a in enumerate(terms) for b in [*terms[i:], "y0"]]
        sums = f"(SELECT series_id, count(*) AS n, sum(y0 * y0) AS yy, {', '.join(pairs('o', own) + pairs('e', every))} FROM x_granger WHERE y{p} IS NOT NULL GROUP BY 1)"
        left = lambda tag, terms: "yy - " + sql_dot(tag, [f"{tag}_{a}_y0" for a in terms])
        out.append(f"SELECT series_id, {p} AS lag, n, n - {2 * p + 1} AS dof, {left('o', own)} AS ro, {left('e', every)} AS re FROM {sql_solve(sums, {'o': own, 'e': every}, 'y0')}")
    cte("x_granger", f"""
  SELECT *, 1.0::DOUBLE AS c, {lags} FROM (SELECT series_id, month, inflation_yoy - avg(inflation_yoy) {whole} AS y0, behavioural_index - avg(behavioural_index) {whole} AS x0
    FROM x_gold WHERE inflation_yoy IS NOT NULL AND behavioural_index IS NOT NULL) WINDOW w AS (PARTITION BY series_id ORDER BY month)""")
    return " UNION ALL ".join(out)


@query("granger_f", f"""
  WITH r AS ({_granger_sql()}), f AS (SELECT *, CASE WHEN dof > 0 AND re > 0 THEN (ro - re) / lag / (re / dof) END AS f FROM r),
  p AS (SELECT *, {sql_f_tail('f', 'lag', 'dof')} AS p FROM f)
  SELECT series_id, lag, n AS n_obs, round(f, 4) AS f_stat, round(p, 6) AS p_value, p < 0.05 AS significant FROM p""")
def granger_f(spark, sf):
    g = ST.granger_f(gold(spark, sf), "inflation_yoy", "behavioural_index").withColumn("p", f_pvalue("f_stat", "dof_1", "dof_2"))
    return g.select("series_id", "lag", "n_obs", r4("f_stat").alias("f_stat"), F.round("p", 6).alias("p_value"), (F.col("p") < 0.05).alias("significant"))


@query("granger_lag1", """
  WITH d AS (SELECT series_id, month, inflation_yoy AS y, behavioural_index AS x FROM x_gold WHERE inflation_yoy IS NOT NULL AND behavioural_index IS NOT NULL),
  l AS (SELECT *, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM d WINDOW w AS (PARTITION BY series_id ORDER BY month)),
  a AS (SELECT series_id, count(*) AS n, regr_syy(y, y1) AS syy, regr_sxx(y, y1) AS saa, regr_sxy(y, y1) AS say, regr_sxx(y, x1) AS sbb, regr_sxy(y, x1) AS sby, regr_sxy(y1, x1) AS sab FROM l WHERE y1 IS NOT NULL GROUP BY 1),
  r AS (SELECT *, syy - say * say / saa AS rr, syy - (say * (say * sbb - sby * sab) + sby * (sby * saa - say * sab)) / (saa * sbb - sab * sab) AS ru FROM a)
  SELECT series_id, n AS n_obs, round((rr - ru) / (ru / (n - 3)), 4) AS f_stat FROM r""")
def granger_lag1(spark, sf):
    """Order 1 of the same operator; plain SQL can state it."""
    return ST.granger_f(gold(spark, sf), "inflation_yoy", "behavioural_index", 1).select("series_id", "n_obs", r4("f_stat").alias("f_stat"))



def _acf_sql(value: str, label: str, source: str) -> str:
    lags = ", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in range(1, 25))
    sums = ", ".join(f"sum(e * e{k}) / sum(e * e) AS r{k}" for k in range(1, 25))
    vals = ", ".join(f"({k}, r{k})" for k in range(1, 25))
    return f"""
  SELECT series_id, '{label}' AS kind, n AS n_obs, v.lag, round(v.acf, 4) AS acf FROM (
    SELECT series_id, count(*) AS n, 1.0::DOUBLE AS r0, {sums} FROM (SELECT *, {lags} FROM (SELECT series_id, month, {value} - avg({value}) OVER (PARTITION BY series_id) AS e FROM {source} WHERE {value} IS NOT NULL)
      WINDOW w AS (PARTITION BY series_id ORDER BY month)) GROUP BY 1), LATERAL (VALUES (0, r0), {vals}) v(lag, acf)"""


cte("x_diff", "SELECT series_id, month, ipc_level - lag(ipc_level) OVER (PARTITION BY series_id ORDER BY month) AS d1 FROM x_panel")


def level_and_diff(spark, sf) -> DataFrame:
    p = inputs.price_panel(spark, sf).withColumn("d1", F.expr(f"ipc_level - lag(ipc_level, 1) OVER {P.series()}"))
    return p.selectExpr("series_id", "month", "stack(2, 'level', ipc_level, 'diff', d1) AS (kind, v)")


@query("acf", _acf_sql("ipc_level", "level", "x_panel") + " UNION ALL " + _acf_sql("d1", "diff", "x_diff"))
def acf(spark, sf):
    return ST.acf(level_and_diff(spark, sf), "v", 24, ["series_id", "kind"]).withColumn("acf", r4("acf"))


def _pacf_sql(lags: int = 24) -> str:
    """The recursion over orders on unrounded autocorrelations, as lists."""
    def wide(value: str, label: str, source: str) -> str:
        sums = ", ".join(f"sum(e * e{k}) / sum(e * e) AS r{k}" for k in range(1, lags + 1))
        return f"""SELECT series_id, '{label}' AS kind, count(*) AS n, {sums} FROM (SELECT *, {', '.join(f'lag(e, {k}) OVER w AS e{k}' for k in range(1, lags + 1))} FROM
      (SELECT series_id, month, {value} - avg({value}) OVER (PARTITION BY series_id) AS e FROM {source} WHERE {value} IS NOT NULL) WINDOW w AS (PARTITION BY series_id ORDER BY month)) GROUP BY 1"""

    every = f"SELECT series_id, kind, n, [{', '.join(f'r{k}' for k in range(1, lags + 1))}] AS r FROM ({wide('ipc_level', 'level', 'x_panel')} UNION ALL {wide('d1', 'diff', 'x_diff')})"
    total = lambda term: f"coalesce(list_sum([{term} for j in range(1, k + 1)]), 0)"
    return f"""
  SELECT series_id, kind, n AS n_obs, generate_subscripts(parts, 1) - 1 AS lag, round(unnest(parts), 4) AS pacf FROM (
    WITH RECURSIVE d AS (
      SELECT series_id, kind, n, r, 0 AS k, []::DOUBLE[] AS phi, [1.0]::DOUBLE[] AS parts FROM ({every})
      UNION ALL SELECT series_id, kind, n, r, k + 1, list_append([phi[j] - last * phi[k + 1 - j] for j in range(1, k + 1)], last), list_append(parts, last)
      FROM (SELECT *, (r[k + 1] - {total('phi[j] * r[k + 1 - j]')}) / nullif(1 - {total('phi[j] * r[j]')}, 0) AS last FROM d WHERE k < {lags}))
    SELECT * FROM d WHERE k = {lags})"""


@query("pacf", _pacf_sql())
def pacf(spark, sf):
    return ST.pacf(level_and_diff(spark, sf), "v", 24, ["series_id", "kind"]).withColumn("pacf", r4("pacf"))


@query("kpss_stat", """
  WITH e AS (SELECT series_id, month, ipc_level - avg(ipc_level) OVER (PARTITION BY series_id) AS e FROM x_panel WHERE ipc_level IS NOT NULL),
  l AS (SELECT *, sum(e) OVER w AS s, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3, lag(e, 4) OVER w AS e4 FROM e WINDOW w AS (PARTITION BY series_id ORDER BY month)),
  a AS (SELECT series_id, count(*) AS n, sum(s * s) AS ss, sum(e * e) + 2 * (0.8 * sum(e * e1) + 0.6 * sum(e * e2) + 0.4 * sum(e * e3) + 0.2 * sum(e * e4)) AS lrv FROM l GROUP BY 1)
  SELECT series_id, n AS n_obs, round(ss / (n * lrv), 4) AS kpss, ss / (n * lrv) < 0.463 AS stationary FROM a""")
def kpss_stat(spark, sf):
    return ST.kpss_stat(inputs.price_panel(spark, sf), "ipc_level").withColumn("kpss", r4("kpss"))


@query("adf_stat", """
  WITH l AS (SELECT series_id, ipc_level AS v, lag(ipc_level, 1) OVER w AS v1, lag(ipc_level, 2) OVER w AS v2 FROM x_panel WHERE ipc_level IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY month)),
  d AS (SELECT series_id, v - v1 AS q, v1 AS a, v1 - v2 AS b FROM l WHERE v2 IS NOT NULL),
  s AS (SELECT series_id, count(*) AS n, regr_sxx(q, a) AS saa, regr_sxx(q, b) AS sbb, regr_sxy(a, b) AS sab, regr_sxy(q, a) AS saq, regr_sxy(q, b) AS sbq, regr_syy(q, a) AS sqq FROM d GROUP BY 1),
  r AS (SELECT *, (saq * sbb - sbq * sab) / (saa * sbb - sab * sab) AS rho, (sbq * saa - saq * sab) / (saa * sbb - sab * sab) AS gam FROM s)
  SELECT series_id, n AS n_obs, round(rho, 4) AS rho, round(rho / sqrt((sqq - rho * saq - gam * sbq) / (n - 3) * sbb / (saa * sbb - sab * sab)), 4) AS adf_t,
    rho / sqrt((sqq - rho * saq - gam * sbq) / (n - 3) * sbb / (saa * sbb - sab * sab)) < -2.86 AS stationary FROM r""")
def adf_stat(spark, sf):
    return ST.adf_stat(inputs.price_panel(spark, sf), "ipc_level").withColumns({"rho": r4("rho"), "adf_t": r4("adf_t")})


# ---- signal selection ----


def sql_decompose(source: str, part: str, value: str) -> str:
    return f"""
  SELECT {part}, month, {value}, trend, seasonal, {value} - trend - seasonal AS resid FROM (
    SELECT *, mm - avg(CASE WHEN rn = 1 THEN mm END) OVER (PARTITION BY {part}) AS seasonal FROM (
      SELECT *, avg({value} - trend) OVER (PARTITION BY {part}, month(month)) AS mm, row_number() OVER (PARTITION BY {part}, month(month) ORDER BY month) AS rn FROM (
        SELECT {part}, month, {value}, CASE WHEN count({value}) OVER (PARTITION BY {part} ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
          (sum({value}) OVER (PARTITION BY {part} ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.5 * (lag({value}, 6) OVER (PARTITION BY {part} ORDER BY month) + lead({value}, 6) OVER (PARTITION BY {part} ORDER BY month))) / 12 END AS trend
        FROM {source})))"""


cte("x_dec", sql_decompose("x_panel", "series_id", "ipc_level"))
cte("x_kwn_dense", """
  SELECT s.keyword, s.month, k.value FROM (SELECT keyword, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM x_kwn GROUP BY 1) s
  LEFT JOIN x_kwn k ON k.keyword = s.keyword AND k.month = s.month""")
cte("x_kwn_i", """
  WITH i AS (SELECT *, row_number() OVER w AS i FROM x_kwn_dense WINDOW w AS (PARTITION BY keyword ORDER BY month)),
  f AS (SELECT *, last_value(value IGNORE NULLS) OVER up AS v0, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER up AS i0, first_value(value IGNORE NULLS) OVER dn AS v1,
      first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER dn AS i1 FROM i
    WINDOW up AS (PARTITION BY keyword ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY keyword ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT keyword, month, value, CASE WHEN value IS NOT NULL THEN value WHEN i - i0 <= 3 THEN v0 + (v1 - v0) * ((i - i0)::DOUBLE / (i1 - i0)) ELSE v1 END AS filled FROM f""")
cte("x_kw_dec", sql_decompose("x_kwn_i", "keyword", "filled"))
cte("x_target", """
  SELECT month, (level / nullif(lag(level, 12) OVER (ORDER BY month), 0) - 1) * 100 AS target FROM (
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_extendedprice) / sum(l_quantity) AS level FROM lineitem GROUP BY 1)""")
cte("x_target_dec", sql_decompose("(SELECT 'all' AS k, month, target FROM x_target)", "k", "target"))
cte("x_kw_panel", """
  SELECT d.keyword, d.month, i.value, d.resid, t.target, t.resid AS target_resid FROM x_kw_dec d JOIN x_kwn_i i USING (keyword, month) LEFT JOIN x_target_dec t ON t.month = d.month""")


@query("decompose_classical", "SELECT series_id, month, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(resid, 4) AS resid FROM x_dec")
def decompose_classical(spark, sf):
    return P.decompose_classical(inputs.price_panel(spark, sf), "ipc_level").select("series_id", "month", *[r4(c).alias(c) for c in ("trend", "seasonal", "resid")])


def national_target(spark, sf) -> DataFrame:
    """Yearly change of the price of all lines, with its residual."""
    lines = inputs.table(spark, sf, "lineitem").groupBy(C.month_start("l_shipdate").alias("month")).agg(F.expr("try_divide(sum(l_extendedprice), sum(l_quantity))").alias("level"))
    t = P.densify(lines.withColumn("series_id", F.lit("all")), ["level"]).withColumn("target", P.pct_change("level", 12))
    return P.decompose_classical(t, "target").select("month", "target", F.col("resid").alias("target_resid"))


def keyword_panel(spark, sf) -> DataFrame:
    """Keywords with gaps interpolated, residuals, and the target of the month (one row per month)."""
    keys = ["keyword"]
    k = P.densify(G.national_keywords(spark, sf).drop("series_id"), ["value"], keys)
    k = P.decompose_classical(P.interpolate_limited(k, "value", "filled", 3, keys), "filled", keys)
    return k.select("keyword", "month", "value", "resid").join(F.broadcast(national_target(spark, sf)), "month", "left")


cte("x_kw_scan", """
  WITH l AS (SELECT keyword, month, resid, v.lag, lead(target_resid, CAST(v.lag AS INTEGER)) OVER (PARTITION BY keyword, v.lag ORDER BY month) AS ty FROM x_kw_panel, (VALUES (0), (1), (2)) v(lag)),
  r AS (SELECT keyword, lag, count(*) FILTER (resid IS NOT NULL AND ty IS NOT NULL) AS n, corr(resid, ty) AS r FROM l GROUP BY 1, 2),
  b AS (SELECT keyword, lag AS best_lag, r AS best_r FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY abs(r) DESC, lag) AS rn FROM r WHERE n >= 20) WHERE rn = 1),
  w AS (SELECT keyword, count(value) AS obs, corr(value, target) AS raw_r FROM x_kw_panel GROUP BY 1)
  SELECT w.keyword, coalesce(best_lag, 0) AS best_lag, coalesce(best_r, 0) AS best_r, raw_r, abs(raw_r) - abs(coalesce(best_r, 0)) AS bias, abs(coalesce(best_r, 0)) >= 0.25 AS keep
  FROM w LEFT JOIN b USING (keyword) WHERE obs >= 24""")


def keyword_scores(spark, sf) -> DataFrame:
    return S.score_keywords(keyword_panel(spark, sf), ["keyword"], "value", "target", "resid", "target_resid")


@query("lag_corr_scan", "SELECT keyword, CAST(best_lag AS INTEGER) AS best_lag, round(best_r, 4) AS best_r, round(raw_r, 4) AS raw_r, round(bias, 4) AS bias, keep FROM x_kw_scan")
def lag_corr_scan(spark, sf):
    return keyword_scores(spark, sf).withColumns({c: r4(c) for c in ("best_r", "raw_r", "bias")})


@query("best_lag", """
  WITH l AS (SELECT keyword, month, value, v.lag, lead(target, CAST(v.lag AS INTEGER)) OVER (PARTITION BY keyword, v.lag ORDER BY month) AS ty FROM x_kw_panel, (VALUES (0), (1), (2)) v(lag)),
  r AS (SELECT keyword, lag, count(*) FILTER (value IS NOT NULL AND ty IS NOT NULL) AS n, corr(value, ty) AS r FROM l GROUP BY 1, 2)
  SELECT keyword, CAST(lag AS INTEGER) AS best_lag, round(r, 4) AS best_r, n FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY abs(r) DESC, lag) AS rn FROM r WHERE n >= 20 AND r IS NOT NULL) WHERE rn = 1""")
def best_lag(spark, sf):
    c = S.lead_correlations(keyword_panel(spark, sf), "value", "target", range(3), 20, ["keyword"])
    return S.best_lag(c, ["keyword"]).withColumn("best_r", r4("best_r"))


@query("keyword_clusters")
def keyword_clusters(spark, sf):
    """Seven clusters of the keyword series and the representative of each."""
    panel = staged(spark, sf, "keyword_panel", keyword_panel)
    vectors = cut_lineage(S.keyword_vectors(panel, ["keyword"], "value"))
    scores = S.score_keywords(panel, ["keyword"], "value", "target", "resid", "target_resid")
    clustered = S.cluster(vectors, vectors.count()).join(scores, "keyword")
    best = S.representatives(clustered, "best_r", ["keyword"]).select("cluster", F.col("keyword").alias("representative"))
    return clustered.select("keyword", "cluster", "best_r").join(best, "cluster")


@query("validated_keywords")
def validated_keywords(spark, sf):
    """Residual scan, threshold, clustering, one keyword per cluster."""
    panel = staged(spark, sf, "keyword_panel", keyword_panel)
    scores = cut_lineage(S.score_keywords(panel, ["keyword"], "value", "target", "resid", "target_resid").where("keep"))
    n = scores.count()
    if n == 0:
        return scores.select(F.lit(None).cast("int").alias("cluster"), "*")
    vectors = cut_lineage(S.keyword_vectors(panel.join(scores.select("keyword"), "keyword", "left_semi"), ["keyword"], "value"))
    return S.representatives(S.cluster(vectors, n).join(scores, "keyword"), "best_r", ["keyword"])


_PERIODS = {"pre": f"month < DATE '{BREAK}'", "post": f"month >= DATE '{BREAK}'", "full": "TRUE"}
cte("x_xc", f"""
  WITH p AS ({' UNION ALL '.join(f"SELECT series_id, month, '{n}' AS period, behavioural_index AS x, inflation_yoy AS y FROM x_gold WHERE {c}" for n, c in _PERIODS.items())}),
  l AS (SELECT series_id, period, v.lag, y, lag(x, CAST(v.lag AS INTEGER)) OVER (PARTITION BY series_id, period, v.lag ORDER BY month) AS xl FROM p, (SELECT unnest(range(0, 7)) AS lag) v)
  SELECT series_id, period, CAST(lag AS INTEGER) AS lag, count(*) FILTER (xl IS NOT NULL AND y IS NOT NULL) AS n, corr(xl, y) AS r FROM l GROUP BY 1, 2, 3 HAVING count(*) FILTER (xl IS NOT NULL AND y IS NOT NULL) >= 5""")


def period_correlations(spark, sf) -> DataFrame:
    tags = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _PERIODS.items())
    g = gold(spark, sf).selectExpr("series_id", "month", "behavioural_index", "inflation_yoy", f"explode(array_compact(array({tags}))) AS period")
    return S.lag_correlations(g, "behavioural_index", "inflation_yoy", range(7), 5, ["series_id", "period"])


@query("xcorr_by_period", "SELECT series_id, period, lag, n, round(r, 4) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM x_xc")
def xcorr_by_period(spark, sf):
    return period_correlations(spark, sf).withColumns({"r": r4("r"), "t": r4("t")})


@query("xcorr_best", """
  SELECT series_id, period, lag AS best_lag, round(r, 4) AS best_r, n FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period ORDER BY abs(r) DESC, lag) AS rn FROM x_xc WHERE r IS NOT NULL) WHERE rn = 1""")
def xcorr_best(spark, sf):
    return S.best_lag(period_correlations(spark, sf), ["series_id", "period"]).withColumn("best_r", r4("best_r"))


@query("xcorr_pvalues", f"""
  WITH t AS (SELECT *, CASE WHEN abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END AS t FROM x_xc), p AS (SELECT *, {sql_t_tail('t', '(n - 2)')} AS p FROM t)
  SELECT series_id, period, lag, n, round(r, 4) AS r, round(t, 4) AS t, round(p, 6) AS p_value, p < 0.05 AS significant FROM p""")
def xcorr_pvalues(spark, sf):
    c = period_correlations(spark, sf).withColumn("p", t_pvalue("t", F.col("n") - 2))
    return c.select("series_id", "period", "lag", "n", r4("r").alias("r"), r4("t").alias("t"), F.round("p", 6).alias("p_value"), (F.col("p") < 0.05).alias("significant"))


_CORR = [c for c in GOLD_COLS if c not in NOT_DOUBLE]


@query("corr_matrix", f"""
  WITH t AS (SELECT series_id, month, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _CORR)} FROM x_gold),
  l AS (SELECT * FROM t UNPIVOT INCLUDE NULLS (v FOR c IN ({', '.join(_CORR)})))
  SELECT a.c AS column_1, b.c AS column_2, round(corr(a.v, b.v), 4) AS r FROM l a JOIN l b ON a.series_id = b.series_id AND a.month = b.month GROUP BY 1, 2""")
def corr_matrix(spark, sf):
    """Every numeric column of gold against every other."""
    return S.correlation_matrix(gold(spark, sf), _CORR).withColumn("r", r4("r"))


# ---- landing and layers ----


def scratch(spark, name: str) -> str:
    return f"{folder(spark)}/landed/{name}-{uuid.uuid4().hex}"


@query("scan_csv_sep", "SELECT series_id, CAST(month AS VARCHAR) AS month, CAST(n_lines AS VARCHAR) AS n_lines FROM x_price_raw")
def scan_csv_sep(spark, sf):
    """The price table landed with semicolons and padded headers, scanned without naming the separator."""
    path = scratch(spark, "csv")
    d = inputs.price_months(spark, sf).selectExpr("series_id AS ` series_id`", "month AS `month `", "n_lines AS ` n_lines `")
    d.write.option("header", True).option("sep", ";").csv(path)
    return landed.scan_delimited(spark, path)


@query("scan_csv_mixed", """
  SELECT series_id, CAST(month AS VARCHAR) AS month, CAST(n_lines AS VARCHAR) AS n_lines, CASE WHEN abs(hash_of) % 3 = 2 THEN CAST(year(month) AS VARCHAR) END AS year
  FROM (SELECT *, year(month) % 3 AS hash_of FROM x_price_raw)""")
def scan_csv_mixed(spark, sf):
    """One folder of files with three separators and two sets of columns, read back whole."""
    path = scratch(spark, "mixed")
    d = inputs.price_months(spark, sf).select("series_id", "month", "n_lines", F.year("month").alias("year"))
    for i, sep in enumerate(landed.SEPARATORS):
        part = d.where(F.col("year") % 3 == i)
        (part if i == 2 else part.drop("year")).write.mode("append").option("header", True).option("sep", sep).csv(path)
    return landed.scan_delimited(spark, path).select("series_id", "month", "n_lines", "year")


@query("medallion_roundtrip", "SELECT series_id, month, round(ipc_level, 4) AS ipc_level, round(inflation_yoy, 4) AS inflation_yoy, split_label FROM x_gold")
def medallion_roundtrip(spark, sf):
    """Bronze to silver to gold through partitioned tables, read back."""
    bronze, silver = scratch(spark, "bronze"), scratch(spark, "silver")
    landed.write_layer(inputs.price_panel(spark, sf), bronze)
    panel = landed.read_layer(spark, bronze)
    landed.write_layer(panel.withColumn("inflation_yoy", P.pct_change("ipc_level", 12)), silver)
    s = landed.read_layer(spark, silver)
    return s.select("series_id", "month", r4("ipc_level").alias("ipc_level"), r4("inflation_yoy").alias("inflation_yoy"), C.split_label("month", K.PANEL_WINDOWS).alias("split_label"))


@query("resolve_columns", """
  SELECT series_id, month AS raw_date, round(sum_price, 2) AS raw_value, round(sum_price, 2) AS fao_food_index, CAST(n_lines AS DOUBLE) AS fao_cereals_index, CAST(NULL AS DOUBLE) AS fao_oils_index FROM x_price_raw""")
def resolve_columns(spark, sf):
    """Alias, numeric-fallback and substring resolution on renamed headers."""
    p = inputs.price_months(spark, sf).withColumn("price", F.round("sum_price", 2))
    messy = p.select("series_id", F.col("month").alias("Mois"), F.col("price").alias("Food Price Index 2014=100"), F.col("n_lines").alias("cereals"))
    names = {k: v for k, v in K.FOOD_PRICE_COLUMNS.items() if v in ("fao_food_index", "fao_cereals_index", "fao_oils_index")}
    with_id = landed.resolve_date_value(messy, keep=messy.columns)
    food = landed.resolve_many(with_id.drop("Mois"), names, keep=["series_id", "raw_date", "raw_value"])
    return food


@query("scan_resolve_cast", "SELECT series_id, month, CAST(n_lines AS DOUBLE) AS value FROM x_price_raw")
def scan_resolve_cast(spark, sf):
    """A landed file whose value column has no known name: scanned as text, found by its values, cast safely."""
    path = scratch(spark, "csv")
    d = inputs.price_months(spark, sf).selectExpr("series_id AS serie", "month AS Mois", "concat('n', n_lines) AS note", "n_lines AS nombre")
    d.write.option("header", True).option("sep", ";").csv(path)
    found = landed.resolve_date_value(landed.scan_delimited(spark, path), keep=["serie"])
    return landed.safe_series(found, extra=["serie"]).withColumnRenamed("serie", "series_id")


@query("safe_cast_ingest", """
  SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice AS value FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0""")
def safe_cast_ingest(spark, sf):
    """Text dates in three forms and text numbers, some unreadable; the unreadable rows drop."""
    raw = inputs.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'dd/MM/yyyy') WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE date_format(o_orderdate, 'yyyy-MM') END AS raw_date",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'abc' ELSE string(o_totalprice) END AS raw_value")
    return landed.safe_series(raw, extra=["o_orderkey"])


@query("ingest_quality", """
  SELECT series_id, count(*) AS n_loaded, count(*) FILTER (sum_price IS NULL) AS n_null, round(min(sum_price), 2) AS min_value, round(max(sum_price), 2) AS max_value, round(avg(sum_price), 6) AS mean_value,
    90::BIGINT AS n_expected, 90 - count(*) AS n_missing, 90 - count(*) > 6 AS gap_warning FROM x_price_raw GROUP BY 1""")
def ingest_quality(spark, sf):
    q = landed.quality_report(inputs.price_months(spark, sf), "sum_price", "1995-01-01", "2002-06-01")
    return q.withColumns({c: F.round(c, d) for c, d in {"min_value": 2, "max_value": 2, "mean_value": 6}.items()})
