"""Queries on the gold table, the indices and their weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwatch.config import PANEL_TRAIN_END
from panelwatch.functions import columns as C
from panelwatch.operators import audit, index as X, normalise as N, panel as P
from panelwatch.plans import gold as G, inputs
from panelwatch.plans.oracle_weights import index_sql, lasso_blocks, pca_block
from panelwatch.plans.q_panel import SPLIT_CASE
from panelwatch.plans.registry import cte, query
from panelwatch.plans.stages import staged


def r4(c):
    return F.round(C.as_col(c), 4)


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """The handed-over gold table."""
    return staged(spark, sf, "gold", G.gold)


def sql_minmax(c: str, part: str = "") -> str:
    w = f"({part})"
    return f"CASE WHEN min({c}) OVER {w} = max({c}) OVER {w} THEN 0.0::DOUBLE ELSE ({c} - min({c}) OVER {w}) / (max({c}) OVER {w} - min({c}) OVER {w}) END"


def sql_mean(cols: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0.0::DOUBLE)" for c in cols)
    n = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols)
    return f"(({total}) / nullif({n}, 0))"


def sql_fill(c: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


TREND = inputs.TREND_COLUMNS
MACRO, YOY = list(inputs.MACRO_YOY), list(inputs.MACRO_YOY.values())
SEGS = {t: ", ".join(f"'{s}'" for s, th in inputs.THEME_OF_SEGMENT.items() if th == t) for t in TREND}

cte("x_kwn", """
  SELECT seg, keyword, month, n * 100.0::DOUBLE / max(n) OVER (PARTITION BY keyword) AS value FROM (
    SELECT c_mktsegment AS seg, c_mktsegment || ':' || o_orderpriority AS keyword, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""")
cte("x_theme_raw", f"""
  SELECT s.month, {', '.join(f'avg(value) FILTER (seg IN ({SEGS[t]})) AS {t}' for t in TREND)}
  FROM (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM x_kwn) s LEFT JOIN x_kwn k ON k.month = s.month GROUP BY 1""")
cte("x_trends", f"""
  WITH n AS (SELECT month, {', '.join(f'{sql_minmax(t)} AS {t}' for t in TREND)} FROM x_theme_raw)
  SELECT *, {sql_mean(TREND)} AS trends_composite FROM n""")
cte("x_macro_wide", f"""
  SELECT s.month, {', '.join(f"max(price) FILTER (region = '{r}') AS {c}" for r, c in inputs.MACRO_OF_REGION.items())}
  FROM (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM x_macro_raw) s LEFT JOIN x_macro_raw k ON k.month = s.month GROUP BY 1""")
cte("x_macro", f"""
  SELECT *, {', '.join(f'({c} / nullif(lag({c}, 12) OVER (ORDER BY month), 0) - 1) * 100 AS {y}' for c, y in inputs.MACRO_YOY.items())} FROM x_macro_wide""")
cte("x_behav", f"""
  WITH f AS (SELECT *, {', '.join(f'{sql_fill(t)} AS f_{t}' for t in TREND)} FROM x_trends),
  r AS (SELECT *, {sql_mean([f'f_{t}' for t in TREND])} AS raw FROM f)
  SELECT month, {', '.join(TREND)}, trends_composite, {', '.join(f'f_{t}' for t in TREND)}, {sql_minmax('raw')} AS behavioural_index FROM r""")
cte("x_hybrid", f"""
  WITH j AS (SELECT b.month, b.behavioural_index, {', '.join('m.' + y for y in YOY)} FROM x_behav b LEFT JOIN x_macro m ON m.month = b.month),
  f AS (SELECT *, {', '.join(f'last_value({y} IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff_{y}' for y in YOY)} FROM j),
  n AS (SELECT *, {', '.join(f'{sql_minmax("ff_" + y)} AS nn_{y}' for y in YOY)} FROM f),
  g AS (SELECT month, {sql_fill('behavioural_index')} AS h_b, {', '.join(f'{sql_fill("nn_" + y)} AS h_{y}' for y in YOY)} FROM n),
  r AS (SELECT *, {sql_mean(['h_b'] + [f'h_{y}' for y in YOY])} AS raw FROM g)
  SELECT month, {sql_minmax('raw')} AS hybrid_index FROM r""")

LAG_SQL = ", ".join(f"lag({f}, {k}) OVER w AS {f}_lag{k}" for f, ks in G.FEATURE_LAGS.items() for k in ks)
cte("x_gold", f"""
  WITH j AS (SELECT c.*, CAST(last_day(c.month) + INTERVAL 20 DAY AS DATE) AS publication_date, {', '.join('b.' + t for t in TREND)}, b.trends_composite,
      {', '.join('m.' + c for c in MACRO + YOY)}, b.behavioural_index, h.hybrid_index
    FROM x_cpi c LEFT JOIN x_behav b ON b.month = c.month LEFT JOIN x_macro m ON m.month = c.month LEFT JOIN x_hybrid h ON h.month = c.month)
  SELECT *, {LAG_SQL}, lead(inflation_yoy) OVER w AS target_inflation_yoy_t1,
    CASE WHEN lead(inflation_yoy) OVER w >= 2 THEN 1.0::DOUBLE WHEN lead(inflation_yoy) OVER w < 2 THEN 0.0::DOUBLE END AS target_high_inflation_regime_t1,
    lead(ipc_level) OVER w AS target_ipc_level_t1, last_day(month) AS as_of_date, CAST(last_day(month) + INTERVAL 1 DAY AS DATE) AS feature_available_at, {SPLIT_CASE} AS split_label
  FROM j WINDOW w AS (PARTITION BY series_id ORDER BY month)""")

LAG_COLS = [f"{f}_lag{k}" for f, ks in G.FEATURE_LAGS.items() for k in ks]
GOLD_COLS = ["ipc_level", "inflation_mom", "inflation_yoy", "publication_date", *TREND, "trends_composite", *MACRO, *YOY, "behavioural_index", "hybrid_index",
             *LAG_COLS, "target_inflation_yoy_t1", "target_high_inflation_regime_t1", "target_ipc_level_t1", "as_of_date", "feature_available_at", "split_label"]
NOT_DOUBLE = {"publication_date", "as_of_date", "feature_available_at", "split_label"}


@query("gold_assemble", f"""
  SELECT series_id, month, {', '.join(c if c in NOT_DOUBLE else f'round({c}, 4) AS {c}' for c in GOLD_COLS)} FROM x_gold""")
def gold_assemble(spark: SparkSession, sf: str) -> DataFrame:
    g = G.gold(spark, sf)
    return g.select("series_id", "month", *[F.col(c) if c in NOT_DOUBLE else r4(c).alias(c) for c in GOLD_COLS])


@query("leakage_audit", f"""
  SELECT series_id, 'unshifted_target' AS "check", 'target_ipc_level_t1' AS "column", 'error' AS severity FROM
    (SELECT series_id, arg_max(coalesce(target_ipc_level_t1, ipc_level), month) AS v FROM x_gold GROUP BY 1) WHERE v IS NOT NULL
  UNION ALL SELECT NULL, 'forbidden_column', 'ipc_change', 'error'
  UNION ALL SELECT NULL, 'contemporaneous_column', c, 'warning' FROM (VALUES ('ipc_level'), ('inflation_yoy'), ('inflation_mom')) v(c)
  UNION ALL SELECT NULL, 'missing_lag1', 'inflation_yoy', 'warning'""")
def leakage_audit(spark, sf):
    """The checks on a gold table with three planted faults: a forbidden column, an unshifted target, a missing lag."""
    g = gold(spark, sf).withColumns({
        "ipc_change": F.col("inflation_mom"), "target_ipc_level_t1": F.coalesce("target_ipc_level_t1", "ipc_level")}).drop("inflation_yoy_lag1")
    return audit.leakage_violations(g)


@query("completeness_report", " UNION ALL ".join(f"""
  SELECT '{c}' AS "column", count({c}) AS n_nonnull, round(count({c}) * 100.0::DOUBLE / count(*), 4) AS pct,
    CASE WHEN count({c}) * 100.0::DOUBLE / count(*) > 80 THEN '' WHEN count({c}) * 100.0::DOUBLE / count(*) > 30 THEN '[!!]' ELSE '[X]' END AS flag FROM x_gold""" for c in GOLD_COLS))
def completeness_report(spark, sf):
    return audit.completeness(gold(spark, sf), GOLD_COLS).withColumn("pct", r4("pct"))


@query("available_features", f"""
  SELECT feature, n_nonnull FROM ({' UNION ALL '.join(f"SELECT '{t}' AS feature, count({t}) AS n_nonnull FROM x_trends" for t in TREND)} UNION ALL SELECT 'trends_composite', count(trends_composite) FROM x_trends)""")
def available_features(spark, sf):
    t = G.national_trends(spark, sf).withColumn("trends_empty", F.lit(None).cast("double"))
    return X.available_features(t, [*TREND, "trends_composite", "trends_empty", "trends_absent"])


@query("theme_subindex", f"""
  WITH m AS (SELECT series_id, month, avg(value) FILTER (keyword IN ('1-URGENT', '2-HIGH')) AS a, avg(value) FILTER (keyword = '3-MEDIUM') AS b,
      avg(value) FILTER (keyword = '4-NOT SPECIFIED') AS c, avg(value) FILTER (keyword = '5-LOW') AS d FROM x_kw GROUP BY 1, 2),
  s AS (SELECT series_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY 1),
  f AS (SELECT s.series_id, s.month, a, b, c, d FROM s LEFT JOIN m ON m.series_id = s.series_id AND m.month = s.month),
  n AS (SELECT series_id, month, {', '.join(f"{sql_minmax(x, 'PARTITION BY series_id')} AS {x}" for x in 'abcd')} FROM f)
  SELECT series_id, month, round(a, 4) AS trends_food, round(b, 4) AS trends_inflation, round(c, 4) AS trends_fuel, round(d, 4) AS trends_subsidy,
     CAST(NULL AS DOUBLE) AS trends_none, round({sql_mean(list('abcd'))}, 4) AS trends_composite, 5::BIGINT AS n_keywords_used FROM n""")
def theme_subindex(spark, sf):
    themes = {"trends_food": ["1-URGENT", "2-HIGH"], "trends_inflation": ["3-MEDIUM"], "trends_fuel": ["4-NOT SPECIFIED"],
              "trends_subsidy": ["5-LOW", "absent"], "trends_none": ["never seen"]}
    t = X.theme_subindices(inputs.keyword_counts(spark, sf), themes)
    return t.select("series_id", "month", *[r4(c).alias(c) for c in [*themes, "trends_composite"]], "n_keywords_used")


@query("trends_composite", f"SELECT month, {', '.join(f'round({t}, 4) AS {t}' for t in TREND)}, round(trends_composite, 4) AS trends_composite, 25::BIGINT AS n_keywords_used FROM x_trends")
def trends_composite(spark, sf):
    t = G.national_trends(spark, sf)
    return t.select("month", *[r4(c).alias(c) for c in [*TREND, "trends_composite"]], "n_keywords_used")


@query("index_bands", """
  SELECT month, round(behavioural_index, 4) AS behavioural_index, CASE WHEN behavioural_index < 0.35 THEN 'normal' WHEN behavioural_index < 0.65 THEN 'warning' ELSE 'high' END AS band FROM x_behav""")
def index_bands(spark, sf):
    t = X.equal_index(G.national_trends(spark, sf), TREND, "behavioural_index")
    return t.select("month", r4("behavioural_index").alias("behavioural_index"), C.index_band("behavioural_index").alias("band"))


@query("index_equal", "SELECT month, round(behavioural_index, 4) AS behavioural_index FROM x_behav")
def index_equal(spark, sf):
    return X.equal_index(G.national_trends(spark, sf), TREND, "behavioural_index").select("month", r4("behavioural_index").alias("behavioural_index"))


@query("hybrid_index", "SELECT b.month, round(behavioural_index, 4) AS behavioural_index, round(hybrid_index, 4) AS hybrid_index FROM x_behav b JOIN x_hybrid h ON h.month = b.month")
def hybrid_index(spark, sf):
    s = G.national_signals(spark, sf).where(F.col("hybrid_index").isNotNull())
    return s.select("month", r4("behavioural_index").alias("behavioural_index"), r4("hybrid_index").alias("hybrid_index"))


@query("macro_outer", """
  WITH fx AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS mean_order FROM orders GROUP BY 1)
  SELECT coalesce(m.month, fx.month) AS month, round(food_index, 4) AS food_index, round(food_yoy, 4) AS food_yoy, round(oils_index, 4) AS oils_index, round(mean_order, 4) AS mean_order
  FROM x_macro m FULL JOIN fx ON fx.month = m.month""")
def macro_outer(spark, sf):
    food = G.national_macro(spark, sf).select("month", "food_index", "food_yoy", "oils_index")
    fx = inputs.table(spark, sf, "orders").groupBy(C.month_start("o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("mean_order"))
    return food.join(fx, "month", "full_outer").select("month", *[r4(c).alias(c) for c in ("food_index", "food_yoy", "oils_index", "mean_order")])


def training_rows(spark, sf) -> DataFrame:
    """Complete training rows: gap-filled sub-indices and the yearly change, months in both."""
    trends = G.national_trends(spark, sf).select("series_id", "month", *[P.fill_gaps(t).alias(t) for t in TREND]).drop("series_id")
    target = inputs.cpi(spark, sf).select("series_id", "month", F.col("inflation_yoy").alias("y"))
    return target.join(trends, "month").where(N.train_rows(PANEL_TRAIN_END))


cte("x_train_xy", f"""
  SELECT c.series_id, c.month, c.inflation_yoy AS y, {', '.join(f'b.f_{t} AS {t}' for t in TREND)} FROM x_cpi c JOIN x_behav b ON b.month = c.month WHERE c.month <= DATE '1998-12-01'""")


@query("common_support", f"""
  SELECT series_id, month, round(y, 4) AS y, {', '.join(f'round({t}, 4) AS {t}' for t in TREND)} FROM x_train_xy WHERE y IS NOT NULL AND {' AND '.join(f'{t} IS NOT NULL' for t in TREND)}""")
def common_support(spark, sf):
    return training_rows(spark, sf).na.drop(subset=["y", *TREND]).select("series_id", "month", r4("y").alias("y"), *[r4(t).alias(t) for t in TREND])


_COLS = [*TREND, "y"]
_SUMS = ", ".join(f"round(sum({c}), 4) AS s_{i}" for i, c in enumerate(_COLS))
_PRODS = ", ".join(f"round(sum({_COLS[i]} * {_COLS[j]}), 4) AS g_{i}_{j}" for i in range(5) for j in range(i, 5))


@query("gram_by_fold", f"""
  WITH c AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n_all
             FROM x_train_xy WHERE y IS NOT NULL AND {' AND '.join(f'{t} IS NOT NULL' for t in TREND)}),
  f AS (SELECT *, CAST(CASE WHEN pos < (n_all % 5) * (n_all // 5 + 1) THEN pos // (n_all // 5 + 1) ELSE n_all % 5 + (pos - (n_all % 5) * (n_all // 5 + 1)) // (n_all // 5) END AS INTEGER) AS fold FROM c)
  SELECT series_id, fold, count(*) AS n, {_SUMS}, {_PRODS} FROM f GROUP BY 1, 2""")
def gram_by_fold(spark, sf):
    g = X.gram_by_fold(training_rows(spark, sf), TREND, "y")
    return g.select("series_id", "fold", "n", *[r4(c).alias(c) for c in g.columns if c.startswith(("s_", "g_"))])


def _fits(spark, sf, method: str) -> DataFrame:
    return X.fit_weights(X.gram_by_fold(training_rows(spark, sf), TREND, "y"), TREND, method)


def _indexed(spark, sf, method: str) -> DataFrame:
    trends = G.national_trends(spark, sf).select("month", *[P.fill_gaps(t).alias(t) for t in TREND])
    series = inputs.cpi(spark, sf).select("series_id", "month")
    rows = series.join(F.broadcast(trends), "month")  # one row per calendar month
    return X.weighted_index(rows, _fits(spark, sf, method), TREND, "behavioural_index").select("series_id", "month", "method", "behavioural_index")


lasso_blocks("x_la", "x_train_xy", TREND)
pca_block("x_pc_fit", "x_train_xy", TREND)
cte("x_index_rows", f"SELECT c.series_id, c.month, {', '.join(f'b.f_{t} AS {t}' for t in TREND)} FROM x_cpi c JOIN x_behav b ON b.month = c.month")


def _index_sql(fits: str, rows: str, names: list[str], out: str) -> str:
    return f"WITH w AS ({index_sql(fits, rows, names, sql_mean(names))}) SELECT series_id, month, method, round({sql_minmax('raw', 'PARTITION BY series_id')}, 4) AS {out} FROM w"


@query("index_lasso", _index_sql("x_la_fit", "x_index_rows", TREND, "behavioural_index"))
def index_lasso(spark, sf):
    """Per-series positive-lasso index; the solve sees five Gram rows per series."""
    return _indexed(spark, sf, "lasso").withColumn("behavioural_index", r4("behavioural_index"))


@query("index_pca", _index_sql("x_pc_fit", "x_index_rows", TREND, "behavioural_index"))
def index_pca(spark, sf):
    return _indexed(spark, sf, "pca").withColumn("behavioural_index", r4("behavioural_index"))


@query("index_weights", f"""
  SELECT series_id, feature, 0.25::DOUBLE AS weight, 'equal' AS method, '1998-12-01' AS train_end
  FROM (SELECT DISTINCT series_id FROM x_cpi), (VALUES {', '.join(f"('{t}')" for t in TREND)}) v(feature)""")
def index_weights(spark, sf):
    """The weights table of the equal method."""
    k = len(TREND)
    fits = inputs.cpi(spark, sf).select("series_id").distinct().select(
        "series_id", F.lit("equal").alias("method"), F.array(*[F.lit(1.0 / k)] * k).alias("weight"))
    return X.weights_report(fits, TREND, PANEL_TRAIN_END)


@query("index_weights_lasso", f"""
  SELECT series_id, v.feature, round(v.weight, 6) AS weight, method, '1998-12-01' AS train_end FROM x_la_fit, LATERAL (VALUES {', '.join(f"('{t}', g{i})" for i, t in enumerate(TREND))}) v(feature, weight)""")
def index_weights_lasso(spark, sf):
    return X.weights_report(_fits(spark, sf, "lasso"), TREND, PANEL_TRAIN_END).withColumn("weight", F.round("weight", 6))


_HYBRID = ["h_b", *(f"h_{y}" for y in YOY)]
cte("x_hybrid_rows", f"""
  WITH j AS (SELECT b.month, b.behavioural_index, {', '.join('m.' + y for y in YOY)} FROM x_behav b LEFT JOIN x_macro m ON m.month = b.month WHERE b.behavioural_index IS NOT NULL),
  f AS (SELECT *, {', '.join(f'last_value({y} IGNORE NULLS) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff_{y}' for y in YOY)} FROM j),
  n AS (SELECT *, {', '.join(f'{sql_minmax("ff_" + y)} AS nn_{y}' for y in YOY)} FROM f),
  g AS (SELECT month, {sql_fill('behavioural_index')} AS h_b, {', '.join(f'{sql_fill("nn_" + y)} AS h_{y}' for y in YOY)} FROM n)
  SELECT c.series_id, c.month, c.inflation_yoy AS y, {', '.join('g.' + h for h in _HYBRID)} FROM x_cpi c JOIN g ON g.month = c.month""")
cte("x_hybrid_train", "SELECT * FROM x_hybrid_rows WHERE month <= DATE '1998-12-01'")
lasso_blocks("x_hy", "x_hybrid_train", _HYBRID)


@query("hybrid_index_lasso", _index_sql("x_hy_fit", "x_hybrid_rows", _HYBRID, "hybrid_index"))
def hybrid_index_lasso(spark, sf):
    """Per-series lasso weights over the behavioural index and the scaled macro changes."""
    yoy = list(inputs.MACRO_YOY.values())
    names = ["h_behavioural_index", *[f"h_{c}" for c in yoy]]
    sig = G.national_signals(spark, sf).where(F.col("behavioural_index").isNotNull()).withColumn("series_id", F.lit("all"))
    feats = X.hybrid_features(sig, "behavioural_index", yoy).select("month", *names)
    rows = inputs.cpi(spark, sf).select("series_id", "month", F.col("inflation_yoy").alias("y")).join(F.broadcast(feats), "month")
    fits = X.fit_weights(X.gram_by_fold(rows.where(N.train_rows(PANEL_TRAIN_END)), names, "y"), names, "lasso")
    return X.weighted_index(rows, fits, names, "hybrid_index").select("series_id", "month", "method", r4("hybrid_index").alias("hybrid_index"))
