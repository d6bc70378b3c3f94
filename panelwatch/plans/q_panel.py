"""Queries on calendars, projections, ordered functions and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwatch.config import FULL_PRESET_LATEST_START, FULL_WINDOWS, PANEL_TRAIN_END, PANEL_WINDOWS, SHORT_WINDOWS
from panelwatch.functions import columns as C
from panelwatch.operators import normalise as N, panel as P, ranks
from panelwatch.plans import inputs
from panelwatch.plans.registry import cte, query
from panelwatch.session import cut_lineage


def r4(c):
    return F.round(C.as_col(c), 4)


@query("pct_change_mom_yoy", """
  SELECT series_id, month, round(ipc_level, 4) AS ipc_level, round(inflation_mom, 4) AS inflation_mom,
         round(inflation_yoy, 4) AS inflation_yoy FROM x_cpi""")
def pct_change_mom_yoy(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.cpi(spark, sf).select("series_id", "month", *[r4(c).alias(c) for c in ("ipc_level", "inflation_mom", "inflation_yoy")])


@query("inflation_regime", """
  SELECT series_id, month, CASE WHEN inflation_yoy >= 2 THEN 1.0::DOUBLE WHEN inflation_yoy < 2 THEN 0.0::DOUBLE END AS inflation_regime
  FROM x_cpi""")
def inflation_regime(spark, sf):
    return inputs.cpi(spark, sf).select("series_id", "month", C.regime_flag("inflation_yoy").alias("inflation_regime"))


@query("publication_dates", """
  SELECT series_id, month, CAST(last_day(month) + INTERVAL 20 DAY AS DATE) AS publication_date, last_day(month) AS as_of_date,
         CAST(last_day(month) + INTERVAL 1 DAY AS DATE) AS feature_available_at FROM x_panel""")
def publication_dates(spark, sf):
    return inputs.price_panel(spark, sf).select(
        "series_id", "month",
        C.publication_date("month").alias("publication_date"),
        C.as_of_date("month").alias("as_of_date"),
        C.available_at("month").alias("feature_available_at"),
    )


@query("date_range_slice", """
  SELECT series_id, month, round(sum_price, 2) AS sum_price, sum_qty, n_lines FROM x_price_raw
  WHERE month BETWEEN DATE '1996-03-01' AND DATE '1998-06-01'""")
def date_range_slice(spark, sf):
    return inputs.price_months(spark, sf, "1996-03-01", "1998-06-01").select(
        "series_id", "month", F.round("sum_price", 2).alias("sum_price"), "sum_qty", "n_lines")


SPLIT_CASE = """
  CASE WHEN concat_ws('|',
      CASE WHEN month BETWEEN DATE '1995-01-01' AND DATE '1998-12-01' THEN 'train_A' WHEN month BETWEEN DATE '1999-01-01' AND DATE '1999-12-01' THEN 'test_A' END,
      CASE WHEN month BETWEEN DATE '1995-01-01' AND DATE '1999-12-01' THEN 'train_B' WHEN month BETWEEN DATE '2000-01-01' AND DATE '2001-11-01' THEN 'test_B' END) = ''
    THEN 'unused' ELSE concat_ws('|',
      CASE WHEN month BETWEEN DATE '1995-01-01' AND DATE '1998-12-01' THEN 'train_A' WHEN month BETWEEN DATE '1999-01-01' AND DATE '1999-12-01' THEN 'test_A' END,
      CASE WHEN month BETWEEN DATE '1995-01-01' AND DATE '1999-12-01' THEN 'train_B' WHEN month BETWEEN DATE '2000-01-01' AND DATE '2001-11-01' THEN 'test_B' END) END"""


@query("split_labels", f"SELECT series_id, month, {SPLIT_CASE} AS split_label FROM x_panel")
def split_labels(spark, sf):
    return inputs.price_panel(spark, sf).select("series_id", "month", C.split_label("month", PANEL_WINDOWS).alias("split_label"))


@query("split_distribution", f"""
  SELECT split_label, count(*) AS n_rows, count(ipc_level) AS n_values
  FROM (SELECT {SPLIT_CASE} AS split_label, ipc_level FROM x_panel) GROUP BY 1""")
def split_distribution(spark, sf):
    return (
        inputs.price_panel(spark, sf)
        .groupBy(C.split_label("month", PANEL_WINDOWS).alias("split_label"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("ipc_level").alias("n_values"))
    )


def choose_windows(starts: DataFrame, start: str = "start") -> DataFrame:
    """Window preset per start date: the three-block one for early starts, else the two-block one."""

    def preset(windows):
        return F.array(*[
            F.struct(*[F.lit(v).cast("date" if f != "label" else "string").alias(f) for f, v in w._asdict().items()]) for w in windows
        ])

    early = F.col(start) <= F.lit(FULL_PRESET_LATEST_START).cast("date")
    chosen = F.when(early, preset(FULL_WINDOWS)).otherwise(preset(SHORT_WINDOWS))
    return starts.withColumn("w", F.explode(chosen)).select(*starts.columns, "w.*")


@query("eval_windows", """
  WITH starts AS (
    SELECT 'orders' AS source, greatest(DATE '1995-01-01', CAST(date_trunc('month', min(o_orderdate)) AS DATE)) AS start FROM orders
    UNION ALL SELECT 'events', greatest(DATE '2010-01-01', CAST(date_trunc('month', min(ts)) AS DATE)) FROM events),
  presets(early, label, train_start, train_end, test_start, test_end) AS (VALUES
    (true,'A',DATE '2010-01-01',DATE '2017-12-01',DATE '2018-01-01',DATE '2019-12-01'),
    (true,'B',DATE '2010-01-01',DATE '2019-12-01',DATE '2020-01-01',DATE '2021-12-01'),
    (true,'C',DATE '2010-01-01',DATE '2021-12-01',DATE '2022-01-01',DATE '2024-12-01'),
    (false,'A',DATE '2017-01-01',DATE '2019-12-01',DATE '2020-01-01',DATE '2021-12-01'),
    (false,'B',DATE '2017-01-01',DATE '2021-12-01',DATE '2022-01-01',DATE '2024-12-01'))
  SELECT source, start, label, train_start, train_end, test_start, test_end
  FROM starts JOIN presets ON early = (start <= DATE '2012-01-01')""")
def eval_windows(spark, sf):
    def first(name, stamp, requested):
        return inputs.table(spark, sf, name).agg(
            F.lit(name).alias("source"),
            F.greatest(F.lit(requested).cast("date"), F.trunc(F.min(stamp).cast("date"), "MM")).alias("start"))

    starts = first("orders", "o_orderdate", "1995-01-01").unionByName(first("events", "ts", "2010-01-01"))
    return choose_windows(starts)


@query("calendar_align", """
  WITH spine AS (SELECT DISTINCT series_id, CAST(unnest(generate_series(DATE '1994-11-01', DATE '2002-01-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM x_price_raw)
  SELECT s.series_id, s.month, round(r.sum_price, 2) AS sum_price, r.sum_qty, r.n_lines FROM spine s LEFT JOIN x_price_raw r
  ON r.series_id = s.series_id AND r.month = s.month""")
def calendar_align(spark, sf):
    aligned = P.align_calendar(inputs.price_months(spark, sf), ["sum_price", "sum_qty", "n_lines"], "1994-11-01", "2002-01-01")
    return aligned.withColumn("sum_price", F.round("sum_price", 2))


@query("resample_monthly", """
  WITH m AS (SELECT o_orderstatus || ':' || o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2),
  s AS (SELECT series_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m GROUP BY 1)
  SELECT s.series_id, s.month, round(v, 6) AS o_totalprice FROM s LEFT JOIN m ON s.series_id = m.series_id AND s.month = m.month""")
def resample_monthly(spark, sf):
    orders = inputs.table(spark, sf, "orders").withColumn("series_id", F.concat_ws(":", "o_orderstatus", "o_orderpriority"))
    return P.resample_mean(orders, "o_totalprice", "o_orderdate").withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("feature_lags", """
  SELECT series_id, month, round(lag(ipc_level,1) OVER w,4) AS ipc_level_lag1, round(lag(ipc_level,2) OVER w,4) AS ipc_level_lag2,
    round(lag(ipc_level,3) OVER w,4) AS ipc_level_lag3, round(lag(inflation_yoy,1) OVER w,4) AS inflation_yoy_lag1,
    round(lag(inflation_yoy,2) OVER w,4) AS inflation_yoy_lag2, round(lag(inflation_mom,1) OVER w,4) AS inflation_mom_lag1,
    round(lag(inflation_mom,2) OVER w,4) AS inflation_mom_lag2
  FROM x_cpi WINDOW w AS (PARTITION BY series_id ORDER BY month)""")
def feature_lags(spark, sf):
    base = inputs.cpi(spark, sf)
    lagged = P.add_lags(base, {"ipc_level": [1, 2, 3], "inflation_yoy": [1, 2], "inflation_mom": [1, 2], "absent": [1]})
    return lagged.select("series_id", "month", *[r4(c).alias(c) for c in lagged.columns if "_lag" in c])


@query("lead_targets", """
  SELECT series_id, month, round(lead(inflation_yoy) OVER w, 4) AS target_inflation_yoy_t1, round(lead(ipc_level) OVER w, 4) AS target_ipc_level_t1,
    CASE WHEN lead(inflation_yoy) OVER w >= 2 THEN 1.0::DOUBLE WHEN lead(inflation_yoy) OVER w < 2 THEN 0.0::DOUBLE END AS target_high_inflation_regime_t1
  FROM x_cpi WINDOW w AS (PARTITION BY series_id ORDER BY month)""")
def lead_targets(spark, sf):
    w = P.over()
    nxt = F.lead("inflation_yoy", 1).over(w)
    return inputs.cpi(spark, sf).select(
        "series_id", "month", r4(nxt).alias("target_inflation_yoy_t1"),
        r4(F.lead("ipc_level", 1).over(w)).alias("target_ipc_level_t1"),
        C.regime_flag(nxt).alias("target_high_inflation_regime_t1"))


cte("x_fill", """
  SELECT series_id, month, v, row_number() OVER w AS i,
    last_value(v IGNORE NULLS) OVER up AS v0, last_value(CASE WHEN v IS NOT NULL THEN month END IGNORE NULLS) OVER up AS t0,
    first_value(v IGNORE NULLS) OVER dn AS v1, first_value(CASE WHEN v IS NOT NULL THEN month END IGNORE NULLS) OVER dn AS t1
  FROM x_gappy WINDOW w AS (PARTITION BY series_id ORDER BY month),
    up AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    dn AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")


@query("fill_gaps", "SELECT series_id, month, round(v,4) AS v, round(coalesce(v0, v1),4) AS filled FROM x_fill")
def fill_gaps(spark, sf):
    return inputs.gappy_panel(spark, sf).select("series_id", "month", r4("v").alias("v"), r4(P.fill_gaps("v")).alias("filled"))


@query("interpolate_time", """
  WITH y AS (SELECT series_id, month, CASE WHEN month(month) = 7 THEN v END AS v FROM x_gappy),
  f AS (SELECT series_id, month, v,
    last_value(v IGNORE NULLS) OVER up AS v0, last_value(CASE WHEN v IS NOT NULL THEN month END IGNORE NULLS) OVER up AS t0,
    first_value(v IGNORE NULLS) OVER dn AS v1, first_value(CASE WHEN v IS NOT NULL THEN month END IGNORE NULLS) OVER dn AS t1
    FROM y WINDOW up AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    dn AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT series_id, month, round(CASE WHEN v IS NOT NULL THEN v WHEN t1 IS NULL THEN v0
    ELSE v0 + (v1 - v0) * (date_diff('day', t0, month)::DOUBLE / date_diff('day', t0, t1)::DOUBLE) END, 4) AS interpolated FROM f""")
def interpolate_time(spark, sf):
    annual = inputs.gappy_panel(spark, sf).withColumn("v", F.when(F.month("month") == 7, F.col("v")))
    return P.interpolate_time(annual, "v", "interpolated").select("series_id", "month", r4("interpolated").alias("interpolated"))


@query("interpolate_limit", """
  WITH g AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER up AS i0,
                first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER dn AS i1 FROM x_fill
    WINDOW up AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    dn AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT series_id, month, round(CASE WHEN v IS NOT NULL THEN v WHEN i0 IS NOT NULL AND i - i0 <= 3
      THEN CASE WHEN i1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ((i - i0)::DOUBLE / (i1 - i0)::DOUBLE) END
      ELSE v1 END, 4) AS interpolated FROM g""")
def interpolate_limit(spark, sf):
    return P.interpolate_limited(inputs.gappy_panel(spark, sf), "v", "interpolated").select("series_id", "month", r4("interpolated").alias("interpolated"))


@query("seasonal_diff", """
  SELECT series_id, month, round(coalesce(ipc_level - lag(ipc_level, 12) OVER w, 0), 4) AS d12, round(ipc_level - lag(ipc_level, 1) OVER w, 4) AS d1
  FROM x_panel WINDOW w AS (PARTITION BY series_id ORDER BY month)""")
def seasonal_diff(spark, sf):
    return inputs.price_panel(spark, sf).select(
        "series_id", "month", r4(P.seasonal_diff("ipc_level")).alias("d12"),
        r4(F.col("ipc_level") - F.lag("ipc_level", 1).over(P.over())).alias("d1"))


@query("expanding_stats", """
  SELECT series_id, month, count(ipc_level) OVER b AS n_train, round(last_value(ipc_level IGNORE NULLS) OVER b, 4) AS last_train,
    round(avg(ipc_level) OVER b, 4) AS mean_train, round(min(ipc_level) OVER b, 4) AS min_train, round(max(ipc_level) OVER b, 4) AS max_train
  FROM x_panel WINDOW b AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_stats(spark, sf):
    s = P.expanding_stats(inputs.price_panel(spark, sf), "ipc_level")
    return s.select("series_id", "month", "n_train", *[r4(c).alias(c) for c in ("last_train", "mean_train", "min_train", "max_train")])


@query("expanding_train", """
  SELECT o.series_id, o.month AS origin, min(h.month) AS train_start, max(h.month) AS train_end, count(h.month) AS n_train
  FROM x_panel o JOIN x_panel h ON h.series_id = o.series_id AND h.month < o.month AND h.ipc_level IS NOT NULL GROUP BY 1, 2""")
def expanding_train(spark, sf):
    seen = F.when(F.col("ipc_level").isNotNull(), F.col("month"))
    b = P.before()
    return inputs.price_panel(spark, sf).select(
        "series_id", F.col("month").alias("origin"), F.min(seen).over(b).alias("train_start"),
        F.max(seen).over(b).alias("train_end"), F.count(seen).over(b).alias("n_train"),
    ).where(F.col("n_train") > 0)


cte("x_flagged", """
  SELECT series_id, month, CASE WHEN inflation_yoy >= 2 THEN 1 WHEN inflation_yoy < 2 THEN 0 END AS flag FROM x_cpi""")


@query("episodes", """
  WITH a AS (SELECT series_id, month, flag, CASE WHEN flag <> lag(flag) OVER w THEN 1 ELSE 0 END AS chg, lead(flag) OVER w AS nxt
             FROM x_flagged WHERE flag IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY month)),
  b AS (SELECT *, sum(chg) OVER (PARTITION BY series_id ORDER BY month) AS run FROM a)
  SELECT series_id, min(month) AS episode_start, max(month) AS episode_end, count(*) AS n_months
  FROM b WHERE flag = 1 GROUP BY series_id, run HAVING max(CASE WHEN nxt = 0 THEN 1 ELSE 0 END) = 1""")
def episodes(spark, sf):
    flagged = inputs.cpi(spark, sf).withColumn("flag", C.regime_flag("inflation_yoy"))
    return P.episodes(flagged, "flag")


@query("month_cyclic", """
  SELECT series_id, month, round(sin(2 * pi() * month(month) / 12.0::DOUBLE), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(month) / 12.0::DOUBLE), 6) + 0.0 AS month_cos
  FROM x_panel""")
def month_cyclic(spark, sf):
    s, c = C.month_cycle("month")
    return inputs.price_panel(spark, sf).select("series_id", "month", (F.round(s, 6) + 0.0).alias("month_sin"), (F.round(c, 6) + 0.0).alias("month_cos"))


# ---- scaling ----


@query("minmax_norm", """
  SELECT series_id, month, round(CASE WHEN min(ipc_level) OVER w = max(ipc_level) OVER w THEN 0
     ELSE (ipc_level - min(ipc_level) OVER w) / (max(ipc_level) OVER w - min(ipc_level) OVER w) END, 4) AS scaled,
     0.0::DOUBLE AS constant_scaled
  FROM x_panel WINDOW w AS (PARTITION BY series_id)""")
def minmax_norm(spark, sf):
    d = inputs.price_panel(spark, sf).withColumn("one", F.when(F.month("month") > 1, F.lit(7.5)))
    return d.select("series_id", "month", r4(N.minmax("ipc_level")).alias("scaled"), N.minmax("one").alias("constant_scaled"))


cte("x_train_stats", """
  SELECT series_id, min(v) AS lo, max(v) AS hi, avg(v) AS mu, stddev_pop(v) AS sd, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3
  FROM (SELECT series_id, ipc_level AS v FROM x_panel WHERE month <= DATE '1998-12-01') GROUP BY 1""")


@query("minmax_train_clip", """
  SELECT series_id, month, CASE WHEN ipc_level IS NOT NULL THEN round(greatest(0, least(1, (ipc_level - lo) / (hi - lo))), 4) END AS scaled FROM x_panel JOIN x_train_stats USING (series_id)""")
def minmax_train_clip(spark, sf):
    scaled = N.minmax_train("ipc_level", N.train_rows(PANEL_TRAIN_END))
    return inputs.price_panel(spark, sf).select("series_id", "month", r4(scaled).alias("scaled"))


@query("zscore_train", """
  SELECT series_id, month, round((ipc_level - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 4) AS z FROM x_panel JOIN x_train_stats USING (series_id)""")
def zscore_train(spark, sf):
    return inputs.price_panel(spark, sf).select("series_id", "month", r4(N.zscore_train("ipc_level", N.train_rows(PANEL_TRAIN_END))).alias("z"))


@query("robust_scale_train", """
  SELECT series_id, month, round((ipc_level - q2) / nullif(q3 - q1, 0), 4) AS robust, round((ipc_level - lo) / (hi - lo), 4) AS minmax_unclipped
  FROM x_panel JOIN x_train_stats USING (series_id)""")
def robust_scale_train(spark, sf):
    t = N.train_rows(PANEL_TRAIN_END)
    d = N.robust_train(inputs.price_panel(spark, sf), "ipc_level", t, "robust")
    return d.select("series_id", "month", r4("robust").alias("robust"), r4(N.minmax_train("ipc_level", t, clip=False)).alias("minmax_unclipped"))


@query("stress_threshold", """
  SELECT series_id, round(quantile_cont(inflation_yoy, 0.75), 4) AS p75, round(quantile_cont(inflation_yoy, 0.025), 4) AS p2_5,
    round(quantile_cont(inflation_yoy, 0.5), 4) AS p50, round(quantile_cont(inflation_yoy, 0.975), 4) AS p97_5
  FROM x_cpi WHERE month <= DATE '1998-12-01' GROUP BY 1""")
def stress_threshold(spark, sf):
    train = inputs.cpi(spark, sf).where(N.train_rows(PANEL_TRAIN_END))
    q = F.percentile("inflation_yoy", F.array(*[F.lit(p) for p in (0.75, 0.025, 0.5, 0.975)]))
    return train.groupBy("series_id").agg(q.alias("q")).select(
        "series_id", *[r4(F.col("q")[i]).alias(n) for i, n in enumerate(("p75", "p2_5", "p50", "p97_5"))])


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max and missing share per numeric column of a table of any size.

    One scan counts the distinct values of each column; moments and quartiles come from these counts.
    """
    long = df.select(F.expr("stack({}, {}) as (column, value)".format(
        len(columns), ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns))))
    counts = cut_lineage(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")))
    n, total = "sum(CASE WHEN value IS NOT NULL THEN c END)", "sum(value * c)"
    moments = counts.groupBy("column").agg(
        F.expr(f"coalesce({n}, 0)").alias("n"), F.sum("c").alias("_rows"), F.expr(f"{total} / {n}").alias("mean"),
        F.expr(f"sqrt(try_divide(greatest(sum(value * value * c) - {total} * {total} / {n}, 0D), {n} - 1))").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = ranks.exact_quantiles(counts, ["column"], "value", [0.25, 0.5, 0.75], weight="c")
    return moments.join(quartiles, "column", "left").withColumn(
        "missing_pct", (F.col("_rows") - F.col("n")) * F.lit(100.0) / F.col("_rows")).drop("_rows")


@query("describe_panel", " UNION ALL ".join(f"""
  SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 3) AS std, min({c}) AS min, max({c}) AS max,
    round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
    (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS missing_pct FROM lineitem""" for c in DESCRIBED))
def describe_panel(spark, sf):
    d = describe(inputs.table(spark, sf, "lineitem"), DESCRIBED)
    return d.select("column", "n", r4("mean").alias("mean"), F.round("std", 3).alias("std"), "min", "max",
                    *[r4(q).alias(q) for q in ("q25", "q50", "q75")], "missing_pct")


# ---- batches sharing an anchor ----

cte("x_kw_pos", """
  SELECT keyword, row_number() OVER (ORDER BY keyword) AS pos
  FROM (SELECT DISTINCT c_mktsegment || ':' || o_orderpriority AS keyword FROM orders JOIN customer ON o_custkey = c_custkey)""")
ANCHOR = "AUTOMOBILE:1-URGENT"


def keyword_positions(spark, sf) -> DataFrame:
    """Declared order of the keywords: a list bounded by the keyword set, ordered on one task."""
    from pyspark.sql import Window

    kws = inputs.keyword_counts(spark, sf).select(F.concat_ws(":", "series_id", "keyword").alias("keyword")).distinct()
    return kws.select("keyword", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("keyword")).cast("long").alias("pos"))


@query("anchor_batches", f"""
  WITH b AS (SELECT CAST(floor((pos - 1) / 4.0) AS INTEGER) AS batch, pos, keyword FROM x_kw_pos)
  SELECT batch, pos, keyword, false AS is_anchor FROM b WHERE keyword <> '{ANCHOR}'
  UNION ALL SELECT DISTINCT batch, 0, '{ANCHOR}', true FROM b""")
def anchor_batches(spark, sf):
    return P.anchor_batches(keyword_positions(spark, sf), ANCHOR)


@query("anchor_rescale", f"""
  WITH vals AS (SELECT 'all' AS series_id, month, series_id || ':' || keyword AS keyword, value FROM x_kw),
  b AS (SELECT CAST(floor((pos - 1) / 4.0) AS INTEGER) AS batch, keyword FROM x_kw_pos),
  members AS (SELECT batch, keyword, false AS is_anchor FROM b WHERE keyword <> '{ANCHOR}' UNION ALL SELECT DISTINCT batch, '{ANCHOR}', true FROM b),
  d AS (SELECT v.series_id, v.month, m.batch, m.keyword, m.is_anchor,
          CASE WHEN month(v.month) = 4 AND m.is_anchor THEN 0 ELSE v.value / (1 + m.batch) END AS value FROM members m JOIN vals v USING (keyword)),
  a AS (SELECT month, batch, nullif(value, 0) AS av FROM d WHERE is_anchor),
  ra AS (SELECT a.month, a.batch, f.av / a.av AS ratio FROM a LEFT JOIN (SELECT month, av FROM a WHERE batch = 0) f USING (month)),
  rf AS (SELECT month, batch, coalesce(last_value(ratio IGNORE NULLS) OVER (PARTITION BY batch ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(ratio IGNORE NULLS) OVER (PARTITION BY batch ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS scale FROM ra)
  SELECT d.series_id, d.month, d.batch, d.keyword, round(d.value * CASE WHEN d.batch = 0 THEN 1 ELSE rf.scale END, 4) AS value
  FROM d LEFT JOIN rf USING (month, batch) WHERE NOT d.is_anchor OR d.batch = 0""")
def anchor_rescale(spark, sf):
    members = P.anchor_batches(keyword_positions(spark, sf), ANCHOR).drop("pos")
    values = inputs.keyword_counts(spark, sf).select(
        F.lit("all").alias("series_id"), "month", F.concat_ws(":", "series_id", "keyword").alias("keyword"), "value")
    batches = members.join(values, "keyword").withColumn(
        "value", F.when((F.month("month") == 4) & F.col("is_anchor"), F.lit(0.0)).otherwise(F.col("value") / (F.lit(1) + F.col("batch"))))
    return P.rescale_batches(batches).withColumn("value", r4("value"))
