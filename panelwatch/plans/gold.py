"""Silver to gold: national signals, indices, lags, targets, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwatch.config import FEATURE_LAGS, PANEL_WINDOWS, REGIME_THRESHOLD, EvalWindow
from panelwatch.functions import columns as C
from panelwatch.operators import index as X, panel as P
from panelwatch.plans import inputs


def national_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly keyword counts of the whole market, each keyword 0-100 of its own maximum."""
    from pyspark.sql import Window

    orders = inputs.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", C.month_start("o_orderdate").alias("month"))
    customers = inputs.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    counts = (
        orders.join(customers, "c_custkey")
        .groupBy(F.concat_ws(":", "c_mktsegment", "o_orderpriority").alias("keyword"), "month")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.select(
        F.lit("all").alias("series_id"), "month", "keyword",
        (F.col("n") * F.lit(100.0) / F.max("n").over(Window.partitionBy("keyword"))).alias("value"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NATIONAL_THEMES = {
    theme: [f"{seg}:{p}" for seg, th in inputs.THEME_OF_SEGMENT.items() if th == theme for p in PRIORITIES]
    for theme in inputs.TREND_COLUMNS
}


def national_trends(spark: SparkSession, sf: str) -> DataFrame:
    return X.theme_subindices(national_keywords(spark, sf), NATIONAL_THEMES)


def national_macro(spark: SparkSession, sf: str) -> DataFrame:
    """Dense macro columns of the whole market with their yearly changes."""
    months = inputs.macro_months(spark, sf)
    wide = months.groupBy(F.lit("all").alias("series_id"), "month").agg(
        *[F.max(F.when(F.col("region") == r, F.col("price"))).alias(c) for r, c in inputs.MACRO_OF_REGION.items()])
    dense = P.densify(wide, list(inputs.MACRO_YOY))
    return dense.withColumns({y: P.pct_change(c, 12) for c, y in inputs.MACRO_YOY.items()})


def national_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Trends, macro and both equal-weight indices, one row per month."""
    trends = national_trends(spark, sf).drop("n_keywords_used")
    trends = X.equal_index(trends, X.feature_names(trends.columns), "behavioural_index")
    macro = national_macro(spark, sf)
    yoy = X.yoy_names(macro.columns)
    joined = trends.join(macro.drop("series_id"), "month", "full_outer").select(
        F.lit("all").alias("series_id"), F.col("behavioural_index").isNotNull().alias("_in"), *[c for c in [*trends.columns, *macro.columns[2:]] if c != "series_id"])
    # months without a behavioural index form their own partition and get no hybrid index
    part = ["series_id", "_in"]
    feats = X.hybrid_features(joined, "behavioural_index", yoy, part)
    hybrid = X.equal_index(feats, ["h_behavioural_index", *[f"h_{c}" for c in yoy]], "hybrid_index", part)
    keep = ["month", *inputs.TREND_COLUMNS, "trends_composite", *inputs.MACRO_YOY, *yoy, "behavioural_index"]
    return hybrid.select(*keep, F.when(F.col("_in"), F.col("hybrid_index")).alias("hybrid_index"))


def assemble(cpi: DataFrame, signals: DataFrame, windows: Sequence[EvalWindow] = PANEL_WINDOWS) -> DataFrame:
    """Gold table: price columns, signals by month, lags, next-month targets, metadata.

    The signals have one row per calendar month (about 1,200 in a century), so their
    broadcast has a fixed bound that does not grow with the data.
    """
    gold = cpi.withColumn("publication_date", C.publication_date("month")).join(F.broadcast(signals), "month", "left")
    gold = P.add_lags(gold, FEATURE_LAGS)
    w = P.over()
    next_yoy = F.lead("inflation_yoy", 1).over(w)
    return gold.withColumns({
        "target_inflation_yoy_t1": next_yoy,
        "target_high_inflation_regime_t1": C.regime_flag(next_yoy, REGIME_THRESHOLD),
        "target_ipc_level_t1": F.lead("ipc_level", 1).over(w),
        "as_of_date": C.as_of_date("month"),
        "feature_available_at": C.available_at("month"),
        "split_label": C.split_label("month", windows),
    })


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return assemble(inputs.cpi(spark, sf), national_signals(spark, sf))
