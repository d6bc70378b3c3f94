"""The reference inputs rebuilt from the given star-schema and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwatch.functions.columns import in_months, month_start
from panelwatch.operators.panel import densify, pct_change

# Search theme of each market segment, macro column of each region.
THEME_OF_SEGMENT = {
    "BUILDING": "trends_food",
    "HOUSEHOLD": "trends_food",
    "FURNITURE": "trends_inflation",
    "AUTOMOBILE": "trends_fuel",
    "MACHINERY": "trends_subsidy",
}
TREND_COLUMNS = ["trends_food", "trends_inflation", "trends_fuel", "trends_subsidy"]
MACRO_OF_REGION = {"AFRICA": "food_index", "AMERICA": "cereals_index", "ASIA": "oils_index", "EUROPE": "fx_rate"}
MACRO_YOY = {"food_index": "food_yoy", "cereals_index": "cereals_yoy", "oils_index": "oils_yoy", "fx_rate": "fx_yoy"}
BASE_YEAR = 1995


# Declared schemas: no footer is opened on the driver to infer them.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
                "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def price_months(spark: SparkSession, sf: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Unit price per brand and month, optionally of a closed month range.

    The range is put on the raw time stamp, so it reaches the file scan. A hot part is
    split by the adaptive skew join; the sums are combined on the map side.
    """
    raw = table(spark, sf, "lineitem")
    if start and end:
        raw = raw.where(in_months("l_shipdate", start, end))
    lines = raw.select("l_partkey", "l_quantity", "l_extendedprice", month_start("l_shipdate").alias("month"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("series_id"))
    return (
        lines.join(parts, "l_partkey")
        .groupBy("series_id", "month")
        .agg(F.sum("l_extendedprice").alias("sum_price"), F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n_lines"))
        .withColumn("price", F.expr("try_divide(sum_price, sum_qty)"))
    )


def price_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Dense monthly price index per brand, base year = 100; absent months are null."""
    dense = densify(price_months(spark, sf).select("series_id", "month", "price"), ["price"])
    base = F.avg(F.when(F.year("month") == BASE_YEAR, F.col("price"))).over(Window.partitionBy("series_id"))
    return dense.select("series_id", "month", (F.try_divide(F.col("price"), base) * F.lit(100.0)).alias("ipc_level"))


def cpi(spark: SparkSession, sf: str) -> DataFrame:
    return price_panel(spark, sf).withColumns({
        "inflation_mom": pct_change("ipc_level", 1),
        "inflation_yoy": pct_change("ipc_level", 12),
    })


def gappy_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The price index with regular and long holes, for the fill operators."""
    hole = F.month("month").isin(2, 3) | ((F.year("month") == 1997) & F.month("month").between(5, 9)) | (
        (F.year("month") == 1995) & (F.month("month") == 1)
    ) | (F.year("month") == 2001) & (F.month("month") >= 8)
    return price_panel(spark, sf).select("series_id", "month", F.when(~hole, F.col("ipc_level")).alias("v"))


def keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per segment, month and priority, scaled to 0-100 of the segment's maximum."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", month_start("o_orderdate").alias("month"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    counts = (
        orders.join(customers, "c_custkey")
        .groupBy(F.col("c_mktsegment").alias("series_id"), "month", F.col("o_orderpriority").alias("keyword"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = F.max("n").over(Window.partitionBy("series_id"))
    return counts.select("series_id", "month", "keyword", (F.col("n") * F.lit(100.0) / top).alias("value"))


def macro_months(spark: SparkSession, sf: str) -> DataFrame:
    """Unit price per supplier region and month; lines are summed per supplier and month before the join."""
    region = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("region"))
    )
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", month_start("l_shipdate").alias("month")).agg(
        F.sum("l_quantity").alias("l_quantity"), F.sum("l_extendedprice").alias("l_extendedprice"))
    return (
        lines.join(region, "l_suppkey")
        .groupBy("region", "month")
        .agg(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("price"))
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as an article table; 36 months from 2022-01 by document number."""
    month = F.add_months(F.lit("2022-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(36)).cast("int"))
    return documents(spark, sf).select(
        F.col("doc_id").alias("article_id"), month.alias("month"), "source", F.col("lang").alias("source_type"), "text"
    )


def labelled_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Row-level truth and score: toxic label against text length, scope = language."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("scope"), F.col("n_chars").cast("double").alias("score"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"))
    return labels.join(docs, "doc_id").select("scope", "score", "y")


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    """Mean event value per type and day: a daily panel with season 7."""
    days = (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("day"))
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_events"))
    )
    return densify(days, ["value", "n_events"], time="day", step="1 day")
