"""Queries on raw rows of any length: carried windows, as-of joins, range lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwatch.operators import longseries as LS
from panelwatch.plans import inputs
from panelwatch.plans.registry import query


@query("long_windows", """
  WITH l AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS chg FROM events WINDOW w AS (ORDER BY ts, event_id))
  SELECT event_id, lag(value, 1) OVER w AS value_1, lag(value, 24) OVER w AS value_24, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER u AS last_purchase,
    CAST(sum(chg) OVER u AS BIGINT) AS run, round(CAST(sum(CAST(value * 100 AS BIGINT)) OVER u AS DOUBLE) / 100, 2) AS total
  FROM l WINDOW w AS (ORDER BY ts, event_id), u AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def long_windows(spark, sf):
    """All events as one series: lags, last known value, run number and running total over ranges."""
    keys, order = ["series_id"], ["ts", "event_id"]
    e = inputs.table(spark, sf, "events").select(F.lit("all").alias("series_id"), *order, "event_type", "value")
    e = e.withColumns({"bought": F.expr("CASE WHEN event_type = 'purchase' THEN value END"), "cents": F.expr("CAST(round(value * 100) AS BIGINT)")})
    r = LS.lags(LS.in_ranges(e, keys, order), keys, order, {"value_1": ("value", 1), "value_24": ("value", 24), "before": ("event_type", 1)})
    r = r.withColumn("chg", F.expr("CASE WHEN event_type <=> before THEN 0 ELSE 1 END"))
    r = LS.running_sum(LS.last_known(r, keys, order, {"last_purchase": "bought"}), keys, order, {"run": "chg", "total": "cents"})
    return r.select("event_id", "value_1", "value_24", "last_purchase", "run", F.round(F.col("total") / 100, 2).alias("total"))


_LEFT, _RIGHT = "(SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase')", "(SELECT user_id, ts, max(struct_pack(c := event_id, v := value)) AS m FROM events WHERE event_type = 'click' GROUP BY 1, 2)"


def _asof_sql(test: str, near: str) -> str:
    return f"""
  SELECT l.event_id, CASE WHEN {near} THEN r.m.c END AS click_id, CASE WHEN {near} THEN r.m.v END AS click_value
  FROM {_LEFT} l ASOF LEFT JOIN {_RIGHT} r ON l.user_id = r.user_id AND l.ts {test} r.ts"""


def _as_of(spark, sf, **options):
    e = inputs.table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return LS.as_of_join(left, right, ["user_id"], "ts", ["click_id", "click_value"], **options).select("event_id", "click_id", "click_value")


@query("as_of_click", _asof_sql(">=", "r.ts >= l.ts - INTERVAL 1 DAY"))
def as_of_click(spark, sf):
    """The last click of the user before each purchase, at most a day back."""
    return _as_of(spark, sf, tolerance="1 DAY")


@query("as_of_next_click", _asof_sql("<=", "TRUE"))
def as_of_next_click(spark, sf):
    """The first click after each purchase, however late."""
    return _as_of(spark, sf, forward=True)


@query("error_lookback", """
  WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type <> 'error'), e AS (SELECT event_id AS error_id, user_id, epoch_us(ts) AS t, CASE WHEN event_id % 10 = 0 THEN 240 ELSE 6 END AS hours FROM events WHERE event_type = 'error')
  SELECT e.error_id, count(*) AS n_before, max(p.t) - max(e.t) AS last_gap FROM e JOIN p ON p.user_id = e.user_id AND p.t BETWEEN e.t - e.hours * 3600000000 AND e.t - 1 GROUP BY 1""")
def error_lookback(spark, sf):
    """What each user did in the hours before an error, on raw events: six hours, for some ten days."""
    e = inputs.table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    points = e.where("event_type <> 'error'").select("event_id", "user_id", "t")
    spans = e.where("event_type = 'error'").selectExpr("event_id AS error_id", "user_id", "t - CASE WHEN event_id % 10 = 0 THEN 240 ELSE 6 END * 3600000000 AS a", "t - 1 AS b")
    met = LS.interval_join(points, spans, ["user_id"], "t", "a", "b", width=3_600_000_000)
    return met.groupBy("error_id").agg(F.count(F.lit(1)).alias("n_before"), (F.max("t") - F.max("b") - 1).alias("last_gap"))
