"""Whole queries on the smallest tables, and the gold audit."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from panelwatch import config as K
from panelwatch.operators import audit
from panelwatch.plans import gold as G
from panelwatch.plans.q_forecast import gold, predictions
from panelwatch.streaming import feeds

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    q, o = entry_module.queries(), entry_module.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert {"series_id", "signal", "scope", "auc", "verdict"} <= set(df.columns)
    assert df.count() >= 0


def test_gold_schema_and_no_leakage(spark):
    g = gold(spark, SF)
    assert len(g.columns) == 47  # series, month and the 45 documented columns
    audit.require_no_leakage(g)
    with pytest.raises(ValueError):
        audit.require_no_leakage(g.withColumn("ipc_change", F.lit(1.0)))


def test_staged_tables_are_reused(spark):
    assert predictions(spark, SF).inputFiles() == predictions(spark, SF).inputFiles()


def test_predictions_use_only_the_past(spark):
    """Changing the values after a month leaves the forecasts up to it as they are."""
    from panelwatch.operators import forecast as FC

    g = gold(spark, SF).select("series_id", "month", "ipc_level", "behavioural_index_lag1")
    cut = "DATE '1999-06-01'"
    changed = g.withColumn("ipc_level", F.expr(f"CASE WHEN month > {cut} THEN ipc_level * 3 ELSE ipc_level END"))
    a, b = (FC.walk_forward(d, "ipc_level", {"sig": "behavioural_index_lag1"}).where(f"month <= {cut}").select("series_id", "month", F.round("pred_sig", 9)) for d in (g, changed))
    assert a.exceptAll(b).count() == 0


def test_index_is_between_0_and_1(spark):
    r = G.national_signals(spark, SF).agg(F.min("behavioural_index"), F.max("behavioural_index"), F.min("hybrid_index"), F.max("hybrid_index")).first()
    assert (r[0], r[1]) == (0.0, 1.0) and r[2] >= 0 and r[3] <= 1


def test_completeness_flags(spark):
    d = spark.createDataFrame([(1, None, None), (2, 1, None), (3, None, None)], "a int, b int, c int")
    assert {r["column"]: r["flag"] for r in audit.completeness(d).collect()} == {"a": "", "b": "[!!]", "c": "[X]"}


def test_plans_have_no_cross_join_and_prune_columns(spark):
    for name in ("early_warning", "dm_pairwise", "gold_assemble", "roc_auc", "press_monthly", "backtest_results", "lag_corr_scan"):
        plan = entry_module.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = entry_module.queries()["date_range_slice"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan


def test_feed_stream_counts_once(spark, tmp_path):
    src = tmp_path / "landed"
    src.mkdir()
    row = '{"date": "2024-05-0%d 10:00:00", "source": "s", "title": "prix %d", "summary": "sucre", "link": "l%d"}'
    (src / "a.json").write_text("\n".join(row % (i, i, i) for i in (1, 2)))
    stream = feeds.press_volume(feeds.read_landed(spark, str(src)), K.PRESS_THEMES)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("press").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    try:
        q.processAllAvailable()
        (src / "b.json").write_text("\n".join(row % (i, i, i) for i in (2, 3)))
        q.processAllAvailable()
        r = spark.table("press").collect()
        assert [(x["press_volume"], x["themes_prix"], x["themes_alim"]) for x in r] == [(3, 3, 3)]
    finally:
        q.stop()
