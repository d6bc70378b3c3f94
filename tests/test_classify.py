import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwatch import config as K
from panelwatch.operators import classify as CL
from tests.conftest import months


def frame(spark, rows):
    return spark.createDataFrame([("s", float(a), b) for a, b in rows], "g string, score double, y int")


def test_one_class_gives_half(spark):
    a = CL.areas(CL.threshold_curve(frame(spark, [(1, 0), (2, 0)]), ["g"], bounded=True), ["g"]).first()
    assert a["auc"] == 0.5 and a["ap"] == 0.5


def test_areas_by_hand(spark):
    # scores 3+ 2- 1+ : points (tpr, fpr) (0,0) (.5,0) (.5,1) (1,1)
    a = CL.areas(CL.threshold_curve(frame(spark, [(3, 1), (2, 0), (1, 1)]), ["g"], bounded=True), ["g"]).first()
    assert a["auc"] == pytest.approx(0.5)
    # precision 1, 1/2, 2/3 at recall .5, .5, 1; no anchor point
    assert a["ap"] == pytest.approx(0.5 * (0.5 + 2 / 3) / 2)


def test_tie_rules_highest_and_lowest(spark):
    # F1 at thresholds 4, 3, 2, 1: 2/3 (tp 2), 4/7.. make two equal maxima by construction
    rows = [(4, 1), (3, 0), (2, 0), (1, 1), (0, 0), (-1, 1)]
    c = CL.threshold_curve(frame(spark, rows), ["g"], bounded=True)
    f1 = {r["threshold"]: r["f1"] for r in c.collect()}
    top = max(f1.values())
    best = [t for t, v in f1.items() if v == top]
    assert CL.f1_optimal(c, ["g"]).first()["threshold_opt"] == max(best)
    assert CL.calibrate(c, ["g"]).first()["threshold"] == min(best)
    two = CL.threshold_curve(frame(spark, [(1, 1), (2, 1)] + [(0, 0)]), ["g"], bounded=True)
    assert CL.calibrate(two, ["g"]).first()["threshold"] == 0.5  # fewer than three positives


def test_equal_f1_really_ties(spark):
    # thresholds 3 and 1 both give F1 = 2/3 with three positives
    rows = [(3, 1), (3, 1), (3, 0), (2, 0), (2, 0), (1, 1), (1, 0)]
    c = CL.threshold_curve(frame(spark, rows), ["g"], bounded=True)
    f1 = {r["threshold"]: round(r["f1"], 6) for r in c.collect()}
    assert f1 == {3.0: round(2 / 3, 6), 2.0: 0.5, 1.0: 0.6}
    assert CL.f1_optimal(c, ["g"]).first()["threshold_opt"] == 3.0


def test_metrics_zero_denominators(spark):
    m = CL.confusion(frame(spark, [(0, 0), (0, 0)]), ["g"], "(score >= 1D)").first()
    assert (m["recall"], m["precision"], m["f1"], m["specificity"], m["bal_acc"]) == (0.0, 0.0, 0.0, 1.0, 0.5)


def test_published_confusion_row(spark):
    d = spark.createDataFrame([(24, 11, 0, 0)], "tp long, fp long, fn long, tn long")
    m = CL.with_metrics(d).first()
    assert (round(m["precision"], 4), m["recall"], round(m["f1"], 4)) == (0.6857, 1.0, 0.8136)


def lead(spark, ys, ss, **kw):
    rows = [("s", f"{m}-01", y, float(s), 0.5) for m, y, s in zip(months(2020, len(ys)), ys, ss)]
    df = spark.createDataFrame(rows, "g string, m string, y int, score double, threshold double").selectExpr("g", "date(m) AS month", "y", "score", "threshold")
    return CL.lead_time(df, ["g"], **kw).first()


def test_lead_time_last_and_first_alert(spark):
    ys, ss = [0, 0, 0, 1, 1, 0, 1], [1, 0, 1, 0, 0, 0, 1]
    r = lead(spark, ys, ss)
    assert r["n_episodes"] == 1 and r["lead_time"] == 1.0  # alert at month 3, start month 4; open run left out
    assert lead(spark, ys, ss, first=True)["lead_time"] == 3.0


def test_lead_time_ignores_alerts_older_than_a_year(spark):
    r = lead(spark, [0] * 14 + [1, 0], [1] + [0] * 15)
    assert r["n_episodes"] == 1 and r["lead_time"] is None


def test_stress_rows_drop_missing_labels(panel):
    gold = panel([("a", m, v) for m, v in zip(months(2017, 96), [i % 7 for i in range(96)])], "inflation_yoy").withColumn("sig", F.lit(0.3))
    rows = CL.stress_rows(gold, K.SHORT_WINDOWS, {"x": "sig"})
    b = rows.where("block = 'B' AND part = 'test'")
    assert b.count() == 35  # the last month has no next month
    assert b.agg(F.max("month")).first()[0] == dt.date(2024, 11, 1)
    assert rows.where("part = 'train'").select("stress_threshold").distinct().count() <= 2


def test_sweep_marks_one_best(spark):
    s = CL.threshold_sweep(frame(spark, [(i, int(i > 6)) for i in range(10)]), ["g"])
    assert s.count() == 14 and s.where("best").count() == 1
