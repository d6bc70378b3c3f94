"""Threshold metrics, ROC and precision-recall curves, calibration, lead times.

Curves come from one pass: rows are first counted per distinct score (map-side
combine), then running totals in descending score order give the counts of every
threshold. Areas are sums over integer counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwatch.config import STRESS_QUANTILE, EvalWindow
from panelwatch.operators.forecast import eval_blocks
from panelwatch.operators.panel import BEFORE, KEYS, TIME, UPTO, series
from panelwatch.operators.ranks import running_totals
from panelwatch.session import cut_lineage

DEFAULT_THRESHOLD = 0.5
MIN_POSITIVES = 3
MAX_LEAD = 12


def ratio0(a: str, b: str) -> str:
    return f"coalesce(try_divide(double({a}), double({b})), 0D)"


METRIC_SQL = {
    "recall": ratio0("tp", "tp + fn"),
    "precision": ratio0("tp", "tp + fp"),
    "specificity": ratio0("tn", "tn + fp"),
    "f1": ratio0("2 * tp", "2 * tp + fp + fn"),
    "bal_acc": f"({ratio0('tp', 'tp + fn')} + {ratio0('tn', 'tn + fp')}) / 2D",
}


def with_metrics(counts: DataFrame) -> DataFrame:
    """Recall, precision, specificity, F1 and balanced accuracy from tp, fp, fn, tn; 0 on a zero denominator."""
    return counts.selectExpr("*", *[f"{e} AS {n}" for n, e in METRIC_SQL.items()])


def confusion(rows: DataFrame, by: Sequence[str], pred: str, y: str = "y") -> DataFrame:
    """Counts and metrics of a 0/1 prediction expression per group."""
    agg = rows.where(f"{y} IS NOT NULL").groupBy(*by).agg(*[
        F.expr(f"count_if({cond})").alias(n) for n, cond in {
            "tp": f"{pred} AND {y} = 1", "fp": f"{pred} AND {y} = 0", "fn": f"NOT {pred} AND {y} = 1", "tn": f"NOT {pred} AND {y} = 0"}.items()])
    return with_metrics(agg)


def threshold_curve(rows: DataFrame, by: Sequence[str], y: str = "y", score: str = "score", bounded: bool = False) -> DataFrame:
    """One row per group and distinct score: counts at that threshold, the counts one step before, metrics.

    ``bounded`` says that a group has at most a calendar of scores; otherwise the
    running totals are taken in ranges of scores so that one hot group uses many tasks.
    """
    return curve_of_counts(score_counts(rows, by, y, score), by, bounded)


def score_counts(rows: DataFrame, by: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Positives ``_p`` and negatives ``_q`` per group and distinct score ``threshold``."""
    return rows.where(f"{y} IS NOT NULL AND {score} IS NOT NULL").groupBy(*by, F.col(score).alias("threshold")).agg(
        F.expr(f"sum({y})").cast("bigint").alias("_p"), F.expr(f"sum(1 - {y})").cast("bigint").alias("_q"))


def curve_of_counts(counts: DataFrame, by: Sequence[str], bounded: bool = False) -> DataFrame:
    """The threshold curve of counts per group and score; a group may have several rows per score."""
    counts = counts.groupBy(*by, "threshold").agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    run = running_totals(counts, by, "threshold", ["_p", "_q"], bounded=bounded)
    out = run.selectExpr(
        *by, "threshold", "total__p AS n_pos", "total__q AS n_neg", "cum__p AS tp", "cum__q AS fp", "total__p - cum__p AS fn", "total__q - cum__q AS tn", "cum__p - _p AS prev_tp", "cum__q - _q AS prev_fp")
    return with_metrics(out)


def areas(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUC and average precision per group.

    AUC is 0.5 when a class is empty. Average precision is the trapezoid over points by
    recall without an anchor; 0.5 without positives, the only precision with one point.
    """
    auc = "sum((fp - prev_fp) * (tp + prev_tp)) / (2D * max(n_pos) * max(n_neg))"
    step = f"({ratio0('tp - prev_tp', 'n_pos')}) * (precision + {ratio0('prev_tp', 'prev_tp + prev_fp')}) / 2D"
    ap = f"sum(CASE WHEN prev_tp + prev_fp > 0 THEN {step} ELSE 0D END)"
    return curve.groupBy(*by).agg(
        F.expr("max(n_pos)").alias("n_pos"), F.expr("max(n_pos) + max(n_neg)").alias("n_total"),
        F.expr(f"CASE WHEN max(n_pos) = 0 OR max(n_neg) = 0 THEN 0.5D ELSE {auc} END").alias("auc"),
        F.expr(f"CASE WHEN max(n_pos) = 0 THEN 0.5D WHEN count(1) = 1 THEN max(precision) ELSE {ap} END").alias("ap"))


def f1_optimal(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """The threshold of largest F1 (ties: the highest) with its rates and the positive share."""
    best = F.expr("max(struct(f1, threshold, tp, fp, recall, precision))").alias("b")
    agg = curve.groupBy(*by).agg(best, F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    return agg.selectExpr(
        *by, "b.f1 AS f1_opt", "b.threshold AS threshold_opt", f"{ratio0('b.fp', 'n_neg')} AS fpr_opt", "b.recall AS recall_opt",
        "b.precision AS precision_opt", f"{ratio0('n_pos', 'n_pos + n_neg')} AS baseline", "n_pos", "n_pos + n_neg AS n_total")


def best_f1(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest F1 over the thresholds (ties: the lowest) with its recall and precision; 0 without positives."""
    agg = curve.groupBy(*by).agg(F.expr("min(struct(-f1 AS o, threshold, recall, precision))").alias("b"), F.max("n_pos").alias("n_pos"))
    return agg.selectExpr(*by, "n_pos", "b.threshold AS threshold", "-b.o AS f1",
                          "CASE WHEN b.o = 0 THEN 0D ELSE b.recall END AS recall", "CASE WHEN b.o = 0 THEN 0D ELSE b.precision END AS precision")


def calibrate(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Threshold of largest F1 (ties: the lowest); 0.5 with fewer than three positives or no F1 above 0."""
    return best_f1(curve, by).selectExpr(
        *by, f"CASE WHEN n_pos < {MIN_POSITIVES} OR f1 <= 0 THEN {DEFAULT_THRESHOLD}D ELSE threshold END AS threshold")


def stress_rows(gold: DataFrame, windows: Sequence[EvalWindow], signals: Mapping[str, str], yoy: str = "inflation_yoy",
                quantile: float = STRESS_QUANTILE, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Labels and scores per series, block, part and signal.

    The stress threshold is the quantile of the yearly change over the block's training
    months; the label of a month is next month's change against it, rows without a label
    are dropped. Scores are filled forward, back, then with 0 inside each part.
    """
    cols = list(dict.fromkeys(signals.values()))
    d = gold.selectExpr(*keys, time, yoy, *cols, f"lead({yoy}, 1) OVER {series(keys, time)} AS _next")
    d = eval_blocks(d, windows, time)
    bk = [*keys, "block"]
    thr = f"percentile(CASE WHEN part = 'train' THEN {yoy} END, {quantile}D) OVER (PARTITION BY {', '.join(bk)})"
    d = d.withColumn("stress_threshold", F.expr(thr))
    d = d.withColumn("y", F.expr("CASE WHEN _next >= stress_threshold THEN 1 WHEN _next < stress_threshold THEN 0 END")).where("y IS NOT NULL")
    pk = [*bk, "part"]
    fills = [
        f"coalesce(last({c}, true) OVER {series(pk, time, UPTO)}, first({c}, true) OVER (PARTITION BY {', '.join(pk)} ORDER BY {time} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0D) AS _s_{n}" for n, c in signals.items()
    ]
    wide = d.selectExpr(*pk, time, "stress_threshold", "y", *fills)
    pairs = ", ".join(f"'{n}', _s_{n}" for n in signals)
    return wide.selectExpr(*pk, time, "stress_threshold", "y", f"stack({len(signals)}, {pairs}) AS (signal, score)")


def lead_time(rows: DataFrame, by: Sequence[str], threshold: str = "threshold", y: str = "y", score: str = "score",
              time: str = TIME, first: bool = False, max_lead: int = MAX_LEAD) -> DataFrame:
    """Mean months from the last alert (or the first) in the year before a closed episode to its start.

    The last alert before each month is a running maximum, so no range join is needed:
    if even the last one is older than a year there is none inside it.
    """
    d = rows.where(f"{y} IS NOT NULL")
    o, b = series(by, time), series(by, time, BEFORE)
    if first:
        alert = (f"min(CASE WHEN {score} >= {threshold} THEN {time} END) OVER (PARTITION BY {', '.join(by)} ORDER BY year({time}) * 12 + month({time}) "
                 f"RANGE BETWEEN {max_lead} PRECEDING AND 1 PRECEDING)")
    else:
        alert = f"max(CASE WHEN {score} >= {threshold} THEN {time} END) OVER {b}"
    d = d.selectExpr(*by, time, y, f"{alert} AS _alert", f"CASE WHEN {y} <> lag({y}, 1) OVER {o} THEN 1 ELSE 0 END AS _chg", f"lead({y}, 1) OVER {o} AS _after")
    d = d.withColumn("_run", F.expr(f"sum(_chg) OVER {series(by, time, UPTO)}")).where(f"{y} = 1")
    runs = d.groupBy(*by, "_run").agg(
        F.min(time).alias("_start"), F.min_by("_alert", time).alias("_alert"), F.expr("max(CASE WHEN _after = 0 THEN 1 ELSE 0 END)").alias("_closed"))
    lead = f"CASE WHEN _closed = 1 AND _alert >= add_months(_start, -{max_lead}) THEN (year(_start) - year(_alert)) * 12 + month(_start) - month(_alert) END"
    return runs.selectExpr(*by, f"{lead} AS _lead", "_closed").groupBy(*by).agg(
        F.sum("_closed").alias("n_episodes"), F.count("_lead").alias("n_led"), F.avg("_lead").alias("lead_time"))


def early_warning(rows: DataFrame, keys: Sequence[str] = KEYS, time: str = TIME, least_positives: int = 2) -> DataFrame:
    """Per series, signal and scope (each block and all blocks pooled): calibrated on train, judged on test.

    ``rows`` comes from :func:`stress_rows`. Blocks with fewer than two positive test
    months are left out. The pooled scope keeps each block's own predictions and reports
    the median thresholds.
    """
    bk = [*keys, "block", "signal"]
    calibrated = calibrate(threshold_curve(rows.where("part = 'train'"), bk, bounded=True), bk)
    test = rows.where("part = 'test'").withColumn("_pos", F.expr(f"sum(y) OVER (PARTITION BY {', '.join(bk)})")).where(f"_pos >= {least_positives}")
    judged = test.join(calibrated, bk).withColumn("pred", F.expr("score >= threshold"))
    # every row counts in its block and in the pooled scope
    scoped = judged.selectExpr(*keys, "signal", time, "y", "score", "pred", "block", "threshold", "stress_threshold", "explode(array(block, 'global')) AS scope")
    scoped = cut_lineage(scoped)  # the short judged rows, read by all that follows
    sk = [*keys, "signal", "scope"]
    once = scoped.groupBy(*sk, "block").agg(F.max("threshold").alias("_t"), F.max("stress_threshold").alias("_s"))
    medians = once.groupBy(*sk).agg(F.expr("percentile(_t, 0.5D)").alias("threshold"), F.expr("percentile(_s, 0.5D)").alias("stress_threshold"))
    counts = confusion(scoped, sk, "pred")
    curve = threshold_curve(scoped, sk, bounded=True)
    leads = lead_time(scoped.drop("threshold", "stress_threshold").join(medians, sk), sk, time=time)
    return medians.join(counts, sk).join(areas(curve, sk), sk).join(leads.select(*sk, "lead_time"), sk, "left")


def threshold_sweep(rows: DataFrame, by: Sequence[str], percents: Sequence[int] = tuple(range(30, 96, 5))) -> DataFrame:
    """Metrics at score percentiles; the first percentile of largest F1 is marked best.

    For calendar-bounded groups: the percentiles of a group are one array.
    """
    probs = ", ".join(f"{p / 100}D" for p in percents)
    part = f"(PARTITION BY {', '.join(by)})"
    d = rows.where("y IS NOT NULL").selectExpr(*by, "y", "score", f"percentile(score, array({probs})) OVER {part} AS _q")
    d = d.selectExpr(*by, "y", "score", "posexplode(_q) AS (_i, threshold)")
    m = confusion(d, [*by, "_i", "threshold"], "(score >= threshold)")
    names = ", ".join(str(p) for p in percents)
    m = m.withColumn("percentile", F.expr(f"array({names})[_i]"))
    best = f"min(struct(-f1 AS o, percentile AS p)) OVER {part}"
    return m.selectExpr(*by, "percentile", "threshold", *METRIC_SQL, f"({best}).p = percentile AS best")
