"""Comparing forecasts and signals: Diebold-Mariano tests, bootstrap intervals, overlap."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelwatch.config import BOOTSTRAP_BLOCK, BOOTSTRAP_REPS, DM_TEXT
from panelwatch.functions.columns import normal_cdf
from panelwatch.operators.panel import TIME

MIN_DM = 8
SEED = 42
# Constants of the integer hash that draws positions.
HASH_REP, HASH_POS, HASH_SEED, HASH_MUL, HASH_MOD = 7919, 104729, 1299721, 48271, 2147483647


# ---- Diebold-Mariano ----


def wide_errors(preds: DataFrame, models: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One error column per model; the pairs of models then need no self-join."""
    return preds.groupBy(*by).agg(*[F.expr(f"max(CASE WHEN model = '{m}' THEN y - yhat END)").alias(f"e_{m}") for m in models])


def dm_test(d: DataFrame, by: Sequence[str], loss_diff: str = "d", order: Sequence[str] = (TIME,), h: int = 1) -> DataFrame:
    """Diebold-Mariano statistic of a loss difference per group.

    Bartlett-weighted long-run variance with lag h - 1 (floor 1e-12 only when that is
    positive), small-sample factor, null below eight observations.
    """
    q = max(h - 1, 0)
    d = d.where(f"{loss_diff} IS NOT NULL")
    if q:
        o = f"(PARTITION BY {', '.join(by)} ORDER BY {', '.join(order)})"
        d = d.withColumns({f"_d{k}": F.expr(f"lag({loss_diff}, {k}) OVER {o}") for k in range(1, q + 1)})
    aggs = [F.count(F.lit(1)).alias("n_obs"), F.avg(loss_diff).alias("_m"), F.var_pop(loss_diff).alias("_g0")]
    for k in range(1, q + 1):
        aggs += [F.expr(f"sum({loss_diff} * _d{k})").alias(f"_p{k}"), F.expr(f"sum(CASE WHEN _d{k} IS NOT NULL THEN {loss_diff} + _d{k} END)").alias(f"_s{k}"), F.count(f"_d{k}").alias(f"_c{k}")]
    a = d.groupBy(*by).agg(*aggs)
    lrv = "_g0" + "".join(f" + {2 * (1 - k / (q + 1))}D * coalesce(_p{k} - _m * _s{k} + _c{k} * _m * _m, 0D) / n_obs" for k in range(1, q + 1))
    lrv = f"greatest({lrv}, 1e-12D)" if q else lrv
    factor = f"CASE WHEN n_obs > {2 * h} THEN sqrt((n_obs + 1 - {2 * h} + {h * (h - 1)} / n_obs) / n_obs) ELSE 1D END"
    stat = f"CASE WHEN n_obs >= {MIN_DM} THEN try_divide(_m, sqrt(({lrv}) / n_obs)) * {factor} END"
    return a.selectExpr(*by, "n_obs", f"{stat} AS dm_stat")


def with_dm_pvalues(stats: DataFrame) -> DataFrame:
    """Two rows per statistic, two-sided and one-sided, with p and the conclusion text."""
    keep = stats.columns
    both = stats.selectExpr(*keep, "explode(array('two-sided', 'one-sided')) AS alternative")
    two = F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs("dm_stat")))
    one = F.lit(1.0) - normal_cdf("dm_stat")
    p = F.when(F.col("dm_stat").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("alternative") == "two-sided", two).otherwise(one))))
    t = DM_TEXT
    text = (f"CASE WHEN p_value IS NULL THEN '{t['few']}' WHEN alternative = 'one-sided' AND p_value < 0.05 THEN '{t['one_yes']}' WHEN alternative = 'one-sided' THEN '{t['one_no']}' "
            f"WHEN p_value < 0.05 THEN '{t['two_yes']}' ELSE '{t['two_no']}' END")
    return both.withColumn("p_value", p).withColumn("conclusion", F.expr(text))


def dm_pairwise(preds: DataFrame, models: Sequence[str], keys: Sequence[str], block: str = "block", time: str = TIME) -> DataFrame:
    """All model pairs in declared order, per block and pooled, squared and absolute loss."""
    wide = wide_errors(preds, models, [*keys, block, time])
    pairs = ", ".join(f"'{a}', '{b}', e_{a}, e_{b}" for a, b in combinations(models, 2))
    n = len(models) * (len(models) - 1) // 2
    long = wide.selectExpr(*keys, block, time, f"stack({n}, {pairs}) AS (model_1, model_2, e1, e2)")
    loss = long.selectExpr(*keys, block, time, "model_1", "model_2", "stack(2, 'MSE', e1 * e1 - e2 * e2, 'MAE', abs(e1) - abs(e2)) AS (loss, d)")
    scoped = loss.selectExpr(*keys, f"explode(array({block}, 'global')) AS scope", "model_1", "model_2", "loss", "d")
    stats = dm_test(scoped, [*keys, "scope", "model_1", "model_2", "loss"]).where(f"n_obs >= {MIN_DM}")
    return with_dm_pvalues(stats)


# ---- bootstrap ----


def block_bootstrap_indices(groups: DataFrame, keys: Sequence[str], n: str = "n", reps: int = BOOTSTRAP_REPS, size: int = BOOTSTRAP_BLOCK, seed: int = SEED) -> DataFrame:
    """Rows (rep, pos, idx) of circular blocks, cut to n positions.

    Starts come from an integer hash of replicate and block, so a lost task draws the
    same numbers again.
    """
    d = groups.selectExpr(*keys, n, f"explode(sequence(1, {reps})) AS rep")
    d = d.selectExpr(*keys, n, "rep", f"explode(sequence(0, int(ceil({n} / {size})) - 1)) AS blk")
    start = f"(((rep * {HASH_REP}L + blk * {HASH_POS}L + {seed * HASH_SEED}L) % {HASH_MOD}L) * {HASH_MUL}L) % {HASH_MOD}L % {n}"
    d = d.selectExpr(*keys, n, "rep", "blk", f"{start} AS _start", f"explode(sequence(0, {size - 1})) AS _j")
    return d.selectExpr(*keys, "rep", f"blk * {size} + _j AS pos", f"int((_start + _j) % {n}) AS idx", n).where(f"pos < {n}").drop(n)


def _draws(n: int, reps: int, size: int, seed: int) -> np.ndarray:
    rep = np.arange(1, reps + 1, dtype=np.int64)[:, None]
    blk = np.arange(-(-n // size), dtype=np.int64)[None, :]
    start = ((rep * HASH_REP + blk * HASH_POS + seed * HASH_SEED) % HASH_MOD) * HASH_MUL % HASH_MOD % n
    return ((start[:, :, None] + np.arange(size)[None, None, :]) % n).reshape(reps, -1)[:, :n]


def _uniforms(n: int, reps: int, seed: int) -> np.ndarray:
    rep = np.arange(1, reps + 1, dtype=np.int64)[:, None]
    pos = np.arange(n, dtype=np.int64)[None, :]
    state = ((rep * HASH_REP + pos * HASH_POS + seed * HASH_SEED) % HASH_MOD) * HASH_MUL % HASH_MOD
    return (state + 0.5) / HASH_MOD


def _interval(values: np.ndarray, alpha: float) -> tuple[float, float]:
    lo, hi = np.percentile(values, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(lo), float(hi)


def ordered_arrays(rows: DataFrame, by: Sequence[str], values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group with its values as arrays in period order (a calendar's length each)."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias("_a"))
    return packed.selectExpr(*by, *[f"_a.{v} AS {v}" for v in values])


def error_intervals(errors: Column, reps: int = BOOTSTRAP_REPS, size: int = BOOTSTRAP_BLOCK, alpha: float = 0.05, seed: int = SEED) -> Column:
    """Struct of RMSE and MAE with block-bootstrap and Bayesian-bootstrap bounds, from an error array.

    The replicates of a group are one vectorised draw inside its row: nothing is exploded
    or shuffled per replicate.
    """
    names = ["rmse", "rmse_lo", "rmse_hi", "mae", "mae_lo", "mae_hi", "rmse_bayes_lo", "rmse_bayes_hi"]

    def run(col: pd.Series) -> pd.DataFrame:
        out = []
        for arr in col:
            e = np.asarray(arr, float)
            n = len(e)
            if n == 0:
                out.append([np.nan] * len(names))
                continue
            sq, ab, idx = e * e, np.abs(e), _draws(n, reps, size, seed)
            w = -np.log(_uniforms(n, reps, seed))
            bayes = np.sqrt((w * sq).sum(1) / w.sum(1))
            out.append([np.sqrt(sq.mean()), *_interval(np.sqrt(sq[idx].mean(1)), alpha), ab.mean(), *_interval(ab[idx].mean(1), alpha), *_interval(bayes, alpha)])
        return pd.DataFrame(out, columns=names)

    return F.pandas_udf(run, ", ".join(f"{n} double" for n in names))(errors)


def _class_metrics(y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """AUC, best F1, its recall and precision per row of (replicates, n) arrays."""
    order = np.argsort(-s, axis=1, kind="stable")
    y, s = np.take_along_axis(y, order, 1), np.take_along_axis(s, order, 1)
    tp, fp = np.cumsum(y, 1), np.cumsum(1 - y, 1)
    pos, neg = tp[:, -1:], fp[:, -1:]
    last = np.ones_like(s, dtype=bool)
    last[:, :-1] = s[:, 1:] != s[:, :-1]
    # counts before the tie group of each position
    step = np.where(last, np.arange(s.shape[1])[None, :], -1)
    prev = np.maximum.accumulate(np.concatenate([np.full((len(s), 1), -1), step[:, :-1]], 1), 1)
    before = lambda c: np.where(prev >= 0, np.take_along_axis(c, np.maximum(prev, 0), 1), 0)
    area = (np.where(last, (fp - before(fp)) * (tp + before(tp)), 0)).sum(1)
    both = (pos[:, 0] > 0) & (neg[:, 0] > 0)
    auc = np.where(both, area / np.maximum(2.0 * pos[:, 0] * neg[:, 0], 1), 0.5)
    f1 = np.where(last, 2.0 * tp / (tp + fp + pos), -1.0)
    # of equal F1 the lowest threshold, which stands furthest to the right
    best = f1.shape[1] - 1 - np.argmax(f1[:, ::-1], axis=1)
    at = lambda a: np.take_along_axis(a, best[:, None], 1)[:, 0]
    top, rec, prec = at(f1), at(tp) / np.maximum(pos[:, 0], 1), at(tp) / (at(tp) + at(fp))
    none = (pos[:, 0] == 0) | (top <= 0)
    return np.stack([auc, np.where(none, 0.0, top), np.where(none, 0.0, rec), np.where(none, 0.0, prec)], 1)


def class_intervals(y: Column, score: Column, reps: int = BOOTSTRAP_REPS, size: int = BOOTSTRAP_BLOCK, alpha: float = 0.05, seed: int = SEED) -> Column:
    """Struct of AUC, best F1, recall, precision with block-bootstrap bounds, from label and score arrays."""
    metrics = ["auc", "f1", "recall", "precision"]
    names = [f"{m}{s}" for m in metrics for s in ("", "_lo", "_hi")]

    def run(ys: pd.Series, ss: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(ys, ss):
            yv, sv = np.asarray(a, int), np.asarray(b, float)
            if len(yv) == 0:
                out.append([np.nan] * len(names))
                continue
            idx = _draws(len(yv), reps, size, seed)
            point, boot = _class_metrics(yv[None, :], sv[None, :])[0], _class_metrics(yv[idx], sv[idx])
            out.append([v for k in range(4) for v in (point[k], *_interval(boot[:, k], alpha))])
        return pd.DataFrame(out, columns=names)

    return F.pandas_udf(run, ", ".join(f"{n} double" for n in names))(y, score)


def ci_overlap(intervals: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Overlap of the intervals of every model pair; ``intervals`` is (keys, metric, model, lo, hi)."""
    wide = intervals.groupBy(*keys, "metric").agg(*[
        F.expr(f"max(CASE WHEN model = '{m}' THEN {b} END)").alias(f"{b}_{m}") for m in models for b in ("lo", "hi")])
    pairs = ", ".join(f"'{a}', '{b}', lo_{a}, hi_{a}, lo_{b}, hi_{b}" for a, b in combinations(models, 2))
    n = len(models) * (len(models) - 1) // 2
    long = wide.selectExpr(*keys, "metric", f"stack({n}, {pairs}) AS (model_a, model_b, a_lo, a_hi, b_lo, b_hi)").where("a_lo IS NOT NULL AND b_lo IS NOT NULL")
    return long.withColumn("overlap", F.expr("greatest(a_lo, b_lo) < least(a_hi, b_hi)")).withColumn("significant_diff", ~F.col("overlap"))
