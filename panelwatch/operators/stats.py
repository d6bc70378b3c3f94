"""Series statistics: breaks, variances, autocorrelation, stationarity, Granger causality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwatch.functions import linear
from panelwatch.operators.panel import KEYS, TIME, UPTO, series

# Published 5 % critical values (constant, no trend).
ADF_CRITICAL, KPSS_CRITICAL = -2.86, 0.463


def _side(break_date: str, time: str) -> str:
    return f"CASE WHEN {time} < DATE '{break_date}' THEN 'pre' ELSE 'post' END"


def break_welch(df: DataFrame, value: str, break_date: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Mean and deviation before and from a date, Welch t and its degrees of freedom, ratio of means."""
    pre, post = f"CASE WHEN {time} < DATE '{break_date}' THEN {value} END", f"CASE WHEN {time} >= DATE '{break_date}' THEN {value} END"
    a = df.groupBy(*keys).agg(*[F.expr(f"{fn}({side})").alias(f"{n}_{t}") for t, side in (("pre", pre), ("post", post))
                                for n, fn in (("n", "count"), ("mean", "avg"), ("var", "var_samp"))])
    se = "(var_pre / n_pre + var_post / n_post)"
    dof = f"try_divide({se} * {se}, var_pre * var_pre / (n_pre * n_pre * (n_pre - 1)) + var_post * var_post / (n_post * n_post * (n_post - 1)))"
    return a.where("n_pre > 1 AND n_post > 1").selectExpr(
        *keys, "n_pre", "n_post", "mean_pre", "mean_post", "sqrt(var_pre) AS std_pre", "sqrt(var_post) AS std_post",
        f"try_divide(mean_pre - mean_post, sqrt({se})) AS t_stat", f"{dof} AS dof", "mean_post / greatest(mean_pre, 0.01D) AS ratio")


def levene(df: DataFrame, value: str, break_date: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Levene W of the two sides around their medians (one-way F of absolute deviations)."""
    d = df.where(f"{value} IS NOT NULL").selectExpr(*keys, f"{_side(break_date, time)} AS _side", f"{value} AS _v")
    part = f"(PARTITION BY {', '.join(keys)}, _side)"
    d = d.selectExpr(*keys, "_side", f"abs(_v - percentile(_v, 0.5D) OVER {part}) AS _z")
    g = d.groupBy(*keys, "_side").agg(F.count("_z").alias("_n"), F.avg("_z").alias("_m"), F.var_pop("_z").alias("_s"))
    t = g.groupBy(*keys).agg(F.sum("_n").alias("n_obs"), F.count(F.lit(1)).alias("_k"), F.expr("sum(_n * _m) / sum(_n)").alias("_gm"),
                             F.expr("sum(_n * _m * _m)").alias("_ms"), F.expr("sum(_n * _s)").alias("_within"))
    return t.where("_k = 2").selectExpr(*keys, "n_obs", "try_divide((n_obs - _k) * (_ms - n_obs * _gm * _gm), (_k - 1) * _within) AS w_stat", "_k - 1 AS dof_1", "n_obs - _k AS dof_2")


def _line_rss(cond: str) -> str:
    """RSS of a straight line over the rows of a condition, from running sums."""
    x, y = f"CASE WHEN {cond} THEN _x END", f"CASE WHEN {cond} THEN _y END"
    return f"regr_syy({y}, {x}) - regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / regr_sxx({y}, {x})"


def chow(df: DataFrame, value: str, break_date: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Chow F of a straight line in time with a break: three fits from one aggregate."""
    d = df.where(f"{value} IS NOT NULL").selectExpr(
        *keys, f"{value} AS _y", f"double((year({time}) - 1970) * 12 + month({time})) AS _x", f"{time} < DATE '{break_date}' AS _pre")
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.expr(_line_rss("TRUE")).alias("rss_all"), F.expr(_line_rss("_pre")).alias("rss_pre"),
                             F.expr(_line_rss("NOT _pre")).alias("rss_post"), F.expr("count_if(_pre)").alias("_np"))
    k = 2
    return a.where(f"_np > {k} AND n_obs - _np > {k}").selectExpr(
        *keys, "n_obs", "rss_all", "rss_pre + rss_post AS rss_split", f"try_divide((rss_all - rss_pre - rss_post) / {k}, (rss_pre + rss_post) / (n_obs - {2 * k})) AS f_stat",
        f"{k} AS dof_1", f"n_obs - {2 * k} AS dof_2")


def acf(df: DataFrame, value: str, lags: int = 24, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Autocorrelations 0..lags as rows (biased, full-sample mean); null values are left out first."""
    arr = _acf_wide(df, value, lags, keys, time)
    return arr.selectExpr(*keys, "n_obs", "posexplode(acf) AS (lag, acf)")


def _acf_wide(df: DataFrame, value: str, lags: int, keys: Sequence[str], time: str) -> DataFrame:
    d = df.where(f"{value} IS NOT NULL").selectExpr(*keys, time, f"{value} - avg({value}) OVER (PARTITION BY {', '.join(keys)}) AS _e")
    o = series(keys, time)
    d = d.selectExpr(*keys, "_e", *[f"lag(_e, {k}) OVER {o} AS _e{k}" for k in range(1, lags + 1)])
    terms = ", ".join(["1D", *[f"try_divide(coalesce(sum(_e * _e{k}), 0D), sum(_e * _e))" for k in range(1, lags + 1)]])
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.expr(f"array({terms})").alias("acf"))


def pacf(df: DataFrame, value: str, lags: int = 24, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion on each series' autocorrelations, folded lag by lag in the JVM.

    A lag whose denominator is 0, and all after it, are null.
    """
    arr = _acf_wide(df, value, lags, keys, time).where("n_obs > 1 AND acf[1] IS NOT NULL")
    # phi holds the coefficients of the order before; the last one of each order is the partial autocorrelation
    above = "acf[k] - aggregate(zip_with(s.phi, reverse(slice(acf, 2, k - 1)), (x, y) -> x * y), 0D, (t, x) -> t + x)"
    below = "1D - aggregate(zip_with(s.phi, slice(acf, 2, k - 1), (x, y) -> x * y), 0D, (t, x) -> t + x)"
    grown = "named_struct('phi', concat(zip_with(s.phi, reverse(s.phi), (x, y) -> x - last * y), array(last)), 'out', concat(s.out, array(last)))"
    step = f"transform(array(try_divide({above}, {below})), last -> {grown})[0]"
    start = "named_struct('phi', CAST(array() AS array<double>), 'out', array(1D))"
    folded = f"aggregate(sequence(1, {lags}), {start}, (s, k) -> {step}).out"
    return arr.selectExpr(*keys, "n_obs", f"posexplode({folded}) AS (lag, pacf)")


def kpss_stat(df: DataFrame, value: str, lags: int = 4, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """KPSS statistic around a level: partial sums over a Bartlett long-run variance."""
    whole = f"(PARTITION BY {', '.join(keys)})"
    d = df.where(f"{value} IS NOT NULL").selectExpr(*keys, time, f"{value} - avg({value}) OVER {whole} AS _e")
    d = d.selectExpr(*keys, "_e", f"sum(_e) OVER {series(keys, time, UPTO)} AS _s", *[f"lag(_e, {k}) OVER {series(keys, time)} AS _e{k}" for k in range(1, lags + 1)])
    lrv = "sum(_e * _e)" + "".join(f" + {2 * (1 - k / (lags + 1))}D * coalesce(sum(_e * _e{k}), 0D)" for k in range(1, lags + 1))
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.expr("sum(_s * _s)").alias("_ss"), F.expr(lrv).alias("_lrv"))
    return a.selectExpr(*keys, "n_obs", "try_divide(_ss, n_obs * _lrv) AS kpss").withColumn("stationary", F.expr(f"kpss < {KPSS_CRITICAL}"))


def adf_stat(df: DataFrame, value: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Dickey-Fuller t with a constant and one lagged difference, from centred sums of products."""
    o = series(keys, time)
    d = df.where(f"{value} IS NOT NULL").selectExpr(*keys, time, f"{value} AS _v", f"lag({value}, 1) OVER {o} AS _v1", f"lag({value}, 2) OVER {o} AS _v2")
    d = d.where("_v2 IS NOT NULL").selectExpr(*keys, "_v - _v1 AS q", "_v1 AS a", "_v1 - _v2 AS b")
    cen = {f"s_{i}{j}": f"sum({i} * {j}) - sum({i}) * sum({j}) / count(1)" for i, j in ("aa", "ab", "bb", "aq", "bq", "qq")}
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), *[F.expr(e).alias(n) for n, e in cen.items()])
    det = "(s_aa * s_bb - s_ab * s_ab)"
    g = g.where("n_obs > 4").selectExpr("*", f"try_divide(s_aq * s_bb - s_bq * s_ab, {det}) AS rho", f"try_divide(s_bq * s_aa - s_aq * s_ab, {det}) AS gam")
    t = f"try_divide(rho, sqrt((s_qq - rho * s_aq - gam * s_bq) / (n_obs - 3) * s_bb / {det}))"
    return g.selectExpr(*keys, "n_obs", "rho", f"{t} AS adf_t").withColumn("stationary", F.expr(f"adf_t < {ADF_CRITICAL}"))


def granger_f(df: DataFrame, target: str, signal: str, max_lag: int = 4, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """F of the signal's lags in an autoregression of the target, per lag order 1..max_lag.

    One aggregate gives the sums of products of every order. One elimination leaves, in turn, what the target's own lags and what both sets of lags
    do not explain. The statistic is null with no degrees of freedom left and where lags determine one another.
    """
    whole = f"(PARTITION BY {', '.join(keys)})"
    d = df.where(f"{target} IS NOT NULL AND {signal} IS NOT NULL").selectExpr(
        *keys, time, f"{target} - avg({target}) OVER {whole} AS y0", f"{signal} - avg({signal}) OVER {whole} AS x0")
    o = series(keys, time)
    d = d.selectExpr(*keys, "y0", "1D AS c", *[f"lag({v}0, {k}) OVER {o} AS {v}{k}" for v in "yx" for k in range(1, max_lag + 1)])
    orders = range(1, max_lag + 1)
    sums = []
    for p in orders:
        names = ["c", *[f"y{k}" for k in range(1, p + 1)], *[f"x{k}" for k in range(1, p + 1)], "y0"]
        known = f"y{p} IS NOT NULL"
        sums.append(F.expr(linear.matrix([[f"sum(CASE WHEN {known} THEN {a} * {b} END)" for b in names] for a in names])).alias(f"_m{p}"))
        sums.append(F.expr(f"count_if({known})").alias(f"_n{p}"))
    g = d.groupBy(*keys).agg(*sums)
    g = g.selectExpr(*g.columns, *[f"{linear.residual(f'_m{p}', 2 * p + 1, n)} AS _{tag}{p}" for p in orders for tag, n in (("own", p + 1), ("all", 2 * p + 1))])
    rows = ", ".join(f"{p}, _n{p}, _own{p}, _all{p}" for p in orders)
    g = g.selectExpr(*keys, f"stack({max_lag}, {rows}) AS (lag, n_obs, _own, _all)").selectExpr(*keys, "lag", "n_obs", "_own", "_all", "double(lag) AS dof_1", "double(n_obs - 2 * lag - 1) AS dof_2")
    f = "CASE WHEN dof_2 > 0 AND _all > 0 THEN (_own - _all) / dof_1 / (_all / dof_2) END"
    return g.selectExpr(*keys, "lag", "n_obs", f"{f} AS f_stat", "dof_1", "dof_2")
