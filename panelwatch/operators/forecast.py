"""One-step-ahead walk-forward forecasts of every series, every origin, in window passes.

With ``w`` the first difference of the seasonal difference of ``y`` (and ``dx`` the same of
an outside signal), the autoregression ``w_t = a w_{t-1} + b w_{t-2} + c dx_t`` fitted on all
rows before an origin needs only sums of products over those rows. The sums are running
windows, so no model is refitted in a loop: each row holds the normal equations of its own
origin and solves them by Cramer's rule as a plain expression.

The full model adds moving-average terms of the season. Its innovations come from a long autoregression (with the terms of
a year before), whose running normal equations are solved the same way; both larger systems are eliminated as
arrays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwatch.config import ERROR_NOTES, MIN_TRAIN, MIN_TRAIN_FULL, EvalWindow
from panelwatch.functions import linear
from panelwatch.operators.panel import BEFORE, KEYS, TIME, fill_gaps, series

SEASON = 12
RANGE_FACTOR = 5.0


def eval_blocks(df: DataFrame, windows: Sequence[EvalWindow], time: str = TIME) -> DataFrame:
    """Repeat each row once per window it belongs to (train start to test end), with its part.

    The windows are a literal array of a few structs; no join.
    """
    arr = ", ".join(
        f"named_struct('block', '{w.label}', 'a', DATE '{w.train_start}', 'b', DATE '{w.train_end}', 'c', DATE '{w.test_start}', 'd', DATE '{w.test_end}')"
        for w in windows
    )
    out = df.withColumn("_w", F.expr(f"explode(array({arr}))"))
    part = f"CASE WHEN {time} BETWEEN _w.a AND _w.b THEN 'train' WHEN {time} BETWEEN _w.c AND _w.d THEN 'test' END"
    out = out.withColumns({"block": F.expr("_w.block"), "part": F.expr(part)})
    return out.where("part IS NOT NULL").drop("_w")


def derive_windows(gold: DataFrame, label: str = "split_label", time: str = TIME) -> DataFrame:
    """Window bounds per label from the labels themselves; only labels with both parts."""
    parts = gold.select(time, F.explode(F.split(label, r"\|")).alias("_p")).where("_p LIKE '%\\_%'")
    parts = parts.selectExpr(time, "substring_index(_p, '_', 1) AS part", "substring_index(_p, '_', -1) AS label")
    return parts.groupBy("label").agg(
        *[F.expr(f"{fn}(CASE WHEN part = '{p}' THEN {time} END)").alias(f"{p}_{n}") for p in ("train", "test") for fn, n in (("min", "start"), ("max", "end"))]
    ).where("train_start IS NOT NULL AND test_start IS NOT NULL")


def differenced(df: DataFrame, y: str, exog: Sequence[str] = (), keys: Sequence[str] = KEYS, time: str = TIME, season: int = SEASON) -> DataFrame:
    """Lags and double differences: ``y1``, ``ys`` (season), ``ys1``, ``w``, ``w1``, ``w2``, and ``dx_{c}``.

    Signals are gap-filled forward, then back, before differencing.
    """
    o = series(keys, time)
    df = df.withColumns({f"_x_{c}": fill_gaps(c, keys, time) for c in exog}) if exog else df
    df = df.withColumns({
        "y1": F.expr(f"lag({y}, 1) OVER {o}"), "ys": F.expr(f"lag({y}, {season}) OVER {o}"), "ys1": F.expr(f"lag({y}, {season + 1}) OVER {o}"),
        **{f"dx_{c}": F.expr(f"_x_{c} - lag(_x_{c}, 1) OVER {o} - lag(_x_{c}, {season}) OVER {o} + lag(_x_{c}, {season + 1}) OVER {o}") for c in exog},
    })
    df = df.withColumn("w", F.expr(f"{y} - y1 - ys + ys1"))
    return df.withColumns({f"w{k}": F.expr(f"lag(w, {k}) OVER {o}") for k in (1, 2)})


def _solve(order: Sequence[str], s) -> list[str]:
    """Cramer's rule for up to three unknowns; ``s(a, b)`` names the sum of products."""
    if len(order) == 1:
        (a,) = order
        return [f"try_divide({s(a, 'w')}, {s(a, a)})"]
    if len(order) == 2:
        a, b = order
        det = f"({s(a, a)} * {s(b, b)} - {s(a, b)} * {s(a, b)})"
        return [
            f"try_divide({s(a, 'w')} * {s(b, b)} - {s(b, 'w')} * {s(a, b)}, {det})",
            f"try_divide({s(b, 'w')} * {s(a, a)} - {s(a, 'w')} * {s(a, b)}, {det})",
        ]
    cols = [[s(i, j) for j in order] for i in order]
    rhs = [s(i, "w") for i in order]

    def det3(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")

    full = det3(cols)
    return [f"try_divide({det3([[rhs[i] if j == k else cols[i][j] for j in range(3)] for i in range(3)])}, {full})" for k in range(3)]


def pair_name(a: str, b: str, tag: str) -> str:
    x, z = sorted((a, b))
    return f"_{tag}__{x}__{z}"


def product_sums(terms: Sequence[str], tag: str) -> dict[str, str]:
    """Products of the regressors among themselves and with ``w`` over rows where all are known."""
    known = " AND ".join(f"{t} IS NOT NULL" for t in [*terms, "w"])
    names = [(a, b) for i, a in enumerate(terms) for b in [*terms[i:], "w"]]
    sums = {pair_name(a, b, tag): f"sum(CASE WHEN {known} THEN {a} * {b} END)" for a, b in names}
    return {**sums, f"_{tag}__n": f"sum(CASE WHEN {known} THEN 1 ELSE 0 END)"}


def normal_equations(terms: Sequence[str], tag: str) -> str:
    """The sums of :func:`product_sums` as one matrix, right-hand side last."""
    return linear.matrix([[pair_name(a, b, tag) for b in [*terms, "w"]] for a in terms])


def long_terms(season: int) -> list[str]:
    """Terms of the long autoregression: the last three values and those of a season before."""
    return [f"w{k}" for k in (1, 2, 3, season, season + 1)]


def ma_terms(season: int) -> list[str]:
    """Two autoregressive terms, and innovations at the lags of (1 - B)(1 - B^season) averages."""
    return ["w1", "w2", *(f"e{k}" for k in (1, season, season + 1))]


def with_innovations(df: DataFrame, keys: Sequence[str], time: str, season: int) -> DataFrame:
    """``e1, e{season}, e{season+1}``: lagged one-step errors of ``w``, each from the equations of its own origin.

    The long autoregression is used where it can be solved, the two-term one before, 0 before that (as the
    conditional likelihood takes innovations before the sample). Expects the sums of both.
    """
    terms = long_terms(season)
    c1, c2 = _solve(["w1", "w2"], lambda a, c: pair_name(a, c, "s2"))
    df = df.withColumn("_long", F.expr(normal_equations(terms, "long")))
    df = df.withColumn("_long", F.expr(f"CASE WHEN _long__n > {len(terms)} THEN {linear.solve('_long', len(terms))} END"))
    short = f"CASE WHEN _s2__n > 2 THEN w - ({c1} * w1 + {c2} * w2) END"
    df = df.withColumn("_e", F.expr(f"coalesce(w - {linear.dot('_long', terms)}, {short}, 0D)")).drop("_long")
    o = series(keys, time)
    return df.withColumns({f"e{k}": F.expr(f"coalesce(lag(_e, {k}) OVER {o}, 0D)") for k in (1, season, season + 1)})


def walk_forward(df: DataFrame, y: str, exog: Mapping[str, str], keys: Sequence[str] = KEYS, time: str = TIME, season: int = SEASON, full: Mapping[str, str | None] | None = None) -> DataFrame:
    """Add ``pred_naive``, ``pred_seasonal`` and ``pred_{model}`` per signal for every row as origin.

    Rules per origin with n known values before it: n < 24 the last value; n < 36 one
    autoregressive term; else two. A signal joins when it has a value before the origin.
    A singular system falls back to the simple one, then to the last value; so does a
    forecast further than five ranges from the mean.

    ``full`` names models with moving-average terms and the signal each has (none: the series alone). With n >= 36 they
    use the full equations, in turn the simple ones if those can't be solved; all other rules are the same.
    """
    full = full or {}
    signals = list(dict.fromkeys([*exog.values(), *(c for c in full.values() if c)]))
    df = differenced(df, y, signals, keys, time, season)
    b, o = series(keys, time, BEFORE), series(keys, time)
    if full:
        df = df.withColumns({f"w{k}": F.expr(f"lag(w, {k}) OVER {o}") for k in (3, season, season + 1)})
    specs: dict[str, list[str]] = {"s1": ["w1"], "s2": ["w1", "w2"]}
    for c in signals:
        specs[f"s1_{c}"] = ["w1", f"dx_{c}"]
        specs[f"s2_{c}"] = ["w1", "w2", f"dx_{c}"]
    stats = {
        "n_train": f"count({y}) OVER {b}", "last_train": f"last({y}, true) OVER {b}", "mean_train": f"avg({y}) OVER {b}",
        "range_train": f"max({y}) OVER {b} - min({y}) OVER {b}",
    }
    stats.update({f"_n_{c}": f"count({c}) OVER {b}" for c in signals})
    for tag, terms in ({**specs, "long": long_terms(season)} if full else specs).items():
        stats.update({k: f"{v} OVER {b}" for k, v in product_sums(terms, tag).items()})
    keep = [*df.columns]
    df = df.selectExpr(*keep, *[f"{e} AS {k}" for k, e in stats.items()])
    raw = {}
    for tag, terms in specs.items():
        coef = _solve(terms, lambda a, c, t=tag: pair_name(a, c, t))
        fit = "y1 + ys - ys1 + " + " + ".join(f"{k} * {t}" for k, t in zip(coef, terms))
        # no more rows than unknowns: the system is singular but for rounding
        raw[f"_p_{tag}"] = f"CASE WHEN _{tag}__n > {len(terms)} THEN {fit} END"
    df = df.selectExpr(*df.columns, *[f"{e} AS {k}" for k, e in raw.items()])
    if full:
        df = with_innovations(df, keys, time, season)
        larger = {f"f{'' if c is None else '_' + c}": [*ma_terms(season), *([f"dx_{c}"] if c else [])] for c in dict.fromkeys([None, *full.values()])}
        sums = {k: v for tag, terms in larger.items() for k, v in product_sums(terms, tag).items()}
        df = df.selectExpr(*df.columns, *[f"{v} OVER {b} AS {k}" for k, v in sums.items()])
        df = df.selectExpr(*df.columns, *[f"{normal_equations(terms, tag)} AS _m_{tag}" for tag, terms in larger.items()])
        df = df.selectExpr(*df.columns, *[f"CASE WHEN _{tag}__n > {len(terms)} THEN {linear.solve(f'_m_{tag}', len(terms))} END AS _b_{tag}" for tag, terms in larger.items()])
        df = df.selectExpr(*df.columns, *[f"y1 + ys - ys1 + {linear.dot(f'_b_{tag}', terms)} AS _p_{tag}" for tag, terms in larger.items()])

    def guarded(simple: str, full: str) -> str:
        pick = f"CASE WHEN n_train < {MIN_TRAIN_FULL} THEN {simple} ELSE coalesce({full}, {simple}) END"
        sane = f"abs({pick} - mean_train) <= {RANGE_FACTOR} * (range_train + 1e-6D)"
        return f"CASE WHEN n_train < {MIN_TRAIN} THEN last_train WHEN {sane} THEN {pick} ELSE last_train END"

    preds = {"pred_naive": "last_train", "pred_seasonal": guarded("_p_s1", "_p_s2")}
    for model, c in exog.items():
        preds[f"pred_{model}"] = f"CASE WHEN _n_{c} > 0 THEN {guarded(f'_p_s1_{c}', f'_p_s2_{c}')} ELSE {guarded('_p_s1', '_p_s2')} END"
    for model, c in full.items():
        alone = guarded("_p_s1", "_p_f")
        preds[f"pred_{model}"] = f"CASE WHEN _n_{c} > 0 THEN {guarded(f'_p_s1_{c}', f'_p_f_{c}')} ELSE {alone} END" if c else alone
    return df.selectExpr(*keep, "n_train", "last_train", *[f"{e} AS {k}" for k, e in preds.items()])


def long_predictions(df: DataFrame, y: str, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``(keep, model, y, yhat)`` rows from the wide forecast columns."""
    pairs = ", ".join(f"'{m}', pred_{m}" for m in models)
    return df.selectExpr(*keep, f"{y} AS y", f"stack({len(models)}, {pairs}) AS (model, yhat)")


def backtest(gold: DataFrame, windows: Sequence[EvalWindow], exog: Mapping[str, str], y: str = "ipc_level", keys: Sequence[str] = KEYS, time: str = TIME, least_train: int = MIN_TRAIN, least_test: int = 6, full: Mapping[str, str | None] | None = None) -> DataFrame:
    """Long predictions ``(keys, block, time, model, y, yhat)`` of the test months of each block.

    Blocks with fewer than ``least_train`` known values before the test or fewer than
    ``least_test`` known test values are skipped for that series.
    """
    full = full or {}
    signals = list(dict.fromkeys([*exog.values(), *(c for c in full.values() if c)]))
    blocks = eval_blocks(gold.select(*keys, time, y, *signals), windows, time)
    bk = [*keys, "block"]
    fc = walk_forward(blocks, y, exog, bk, time, full=full).where(f"part = 'test' AND {y} IS NOT NULL")
    whole = f"(PARTITION BY {', '.join(bk)})"
    fc = fc.withColumns({"_tr": F.expr(f"min(n_train) OVER {whole}"), "_te": F.expr(f"count({y}) OVER {whole}")})
    fc = fc.where(f"_tr >= {least_train} AND _te >= {least_test}")
    return long_predictions(fc, y, ["naive", "seasonal", *exog, *full], [*bk, time])


def forecast_metrics(preds: DataFrame, by: Sequence[str], order: str = TIME, naive: str = "naive") -> DataFrame:
    """RMSE, MAE, MAPE, sMAPE, MASE (scale from the test actuals) and Theil U per group and model."""
    prev = preds.withColumn("_d", F.expr(f"abs(y - lag(y, 1) OVER (PARTITION BY {', '.join(by)}, model ORDER BY {order}))"))
    agg = prev.where("y IS NOT NULL AND yhat IS NOT NULL").groupBy(*by, "model").agg(
        F.expr("sqrt(avg((y - yhat) * (y - yhat)))").alias("rmse"), F.expr("avg(abs(y - yhat))").alias("mae"),
        F.expr("avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100D").alias("mape"),
        F.expr("avg(CASE WHEN abs(y) + abs(yhat) <> 0 THEN 200D * abs(y - yhat) / (abs(y) + abs(yhat)) END)").alias("smape"),
        F.expr("try_divide(avg(abs(y - yhat)), avg(_d))").alias("mase"), F.count(F.lit(1)).alias("n_test"))
    base = f"max(CASE WHEN model = '{naive}' THEN rmse END) OVER (PARTITION BY {', '.join(by)})"
    return agg.withColumn("theils_u", F.expr(f"CASE WHEN model = '{naive}' THEN 1D ELSE try_divide(rmse, {base}) END"))


def error_verdict_sql() -> str:
    """Joined notes on the three error rules, over the columns mape, mase, theils_u."""
    notes = ERROR_NOTES
    joined = (f"concat_ws(' | ', CASE WHEN mape < 5 THEN '{notes['mape']}' END, CASE WHEN mase < 1 THEN '{notes['mase']}' END, "
              f"CASE WHEN theils_u < 1 THEN '{notes['theils_u']}' END)")
    return f"CASE WHEN {joined} = '' THEN '{notes['none']}' ELSE {joined} END"


# ---- fit statistics from one aggregate pass ----


def _gram_aggs(terms: Sequence[str], tag: str) -> dict[str, str]:
    known = " AND ".join(f"{t} IS NOT NULL" for t in [*terms, "w"])
    return {**product_sums(terms, tag), f"_{tag}__yy": f"sum(CASE WHEN {known} THEN w * w END)"}


def _rss(terms: Sequence[str], tag: str) -> str:
    coef = _solve(terms, lambda a, b: pair_name(a, b, tag))
    return f"(_{tag}__yy - " + " - ".join(f"({c}) * {pair_name(t, 'w', tag)}" for c, t in zip(coef, terms)) + ")"


def model_ic(df: DataFrame, y: str, signal: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """AIC, BIC, HQIC of the two-term model without and with the signal on the same rows; the signal's coefficient and t."""
    d = differenced(df, y, [signal], keys, time)
    x = f"dx_{signal}"
    terms = ["w1", "w2", x]
    agg = d.groupBy(*keys).agg(*[F.expr(v).alias(k) for k, v in _gram_aggs(terms, "g").items()])
    base, full = _rss(["w1", "w2"], "g"), _rss(terms, "g")
    n = "_g__n"
    s = lambda a, b: pair_name(a, b, "g")
    minor = f"({s('w1', 'w1')} * {s('w2', 'w2')} - {s('w1', 'w2')} * {s('w1', 'w2')})"
    det = (f"({s('w1', 'w1')} * ({s('w2', 'w2')} * {s(x, x)} - {s('w2', x)} * {s('w2', x)}) - {s('w1', 'w2')} * ({s('w1', 'w2')} * {s(x, x)} - {s('w2', x)} * {s('w1', x)})"
           f" + {s('w1', x)} * ({s('w1', 'w2')} * {s('w2', x)} - {s('w2', 'w2')} * {s('w1', x)}))")
    coef = _solve(terms, s)[2]
    agg = agg.where(f"{n} > 5").selectExpr(*keys, f"{n} AS n", f"{base} AS rss_base", f"{full} AS rss_full", f"{coef} AS coef", f"try_divide({minor}, {det}) AS inv_xx")
    out = []
    for tag, k in (("base", 2), ("full", 3)):
        ll = f"n * ln(rss_{tag} / n)"
        out += [f"{ll} + 2 * {k} AS aic_{tag}", f"{ll} + ln(n) * {k} AS bic_{tag}", f"{ll} + 2 * ln(ln(n)) * {k} AS hqic_{tag}"]
    return agg.selectExpr(*keys, "n", "rss_base", "rss_full", *out, "coef", "coef / sqrt(rss_full / (n - 3) * inv_xx) AS t_stat")


def order_grid(df: DataFrame, y: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """AIC of one, two and three autoregressive terms on the same rows; the lowest is marked best (ties: fewest terms)."""
    o = series(keys, time)
    d = differenced(df, y, (), keys, time).withColumn("w3", F.expr(f"lag(w, 3) OVER {o}"))
    terms = ["w1", "w2", "w3"]
    agg = d.groupBy(*keys).agg(*[F.expr(v).alias(k) for k, v in _gram_aggs(terms, "g").items()]).where("_g__n > 5")
    rows = ", ".join(f"{p}, _g__n * ln({_rss(terms[:p], 'g')} / _g__n) + 2 * {p}" for p in (1, 2, 3))
    long = agg.selectExpr(*keys, "_g__n AS n", f"stack(3, {rows}) AS (ar_order, aic)")
    best = f"min(struct(aic, ar_order)) OVER (PARTITION BY {', '.join(keys)})"
    return long.selectExpr(*keys, "n", "ar_order", "aic", f"{best}.ar_order = ar_order AS best")


def forecast_yoy(df: DataFrame, y: str, preds: Sequence[str], keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """``yoy_{p}``: the forecast as a yearly percent change against the actual of twelve months before."""
    base = f"lag({y}, 12) OVER {series(keys, time)}"
    return df.withColumns({f"yoy_{p}": F.expr(f"(try_divide(pred_{p}, {base}) - 1D) * 100D") for p in preds})
