"""Composite indices: thematic sub-indices, equal, sparse-regression and principal-component weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwatch.config import TREND_THEMES
from panelwatch.functions import linear
from panelwatch.functions.columns import add_all, row_mean
from panelwatch.operators.normalise import minmax
from panelwatch.operators.panel import KEYS, TIME, densify, fill_gaps, forward_fill, over

FOLDS = 5
MIN_ROWS = 12


def theme_subindices(df: DataFrame, themes: Mapping[str, Sequence[str]] = TREND_THEMES, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Per theme the mean of its available keywords, scaled 0-1 per series; their mean as composite.

    ``df`` is long ``(keys, time, keyword, value)``. A theme without any keyword stays null.
    ``n_keywords_used`` adds up, per series, the keywords found of each theme: one in two themes counts twice.
    """
    cols = {t: F.avg(F.when(F.col("keyword").isin(*ws), F.col("value"))).alias(t) for t, ws in themes.items()}
    seen = {f"_n{i}_{j}": F.max((F.col("keyword") == w).cast("int")).alias(f"_n{i}_{j}") for i, ws in enumerate(themes.values()) for j, w in enumerate(ws)}
    wide = densify(df.groupBy(*keys, time).agg(*cols.values(), *seen.values()), [*themes, *seen], keys, time)
    whole = f"(PARTITION BY {', '.join(keys)})"
    used = F.expr(" + ".join(f"coalesce(max({c}) OVER {whole}, 0)" for c in seen)).cast("bigint").alias("n_keywords_used")
    out = wide.select(*keys, time, *[minmax(t, keys).alias(t) for t in themes], used)
    return out.withColumn("trends_composite", row_mean(list(themes)))


def feature_names(columns: Sequence[str]) -> list[str]:
    """Sub-index columns by name: the trends ones but not the composite or the counter."""
    return [c for c in columns if c.startswith("trends_") and c != "trends_composite" and "n_keywords" not in c]


def yoy_names(columns: Sequence[str], target: Sequence[str] = ("inflation_yoy", "inflation_mom")) -> list[str]:
    return [c for c in columns if "yoy" in c and c not in target]


def available_features(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """Candidates that exist and are not all null, with their non-null counts; one aggregate pass."""
    present = [c for c in candidates if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in present])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_nonnull")) for c in present])
    return counts.select(F.explode(rows).alias("p")).select("p.*").where(F.col("n_nonnull") > 0)


def equal_index(df: DataFrame, features: Sequence[str], out: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Mean of the gap-filled features, scaled 0-1."""
    filled = df.withColumns({f"_g_{f}": fill_gaps(f, keys, time) for f in features})
    raw = filled.select(*df.columns, row_mean([f"_g_{f}" for f in features]).alias("_raw"))
    return raw.select(*df.columns, minmax("_raw", keys).alias(out))


def hybrid_features(df: DataFrame, behavioural: str, macro: Sequence[str], keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """``h_{c}``: the behavioural index and each forward-filled, 0-1 scaled macro change, gaps filled."""
    df = df.withColumns({f"_f_{c}": forward_fill(c, keys, time) for c in macro})
    df = df.withColumns({f"_f_{c}": minmax(f"_f_{c}", keys) for c in macro})
    filled = {f"h_{c}": fill_gaps(f"_f_{c}", keys, time) for c in macro}
    filled[f"h_{behavioural}"] = fill_gaps(behavioural, keys, time)
    return df.withColumns(filled).drop(*[f"_f_{c}" for c in macro])


# ---- one distributed pass to Gram sums, then a tiny solve per series ----


def gram_by_fold(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = KEYS, time: str = TIME, folds: int = FOLDS) -> DataFrame:
    """Sums of products per series and contiguous fold over the complete rows.

    Fold sizes are as equal as possible, the first folds one row longer. Columns:
    ``n``, ``s_i`` (sums), ``g_i_j`` (products, i <= j) over features and, last, the target.
    """
    cols = [*features, target]
    complete = df.where(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)))
    pos = F.row_number().over(over(keys, time)) - 1
    total = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    complete = complete.withColumns({"_pos": pos, "_n": total})
    size, rest = F.floor(F.col("_n") / folds), F.col("_n") % folds
    edge = rest * (size + 1)
    fold = F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (size + 1))).otherwise(
        rest + F.floor(F.try_divide((F.col("_pos") - edge).cast("double"), size.cast("double"))))
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)]
    prods = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return complete.withColumn("fold", fold.cast("int")).groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("n"), *sums, *prods)


def _totals(gram: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """One row per series: sums over all folds (``n, s, g``; g as full rows), the folds as ``parts``, and means and deviations of the features."""
    at = lambda i, j: f"g_{min(i, j)}_{max(i, j)}"
    s = f"array({', '.join(f's_{i}' for i in range(k + 1))})"
    g = linear.matrix([[at(i, j) for j in range(k + 1)] for i in range(k + 1)])
    one = gram.selectExpr(*keys, f"named_struct('n', double(n), 's', {s}, 'g', {g}) AS p")
    total = lambda of: f"double(sum({of}))"
    sums = f"array({', '.join(total(f'p.s[{i}]') for i in range(k + 1))})"
    prods = linear.matrix([[total(f"p.g[{i}][{j}]") for j in range(k + 1)] for i in range(k + 1)])
    return one.groupBy(*keys).agg(F.expr(total("p.n")).alias("n"), F.expr(sums).alias("s"), F.expr(prods).alias("g"), F.collect_list("p").alias("parts"))


def _scale(k: int, standardise: bool) -> list[str]:
    """Means and deviations of the features over all rows (a constant feature has deviation 1)."""
    if not standardise:
        return [f"array_repeat(0D, {k}) AS mean", f"array_repeat(1D, {k}) AS dev"]
    dev = "transform(sequence(0, {k}), i -> CASE WHEN sqrt(greatest(g[i][i] / n - s[i] / n * s[i] / n, 0D)) < 1e-12D THEN 1D ELSE sqrt(greatest(g[i][i] / n - s[i] / n * s[i] / n, 0D)) END)".replace("{k}", str(k - 1))
    return [f"transform(slice(s, 1, {k}), x -> x / n) AS mean", f"{dev} AS dev"]


def _centred(k: int, n: str, s: str, g: str) -> str:
    """Products of the deviations from the means, features scaled by ``dev``, the target last."""
    unit = [f"dev[{i}]" for i in range(k)] + ["1D"]
    return linear.matrix([[f"({g}[{i}][{j}] - {s}[{i}] * {s}[{j}] / {n}) / ({unit[i]} * {unit[j]})" for j in range(k + 1)] for i in range(k + 1)])


def lasso_weights(gram: DataFrame, k: int, keys: Sequence[str], standardise: bool = True, n_alphas: int = 100, eps: float = 1e-3) -> DataFrame:
    """Cross-validated positive lasso, exact: ``keys, n, mean, dev, coef`` (null where nothing can be fitted).

    For every set of active features the coefficients are linear in the penalty, so its optimality conditions (active
    ones positive, the others' gradients below the penalty) hold on one interval. All 2^k sets of a fold are solved once and
    each penalty of the grid reads its coefficients off the set that holds it; nothing iterates. At most twelve features.
    """
    if k > 12:
        raise ValueError("2^k sets of features are solved: at most 12 features")
    t = _totals(gram, k, keys).selectExpr("*", *_scale(k, standardise))
    t = t.selectExpr("*", f"{_centred(k, 'n', 's', 'g')} AS c")
    t = t.selectExpr("*", f"array_max(transform(slice(c[{k}], 1, {k}), x -> abs(x))) / n AS top").where(f"n >= {MIN_ROWS} AND top > 0")
    # the rows left after a fold is taken out, and all rows (no held-out fold)
    folds = t.selectExpr(*keys, "n", "s", "g", "mean", "dev", "top", "explode(concat(parts, array(CAST(null AS struct<n: double, s: array<double>, g: array<array<double>>>)))) AS h")
    less = "zip_with({0}, coalesce(h.{0}, transform({0}, x -> 0D)), (x, y) -> x - y)"
    rest = "transform(g, (r, i) -> zip_with(r, coalesce(h.g[i], transform(r, x -> 0D)), (x, y) -> x - y))"
    folds = folds.selectExpr(*keys, "n", "mean", "dev", "top", "h", "n - coalesce(h.n, 0D) AS tn", f"{less.format('s')} AS ts", f"{rest} AS tg").where("tn > 0")
    m = [f"ts[{i}] / tn" for i in range(k + 1)]
    unit = [f"dev[{i}]" for i in range(k)] + ["1D"]
    held = linear.matrix([[f"(h.g[{i}][{j}] - {m[i]} * h.s[{j}] - {m[j]} * h.s[{i}] + h.n * {m[i]} * {m[j]}) / ({unit[i]} * {unit[j]})" for j in range(k + 1)] for i in range(k + 1)])
    folds = folds.selectExpr(*keys, "n", "mean", "dev", "top", "h.n AS hn", "tn", f"{_centred(k, 'tn', 'ts', 'tg')} AS c", f"CASE WHEN h IS NOT NULL THEN {held} END AS e")
    sets = folds.selectExpr("*", f"explode(sequence(0, {2**k - 1})) AS mask")
    on = [f"(mask & {1 << i}) <> 0" for i in range(k)]
    rows = [[*(f"CASE WHEN {on[i]} AND {on[j]} THEN c[{i}][{j}] ELSE {'1D' if i == j else '0D'} END" for j in range(k)),
             f"CASE WHEN {on[i]} THEN c[{i}][{k}] ELSE 0D END", f"CASE WHEN {on[i]} THEN 1D ELSE 0D END"] for i in range(k)]
    sets = sets.selectExpr("*", f"{linear.matrix(rows)} AS m").selectExpr("*", f"{linear.solve('m', k, 2)} AS b").where("b IS NOT NULL AND NOT exists(b[0], x -> x IS NULL)")
    # conditions p - l q >= 0 on the penalty l: of active features the coefficients, of others the slack of the gradients
    slack = lambda i, side: f"({'c[' + str(i) + '][' + str(k) + ']' if side == 0 else '1D'} - ({' + '.join(f'c[{i}][{j}] * b[{side}][{j}]' for j in range(k))}))"
    cond = ", ".join(f"CASE WHEN {on[i]} THEN named_struct('p', b[0][{i}], 'q', b[1][{i}]) ELSE named_struct('p', -{slack(i, 0)}, 'q', -{slack(i, 1)}) END" for i in range(k))
    sets = sets.selectExpr(*keys, "n", "mean", "dev", "top", "hn", "tn", "e", "mask", "b", f"array({cond}) AS cond")
    sets = sets.selectExpr(*keys, "n", "mean", "dev", "top", "hn", "tn", "e", "mask", "b",
                           "coalesce(array_max(transform(filter(cond, x -> x.q < 0), x -> x.p / x.q)), 0D) AS low", "array_min(transform(filter(cond, x -> x.q > 0), x -> x.p / x.q)) AS high",
                           "exists(cond, x -> x.q = 0 AND x.p < 0) AS never")
    near = 1e-9
    grid = sets.where("NOT never").selectExpr("*", f"explode(sequence(0, {n_alphas - 1})) AS a").selectExpr("*", f"tn * top * power({eps}D, a / {n_alphas - 1}D) AS l")
    grid = grid.where(f"l >= low * (1D - {near}D) AND (high IS NULL OR l <= high * (1D + {near}D))")
    grid = grid.selectExpr(*keys, "n", "mean", "dev", "hn", "e", "mask", "a", "zip_with(b[0], b[1], (u, v) -> greatest(u - l * v, 0D)) AS coef")
    cross = " + ".join(f"coef[{i}] * coef[{j}] * e[{i}][{j}]" for i in range(k) for j in range(k))
    sse = f"e[{k}][{k}] - 2D * ({' + '.join(f'coef[{j}] * e[{j}][{k}]' for j in range(k))}) + {cross}"
    picked = grid.groupBy(*keys, "a", "hn", "e").agg(F.expr("min_by(struct(n, mean, dev, coef), mask)").alias("x"))
    scored = picked.selectExpr(*keys, "a", "hn", "x.*", "e").selectExpr(*keys, "a", "n", "mean", "dev", "coef", f"CASE WHEN hn IS NOT NULL THEN ({sse}) / hn END AS err", "hn IS NULL AS whole")
    by_alpha = scored.groupBy(*keys, "a").agg(F.sum("err").alias("err"), F.expr("max(CASE WHEN whole THEN struct(coef, n, mean, dev) END)").alias("x"))
    best = by_alpha.where("err IS NOT NULL AND x IS NOT NULL").groupBy(*keys).agg(F.expr("min(struct(err, a, x))").alias("m"))
    return best.selectExpr(*keys, "m.x.n", "m.x.mean", "m.x.dev", "m.x.coef")


def pca_weights(gram: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """First principal axis of the standardised features, its largest loading positive: ``keys, n, mean, dev, coef``."""
    t = _totals(gram, k, keys).where(f"n >= {MIN_ROWS}").selectExpr("*", *_scale(k, True))
    t = t.selectExpr(*keys, "n", "mean", "dev", f"transform(slice({_centred(k, 'n', 's', 'g')}, 1, {k}), r -> slice(r, 1, {k})) AS c")
    return t.selectExpr(*keys, "n", "mean", "dev", f"{linear.principal_axis('c', k)} AS coef")


def fit_weights(gram: DataFrame, features: Sequence[str], method: str, keys: Sequence[str] = KEYS, standardise: bool = True) -> DataFrame:
    """Per series: coefficients, fitted means and deviations, normalised weights.

    The input is the Gram table (five short rows per series), never the observations.
    Too few rows or all-zero coefficients give equal weights (``method`` = equal).
    """
    k = len(features)
    fits = lasso_weights(gram, k, keys, standardise) if method == "lasso" else pca_weights(gram, k, keys)
    every = gram.groupBy(*keys).agg(F.sum("n").cast("double").alias("n_train"))
    d = every.join(fits, list(keys), "left").withColumn("_total", F.expr("aggregate(coef, 0D, (t, x) -> t + abs(x))"))
    found = "_total > 0"
    weight = "coef" if method == "pca" else "transform(coef, x -> abs(x) / _total)"
    return d.selectExpr(
        *keys, f"CASE WHEN {found} THEN '{method}' ELSE 'equal' END AS method", "n_train", f"CASE WHEN {found} THEN coef ELSE array_repeat(1D, {k}) END AS coef",
        f"coalesce(mean, array_repeat(0D, {k})) AS mean", f"coalesce(dev, array_repeat(1D, {k})) AS dev", f"CASE WHEN {found} THEN {weight} ELSE array_repeat(1D / {k}, {k}) END AS weight")


def weighted_index(df: DataFrame, fits: DataFrame, features: Sequence[str], out: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Apply fitted coefficients to all rows and scale 0-1; equal weights use the plain mean."""
    joined = df.join(fits.select(*keys, "method", "coef", "mean", "dev"), list(keys), "left")
    z = [(F.coalesce(F.col(f), F.lit(0.0)) - F.col("mean")[i]) / F.col("dev")[i] * F.col("coef")[i] for i, f in enumerate(features)]
    raw = F.when(F.col("method") == "equal", row_mean(features)).otherwise(add_all(z))
    return joined.withColumn("_raw", raw).withColumn(out, minmax("_raw", keys)).drop("_raw", "coef", "mean", "dev")


def weights_report(fits: DataFrame, features: Sequence[str], train_end: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Long table (feature, weight, method, train end), largest weight first."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("weight")[i].alias("weight")) for i, f in enumerate(features)])
    return fits.select(*keys, "method", F.explode(rows).alias("p")).select(
        *keys, "p.feature", "p.weight", "method", F.lit(train_end).alias("train_end")).orderBy(*keys, F.col("weight").desc(), "feature")


def blend(a: Column, b: Column, share: float | Column = 0.7) -> Column:
    """share * a + (1 - share) * b."""
    s = F.lit(share) if isinstance(share, float) else share
    return s * a + (F.lit(1.0) - s) * b
