"""Choosing signals: lagged correlations, best lag, clusters and representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwatch.config import MIN_KEYWORD_CORR
from panelwatch.operators.panel import KEYS, TIME, align_calendar, over


def t_of_r(r: Column, n: Column) -> Column:
    """t statistic of a Pearson correlation, null at |r| = 1."""
    return r * F.sqrt(F.try_divide((n - 2).cast("double"), F.lit(1.0) - r * r))


def _pairs(df: DataFrame, x: Column, y: Column, by: Sequence[str], min_pairs: int) -> DataFrame:
    both = x.isNotNull() & y.isNotNull()
    agg = df.groupBy(*by).agg(F.count_if(both).alias("n"), F.corr(F.when(both, x), F.when(both, y)).alias("r"))
    return agg.where(F.col("n") >= min_pairs).withColumn("t", t_of_r(F.col("r"), F.col("n")))


def lead_correlations(df: DataFrame, x: str, y: str, lags: Sequence[int], min_pairs: int, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """corr(x_t, y_{t+lag}) per series and lag: n, r, t.

    All leads come from one window pass; the lags then become rows and one aggregate
    (with map-side combine) gives every correlation.
    """
    w = over(keys, time)
    wide = df.select(*keys, time, F.col(x).alias("_x"), *[F.lead(y, k).over(w).alias(f"_y{k}") for k in lags])
    long = wide.select(*keys, "_x", F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"_y{k}").alias("_y")) for k in lags])).alias("p")).select(*keys, "_x", "p.lag", "p._y")
    return _pairs(long, F.col("_x"), F.col("_y"), [*keys, "lag"], min_pairs)


def lag_correlations(df: DataFrame, x: str, y: str, lags: Sequence[int], min_pairs: int, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """corr(x_{t-lag}, y_t) per series and lag: n, r, t."""
    w = over(keys, time)
    wide = df.select(*keys, time, F.col(y).alias("_y"), *[F.lag(x, k).over(w).alias(f"_x{k}") for k in lags])
    long = wide.select(*keys, "_y", F.explode(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"_x{k}").alias("_x")) for k in lags])).alias("p")).select(*keys, "_y", "p.lag", "p._x")
    return _pairs(long, F.col("_x"), F.col("_y"), [*keys, "lag"], min_pairs)


def best_lag(corrs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest |r| per key; of equal ones the smallest lag."""
    pick = F.max(F.struct(F.abs("r").alias("a"), (-F.col("lag")).alias("l"), F.col("r").alias("r"), F.col("n").alias("n")))
    return corrs.where(F.col("r").isNotNull()).groupBy(*keys).agg(pick.alias("p")).select(
        *keys, (-F.col("p.l")).cast("int").alias("best_lag"), F.col("p.r").alias("best_r"), F.col("p.n").alias("n"))


def score_keywords(panel: DataFrame, keys: Sequence[str], value: str, target: str, resid: str, target_resid: str,
                   max_lag: int = 2, min_obs: int = 24, min_pairs: int = 20, threshold: float = MIN_KEYWORD_CORR) -> DataFrame:
    """Per keyword: best lagged correlation of the residuals, raw correlation, bias, keep flag.

    ``best_r`` is 0 at lag 0 when no lag has enough pairs; keywords with fewer than
    ``min_obs`` values are left out.
    """
    scans = best_lag(lead_correlations(panel, resid, target_resid, range(max_lag + 1), min_pairs, keys), keys)
    raw = panel.groupBy(*keys).agg(F.count(value).alias("_obs"), F.corr(value, target).alias("raw_r")).where(F.col("_obs") >= min_obs)
    joined = raw.join(scans.drop("n"), list(keys), "left").withColumns({
        "best_lag": F.coalesce("best_lag", F.lit(0)), "best_r": F.coalesce("best_r", F.lit(0.0))})
    return joined.select(
        *keys, "best_lag", "best_r", "raw_r", (F.abs("raw_r") - F.abs("best_r")).alias("bias"),
        (F.abs("best_r") >= threshold).alias("keep"))


def keyword_vectors(panel: DataFrame, keys: Sequence[str], value: str, time: str = TIME) -> DataFrame:
    """One dense vector per keyword: its months, standardised per month over the keywords.

    The month axis is the calendar between the first and last month (two dates come to
    the driver), so the vector length is bounded; missing months count as 0.
    """
    from pyspark.ml.functions import array_to_vector

    span = panel.agg(F.min(time), F.max(time)).first()
    aligned = align_calendar(panel, [value], str(span[0]), str(span[1]), keys, time)
    filled = aligned.select(*keys, time, F.coalesce(F.col(value), F.lit(0.0)).alias("_v"))
    by_month = Window.partitionBy(time)
    dev = F.stddev_pop("_v").over(by_month)
    z = (F.col("_v") - F.avg("_v").over(by_month)) / F.when(dev == 0, F.lit(1.0)).otherwise(dev)
    scaled = filled.select(*keys, time, z.alias("_z"))
    arrays = scaled.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(time, "_z"))).alias("_a"))
    return arrays.select(*keys, array_to_vector(F.transform("_a", lambda s: s["_z"])).alias("features"))


def cluster(vectors: DataFrame, n_valid: int, k: int = 7, seed: int = 42, features: str = "features") -> DataFrame:
    """K-Means cluster per row; with fewer rows than ``k``, max(2, rows) clusters, never more than there are different vectors.

    Rows are assigned one by one: the solver by blocks fails on fewer starting centres than clusters, so on a single row.
    The few draws of the start can miss near copies; then it is drawn once more with a draw for each cluster.
    """
    from pyspark.ml.clustering import KMeans

    n = k if n_valid >= k else max(2, n_valid)
    means = KMeans(k=n, seed=seed, featuresCol=features, predictionCol="cluster", solver="row")
    model = means.fit(vectors)
    if len(model.clusterCenters()) < n:
        model = means.setInitSteps(n).fit(vectors)
    return model.transform(vectors)


def representatives(clustered: DataFrame, order_abs: str, name: Sequence[str]) -> DataFrame:
    """The row of largest |score| in each cluster; equal ones by name."""
    rest = [c for c in clustered.columns if c not in ("features", "cluster")]
    pick = F.min(F.struct((-F.abs(order_abs)).alias("_o"), *name, *[c for c in rest if c not in name]))
    return clustered.groupBy("cluster").agg(pick.alias("p")).select("cluster", *[F.col(f"p.{c}").alias(c) for c in rest])


def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson r of every pair of columns as rows.

    Each unordered pair is one group of a single aggregate, combined before its shuffle, and given in both orders;
    a pair without variance or common rows has a null.
    """
    n = len(columns)
    wide = df.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias("_v"))
    pairs = wide.select(*keys, "_v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i")).select(*keys, "_v", "_i", F.explode(F.sequence("_i", F.lit(n - 1))).alias("_j"))
    pairs = pairs.select(*keys, "_i", "_j", F.get("_v", F.col("_i")).alias("_a"), F.get("_v", F.col("_j")).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    r = F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop(F.when(both, F.col("_a"))) * F.stddev_pop(F.when(both, F.col("_b"))))
    each = pairs.groupBy(*keys, "_i", "_j").agg(r.alias("r"))
    order = F.when(F.col("_i") == F.col("_j"), F.array(F.struct(F.col("_i").alias("a"), F.col("_j").alias("b")))).otherwise(
        F.array(F.struct(F.col("_i").alias("a"), F.col("_j").alias("b")), F.struct(F.col("_j").alias("a"), F.col("_i").alias("b"))))
    names = F.array(*map(F.lit, columns))
    return each.select(*keys, "r", F.explode(order).alias("p")).select(*keys, F.get(names, F.col("p.a")).alias("column_1"), F.get(names, F.col("p.b")).alias("column_2"), "r")
