"""Running totals and exact quantiles over values of any number, without one big sort task.

A window ordered by value over a whole scope would put that scope into one task.
Here the distinct values with their measures are partitioned by range of (scope, value), whose limits
come from a sample of the values themselves, so a crowded or heavy-tailed distribution is
spread like any other. A reliable checkpoint fixes which value is in which range; the totals
per range, at most one row per range and scope, are summed up first and the fine running
totals are taken inside the ranges. No row is joined or grouped by its scope alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwatch.session import cut_lineage


def running_totals(df: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], descending: bool = True, bounded: bool = False) -> DataFrame:
    """Add ``cum_{m}`` (total over rows at or beyond this value) and ``total_{m}`` per measure.

    ``df`` holds one row per ``(keys, value)``. ``bounded`` is for scopes whose number of
    distinct values has a fixed limit (the months of a panel): a plain window.
    """
    order = F.col(value).desc() if descending else F.col(value).asc()
    keys = list(keys)
    if bounded:
        w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*keys)
        return df.withColumns({
            **{f"cum_{m}": F.sum(m).over(w) for m in measures}, **{f"total_{m}": F.sum(m).over(whole) for m in measures}})

    # the values once, then in ranges: sampling the limits must not aggregate the rows again
    ranged = cut_lineage(cut_lineage(df).repartitionByRange(*keys, order)).withColumn("_range", F.spark_partition_id())
    totals = ranged.groupBy("_range", *keys).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    earlier = _window(keys, F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_range", *keys, *[F.coalesce(F.sum(f"_t_{m}").over(earlier), F.lit(0)).alias(f"_b_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(Window.partitionBy(*keys)).alias(f"total_{m}") for m in measures])
    fine = _window(["_range", *keys], order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(totals, ["_range", *keys]).withColumns({f"cum_{m}": F.sum(m).over(fine) + F.col(f"_b_{m}") for m in measures})
    return out.select(*df.columns, *[f"cum_{m}" for m in measures], *[f"total_{m}" for m in measures])


def _window(keys: Sequence[str], order: Column):
    return Window.partitionBy(*keys).orderBy(order)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles, one column ``q{100p}`` per probability, for groups of any size.

    Rows are counted per distinct value (``weight``: they already are, with this count), and the values at the
    wanted ranks are read off the running counts. No group is sorted or collected; the result is exact.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), *([F.col(weight).alias("_w")] if weight else []))
    counts = rows.groupBy(*keys, "_v").agg((F.sum("_w") if weight else F.count(F.lit(1))).alias("_n"))
    run = running_totals(counts, keys, "_v", ["_n"], descending=False)
    ranks = [f"{fn}((total__n - 1) * {float(p)}D) + 1" for p in probs for fn in ("floor", "ceil")]
    picks = [F.expr(f"max(CASE WHEN ({r}) BETWEEN cum__n - _n + 1 AND cum__n THEN _v END)").alias(f"_r{i}") for i, r in enumerate(ranks)]
    found = run.groupBy(*keys).agg(*picks, F.max("total__n").alias("_total"))
    share = lambda p: f"((_total - 1) * {float(p)}D - floor((_total - 1) * {float(p)}D))"
    return found.selectExpr(*keys, *[f"_r{2 * i} + (_r{2 * i + 1} - _r{2 * i}) * {share(p)} AS {quantile_name(p)}" for i, p in enumerate(probs)])


def quantile_name(p: float) -> str:
    return f"q{p * 100:g}".replace(".", "_")
