"""Operators on a panel ``(series key, period)``.

Every window is partitioned by the series key and ordered by the period, on data
already aggregated to one row per key and period, so a partition is bounded by the
length of the calendar and never by the number of raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwatch.functions.columns import as_col

KEYS = ["series_id"]
TIME = "month"


def over(keys: Sequence[str] = KEYS, time: str = TIME):
    return Window.partitionBy(*keys).orderBy(time)


def series(keys: Sequence[str] = KEYS, time: str = TIME, frame: str = "") -> str:
    """Text of the window of a series in period order, for SQL expressions."""
    return f"(PARTITION BY {', '.join(keys)} ORDER BY {time} {frame})"


BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def before(keys: Sequence[str] = KEYS, time: str = TIME):
    """All rows of the series strictly before the current one."""
    return over(keys, time).rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: Sequence[str] = KEYS, time: str = TIME):
    return over(keys, time).rowsBetween(Window.unboundedPreceding, 0)


def densify(df: DataFrame, values: Sequence[str], keys: Sequence[str] = KEYS, time: str = TIME, step: str = "1 month") -> DataFrame:
    """Insert the missing periods between the first and last one of each series.

    Each row is expanded up to the next observed period with ``lead``; no spine table
    and no join, and the hash partitioning by series serves all later windows.
    """
    nxt = df.selectExpr(*keys, time, *values, f"lead({time}, 1) OVER {series(keys, time)} AS _next")
    slots = f"explode(sequence({time}, coalesce(date(_next - interval {step}), {time}), interval {step})) AS _slot"
    out = nxt.selectExpr(*keys, f"{time} AS _seen", *values, slots)
    return out.selectExpr(*keys, f"_slot AS {time}", *[f"CASE WHEN _slot = _seen THEN {v} END AS {v}" for v in values])


def align_calendar(df: DataFrame, values: Sequence[str], start: str, end: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """One row per series and month of a fixed calendar; absent months are null rows."""
    months = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    spine = df.select(*keys).distinct().withColumn(time, F.explode(months))
    return spine.join(df.select(*keys, time, *values), [*keys, time], "left")


def pct_change(value: str, k: int, keys: Sequence[str] = KEYS, time: str = TIME) -> Column:
    """Percent change against k periods before; null in, null out, zero base gives null."""
    return F.expr(f"(try_divide({value}, lag({value}, {k}) OVER {series(keys, time)}) - 1D) * 100D")


def add_lags(df: DataFrame, lags: Mapping[str, Sequence[int]], keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """``{feature}_lag{k}`` for every listed feature that exists; one window for all."""
    w, have = series(keys, time), set(df.columns)
    return df.withColumns({
        f"{f}_lag{k}": F.expr(f"lag({f}, {k}) OVER {w}")
        for f, ks in lags.items()
        if f in have
        for k in ks
        if k > 0 and f"{f}_lag{k}" not in have
    })


def forward_fill(value: str, keys: Sequence[str] = KEYS, time: str = TIME) -> Column:
    return F.expr(f"last({value}, true) OVER {series(keys, time, UPTO)}")


def backward_fill(value: str, keys: Sequence[str] = KEYS, time: str = TIME) -> Column:
    """The next known value: a running last in descending order, so linear in the length of a series."""
    return F.expr(f"last({value}, true) OVER (PARTITION BY {', '.join(keys)} ORDER BY {time} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def fill_gaps(value: str, keys: Sequence[str] = KEYS, time: str = TIME) -> Column:
    """Forward fill, then what is left at the start is the first known value of the series."""
    whole = f"(PARTITION BY {', '.join(keys)} ORDER BY {time} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return F.expr(f"coalesce(last({value}, true) OVER {series(keys, time, UPTO)}, first({value}, true) OVER {whole})")


def interpolate_time(df: DataFrame, value: str, out: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Linear in days between observed points, flat after the last, null before the first."""
    at = f"CASE WHEN {value} IS NOT NULL THEN {time} END"
    df = df.withColumns({
        "_v0": forward_fill(value, keys, time), "_t0": forward_fill(at, keys, time),
        "_v1": backward_fill(value, keys, time), "_t1": backward_fill(at, keys, time),
    })
    share = F.try_divide(F.datediff(F.col(time), "_t0").cast("double"), F.datediff("_t1", "_t0").cast("double"))
    blended = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share
    filled = F.coalesce(F.col(value), F.when(F.col("_t1").isNull(), F.col("_v0")).otherwise(blended))
    return df.withColumn(out, filled).drop("_v0", "_t0", "_v1", "_t1")


def interpolate_limited(df: DataFrame, value: str, out: str, limit: int = 3, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Linear by position over at most ``limit`` successive gaps, the rest back filled."""
    df = df.withColumn("_i", F.row_number().over(over(keys, time)))
    at = f"CASE WHEN {value} IS NOT NULL THEN _i END"
    df = df.withColumns({
        "_v0": forward_fill(value, keys, time), "_i0": forward_fill(at, keys, time),
        "_v1": backward_fill(value, keys, time), "_i1": backward_fill(at, keys, time),
    })
    share = F.try_divide((F.col("_i") - F.col("_i0")).cast("double"), (F.col("_i1") - F.col("_i0")).cast("double"))
    blended = F.when(F.col("_i1").isNull(), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)
    near = F.when(F.col("_i") - F.col("_i0") <= limit, blended)
    return df.withColumn(out, F.coalesce(F.col(value), near, F.col("_v1"))).drop("_i", "_v0", "_i0", "_v1", "_i1")


def seasonal_diff(value, k: int = 12, keys: Sequence[str] = KEYS, time: str = TIME) -> Column:
    """Difference against k periods before, 0 where there is none."""
    v = as_col(value)
    return F.coalesce(v - F.lag(v, k).over(over(keys, time)), F.lit(0.0))


def decompose_classical(df: DataFrame, value: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Centred 2x12 moving-average trend, month-of-year means, residual.

    Adds ``trend``, ``seasonal`` and ``resid``; the trend is null in the first and last
    six months, so there the residual is null too.
    """
    w, v = over(keys, time), F.col(value)
    wide = w.rowsBetween(-6, 6)
    inner = F.sum(v).over(w.rowsBetween(-5, 5))
    ends = (F.lag(v, 6).over(w) + F.lead(v, 6).over(w)) * F.lit(0.5)
    df = df.withColumn("trend", F.when(F.count(v).over(wide) == 13, (inner + ends) / F.lit(12.0)))
    df = df.withColumn("_detrended", v - F.col("trend"))
    by_month = Window.partitionBy(*keys, F.month(time))
    df = df.withColumn("_month_mean", F.avg("_detrended").over(by_month))
    whole = Window.partitionBy(*keys)
    # mean of the twelve month means: each calendar month counts once
    first_of_month = F.row_number().over(Window.partitionBy(*keys, F.month(time)).orderBy(time)) == 1
    df = df.withColumn("_once", F.when(first_of_month, F.col("_month_mean")))
    df = df.withColumn("seasonal", F.col("_month_mean") - F.avg("_once").over(whole))
    df = df.withColumn("resid", v - F.col("trend") - F.col("seasonal"))
    return df.drop("_detrended", "_month_mean", "_once")


def expanding_stats(df: DataFrame, value: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Count, last, mean, min, max over the rows before each row."""
    b, v = before(keys, time), F.col(value)
    return df.withColumns({
        "n_train": F.count(v).over(b),
        "last_train": F.last(v, ignorenulls=True).over(b),
        "mean_train": F.avg(v).over(b),
        "min_train": F.min(v).over(b),
        "max_train": F.max(v).over(b),
    })


def lookback_windows(df: DataFrame, value: str, lengths: Sequence[int], keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Array of the previous L values per period, kept only when it is complete."""
    w = over(keys, time)
    wide = df.select(
        *keys, time, *[F.collect_list(value).over(w.rowsBetween(-n, -1)).alias(f"_w{n}") for n in lengths]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("lookback"), F.col(f"_w{n}").alias("values")) for n in lengths])
    return (
        wide.select(*keys, time, F.explode(pairs).alias("p"))
        .select(*keys, time, "p.lookback", "p.values")
        .where(F.size("values") == F.col("lookback"))
    )


def episodes(df: DataFrame, flag: str, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Closed runs of 1: start, last month, length. A run still open at the end is left out."""
    w = over(keys, time)
    df = df.where(F.col(flag).isNotNull())
    df = df.withColumn("_change", (F.col(flag) != F.lag(flag, 1).over(w)).cast("int"))
    df = df.withColumn("_run", F.sum(F.coalesce("_change", F.lit(0))).over(upto(keys, time)))
    df = df.withColumn("_after", F.lead(flag, 1).over(w))
    return (
        df.where(F.col(flag) == 1)
        .groupBy(*keys, "_run")
        .agg(
            F.min(time).alias("episode_start"),
            F.max(time).alias("episode_end"),
            F.count(F.lit(1)).alias("n_months"),
            F.max((F.col("_after") == 0).cast("int")).alias("_closed"),
        )
        .where(F.col("_closed") == 1)
        .drop("_run", "_closed")
    )


def anchor_batches(keywords: DataFrame, anchor: str, size: int = 4, keyword: str = "keyword", pos: str = "pos") -> DataFrame:
    """Groups of ``size`` keywords in order, the anchor first in every group.

    ``pos`` starts at 1; the anchor is not repeated inside a group that holds it already.
    """
    batched = keywords.select(F.floor((F.col(pos) - 1) / size).cast("int").alias("batch"), F.col(pos), F.col(keyword))
    anchors = batched.select("batch").distinct().select("batch", F.lit(0).cast(dict(batched.dtypes)[pos]).alias(pos), F.lit(anchor).alias(keyword))
    return batched.where(F.col(keyword) != anchor).unionByName(anchors).withColumn("is_anchor", F.col(keyword) == anchor)


def rescale_batches(df: DataFrame, keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """Bring later batches to the scale of the first one through their common anchor.

    Input ``(keys, time, batch, keyword, is_anchor, value)``. The ratio of the first
    batch's anchor to each batch's anchor (0 counts as missing) is filled forward, then
    back, and multiplies the batch; only the first batch keeps its anchor.
    """
    anchor = F.when(F.col("value") != 0, F.col("value"))
    per_batch = df.where("is_anchor").select(*keys, time, "batch", anchor.alias("_a"))
    first = F.first(F.when(F.col("batch") == 0, F.col("_a")), ignorenulls=True).over(Window.partitionBy(*keys, time))
    ratios = per_batch.withColumn("_ratio", F.try_divide(first, F.col("_a")))
    bk = [*keys, "batch"]
    ratios = ratios.select(*bk, time, fill_gaps("_ratio", bk, time).alias("_scale"))
    scaled = df.where(~F.col("is_anchor") | (F.col("batch") == 0)).join(ratios, [*bk, time], "left")
    scale = F.when(F.col("batch") == 0, F.lit(1.0)).otherwise(F.col("_scale"))
    return scaled.select(*keys, time, "batch", "keyword", (F.col("value") * scale).alias("value"))


def resample_mean(df: DataFrame, value: str, stamp: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean per calendar month, empty months between kept as null."""
    monthly = df.groupBy(*keys, F.trunc(F.col(stamp).cast("date"), "MM").alias(TIME)).agg(F.avg(value).alias(value))
    return densify(monthly, [value], keys)
