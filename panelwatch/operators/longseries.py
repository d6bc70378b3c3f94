"""Windows over series of any length: lags, last known values, running sums, and the as-of join made of them.

A plain window puts a whole series into one task. Here rows are partitioned by range of (keys, order), so one long series
spreads over many tasks; a reliable checkpoint fixes which row is in which range. Windows run inside the ranges, and what they
need from the ranges before comes from a table of one row per range and key: counts, sums and last values, prefixed
over the ranges. Lags get the few rows before a range handed over. Results equal the plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from panelwatch.session import cut_lineage

RANGE, START = "_range", "_start"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """``df`` in fixed ranges of (keys, order), with the number of its range. ``order`` must tell the rows of a key apart."""
    cols = [*keys, *order]
    fixed = cut_lineage(df)  # the limits are sampled from these rows, not from a second run of what made them
    dealt = fixed.repartitionByRange(pieces, *cols) if pieces else fixed.repartitionByRange(*cols)
    return cut_lineage(dealt).withColumn(RANGE, F.spark_partition_id())


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(RANGE, *keys).orderBy(*order)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def _with(rows: DataFrame, small: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join on columns of equal name, where a null key meets a null key, as in a window."""
    other = small.withColumnsRenamed({c: f"_j_{c}" for c in columns})
    same = [rows[c].eqNullSafe(other[f"_j_{c}"]) for c in columns]
    return rows.join(other, same).drop(*[f"_j_{c}" for c in columns])


def running_sum(ranged: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Add ``name``: the sum of ``column`` over all rows of the key up to this one."""
    sums = ranged.groupBy(RANGE, *keys).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in columns.items()])
    sums = sums.select(RANGE, *keys, *[F.sum(f"_s_{n}").over(_before(keys)).alias(f"_b_{n}") for n in columns])
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with(ranged, sums, [RANGE, *keys])
    totals = {n: F.when(F.sum(c).over(upto).isNull() & F.col(f"_b_{n}").isNull(), None).otherwise(F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0))) for n, c in columns.items()}
    return out.withColumns(totals).drop(*[f"_b_{n}" for n in columns])


def last_known(ranged: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Add ``name``: the last value of ``column`` that is not null, over all rows of the key up to this one."""
    at = F.struct(*order)
    ends = ranged.groupBy(RANGE, *keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_l_{n}") for n, c in columns.items()])
    ends = ends.select(RANGE, *keys, *[F.last(f"_l_{n}", True).over(_before(keys)).alias(f"_b_{n}") for n in columns])
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with(ranged, ends, [RANGE, *keys])
    return out.withColumns({n: F.coalesce(F.last(c, True).over(upto), F.col(f"_b_{n}")) for n, c in columns.items()}).drop(*[f"_b_{n}" for n in columns])


def lags(ranged: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Add ``name``: ``column`` of ``k`` rows before, for each ``name: (column, k)``.

    The last rows of a range are copied to every later range of the key that begins less than the largest lag after them, however short
    the ranges between are.
    """
    most = max(k for _, k in columns.values())
    sizes = ranged.groupBy(RANGE, *keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = cut_lineage(sizes.select(RANGE, *keys, F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias(START), "_n"))
    down = Window.partitionBy(RANGE, *keys).orderBy(*[F.col(c).desc() for c in order])
    tails = ranged.withColumn("_up", F.row_number().over(down)).where(F.col("_up") <= most)
    tails = _with(tails, starts, [RANGE, *keys])
    place = F.col(START) + F.col("_n") - F.col("_up")
    tails = tails.withColumn("_place", place).drop("_up", START, "_n").withColumnRenamed(RANGE, "_from")
    later = starts.select(RANGE, *keys, START)
    halo = _with(tails, later, list(keys)).where((F.col(RANGE) > F.col("_from")) & (F.col("_place") >= F.col(START) - most) & (F.col("_place") < F.col(START)))
    both = ranged.withColumn("_own", F.lit(True)).unionByName(halo.select(*ranged.columns).withColumn("_own", F.lit(False)))
    w = _inside(keys, order)
    return both.withColumns({n: F.lag(c, k).over(w) for n, (c, k) in columns.items()}).where("_own").drop("_own")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], tolerance: str | None = None, forward: bool = False, pieces: int | None = None) -> DataFrame:
    """Each row of ``left`` with the ``columns`` of the last row of ``right`` of its key at or before its ``time`` (``forward``: the first at or after).

    ``tolerance`` is an interval such as ``'1 day'``: rows farther away do not count. Of several right rows at one time the one of largest
    columns counts. Rows without a match stay, with nulls; so do left rows whose time or key is null. The matched time is ``matched_{time}``.
    """
    sign = -1 if forward else 1
    at = (F.unix_micros(F.col(time).cast("timestamp")) * sign).alias("_t")
    seen = F.struct(F.col(time).alias("_time"), *columns)
    rows = right.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.max(F.struct(*columns)).alias("_m")).select(*keys, time, "_m.*")
    a = left.select(*keys, at, F.lit(1).alias("_side"), F.monotonically_increasing_id().alias("_id"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(rows.select(seen.alias("s")).schema["s"].dataType).alias("_seen"))
    b = rows.select(*keys, at, F.lit(0).alias("_side"), F.lit(-1).cast("long").alias("_id"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), seen.alias("_seen"))
    order = ["_t", "_side", "_id"]
    found = last_known(in_ranges(a.unionByName(b), keys, order, pieces), keys, order, {"_hit": "_seen"}).where("_side = 1")
    known = [F.col(c).isNotNull() for c in (*keys, "_t")]
    hit = F.when(reduce(lambda a, b: a & b, known), F.col("_hit"))
    out = found.select("_row.*", hit.alias("_hit"))
    if tolerance:
        ends = F.expr(f"_hit._time {'-' if forward else '+'} INTERVAL {tolerance}")
        out = out.withColumn("_hit", F.when(ends <= F.col(time) if forward else ends >= F.col(time), F.col("_hit")))
    return out.select(*left.columns, F.col("_hit._time").alias(f"matched_{time}"), *[F.col(f"_hit.{c}").alias(c) for c in columns])


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int, fan: int = 16) -> DataFrame:
    """All pairs of a point and an interval of its key that holds it (both ends inclusive), by bins.

    ``at``, ``start`` and ``end`` are whole numbers. An interval is copied to the bins it touches, of the finest width that it touches at most ``fan + 1``
    of; a point to one bin of each width in use. Pairs meet on key and bin, are verified, and appear once. A crowded bin is split by the
    skew join. Empty and reversed intervals, and nulls, match nothing.
    """
    span = F.greatest(F.col(end) - F.col(start), F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log(float(fan), span / float(width)))).cast("int")
    wide = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    size = (F.lit(float(width)) * F.pow(F.lit(float(fan)), F.col("_level"))).cast("long")
    wide = wide.withColumn("_bin", F.explode(F.sequence(F.expr(f"floor({start} / double({width} * power({fan}, _level)))"), F.expr(f"floor({end} / double({width} * power({fan}, _level)))"))))
    used = [r[0] for r in wide.select("_level").distinct().orderBy("_level").collect()]  # a logarithm of the longest interval
    dealt = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in used]) if used else F.array().cast("array<int>")))
    dealt = dealt.withColumn("_bin", F.floor(F.col(at) / size.cast("double")))
    clash = [c for c in intervals.columns if c in points.columns and c not in keys]
    if clash:
        raise ValueError(f"columns of both sides: {clash}")
    met = dealt.join(wide, [*keys, "_level", "_bin"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).select(*points.columns, *[c for c in intervals.columns if c not in keys])
