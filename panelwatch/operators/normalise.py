"""Scaling of panel columns: full-sample or fitted on the training part only.

The statistics are aggregates per series over a calendar-bounded partition, so they are
taken as windows on the partitioning that the other panel operators use; no join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwatch.operators.panel import KEYS, TIME


def _whole(keys: Sequence[str]) -> str:
    return f"(PARTITION BY {', '.join(keys)})"


def minmax(value: str, keys: Sequence[str] = KEYS) -> Column:
    """(x - min) / (max - min); a constant series is 0.0 throughout, null rows included."""
    lo, hi = f"min({value}) OVER {_whole(keys)}", f"max({value}) OVER {_whole(keys)}"
    return F.expr(f"CASE WHEN {lo} = {hi} THEN 0D ELSE ({value} - {lo}) / ({hi} - {lo}) END")


def minmax_train(value: str, in_train: str, keys: Sequence[str] = KEYS, clip: bool = True) -> Column:
    """Min-max fitted on training rows; no or constant training values give 0.0."""
    fitted = f"CASE WHEN {in_train} THEN {value} END"
    lo, hi = f"min({fitted}) OVER {_whole(keys)}", f"max({fitted}) OVER {_whole(keys)}"
    scaled = f"({value} - {lo}) / ({hi} - {lo})"
    scaled = f"greatest(0D, least(1D, {scaled}))" if clip else scaled
    return F.expr(f"CASE WHEN {lo} IS NULL OR {lo} = {hi} THEN 0D WHEN {value} IS NOT NULL THEN {scaled} END")


def zscore_train(value: str, in_train: str, keys: Sequence[str] = KEYS) -> Column:
    """Standardise with mean and population deviation of the training rows (0 deviation counts as 1)."""
    fitted = f"CASE WHEN {in_train} THEN {value} END"
    mean, dev = f"avg({fitted}) OVER {_whole(keys)}", f"stddev_pop({fitted}) OVER {_whole(keys)}"
    return F.expr(f"({value} - {mean}) / CASE WHEN {dev} = 0 THEN 1D ELSE {dev} END")


def robust_train(df: DataFrame, value: str, in_train: str, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(x - median) / interquartile range, both of the training rows; a zero range gives null."""
    q = df.where(in_train).groupBy(*keys).agg(F.expr(f"percentile({value}, array(0.25D, 0.5D, 0.75D))").alias("_q"))
    joined = df.join(q, list(keys), "left")
    return joined.withColumn(out, F.expr(f"try_divide({value} - _q[1], _q[2] - _q[0])")).drop("_q")


def train_rows(train_end: str, time: str = TIME) -> str:
    """Condition of the training rows, as SQL text."""
    return f"{time} <= DATE '{train_end}'"
