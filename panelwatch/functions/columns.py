"""Scalar Column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from panelwatch.config import PUBLICATION_DELAY_DAYS, REGIME_THRESHOLD, EvalWindow


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c) -> Column:
    """First day of the month of a date or timestamp, as DATE."""
    return F.trunc(as_col(c).cast("date"), "MM")


def publication_date(month, delay: int = PUBLICATION_DELAY_DAYS) -> Column:
    """Month end plus the publication delay."""
    return F.date_add(F.last_day(month), delay)


def as_of_date(month) -> Column:
    return F.last_day(month)


def available_at(month) -> Column:
    """First day on which features of this month may be used."""
    return F.date_add(F.last_day(month), 1)


def regime_flag(value, threshold=REGIME_THRESHOLD) -> Column:
    """1.0 at or above the threshold, 0.0 below, null for null."""
    v, t = as_col(value), threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(v >= t, F.lit(1.0)).when(v < t, F.lit(0.0))


def in_range(month, start: str, end: str) -> Column:
    return as_col(month).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def in_months(stamp: str, start: str, end: str) -> Column:
    """Closed month range on a raw time stamp, as a comparison the file scan can use."""
    return F.expr(f"{stamp} >= TIMESTAMP_NTZ '{start} 00:00:00' AND {stamp} < CAST(add_months(DATE '{end}', 1) AS TIMESTAMP_NTZ)")


def declared_rank(c: str, order: Sequence[str]) -> Column:
    """Position of a label in its declared order, from 0; null for a label outside it."""
    return F.expr(f"CASE {c} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(order)) + " END")


def split_label(month, windows: Sequence[EvalWindow]) -> Column:
    """``train_X`` / ``test_X`` per window in window order, joined by ``|``; else ``unused``."""
    parts = [
        F.when(in_range(month, w.train_start, w.train_end), f"train_{w.label}").when(
            in_range(month, w.test_start, w.test_end), f"test_{w.label}"
        )
        for w in windows
    ]
    joined = F.concat_ws("|", *parts)
    return F.when(joined == "", "unused").otherwise(joined)


def index_band(value) -> Column:
    """Documented reading of a 0-1 index."""
    v = as_col(value)
    return F.when(v < 0.35, "normal").when(v < 0.65, "warning").when(v.isNotNull(), "high")


def add_all(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of several columns of one row, nulls left out; null if all are null."""
    total = " + ".join(f"coalesce({c}, 0D)" for c in cols)
    count = " + ".join(f"int({c} IS NOT NULL)" for c in cols)
    return F.expr(f"try_divide({total}, {count})")


def month_cycle(month) -> tuple[Column, Column]:
    """sin and cos of the position in the year."""
    angle = F.month(as_col(month)) * F.lit(2.0) * F.pi() / F.lit(12.0)
    return F.sin(angle), F.cos(angle)


def normal_cdf(x) -> Column:
    """Standard normal CDF through the Abramowitz-Stegun 7.1.26 polynomial (error at most 1.5e-7)."""
    v = as_col(x)
    z = F.abs(v) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * z)
    poly = F.lit(0.0)
    # Published coefficients of the approximation, highest power first.
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-z * z)
    return F.when(v >= 0, F.lit(0.5) * (F.lit(1.0) + erf)).otherwise(F.lit(0.5) * (F.lit(1.0) - erf))
