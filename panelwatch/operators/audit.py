"""Leakage and completeness checks of the gold table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelwatch.operators.panel import KEYS, TIME

# Columns never allowed, columns not to be used undelayed, shifted targets.
FORBIDDEN = ["ipc_change"]
CONTEMPORANEOUS = ["ipc_level", "inflation_yoy", "inflation_mom", "inflation_regime"]
NEED_LAG = ["ipc_level", "inflation_yoy"]
SHIFTED_TARGETS = {"target_inflation_yoy_t1": "inflation_yoy", "target_ipc_level_t1": "ipc_level"}


def leakage_violations(gold: DataFrame, keys: Sequence[str] = KEYS, time: str = TIME, targets: Mapping[str, str] = SHIFTED_TARGETS) -> DataFrame:
    """Violations as rows (key, check, column, severity); the data pass is one aggregate per series."""
    cols = gold.columns
    schema_rows = (
        [(c, "forbidden_column", "error") for c in FORBIDDEN if c in cols]
        + [(c, "contemporaneous_column", "warning") for c in CONTEMPORANEOUS if c in cols]
        + [(c, "missing_lag1", "warning") for c in NEED_LAG if c in cols and f"{c}_lag1" not in cols]
    )
    checked = [t for t, s in targets.items() if t in cols and s in cols]
    frames = []
    if checked:
        last = gold.groupBy(*keys).agg(*[F.max_by(t, time).alias(t) for t in checked])
        pairs = ", ".join(f"'{t}', {t} IS NOT NULL" for t in checked)
        shifted = last.selectExpr(*keys, f"stack({len(checked)}, {pairs}) AS (column, _bad)").where("_bad")
        frames.append(shifted.select(*keys, F.lit("unshifted_target").alias("check"), "column", F.lit("error").alias("severity")))
    if schema_rows:
        found = gold.sparkSession.createDataFrame(schema_rows, "column string, check string, severity string")
        nulls = [F.lit(None).cast(t).alias(c) for c, t in gold.select(*keys).dtypes]
        frames.append(found.select(*nulls, "check", "column", "severity"))
    return reduce(DataFrame.unionByName, frames)


def require_no_leakage(gold: DataFrame) -> None:
    """Raise when the gold table has an error-level violation."""
    bad = leakage_violations(gold).where(F.col("severity") == "error").limit(5).collect()
    if bad:
        raise ValueError(f"as-of violations: {bad}")


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null count and share per column with a flag below 80 % and below 30 %; one aggregate row unpivoted."""
    cols = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_nonnull")) for i, c in enumerate(cols)])
    out = counts.select("_rows", F.explode(rows).alias("p")).select("p.*", (F.col("p.n_nonnull") * F.lit(100.0) / F.col("_rows")).alias("pct"))
    return out.withColumn("flag", F.when(F.col("pct") > 80, "").when(F.col("pct") > 30, "[!!]").otherwise("[X]"))
