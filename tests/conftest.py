import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelwatch.plans.stages import clear  # noqa: E402
from panelwatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear(s)
    s.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Rows (series, 'YYYY-MM', value) to a panel with month starts."""

    def make(rows, name="v", typ="double"):
        df = spark.createDataFrame([(s, f"{m}-01", None if v is None else (float(v) if typ == "double" else v)) for s, m, v in rows], f"series_id string, m string, {name} {typ}")
        return df.selectExpr("series_id", "date(m) AS month", name)

    return make


def months(start_year, n):
    return [f"{start_year + i // 12:04d}-{i % 12 + 1:02d}" for i in range(n)]
