"""Monthly press volumes from a folder that feed polls keep adding to.

Each poll lands a file; the stream reads new files only, drops articles already seen
within the watermark (polls overlap by weeks) and keeps one counter row per month as
state, the same counts as the batch aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwatch.functions import text as T
from panelwatch.operators.press import THEME_COUNTS

SCHEMA = "date TIMESTAMP, source STRING, title STRING, summary STRING, link STRING"


def read_landed(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def press_volume(articles: DataFrame, themes: Mapping[str, Sequence[str]], late: str = "90 days", counts: Mapping[str, str] = THEME_COUNTS) -> DataFrame:
    """Articles with a theme and articles per theme for each month; for update or complete mode."""
    text = F.concat_ws(" ", T.strip_tags("title"), T.strip_tags("summary"))
    fresh = articles.withWatermark("date", late).dropDuplicatesWithinWatermark(["source", "title", "link"])
    themed = fresh.withColumn("themes", T.theme_labels(text, themes)).where(F.size("themes") > 0)
    return themed.groupBy(F.trunc(F.col("date").cast("date"), "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("press_volume"), *[F.count_if(F.array_contains("themes", t)).alias(n) for n, t in counts.items()])
