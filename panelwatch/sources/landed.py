"""Reading landed files: delimited series, article feeds; column resolution and safe casts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwatch.config import DATE_ALIASES, ECONOMIC_TERMS, VALUE_ALIASES
from panelwatch.functions.columns import month_start
from panelwatch.functions.text import clean_html, contains_any

SEPARATORS = (",", ";", "\t")
META_COLUMNS = ("pulled_at", "ingested_at", "source_file", "is_official", "isPartial")


def separator_of(line: str) -> str:
    """The first of comma, semicolon, tab that splits the line."""
    return next((s for s in SEPARATORS if len(line.split(s)) >= 2), SEPARATORS[-1])


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line``: the first line of every file, found by the executors; empty files have none."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    # lines of a split are read in order, so the smallest number of the first split is the file's first line
    numbered = lines.where("_block = 0").withColumn("_i", F.monotonically_increasing_id())
    return numbered.groupBy("file").agg(F.min_by("value", "_i").alias("line"))


def scan_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All delimited files below a path, each with the separator and the columns of its own header, as text columns.

    Files of one header are scanned together; a column that a file does not have is null in its rows. Names are stripped;
    columns come in the order in which headers, sorted, name them. A folder without lines gives no columns and no rows.
    """
    heads = first_lines(spark, path).groupBy("line").agg(F.collect_list("file").alias("files")).orderBy("line").collect()
    parts = []
    for r in heads:  # one scan for each different header, not for each file
        df = spark.read.csv(r["files"], header=True, sep=separator_of(r["line"]))
        parts.append(df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns]))
    if not parts:
        return spark.createDataFrame([], "struct<>")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def resolve_exact(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First column whose lower-cased name is an alias."""
    return next((c for c in columns if c.strip().lower() in aliases), None)


def resolve_contains(columns: Sequence[str], parts: Sequence[str], default: str | None = None) -> str | None:
    """First column whose lower-cased name contains one of the parts."""
    return next((c for c in columns if any(p in c.lower() for p in parts)), default)


def resolve_either_way(columns: Sequence[str], names: Mapping[str, str]) -> dict[str, str | None]:
    """Standard name to the first column containing, or contained in, the source name."""
    found = {}
    for source, target in names.items():
        s = source.lower()
        found[target] = next((c for c in columns if s in c.lower() or c.lower() in s), None)
    return found


def resolve_date_value(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``raw_date`` and ``raw_value`` by alias; the value falls back to the first column whose values are all numbers.

    Files are scanned as text, so the fallback counts, in one pass, the values of each column and those that read as numbers.
    """
    date = resolve_exact(df.columns, DATE_ALIASES)
    if date is None:
        raise ValueError(f"no date column among {df.columns}")
    value = resolve_exact(df.columns, VALUE_ALIASES)
    if value is None:
        rest = [c for c, t in df.dtypes if c != date and t not in ("date", "timestamp", "timestamp_ntz", "boolean")]
        sums = [F.count(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))).alias(f"n{i}") for i, c in enumerate(rest)]
        sums += [F.count(F.expr(f"try_cast(`{c}` AS double)")).alias(f"k{i}") for i, c in enumerate(rest)]
        n = df.agg(*sums).first() if rest else ()
        value = next((c for i, c in enumerate(rest) if 0 < n[f"n{i}"] == n[f"k{i}"]), None)
    if value is None:
        raise ValueError(f"no value column among {df.columns}")
    return df.select(F.col(f"`{date}`").alias("raw_date"), F.col(f"`{value}`").alias("raw_value"), *[F.col(f"`{c}`") for c in keep])


def resolve_many(df: DataFrame, names: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One double column per standard name; a name without a column is null."""
    found = resolve_either_way([c for c in df.columns if c not in keep], names)
    return df.select(
        *keep,
        *[
            (F.expr(f"try_cast(`{c}` AS double)") if c else F.lit(None).cast("double")).alias(target)
            for target, c in found.items()
        ]
    )


def safe_date(c: str, day_first: bool = True) -> Column:
    """Date from text in ISO or day-first (or month-first) form; null when unreadable."""
    slash = ["d/M/yyyy", "d-M-yyyy", "M/yyyy"] if day_first else ["M/d/yyyy", "M-d-yyyy", "M/yyyy"]
    forms = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM", *slash]
    return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(f)) for f in forms]).cast("date")


def safe_series(df: DataFrame, date: str = "raw_date", value: str = "raw_value", extra: Sequence[str] = ()) -> DataFrame:
    """Month and value by safe casts; rows unreadable in either are dropped."""
    out = df.select(
        *extra,
        month_start(safe_date(date)).alias("month"),
        F.expr(f"try_cast({value} AS double)").alias("value"),
    )
    return out.na.drop(subset=["month", "value"])


def with_provenance(df: DataFrame, official: bool = True) -> DataFrame:
    """Source file name, UTC ingest time, official flag; for frames read from files."""
    return df.withColumns({
        "source_file": F.element_at(F.split(F.input_file_name(), "/"), -1),
        "ingested_at": F.current_timestamp(),
        "is_official": F.lit(official),
    })


def drop_provenance(df: DataFrame) -> DataFrame:
    return df.drop(*META_COLUMNS)


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep, of rows equal in ``keys``, the one with the smallest unique ``order``.

    The smallest order per key is an aggregate with map-side combine, so a group of
    copies of any size never sits in one task; the rows follow by a semi join on ``order``.
    Only a digest of the keys and ``order`` are shuffled for it, not the keys, which may be whole texts.
    """
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    firsts = df.groupBy(digest.alias("_digest")).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, [order], "left_semi")


def quality_report(df: DataFrame, value: str, start: str, end: str, keys: Sequence[str] = ("series_id",), month: str = "month") -> DataFrame:
    """Loaded, expected and missing months, nulls, range and mean per series; warns above 6 missing."""
    expected = (F.months_between(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1).cast("bigint")
    rep = df.groupBy(*keys).agg(
        F.count(month).alias("n_loaded"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
    )
    rep = rep.withColumn("n_expected", expected).withColumn("n_missing", F.col("n_expected") - F.col("n_loaded"))
    return rep.withColumn("gap_warning", F.col("n_missing") > 6)


def parse_articles(df: DataFrame, article_id: str, url: str, published: str, title_html: str, body_html: str, terms: Sequence[str] = tuple(ECONOMIC_TERMS), closed: bool = False) -> DataFrame:
    """Landed posts to article rows: cleaned title and text, month; unreadable dates dropped, economic texts kept.

    ``closed`` decodes only entities that have their semicolon.
    """
    parsed = df.select(
        F.col(article_id).cast("string").alias("article_id"),
        F.col(url).alias("url"),
        F.col(published).cast("timestamp").alias("published_at"),
        clean_html(title_html, closed).alias("title"),
        clean_html(body_html, closed).alias("excerpt"),
    )
    text = F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("excerpt", F.lit(""))))
    parsed = parsed.withColumn("text", text).withColumn("month", month_start("published_at"))
    return parsed.where(F.col("month").isNotNull() & contains_any("text", terms))


def read_posts_json(spark: SparkSession, path: str, terms: Sequence[str] = tuple(ECONOMIC_TERMS)) -> DataFrame:
    """Landed post feed (one JSON object per line) to article rows."""
    schema = (
        "id BIGINT, date STRING, link STRING, title STRUCT<rendered: STRING>, "
        "excerpt STRUCT<rendered: STRING>, categories ARRAY<BIGINT>"
    )
    raw = spark.read.schema(schema).json(path)
    flat = raw.select("id", "link", F.expr("try_cast(date AS timestamp)").alias("date"),
                      F.col("title.rendered").alias("title"), F.col("excerpt.rendered").alias("excerpt"))
    return parse_articles(flat, "id", "link", "date", "title", "excerpt", terms)


def read_feed_xml(spark: SparkSession, path: str, source: str, row_tag: str = "item") -> DataFrame:
    """Landed RSS items: UTC time, source, title, summary."""
    schema = "title STRING, description STRING, pubDate STRING, link STRING"
    raw = spark.read.schema(schema).option("rowTag", row_tag).format("xml").load(path)
    stamp = F.coalesce(
        F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.expr("try_cast(pubDate AS timestamp)"),
    )
    return raw.select(stamp.alias("date"), F.lit(source).alias("source"), "title",
                      F.coalesce("description", F.lit("")).alias("summary"), "link").where(F.col("date").isNotNull())


def write_layer(df: DataFrame, path: str, month: str = "month", export_csv: bool = False) -> None:
    """Bronze, silver or gold table: parquet partitioned by year (or one-off CSV export)."""
    if export_csv:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    parted = df.withColumn("year", F.year(month))
    parted.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("year")
