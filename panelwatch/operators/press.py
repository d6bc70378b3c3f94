"""Monthly aggregation of article rows: volumes, themes, lexicon scores, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwatch.config import INTENSIFIERS, NEGATIVE_TERMS, POSITIVE_TERMS, PRESS_THEMES
from panelwatch.functions import text as T
from panelwatch.functions.columns import row_mean
from panelwatch.operators.normalise import minmax

THEME_COUNTS = {"themes_prix": "prix", "themes_inflation": "inflation", "themes_alim": "alimentaire"}


def with_themes(df: DataFrame, themes: Mapping[str, Sequence[str]] = PRESS_THEMES, text: str = "text") -> DataFrame:
    """``themes`` (array, declared order) and ``n_themes`` of each article."""
    labels = T.theme_labels(text, themes)
    return df.withColumn("themes", labels).withColumn("n_themes", F.size("themes"))


def press_monthly(df: DataFrame, keys: Sequence[str] = (), theme_counts: Mapping[str, str] = THEME_COUNTS) -> DataFrame:
    """Articles, distinct sources and articles per theme for each month; two-phase aggregates only."""
    return df.groupBy(*keys, "month").agg(
        F.count(F.lit(1)).alias("press_volume"),
        F.count_distinct("source").alias("n_sources"),
        *[F.count_if(F.array_contains("themes", t)).alias(name) for name, t in theme_counts.items()],
    )


def press_index(monthly: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("press_volume", *THEME_COUNTS)) -> DataFrame:
    """Min-max ``{c}_norm`` per column and the mean of the theme ones as ``press_index``."""
    normed = monthly.withColumns({f"{c}_norm": minmax(f"double({c})", keys) for c in columns})
    return normed.withColumn("press_index", row_mean([f"{c}_norm" for c in columns if c.startswith("themes_")]))


def cleaned(df: DataFrame, text: str = "text", stop_words: Sequence[str] | None = None) -> DataFrame:
    """``tokens``, ``clean_text``, ``token_count``, ``lang_profile`` and the digit-letter flag."""
    df = df.withColumn("_lower", T.lower_text(text)).withColumn("_prepared", T.strip_urls("_lower")).drop("_lower")
    df = df.withColumn("has_digit_letters", T.has_digit_letters("_prepared"))
    stop = {} if stop_words is None else {"stop_words": stop_words}
    df = df.withColumn("tokens", T.tokens(T.digits_to_letters("_prepared"), **stop)).drop("_prepared")
    return df.withColumns({
        "clean_text": F.concat_ws(" ", "tokens"),
        "token_count": F.size("tokens"),
        "lang_profile": T.language_profile("tokens"),
    })


def with_scores(df: DataFrame, negative: Sequence[str] = tuple(T.lexicon_terms(NEGATIVE_TERMS)), positive: Sequence[str] = tuple(T.lexicon_terms(POSITIVE_TERMS)),
                intensifiers: Sequence[str] = tuple(T.lexicon_terms(INTENSIFIERS)), text: str = "text") -> DataFrame:
    """Per document: negative and positive hits and the lexicon score of the lower-cased text.

    The default lists are the built-in ones, mapped like cleaned text.
    """
    df = df.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    df = df.withColumns({"neg_hits": T.term_hits("_low", negative), "pos_hits": T.term_hits("_low", positive)})
    score = T.lexicon_score("neg_hits", "pos_hits", "_low", intensifiers)
    return df.withColumn("score", score).drop("_low")


def text_score_monthly(scored: DataFrame, source: str = "source_type", keys: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Mean score, documents, hits and dominant source per month.

    Counts per source first, then one row per month: the mode needs no list of documents.
    ``n_texts`` counts texts that are not null (rows, where the frame has no texts). Ties of the dominant source go to the smallest name.
    """
    per_source = scored.groupBy(*keys, "month", source).agg(
        F.sum("score").alias("_s"), F.count(F.lit(1)).alias("_n"), F.count(text if text in scored.columns else F.lit(1)).alias("_t"), F.sum("neg_hits").alias("_neg"), F.sum("pos_hits").alias("_pos"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(source).alias("s")))
    out = per_source.groupBy(*keys, "month").agg(
        (F.sum("_s") / F.sum("_n")).alias("score_lexical_raw"), F.sum("_t").alias("n_texts"), best.alias("_best"),
        F.sum("_neg").alias("n_negative_hits"), F.sum("_pos").alias("n_positive_hits"))
    return out.withColumn("source_type_dominant", F.col("_best.s")).drop("_best")


def impute_coverage(aligned: DataFrame) -> DataFrame:
    """Months without texts: flag 0, reason, zero score and counts, dominant source ``none``."""
    covered = F.coalesce(F.col("n_texts"), F.lit(0)) > 0
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_texts", "n_negative_hits", "n_positive_hits")}
    return aligned.withColumns({
        "coverage_flag": covered.cast("int"),
        "imputation_reason": F.when(covered, "").otherwise("no_data_neutral_imputation"),
        "score_lexical_raw": F.coalesce("score_lexical_raw", F.lit(0.0)),
        "source_type_dominant": F.coalesce("source_type_dominant", F.lit("none")),
        **zero,
    })


def coverage_by_year(df: DataFrame, article_id: str, early_before: int, least: int = 50, month: str = "month") -> DataFrame:
    """Texts and distinct articles per year; flags early years with too few texts."""
    by_year = df.groupBy(F.year(month).alias("year")).agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_distinct(article_id).alias("n_articles"))
    return by_year.withColumn("insufficient", (F.col("year") < early_before) & (F.col("n_texts") < least))


def top_terms(df: DataFrame, terms: Sequence[str], k: int = 20, text: str = "text") -> DataFrame:
    """Corpus-wide hits per lexicon term, the ``k`` largest.

    One aggregate row with a sum per term, then turned to long form: nothing is exploded
    per document.
    """
    low = df.select(F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    sums = low.agg(*[F.sum(T.term_count("_low", t)).alias(f"_c{i}") for i, t in enumerate(terms)])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_c{i}").alias("n_hits")) for i, t in enumerate(terms)])
    return sums.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("n_hits") > 0).orderBy(F.col("n_hits").desc(), "term").limit(k)


def candidate_terms(occurrences: DataFrame, excluded: Sequence[str], seeds: Sequence[str], min_length: int = 3) -> DataFrame:
    """Distinct candidate keywords in first-seen order, the seeds last.

    ``occurrences`` is ``(term, seen)`` with ``seen`` any orderable value (a struct, say) that grows in reading order.
    Candidates are at least ``min_length`` long and contain no excluded term.
    """
    # first the aggregate (map-side combine), then the substring tests on distinct terms only
    distinct = occurrences.where(F.length("term") >= min_length).groupBy("term").agg(F.min("seen").alias("seen"))
    kept = distinct.where(~T.contains_any("term", excluded))
    spark = occurrences.sparkSession
    seed_rows = spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "term string, seed_rank int")
    return (
        kept.join(seed_rows, "term", "full_outer")
        .select("term", "seen", F.when(F.col("seen").isNull(), F.col("seed_rank")).alias("seed_rank"))
    )
