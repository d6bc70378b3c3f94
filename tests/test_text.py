import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

from panelwatch import config as K
from panelwatch.functions import text as T
from panelwatch.operators import press
from panelwatch.sources import landed

TEXTS = [
    "Les prix http://x.y/z?a=1 @user #tag montent 😀 vite",
    "3ziz bzzaf had l7aja 2024",
    "الأسعار ارتفعت في السوق اليوم",
    "www.site.ma prix غالي le",
    "",
    "¡ÉTÉ! naïve_x  tab\tnew\nline ½ x² 𝐀𝐁 fin",
]


def python_tokens(text):
    t = text.lower()
    t = re.sub(r"https?://\S+|www\.\S+", " ", t)
    t = re.sub(r"[@#]\w+", " ", t)
    t = re.sub("[\U00010000-\U0010ffff]", " ", t)
    for d, letter in K.DIGIT_LETTERS.items():
        t = t.replace(d, letter)
    return [w for w in re.split(r"[^\w؀-ۿ]+", t) if w and w not in K.STOP_WORDS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")


def test_tokens_equal_the_plain_python_rules(docs):
    got = {r["i"]: r["tokens"] for r in press.cleaned(docs).collect()}
    assert got == {i: python_tokens(t) for i, t in enumerate(TEXTS)}


def test_profile_and_flag(docs):
    got = {r["i"]: (r["lang_profile"], r["has_digit_letters"], r["token_count"]) for r in press.cleaned(docs).collect()}
    assert got[0][0] == "fr" and got[2][0] == "darija" and got[4] == ("unknown", 0, 0)
    assert got[1][1] == 1 and got[3][0] == "mixed"


def test_null_text_is_empty(spark):
    r = press.cleaned(spark.createDataFrame([(1, None)], "i int, text string")).first()
    assert (r["clean_text"], r["token_count"]) == ("", 0)


def test_astral_removal(docs):
    assert docs.where("i = 0").select(T.strip_astral("text")).first()[0].count("😀") == 0


def test_html_clean_matches_unescape(spark):
    raw = "<p>Prix&nbsp;&amp; <b>co&ucirc;t</b> &lt;b&gt; l&#39;ann&eacute;e&hellip;</p>\n\n fin &amp;lt;"
    raw = raw.replace("&ucirc;", "û")
    want = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(raw))).strip()
    assert spark.createDataFrame([(raw,)], "h string").select(T.clean_html("h")).first()[0] == want


def test_substring_counting_is_kept(spark):
    d = spark.createDataFrame([("la recherche est cher cher",)], "t string")
    assert d.select(T.term_count("t", "cher")).first()[0] == 3
    s = press.with_scores(spark.createDataFrame([("hausse très hausse baisse",)], "text string"), ["hausse"], ["baisse"], ["très"]).first()
    assert (s["neg_hits"], s["pos_hits"], s["score"]) == (2, 1, 1.5)


def test_lexicon_is_mapped_like_the_text():
    assert "عziz" in T.lexicon_terms(["3ziz"]) and T.lexicon_terms(["3ziz"], legacy=True) == ["3ziz"]


def test_themes_in_declared_order(spark):
    d = spark.createDataFrame([("Le taux directeur de BAM et le PRIX du gaz",)], "text string")
    r = press.with_themes(d, K.PRESS_THEMES).first()
    assert r["themes"] == ["prix", "énergie", "politique_eco"] and r["n_themes"] == 3


def test_monthly_scores_mode_and_coverage(spark):
    rows = [("2020-01-01", "b", 1.0), ("2020-01-01", "a", 3.0), ("2020-03-01", "c", 2.0)]
    d = spark.createDataFrame(rows, "m string, source_type string, score double").selectExpr("date(m) AS month", "source_type", "score", "1L AS neg_hits", "0L AS pos_hits", "'all' AS series_id")
    from panelwatch.operators.panel import align_calendar

    m = press.text_score_monthly(d).withColumn("series_id", F.lit("all"))
    c = press.impute_coverage(align_calendar(m, ["score_lexical_raw", "n_texts", "n_negative_hits", "n_positive_hits", "source_type_dominant"], "2020-01-01", "2020-03-01"))
    r = c.orderBy("month").collect()
    assert [x["coverage_flag"] for x in r] == [1, 0, 1]
    assert r[0]["source_type_dominant"] == "a" and r[0]["score_lexical_raw"] == 2.0  # tie goes to the smaller name
    assert r[1]["imputation_reason"] == "no_data_neutral_imputation" and r[1]["source_type_dominant"] == "none"


def test_candidates_first_seen_and_seeds(spark):
    occ = spark.createDataFrame([("prix huile", 5), ("prix huile", 2), ("ab", 1), ("film prix", 3)], "term string, seen long")
    got = {r["term"]: (r["seen"], r["seed_rank"]) for r in press.candidate_terms(occ, K.EXCLUDED_TERMS, ["prix huile", "cherté"]).collect()}
    assert got == {"prix huile": (2, None), "cherté": (None, 1)}


def test_separator_and_columns(spark, tmp_path):
    for i, sep in enumerate([",", ";", "\t"]):
        (tmp_path / f"f{i}.csv").write_text(f" Mois {sep} IPC \n01/02/2020{sep}100.5\nn/a{sep}3\n15/03/2020{sep}x\n", encoding="utf-8")
        df = landed.safe_series(landed.resolve_date_value(landed.scan_delimited(spark, str(tmp_path / f"f{i}.csv"))))
        assert [(str(r["month"]), r["value"]) for r in df.collect()] == [("2020-02-01", 100.5)]


def test_column_fallback_and_error(spark):
    d = spark.createDataFrame([("2020-01-01", "x", 1.5)], "Date string, txt string, level double")
    assert landed.resolve_date_value(d).first()["raw_value"] == 1.5
    with pytest.raises(ValueError):
        landed.resolve_date_value(d.drop("Date"))
    assert landed.resolve_either_way(["Cereals (2014)", "oil"], {"Cereals": "c", "Oils": "o", "Meat": "m"}) == {"c": "Cereals (2014)", "o": "oil", "m": None}


def test_dedup_keeps_the_first(spark):
    d = spark.createDataFrame([(3, "k"), (1, "k"), (2, "j")], "id long, k string")
    assert sorted(r["id"] for r in landed.dedup_first(d, ["k"], "id").collect()) == [1, 2]


def test_quality_report(panel):
    q = landed.quality_report(panel([("a", "2020-01", 1), ("a", "2020-03", None)]), "v", "2020-01-01", "2020-12-01").first()
    assert (q["n_loaded"], q["n_expected"], q["n_missing"], q["n_null"], q["gap_warning"]) == (2, 12, 10, 1, True)


def test_posts_and_feed_files(spark, tmp_path):
    (tmp_path / "posts.json").write_text(
        '{"id": 7, "date": "2021-05-17T10:00:00", "link": "u", "title": {"rendered": "Hausse des <b>prix</b>"}, "excerpt": {"rendered": "le sucre &amp; co"}}\n'
        '{"id": 8, "date": "bad", "link": "u", "title": {"rendered": "prix"}, "excerpt": {"rendered": ""}}\n'
        '{"id": 9, "date": "2021-05-18T10:00:00", "link": "u", "title": {"rendered": "sport"}, "excerpt": {"rendered": "foot"}}\n', encoding="utf-8")
    rows = landed.read_posts_json(spark, str(tmp_path / "posts.json")).collect()
    assert [(r["article_id"], r["text"], str(r["month"])) for r in rows] == [("7", "Hausse des prix. le sucre & co", "2021-05-01")]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>Prix</title><description>x</description><pubDate>Mon, 17 May 2021 10:00:00 +0000</pubDate><link>l</link></item></channel></rss>", encoding="utf-8")
    f = landed.read_feed_xml(spark, str(tmp_path / "feed.xml"), "src").collect()
    assert [(r["title"], str(r["date"])[:10]) for r in f] == [("Prix", "2021-05-17")]


def test_layers_round_trip(spark, panel, tmp_path):
    df = panel([("a", "2020-01", 1), ("a", "2021-01", 2)])
    landed.write_layer(df, str(tmp_path / "silver"))
    assert (tmp_path / "silver" / "year=2021").exists()
    assert sorted(map(tuple, landed.read_layer(spark, str(tmp_path / "silver")).collect())) == sorted(map(tuple, df.collect()))


def test_provenance_and_substring_columns(spark, tmp_path):
    (tmp_path / "fx.csv").write_text("Date,MAD per EUR,dollar\n2020-01-01,10.8,9.6\n", encoding="utf-8")
    df = landed.with_provenance(landed.scan_delimited(spark, str(tmp_path / "fx.csv")))
    r = df.first()
    assert r["source_file"] == "fx.csv" and r["is_official"] and r["ingested_at"] is not None
    assert landed.drop_provenance(df).columns == ["Date", "MAD per EUR", "dollar"]
    assert landed.resolve_contains(df.columns, ["eur", "euro"]) == "MAD per EUR"
    assert landed.resolve_contains(df.columns, ["yen"], "Date") == "Date"


def test_builtin_lexicon_scores_cleaned_text(spark):
    d = press.cleaned(spark.createDataFrame([("3ziz bzzaf cherté", )], "text string"), stop_words=["le"])
    s = press.with_scores(d, text="clean_text").first()
    assert s["neg_hits"] == 3 and s["score"] == 4.5  # the mapped term, "cher" and "cherté"; "bzzaf" intensifies


def test_missing_keywords_and_default_trend_map(spark):
    from panelwatch.operators import index as X

    rows = [("s", m, k, float(v)) for m, k, v in [("2020-01-01", "prix huile", 1), ("2020-02-01", "prix huile", 3), ("2020-01-01", "other", 9)]]
    d = spark.createDataFrame(rows, "series_id string, m string, keyword string, value double").selectExpr("series_id", "date(m) AS month", "keyword", "value")
    r = X.theme_subindices(d).orderBy("month").collect()
    assert [x["trends_prix_alim"] for x in r] == [0.0, 1.0] and r[0]["trends_inflation"] is None
    assert [x["trends_composite"] for x in r] == [0.0, 1.0] and r[0]["n_keywords_used"] == 1


CUT_PAGES = [
    (1, "<title>Prix eaux &lt;b&gt;&amp</title><p>a&amp;amp; b&copy</p>", "Prix eaux &amp", "Prix eaux &amp a&amp; b&copy"),
    (2, "<title>eaux &quo</title>x &#233;t&#xE9; &#233 &ampx; &unknown; &eacute;", "eaux &quo", "eaux &quo x été &#233 &ampx; &unknown; é"),
    (3, "<title>gaz &middot; eaux</title>fin &am", "gaz · eaux", "gaz · eaux fin &am"),
]


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Pages cut off inside entities, as the given ones are at the end of a title."""
    folder = tmp_path_factory.mktemp("cut")
    spark.createDataFrame([(i, f"u{i}", h) for i, h, _, _ in CUT_PAGES], "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def test_articles_of_pages_cut_off_inside_an_entity(spark, cut_pages):
    from panelwatch.plans.q_text import pages_to_articles

    got = {(r["article_id"], r["title"], r["text_hash"]) for r in pages_to_articles(spark, cut_pages).collect()}
    assert got == {(str(i), t, hashlib.md5(f"{t}. {b}".encode()).hexdigest()) for i, _, t, b in CUT_PAGES}


def test_clean_pages_cut_off_inside_an_entity(spark, cut_pages):
    from panelwatch.plans.q_text import html_clean

    got = {(r["page_id"], r["text_hash"], r["n_chars"]) for r in html_clean(spark, cut_pages).collect()}
    assert got == {(i, hashlib.md5(b.encode()).hexdigest(), len(b)) for i, _, _, b in CUT_PAGES}


def test_closed_entities_are_a_choice(spark):
    d = spark.createDataFrame([("a &amp b &lt;i&gt; &copy; &amp",), (None,)], "h string")
    got = d.select(T.clean_html("h").alias("all"), T.clean_html("h", closed=True).alias("closed")).collect()
    assert {tuple(r) for r in got} == {("a & b © &", "a &amp b © &amp"), (None, None)}
