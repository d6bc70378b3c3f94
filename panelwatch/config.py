"""Settings of the pipelines: evaluation windows, lags, thresholds, term lists."""

from __future__ import annotations

from typing import NamedTuple


class EvalWindow(NamedTuple):
    """Closed month ranges of one evaluation block."""

    label: str
    train_start: str
    train_end: str
    test_start: str
    test_end: str


# The two window presets and the date that chooses between them.
FULL_WINDOWS = [
    EvalWindow("A", "2010-01-01", "2017-12-01", "2018-01-01", "2019-12-01"),
    EvalWindow("B", "2010-01-01", "2019-12-01", "2020-01-01", "2021-12-01"),
    EvalWindow("C", "2010-01-01", "2021-12-01", "2022-01-01", "2024-12-01"),
]
SHORT_WINDOWS = [
    EvalWindow("A", "2017-01-01", "2019-12-01", "2020-01-01", "2021-12-01"),
    EvalWindow("B", "2017-01-01", "2021-12-01", "2022-01-01", "2024-12-01"),
]
FULL_PRESET_LATEST_START = "2012-01-01"

# Windows for the 1995-2001 price panel of the driver tables.
PANEL_WINDOWS = [
    EvalWindow("A", "1995-01-01", "1998-12-01", "1999-01-01", "1999-12-01"),
    EvalWindow("B", "1995-01-01", "1999-12-01", "2000-01-01", "2001-11-01"),
]
PANEL_TRAIN_END = "1998-12-01"

# Thresholds of the regime, stress, selection and forecast rules.
REGIME_THRESHOLD = 2.0
STRESS_QUANTILE = 0.75
MIN_KEYWORD_CORR = 0.25
MIN_TRAIN = 24
MIN_TRAIN_FULL = 36
PUBLICATION_DELAY_DAYS = 20
BOOTSTRAP_REPS = 1000
BOOTSTRAP_BLOCK = 6

# Lags kept in the gold table (lag 0 is the column itself).
# Delays of the features.
FEATURE_LAGS = {
    "behavioural_index": [1, 2],
    "hybrid_index": [1, 2],
    "trends_food": [1],
    "trends_inflation": [1],
    "trends_fuel": [1],
    "trends_composite": [1],
    "food_index": [1],
    "food_yoy": [1],
    "oils_yoy": [1],
    "fx_rate": [1],
    "fx_yoy": [1],
    "ipc_level": [1, 2, 3],
    "inflation_yoy": [1, 2],
    "inflation_mom": [1, 2],
}

# Words dropped by the tokeniser.
STOP_WORDS = [
    "wa", "li", "fi", "3la", "dyal", "hada", "hadchi", "mashi",
    "walo", "bzzaf", "chwiya", "de", "la", "le", "les", "des",
    "du", "un", "une", "et", "en", "au", "aux", "sur",
]

# Digits written for letters, and their letters.
DIGIT_LETTERS = {"3": "ع", "7": "ح", "9": "ق", "5": "خ", "2": "ء"}

# Stress lexicon.
NEGATIVE_TERMS = [
    "ghali", "mghal", "3la", "ma imkinch", "l3icha s3iba", "ma بقاش", "ma b9ach",
    "3ziz", "zad fl prix", "tla3 lprix", "zid", "ma 3ndnach", "hchouma", "3ar",
    "skhoun", "ghalya", "ghlaw", "mghla", "cher", "cherte", "cherté",
    "hausse", "flambee", "flambée", "augmentation", "غالي", "مغال", "زاد", "ارتفع", "غلاء",
]
POSITIVE_TERMS = [
    "hbat", "nq9s", "rkhis", "mezyan", "walo mushkil", "b5ir",
    "baisse", "stabilite", "stabilité", "normal", "هبط", "رخيص", "انخفض", "استقر",
]
INTENSIFIERS = [
    "bzzaf", "ktir", "3zim", "jddan", "vraiment", "tres", "très", "trop", "جداً", "كثير", "عظيم",
]
INTENSITY = 1.5

# Press themes and their terms, in declared order.
PRESS_THEMES = {
    "prix": ["prix", "tarif", "coût", "tarification", "cher", "cherté", "hausse", "augmentation",
             "flambée", "renchérissement", "أسعار", "ارتفاع", "غلاء"],
    "inflation": ["inflation", "deflation", "IPC", "indice des prix", "pouvoir d'achat",
                  "التضخم", "القوة الشرائية"],
    "alimentaire": ["huile", "farine", "sucre", "légumes", "viande", "lait", "produits alimentaires",
                    "panier", "ONSSA", "الزيت", "الدقيق", "السكر", "الخضر"],
    "énergie": ["carburant", "essence", "gasoil", "gaz", "électricité", "ONEE", "الوقود", "الغاز", "البنزين"],
    "politique_eco": ["subvention", "compensation", "caisse compensation", "HCP", "BAM", "Bank Al-Maghrib",
                      "taux directeur", "budget", "دعم", "صندوق المقاصة"],
}

# Terms that make an article count as economic.
ECONOMIC_TERMS = [
    "prix", "inflation", "economie", "économie", "hausse", "baisse",
    "pouvoir d'achat", "carburant", "essence", "gasoil", "gaz", "sucre",
    "farine", "huile", "coût", "cout", "budget", "subvention",
    "الأسعار", "التضخم", "اقتصاد", "غلاء", "ارتفاع", "الوقود", "الزيت",
]

# Words that mark a candidate keyword as noise, and the seeds.
EXCLUDED_TERMS = [
    "recette", "cuisine", "video", "youtube", "facebook", "تحميل", "مشاهدة",
    "film", "musique", "chanson", "meteo", "weather", "football", "sport",
]
SEED_KEYWORDS = ["inflation maroc", "prix alimentaires", "pouvoir d achat", "cherté", "prix carburant"]

# Search keywords of each trend theme, the first one of "inflation" is the anchor.
TREND_THEMES = {
    "trends_prix_alim": ["prix huile", "hausse prix", "prix legumes maroc", "أسعار المواد الغذائية", "غلاء المعيشة"],
    "trends_inflation": ["inflation maroc", "التضخم في المغرب"],
    "trends_carburant": ["prix carburant maroc", "ارتفاع الأسعار"],
    "trends_subvention": ["subvention maroc"],
}

# Header names accepted for the date and the value column.
DATE_ALIASES = ["date", "mois", "month", "periode"]
VALUE_ALIASES = ["ipc", "indice", "cpi", "valeur", "index"]
FOOD_PRICE_COLUMNS = {
    "Food Price Index": "fao_food_index",
    "Cereals": "fao_cereals_index",
    "Oils": "fao_oils_index",
    "Dairy": "fao_dairy_index",
    "Meat": "fao_meat_index",
    "Sugar": "fao_sugar_index",
}

# The label texts of the reports.
ERROR_NOTES = {"mape": "Erreur faible", "mase": "Meilleur que la naive", "theils_u": "Mieux que la prediction naive", "none": "Performance a nuancer"}
WARNING_VERDICTS = [
    ("recall = 1 AND precision >= 0.60", "Detection parfaite"),
    ("recall = 1 AND precision >= 0.40", "Sur-alerte moderee - Recall parfait"),
    ("recall = 1 AND precision < 0.40", "Sur-alerte (favorable early warning)"),
    ("f1 >= 0.70", "Equilibre F1 excellent (>0.70)"),
    ("f1 >= 0.50", "Equilibre F1 acceptable (>0.50)"),
    ("recall >= 0.80 AND precision < 0.40", "Sur-alerte moderee - bon Recall"),
    ("precision >= 0.80 AND recall < 0.40", "Trop conservateur - manque des crises"),
    ("bal_acc >= 0.70", "Bonne accuracy equilibree"),
    ("recall < 0.50", "Insuffisant - trop de crises manquees"),
]
WARNING_DEFAULT = "Partiel - compromis a ameliorer"
ROC_BIAS = [
    ("delta > 0.15", "ROC tres optimiste (desequilibre fort)"),
    ("delta > 0.05", "ROC moderement optimiste"),
    ("delta < -0.05", "AP > AUC (classe dominante positive)"),
]
ROC_BIAS_DEFAULT = "AUC ~= AP (classes equilibrees)"
AP_VERDICTS = [("ap > 0.70", "Excellent malgre desequilibre"), ("ap > 0.50", "Acceptable"), ("ap > 0.30", "Faible")]
AP_DEFAULT = "Insuffisant"
DM_TEXT = {
    "few": "Echantillon insuffisant",
    "one_yes": "Amelioration statistiquement significative",
    "one_no": "Amelioration directionnelle non significative - a nuancer dans la presentation",
    "two_yes": "Difference significative entre modeles",
    "two_no": "Difference non significative",
}


def case_text(rules, default: str) -> str:
    """CASE expression of ordered (condition, text) rules; plain SQL for any engine."""
    whens = " ".join(f"WHEN {c} THEN '{t}'" for c, t in rules)
    return f"CASE {whens} ELSE '{default}' END"

# Rules of the two hypotheses, with their texts.
HYPOTHESIS_RULES = {
    "h1_auc": "CASE WHEN auc_b > 0.65 THEN 'VALIDÉE' ELSE 'REJETÉE' END",
    "h1_recall": "CASE WHEN recall_b >= 0.8 THEN 'PARTIELLEMENT VALIDEE' ELSE 'NON VALIDEE' END",
    "h2_auc": "CASE WHEN auc_h IS NULL THEN 'NON TESTABLE' WHEN auc_h - auc_b > 0.05 THEN 'VALIDÉE' ELSE 'REJETÉE' END",
    "h2_recall": "CASE WHEN rec_b IS NULL OR rec_h IS NULL THEN 'NON TESTABLE' WHEN rec_b > rec_h THEN 'REJETEE' ELSE 'VALIDEE' END",
}
