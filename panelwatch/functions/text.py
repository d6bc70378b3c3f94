"""Text cleaning and scoring as built-in string expressions; only entities are decoded in Python, in batches."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from panelwatch.config import DIGIT_LETTERS, INTENSITY, STOP_WORDS
from panelwatch.functions.columns import add_all, as_col

# A word character is a letter, a number of any script, or "_"; the Arabic block counts whole.
WORD = r"[\p{L}\p{N}_]"
# Everything beyond the basic plane separates words as well.
NON_WORDS = r"[[^\p{L}\p{N}_\x{0600}-\x{06FF}]\x{10000}-\x{10FFFF}]+"


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


# An entity with its semicolon: a number or a name.
CLOSED_ENTITY = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


def _closed_entity(m: re.Match) -> str:
    return html5.get(f"{m[1]};", m[0]) if m[1] else html.unescape(m[0])


@F.pandas_udf(StringType())
def _unescaped_closed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: CLOSED_ENTITY.sub(_closed_entity, t), na_action="ignore")


def unescape_entities(c, closed: bool = False) -> Column:
    """All named, decimal and hexadecimal entities to characters, in batches; texts without an ampersand pass by.

    As in HTML, some count without their semicolon too; ``closed`` leaves those as they are, so that a text
    cut off inside an entity keeps its last characters.
    """
    t = as_col(c)
    decode = _unescaped_closed if closed else _unescaped
    return F.when(t.contains("&"), decode(F.when(t.contains("&"), t))).otherwise(t)


def strip_tags(c) -> Column:
    return F.regexp_replace(as_col(c), "<[^>]+>", " ")


def clean_html(c, closed: bool = False) -> Column:
    """Entities (``closed``: only those with a semicolon), then tags to a blank, then one blank between words, trimmed."""
    spaced = F.regexp_replace(strip_tags(unescape_entities(c, closed)), r"(?U)\s+", " ")
    return F.trim(spaced)


def strip_urls(c) -> Column:
    """URLs, mentions and hashtags to blanks; the patterns run only on texts that hold their marks."""
    t = as_col(c)
    no_urls = F.when(t.contains("://") | t.contains("www."), F.regexp_replace(t, r"(?U)https?://\S+|www\.\S+", " ")).otherwise(t)
    return F.when(no_urls.contains("@") | no_urls.contains("#"), F.regexp_replace(no_urls, rf"[@#]{WORD}+", " ")).otherwise(no_urls)


def strip_astral(c) -> Column:
    """Emoji and everything else beyond the basic plane to blanks."""
    return F.regexp_replace(as_col(c), "[\\x{10000}-\\x{10FFFF}]", " ")


def digits_to_letters(c) -> Column:
    out = as_col(c)
    for digit, letter in DIGIT_LETTERS.items():
        out = F.replace(out, F.lit(digit), F.lit(letter))
    return out


def has_digit_letters(c) -> Column:
    return as_col(c).rlike("[" + "".join(DIGIT_LETTERS) + "]").cast("int")


def tokens(c, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Words between runs of non-word characters, without stop-words; order and repeats kept."""
    parts = F.split(as_col(c), NON_WORDS)
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*stop_words))


def lower_text(c) -> Column:
    """Lower case, null as empty text."""
    return F.lower(F.coalesce(as_col(c), F.lit("")))


def language_profile(token_array) -> Column:
    """Script profile of a token array by the 60 % rules."""
    t = as_col(token_array)
    total = F.size(t)
    arabic = F.size(F.filter(t, lambda x: x.rlike(r"[\x{0600}-\x{06FF}]")))
    latin = F.size(F.filter(t, lambda x: x.rlike("[a-zA-Z]")))
    return (
        F.when(total == 0, "unknown")
        .when(arabic >= total * 0.6, "darija")
        .when(latin >= total * 0.6, "fr")
        .when((arabic > 0) & (latin > 0), "mixed")
        .otherwise("unknown")
    )


def contains_any(text, terms: Sequence[str]) -> Column:
    """Case-insensitive substring test against a term list; null text is false.

    The lambda binds the lowered text, so it is made once per row and not once per term
    (a filter does not share repeated parts of its condition).
    """
    def hit(low: Column) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in terms])

    return F.exists(F.array(F.coalesce(F.lower(as_col(text)), F.lit(""))), hit)


def theme_labels(text, themes: Mapping[str, Sequence[str]]) -> Column:
    """Array of the themes, in declared order, that have a term in the text."""
    hits = [F.when(contains_any(text, terms), F.lit(name)) for name, terms in themes.items()]
    return F.array_compact(F.array(*hits))


def term_count(text, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    t = as_col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def term_hits(text, terms: Sequence[str]) -> Column:
    return add_all([term_count(text, t) for t in terms])


def lexicon_terms(terms: Sequence[str], legacy: bool = False) -> list[str]:
    """Lexicon as it must look against cleaned text, whose digits have become letters.

    ``legacy`` leaves the digits in the lexicon (such terms then never match).
    """
    if legacy:
        return list(terms)
    table = str.maketrans(DIGIT_LETTERS)
    return list(dict.fromkeys(t.translate(table) for t in terms))


def lexicon_score(neg_hits, pos_hits, text, intensifiers: Sequence[str]) -> Column:
    """(negative hits - positive hits), times 1.5 when an intensifier occurs."""
    factor = F.when(contains_any(text, intensifiers), F.lit(INTENSITY)).otherwise(F.lit(1.0))
    return (as_col(neg_hits) - as_col(pos_hits)).cast("double") * factor
