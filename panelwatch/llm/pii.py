"""Personal data by weak supervision.

Regular expressions propose spans: strict ones (the base spans, always kept) and looser ones. Labelers of three
kinds, pattern, gazetteer and context, vote on each for, against or not at all. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is, without labels; its posteriors then train a
logistic classifier on the shape and surroundings of the spans, which decides about the looser ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelwatch.llm.common import by_row, staged

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "edges")
#: Gazetteers of top-level domains, calling codes and card prefixes, and cue words before a span.
DOMAINS = frozenset("com org net edu gov info io co uk de fr es it eu example test".split())
CALLING = ("+1", "+20", "+212", "+31", "+32", "+33", "+34", "+39", "+41", "+43", "+44", "+45", "+46", "+47", "+48", "+49", "+52", "+55", "+61", "+81", "+86", "+91")
CARD_PREFIX = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
CUES = {
    "email": re.compile(r"\b(e-?mail|mail|contact|write|reach|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|client|from)\b", re.I),
    "card": re.compile(r"\b(card|visa|credit|debit|payment|pay|carte|karte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|call|mobile|fax|cell|telefon|tel[ée]fono)\b", re.I),
}
AGAINST = re.compile(r"\b(version|release|build|order|invoice|isbn|ref|id|section)\W*$", re.I)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63})+", re.I)
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
DIGIT = re.compile(r"[0-9]")

SCANNED = "doc_id string, kinds array<int>, starts array<long>, ends array<long>, base array<boolean>, votes array<int>, shapes array<int>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from the at signs, so that long runs without one cost nothing."""
    at, done = text.find("@"), 0
    while at >= 0:
        end = DOMAIN.match(text, at + 1)
        start = at
        while end and start > done and text[start - 1] in LOCAL:
            start -= 1
        if end and start < at:
            done = end.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` of the strict patterns, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that touch no base span: spelled-out addresses, numbers of card length, local phone numbers."""
    found = []
    low = text.lower()
    if "at)" in low or "at]" in low:
        found += [(0, m.start(), m.end()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        found += [(2, m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= sum(c.isdigit() for c in m[0]) <= 19]
        found += [(3, m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, int)
    out, last = [], -1
    for k, a, b in sorted(found, key=lambda x: (x[1], x[0])):
        i = np.searchsorted(starts, b) - 1
        if (i < 0 or reach[i] <= a) and a >= last:
            out.append((k, a, b))
            last = b
    return out


def votes(text: str, kind: int, a: int, b: int, strict: bool) -> tuple[int, ...]:
    """One vote of -1, 0 or 1 per labeler."""
    span, before = text[a:b], text[max(0, a - 40) : a]
    digits = "".join(c for c in span if c in "0123456789")
    check, gazetteer = 0, 0
    if kind == 0:
        top = re.split(r"\W+", span.lower().rstrip(".)]"))[-1]
        check, gazetteer = (1 if 2 <= len(top) <= 10 and top.isalpha() else -1), (1 if top in DOMAINS else -1)
    elif kind == 1:
        parts = span.split(".")
        check, gazetteer = (-1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1), (-1 if parts[0] in ("0", "1", "2") and parts[1] == "0" else 0)
    elif kind == 2:
        check, gazetteer = (1 if luhn(digits) else -1), (1 if CARD_PREFIX.match(digits) else -1)
    else:
        check = 1 if 9 <= len(digits) <= 15 and not luhn(digits + "00") or len(digits) in (10, 11, 12) else -1
        gazetteer = 1 if span.startswith(CALLING) else 0
    context = -1 if AGAINST.search(before) else 1 if CUES[KINDS[kind]].search(before) else 0
    glued = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
    return (1 if strict else -1), check, gazetteer, context, (-1 if glued else 1)


def shape(text: str, kind: int, a: int, b: int) -> int:
    """Features of the classifier in one number: length class, share of digits, marks inside, what stands on both sides."""
    span = text[a:b]
    size = min(7, (b - a).bit_length())
    share = 4 * sum(c.isdigit() for c in span) // max(1, b - a)
    marks = min(3, sum(c in " -.()" for c in span))
    left = 0 if a == 0 or text[a - 1].isspace() else 1 if text[a - 1].isalnum() else 2
    right = 0 if b == len(text) or text[b].isspace() else 1 if text[b].isalnum() else 2
    plus = span.startswith("+") or "@" in span
    return ((((size * 5 + share) * 4 + marks) * 3 + left) * 3 + right) * 2 + plus


def _one_hot(kind: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Indicators of each feature's value within its kind."""
    parts, rest = [], shapes.copy()
    for n in (2, 3, 3, 4, 5, 8):
        parts.append((kind * n + rest % n, 4 * n))
        rest //= n
    return np.concatenate([np.eye(n)[i] for i, n in parts], axis=1)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates of every whole text with their votes (a number in base 3) and shapes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(doc_id, t):
            t = t or ""
            strict = base_spans(t)
            spans = [(*s, True) for s in strict] + [(*s, False) for s in loose_spans(t, strict)]
            coded = [sum((v + 1) * 3**i for i, v in enumerate(votes(t, *s))) for s in spans]
            return [(doc_id, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans], [s[3] for s in spans], coded, [shape(t, *s[:3]) for s in spans])]

        yield from by_row(one, batches, [c.split()[0] for c in SCANNED.split(", ")])

    return docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, SCANNED)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for labelers that err independently: posteriors of the patterns, P(vote | class) and the share of true spans.

    ``patterns`` are votes of -1, 0, 1, one row per pattern. Starts from the majority; smoothed, so a labeler that never
    votes has no say.
    """
    p = np.clip(0.5 + 0.4 * np.sign(patterns.sum(axis=1)), 0.1, 0.9)
    prior, given = 0.5, np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for y, w in ((1, p * counts), (0, (1 - p) * counts)):
            for i in range(patterns.shape[1]):
                n = np.bincount(patterns[:, i] + 1, weights=w, minlength=3) + 1.0
                given[y, i] = n / n.sum()
        prior = (p @ counts + 1) / (counts.sum() + 2)
        odds = np.log(prior / (1 - prior)) + sum(np.log(given[1, i, patterns[:, i] + 1] / given[0, i, patterns[:, i] + 1]) for i in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return p, given, prior


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model of soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(scanned: DataFrame) -> dict[tuple[int, int], float]:
    """Probability of each (kind, shape). All candidates count; what is gathered are counts per kind, vote pattern and
    shape, whose number is bounded by their few values."""
    zipped = scanned.select(F.explode(F.arrays_zip("kinds", "votes", "shapes")).alias("x")).groupBy("x.kinds", "x.votes", "x.shapes").count()
    rows = zipped.toPandas().sort_values(["kinds", "votes", "shapes"])
    if rows.empty:
        return {}
    n, kind, shapes = rows["count"].to_numpy(float), rows["kinds"].to_numpy(np.int64), rows["shapes"].to_numpy(np.int64)
    soft = np.zeros(len(rows))
    for k in range(len(KINDS)):
        mine = kind == k
        if mine.any():
            coded = rows["votes"].to_numpy(np.int64)[mine]
            each, where = np.unique(coded, return_inverse=True)
            patterns = np.stack([each // 3**i % 3 - 1 for i in range(len(LABELERS))], axis=1)
            soft[mine] = reliabilities(patterns, np.bincount(where, weights=n[mine]))[0][where]
    x = _one_hot(kind, shapes)
    p = 1 / (1 + np.exp(-x @ fit_logistic(x, soft, n)))
    return {(int(k), int(s)): float(v) for k, s, v in zip(kind, shapes, p)}


FOUND = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row of ``docs``.

    The counts and the digest are of the base spans; ``spans`` adds the looser ones that the classifier accepts, as
    ``kind:start:end`` in code points, by kind, then start. A null text is an empty one; repeated rows and null ids
    are kept; an empty table gives none; other columns are ignored.
    """
    scanned = staged(scan(docs, key, text), "candidates")
    share = docs.sparkSession.sparkContext.broadcast(train(scanned))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(doc_id, kinds, starts, ends, base, _, shapes):
            rows = sorted(zip(map(int, kinds), map(int, starts), map(int, ends), map(bool, base), map(int, shapes)))
            name = lambda r: f"{KINDS[r[0]]}:{r[1]}:{r[2]}"
            kept = [r for r in rows if r[3] or share.value.get((r[0], r[4]), 0.0) >= threshold]
            strict = [r for r in rows if r[3]]
            digest = hashlib.sha256(",".join(map(name, strict)).encode()).hexdigest()
            return [(doc_id, *(sum(r[0] == k for r in strict) for k in range(4)), digest, ",".join(map(name, kept)), len(kept) - len(strict))]

        yield from by_row(one, batches, [c.split()[0] for c in FOUND.split(", ")])

    return scanned.mapInPandas(run, FOUND).withColumn("doc_id", F.col("doc_id").cast("long"))
