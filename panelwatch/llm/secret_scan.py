"""Secrets by fixed patterns and by character Markov models, in built-in functions throughout.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A run of token characters is a secret if its log-likelihood ratio outweighs the rarity of secrets.
The fixed patterns (an assignment to a telling name, an access key, a hexadecimal string) are always kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwatch.llm.common import in_ids, sample_ids, staged

#: The patterns of the contract, kinds in its order, and the kind that the models add.
NAMES = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = NAMES + r"""["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run that is too short holds no longer one
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE = 12

#: A run of characters up to an assignment in it, with the assignment; else a run long enough to be judged by the models.
_TO_ASSIGN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]*?" + ASSIGN
UNIT = _TO_ASSIGN + r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
_UNIT_GATE = r"[A-Za-z0-9+/_-]{16}"
WORD = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{6,}={0,2}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
_SIDE = len(ALPHABET) + 1
_BLOCK = 1024
MARK = "[SECRET]"


@dataclass(frozen=True)
class Model:
    """Log ratio, random to ordinary, of every step from one character to the next (code of the first x side + code of the next)."""

    ratios: tuple[float, ...]
    threshold: float

    def table(self) -> Column:
        return F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")


def _positions(pieces: Column, hits: Column) -> Column:
    """Starts of the hits of a text from the lengths of the hits and of the pieces between them: a running sum.

    Taken in blocks, so that the arrays that grow step by step stay short however many hits a text has.
    """
    n = F.size(hits)
    steps = F.zip_with(F.slice(pieces, 1, n), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK))
    empty = F.array().cast("array<int>")

    def along(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), empty.alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct((acc["at"] + x["p"] + x["h"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["p"]).alias("out")))["out"]

    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["p"] + x["h"]))
    before = F.aggregate(sums, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, s: F.struct((acc["at"] + s).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
    return F.flatten(F.zip_with(blocks, before, along))


SPAN = "array<struct<start: int, kind: int, stop: int, value: string>>"
#: Gate (texts without it cost one search), pattern and group of the value, by kind.
_SEARCHES = ((NAMES + r"""["']? *[:=]""", ASSIGN, 1), (ACCESS, ACCESS, 0), (HEX, HEX, 0), (_UNIT_GATE, UNIT, 0))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", word_ids: list | None = None) -> DataFrame:
    """``doc_id, base, units, words``: base spans, runs to be judged, and the words of the documents of ``word_ids``.

    One pass over the texts; a null text is an empty one.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = {}
    for kind, (gate, pattern, group) in enumerate(_SEARCHES):
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        parts = [F.transform(F.split("text", pattern, -1), F.char_length).alias("pieces"), hits.alias("hits")]
        parts += [F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("values")] * (group > 0)
        found[f"_{kind}"] = F.when(F.rlike("text", F.lit(gate)), F.struct(*parts))
    words = F.when(in_ids(F.col("doc_id"), word_ids or []), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", words.alias("words"), *(c.alias(name) for name, c in found.items()))

    def spans(kind: int) -> Column:
        own = F.col(f"_{kind}")
        at = _positions(own["pieces"], F.transform(own["hits"], F.char_length))
        values = own["values"] if _SEARCHES[kind][2] else own["hits"]
        each = F.transform(F.arrays_zip(at.alias("start"), own["hits"].alias("hit"), values.alias("value")), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.char_length(x["hit"])).alias("stop"), x["value"].alias("value")))
        return F.when(F.size(own["hits"]) > 0, each).otherwise(F.array()).cast(SPAN)

    base = F.concat(F.filter(spans(0), lambda s: F.char_length(s["value"]) >= MIN_VALUE), spans(1), spans(2))
    judge = lambda u: ~F.rlike(u["value"], F.lit(f"{ASSIGN}|{ACCESS}|{HEX}"))
    return rows.select("doc_id", base.alias("base"), F.filter(spans(3), judge).alias("units"), "words")


def _steps(token: Column) -> Column:
    """Codes of the steps between the characters of a token; 0 is any character outside the alphabet."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.greatest(F.char_length(token) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: a * _SIDE + b)


def train(samples: DataFrame, token: str = "token", random: str = "random", rarity: float = 1e-2, smoothing: float = 0.5) -> Model:
    """Fit both models on labelled tokens (``random``: true for random strings, false for ordinary identifiers).

    What is gathered are two counts for each pair of characters. Without samples of a class its model is uniform;
    null tokens and labels are skipped, repeated rows count repeatedly. ``rarity`` is the share of random strings
    among judged runs that the decision assumes.
    """
    steps = samples.where(F.col(token).isNotNull() & F.col(random).isNotNull()).select(F.col(random).cast("boolean").alias("random"), F.explode(_steps(F.col(token))).alias("step"))
    counts = {(r["random"], r["step"]): r["n"] for r in steps.groupBy("random", "step").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratios = []
    for first in range(_SIDE):
        total = {y: sum(counts.get((y, first * _SIDE + i), 0) for i in range(_SIDE)) + smoothing * _SIDE for y in (True, False)}
        for i in range(first * _SIDE, (first + 1) * _SIDE):
            ratios.append(round(math.log((counts.get((True, i), 0) + smoothing) / total[True]) - math.log((counts.get((False, i), 0) + smoothing) / total[False]), 6))
    return Model(tuple(ratios), -math.log(rarity))


def log_ratio(token: Column, model: Model) -> Column:
    """Log-likelihood ratio of a token, random to ordinary."""
    return F.aggregate(_steps(token), F.lit(0.0), lambda acc, s: acc + F.get(model.table(), s))


def labelled(scanned: DataFrame, bound: int = 20_000) -> DataFrame:
    """``token, random``: different values of the base spans, and words of the sampled documents, at most ``bound`` of each.

    An ordinary identifier is a word that more than one document has, so that secrets yet unknown do not teach the
    model of identifiers; it counts in capitals too, since identifiers come in either case. Those of smallest hash are taken, so the same at every run.
    """
    some = lambda df: df.orderBy(F.xxhash64("token", F.lit("sample")), "token").limit(bound)
    fits = F.length("token").between(6, 256)
    values = scanned.select(F.explode("base.value").alias("token")).where(fits).distinct()
    words = scanned.where("words IS NOT NULL").select("doc_id", F.explode("words").alias("token")).where(fits & ~F.rlike("token", F.lit(f"{ACCESS}|{HEX}")))
    shared = words.groupBy("token").agg((F.min("doc_id") < F.max("doc_id")).alias("several")).where("several").select("token")
    cases = some(shared).select(F.explode(F.array("token", F.upper("token"))).alias("token"))
    return some(values).withColumn("random", F.lit(True)).unionByName(cases.withColumn("random", F.lit(False)))


def judged(scanned: DataFrame, model: Model) -> DataFrame:
    """``scanned`` with ``added``, the runs that the models take for secrets."""
    return scanned.withColumn("added", F.filter("units", lambda u: log_ratio(u["value"], model) > model.threshold))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 2000, bound: int = 20_000) -> tuple[DataFrame, Model]:
    """Scan all documents, once, and train: random strings are the values of base spans anywhere, ordinary identifiers the
    words that several of at most ``sample_docs`` documents have, those of smallest hash."""
    scanned = staged(scan(docs, key, text, sample_ids(docs, key, sample_docs)), "secret-spans")
    return scanned, train(labelled(scanned, bound))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 2000, bound: int = 20_000) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added`` for every row of ``docs``.

    Counts and digest are of the base spans; ``spans`` adds those of the models, ``kind:start:end`` by start, then kind.
    A run that holds a base span is not judged again. A null text is an empty one; repeated rows and null ids are kept;
    an empty table gives no rows; other columns are ignored.
    """
    scanned, model = fit(docs, key, text, sample_docs, bound)
    kinds = F.array(*map(F.lit, KINDS))
    names = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("k"), s["stop"].alias("b")))), lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["a"], s["b"])), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return judged(scanned, model).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(names(F.col("base")), 256).alias("base_sha256"),
        names(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def redacted(text: Column, model: Model) -> Column:
    """A text with every run of token characters that holds a secret replaced by a mark; null stays null.

    Assignments go first, with what stands before them without a break; then the runs that hold another base span or
    that the models take for random.
    """

    def swap(text: Column, gate: str, pattern: str, bad) -> Column:
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(bad(h), F.lit(MARK)).otherwise(h))
        return F.when(F.rlike(text, F.lit(gate)), F.array_join(F.zip_with(F.split(text, pattern, -1), hits, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")).otherwise(text)

    long_value = lambda h: F.char_length(F.regexp_extract(h, _TO_ASSIGN, 1)) >= MIN_VALUE
    text = swap(text, NAMES + r"""["']? *[:=]""", _TO_ASSIGN, long_value)
    random = lambda h: F.rlike(h, F.lit(f"{ACCESS}|{HEX}")) | (log_ratio(h, model) > model.threshold)
    return swap(text, _UNIT_GATE, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", random)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = 2000, bound: int = 20_000) -> DataFrame:
    """``docs`` with all columns and rows, secrets in the text replaced by a mark."""
    _, model = fit(docs, key, text, sample_docs, bound)
    return docs.withColumn(text, redacted(F.col(text).cast("string"), model))
