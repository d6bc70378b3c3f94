"""Language identification by nearest centroid.

A text is a unit vector of TF-IDF weights of its hashed letter n-grams (one to three characters, words apart).
Each language has several centroids, found by clustering vectors of its labelled texts on the sphere. A text gets
the language of the centroid of largest cosine; one that is further from it than labelled texts of that centroid
are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelwatch.llm.common import staged

BUCKETS = 4096
STEP = 1 << 20
UNKNOWN = "und"
_U = np.uint32
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters (combining marks count, so that decomposed accents keep words together)."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() or 0x300 <= i < 0x370 for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, worked through in steps; all zero if it has no letter."""
    total = np.zeros(buckets, np.int64)
    if not text:
        return total
    letters = letter_table()
    for i in range(0, len(text), STEP):
        # a step sees two characters of the one before, whose n-grams it does not count again
        c = np.frombuffer(text[max(0, i - 2) : i + STEP].lower().encode("utf-32-le"), _U)
        c = np.where(letters[c], c, _U(0))
        c = np.concatenate((np.zeros(2 * (i == 0), _U), c, np.zeros(int(i + STEP >= len(text)), _U)))
        one, two, three = c[2:], c[1:-1], c[:-2]
        h = one * _U(0x9E3779B1)
        parts = [h[one > 0]]
        h = (h ^ (h >> _U(15))) * _U(0x85EBCA6B) + two * _U(0xC2B2AE35)
        parts.append(h[(one > 0) | (two > 0)] ^ _U(0x5BD1E995))
        h = (h ^ (h >> _U(13))) * _U(0x27D4EB2F) + three * _U(0x165667B1)
        parts.append(h[(two > 0) & ((one > 0) | (three > 0))] ^ _U(0x1B873593))
        h = np.concatenate(parts)
        h = (h ^ (h >> _U(16))) * _U(0x7FEB352D)
        total += np.bincount((h >> _U(7)) % _U(buckets), minlength=buckets)
    return total


def vector(n: np.ndarray, idf: np.ndarray) -> np.ndarray | None:
    v = np.log1p(n) * idf
    norm = np.sqrt((v * v).sum())
    return v / norm if norm > 0 else None


SIZES = 32


def size_class(n: np.ndarray) -> int:
    """Power of two of the number of different n-grams: a short text is far from every centroid."""
    return int(np.count_nonzero(n)).bit_length()


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # one per row, of length 1
    floors: np.ndarray  # smallest cosine that is not rejected, of each centroid and size of text
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is too far from every centroid."""
        n = counts(text, len(self.idf))
        v = vector(n, self.idf)
        if v is None or not self.languages:
            return UNKNOWN, 0.0, True
        near = self.centroids @ v
        best = int(near.argmax())
        return self.languages[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < self.floors[best, size_class(n)])


def _cluster(x: np.ndarray, k: int, rounds: int = 20, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and each row's cosine to its own."""
    r = np.random.default_rng(seed)
    c = x[[int(r.integers(len(x)))]]
    while len(c) < min(k, len(x)):  # start far apart
        c = np.concatenate((c, x[[int((x @ c.T).max(axis=1).argmin())]]))
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.array([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    near = x @ c.T
    return c, near


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 1000, clusters: int = 3, margin: float = 0.4, buckets: int = BUCKETS) -> Model:
    """Fit on rows with a text and a language.

    Document frequencies cover all of these rows: one count per bucket and task. The centroids of a language are
    fitted on at most ``sample`` of its rows, those of smallest hash of the id, as vectors of fixed size, so a
    language is one bounded group whatever its share and however long its texts. The floor of
    a language is ``margin`` times the smallest cosine of its sampled rows of about the same size (sizes without any take the floor
    of the next smaller ones), so that only what is far from all that was labelled is rejected.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    hashed = rows.select("id", "lang", F.xxhash64("id", F.lit("sample")).alias("h"))
    # first within parts of a language, so that no task gets the candidates that all tasks have of one language
    for part in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        hashed = hashed.withColumn("r", F.row_number().over(Window.partitionBy(*part).orderBy("h", "id"))).where(F.col("r") <= sample)
    picked = hashed
    ids = staged(picked.select("lang", "id").distinct(), "sample")
    chosen = docs.sparkSession.sparkContext.broadcast({(r[0], r[1]) for r in ids.collect()})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(buckets, np.int64)
        for pdf in batches:
            for d, t, lang in zip(pdf["id"], pdf["text"], pdf["lang"]):
                c = counts(t, buckets)
                if not c.any():
                    continue
                n += 1
                df += c > 0
                if (lang, d) in chosen.value:
                    yield pd.DataFrame({"lang": [lang], "id": [d], "n": [1], "v": [c.astype(np.float32)]})
        yield pd.DataFrame({"lang": [None], "id": [None], "n": [n], "v": [df.astype(np.float32)]})

    found = staged(rows.mapInPandas(count, "lang string, id string, n long, v array<float>"), "language-vectors")
    frequency = found.where("lang IS NULL").select("n", F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("x"), F.sum("n").alias("n")).toPandas()
    df, total = np.zeros(buckets), float(frequency["n"].max() if len(frequency) else 0)
    df[frequency["i"]] = frequency["x"]
    idf = np.log((1 + total) / (1 + df)) + 1

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates("id").head(sample)
        x = np.empty((len(pdf), buckets), np.float32)
        for i, v in enumerate(pdf["v"]):
            x[i] = vector(np.asarray(v, float), idf)
        c, near = _cluster(x, clusters)
        best, size = near.max(axis=1), np.array([size_class(np.asarray(v)) for v in pdf["v"]])
        floors = [best.min()]
        for i in range(1, SIZES):
            floors.append(best[size == i].min() if (size == i).any() else floors[-1])
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "i": range(len(c)), "floor": [margin * np.array(floors)] * len(c), "c": list(c)})

    fitted = found.where("lang IS NOT NULL").groupBy("lang").applyInPandas(fit, "lang string, i int, floor array<double>, c array<double>").orderBy("lang", "i").collect()
    return Model([r["lang"] for r in fitted], np.array([r["c"] for r in fitted]).reshape(-1, buckets), np.array([r["floor"] for r in fitted]).reshape(-1, SIZES), idf)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_lang`` (in place of one of that name) of ``lang_pred, score, rejected`` for every whole text.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. Ties go to the first centroid,
    languages in order of name. Repeated rows and nulls in other columns make no difference.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([share.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("_lang", predict(F.col(text).cast("string")))


def held_out(key: str = "doc_id"):
    """The fifth of the ids that is kept from training."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0
