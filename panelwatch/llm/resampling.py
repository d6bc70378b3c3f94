"""Quality selection by importance resampling.

Two generative models over hashed words and word pairs, one of target text and one of all raw text, give every
document the log ratio of its probabilities. Adding Gumbel noise and keeping the largest k sums is sampling k
documents without replacement in proportion to the ratios.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelwatch.llm.common import bounded_batches, by_row, chunks_of_words, sample_ids, staged

BUCKETS = 10_000


def features(text: str | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all words and pairs of neighbouring words, in steps for long texts."""
    last = None
    for words in chunks_of_words(text or ""):
        h = np.array([zlib.crc32(w) for w in words], np.uint64)
        if last is not None:
            h = np.concatenate((last, h))
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) % np.uint64(4294967291) % np.uint64(buckets)
        single = h[last is not None :] % np.uint64(buckets)
        last = h[-1:]
        yield np.concatenate((single, pairs)).astype(np.int64)


def log_ratios(docs: DataFrame, target_ids: list, buckets: int = BUCKETS, prior: float = 1.0) -> np.ndarray:
    """Log probability of each bucket in the target less that in all texts. The counts cover all rows of ``docs``.

    Each task sends one count per bucket; ``target_ids`` is bounded by its caller.
    """
    share = docs.sparkSession.sparkContext.broadcast(frozenset(target_ids))
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                mine = d is not None and int(d) in share.value
                for f in features(t, buckets):
                    n = np.bincount(f, minlength=buckets)
                    raw += n
                    if mine:
                        target += n
        yield pd.DataFrame({"bucket": np.arange(buckets, dtype=np.int32), "raw": raw, "target": target})

    totals = docs.mapInPandas(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[totals["bucket"]], target[totals["bucket"]] = totals["raw"], totals["target"]
    return np.log((target + prior) / (target.sum() + prior * buckets)) - np.log((raw + prior) / (raw.sum() + prior * buckets))


def kth_largest(df: DataFrame, column: str, k: int, cells: int = 1024, few: int = 2000) -> float | None:
    """The k-th largest value, exactly: count by cells, go into the cell that holds it, and repeat until few values are left."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    if k >= n:
        return lo
    inside = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    while lo < hi and n > few:
        width = (hi - lo) / cells
        cell = F.least(F.floor((F.col("v") - lo) / width), F.lit(cells - 1)).cast("int") if width > 0 else F.lit(0)
        counts = inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(F.desc("c")).collect()
        for row in counts:
            if k <= row["n"]:
                break
            k -= row["n"]
        lo, hi, n = row["lo"], row["hi"], row["n"]
        inside = inside.where(F.col("v").between(lo, hi))
    return lo if lo == hi else sorted((r[0] for r in inside.collect()), reverse=True)[k - 1]


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.8, key: str = "doc_id", text: str = "text", target: str = "quality = 1 AND coalesce(toxic, 0) = 0", max_target: int = 20_000, per_features: float = 200.0, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """``doc_id, log_weight, sample_key``: the sampled documents, ``fraction`` of all rows.

    The target model is fitted on at most ``max_target`` labelled documents, those of smallest hash (the bound
    keeps the list of ids that is broadcast small); the raw model on all documents. A document's log weight is
    its mean log ratio times ``per_features``: as if each had that many words and pairs, so that long
    documents are not certain to be in or out. The Gumbel noise is drawn from a hash of the id, so a task
    that runs again draws the same.

    Null and empty texts have weight 0 before the noise; rows that tie with the last one chosen are kept
    (repeated ids have the same noise); without labels every log weight is 0; other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = sample_ids(labels.where(target), key, max_target)
    ratios = log_ratios(rows, ids, buckets) if ids else np.zeros(buckets)
    share = docs.sparkSession.sparkContext.broadcast(ratios)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(d, t):
            total, n = 0.0, 0
            for f in features(t, buckets):
                total, n = total + share.value[f].sum(), n + len(f)
            return [(d, per_features * total / n if n else 0.0)]

        yield from by_row(one, batches, ["doc_id", "log_weight"])

    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit("")), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = staged(rows.mapInPandas(weigh, "doc_id string, log_weight double").withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    last = kth_largest(scored, "sample_key", int(np.ceil(fraction * scored.count())))
    return scored.where(F.col("sample_key") >= F.lit(last) if last is not None else F.lit(False)).withColumn("doc_id", F.col("doc_id").cast("long"))
