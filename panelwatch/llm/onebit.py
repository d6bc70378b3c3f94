"""Nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated at random and only the signs of its components are kept, packed, with one correction
scalar: its inner product with its own code. The inner product with a query is estimated from the code alone,
with an error bound that holds with high probability; only vectors whose bound reaches the k-th best found so far are
compared exactly. The stated queries meet all vectors in blocks, so each task holds two blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

CODED = "vec_id long, vector array<double>, code binary, fit double"


def rotation(n: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same for the same size and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and the inner product of each with its code."""
    y = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ turn.T
    return np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])


def estimate(codes: np.ndarray, fit: np.ndarray, queries: np.ndarray, turn: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (codes x queries) and the half-width of each code's bound."""
    n = queries.shape[1]
    q = (queries / np.sqrt((queries * queries).sum(axis=1, keepdims=True))) @ turn.T
    signs = np.unpackbits(codes, axis=1, count=n).astype(np.float32) * 2 - 1
    return (signs @ q.T.astype(np.float32)) / (np.sqrt(n) * fit)[:, None], confidence * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(max(1, n - 1))


def search_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, fit: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, confidence: float) -> Iterator[tuple[int, int, float]]:
    """``query, id, cosine`` of the k nearest of a block for each query, ties to the smaller id."""
    near, width = estimate(codes, fit, queries, turn, confidence)
    norms = np.sqrt((x * x).sum(axis=1))
    for j, (own, q) in enumerate(zip(query_ids, queries)):
        length = np.sqrt(q @ q)
        est = np.where(ids == own, -np.inf, near[:, j])
        first = np.argpartition(-est, min(4 * k, len(est) - 1))[: 4 * k]
        first = first[ids[first] != own]
        exact = np.sort((x[first] @ q) / (norms[first] * length))
        floor = exact[-k] if len(exact) >= k else -np.inf
        some = np.flatnonzero((est + width >= floor) & (ids != own))
        some = np.union1d(some, first)
        score = (x[some] @ q) / (norms[some] * length)
        for i in np.lexsort((ids[some], -score))[:k]:
            yield int(own), int(ids[some[i]]), float(score[i])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id, vector`` of rows with an id and a finite, non-zero vector of the most common size.

    Of rows that repeat an id the smallest vector counts.
    """
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL")
    v = v.where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    size = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vector") == (size["n"] if size else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, confidence: float = 3.0, block: int = 1 << 14, seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows by cosine of every row for which ``is_query`` holds.

    ``is_query`` is a condition on ``vec_id``. Null, zero and non-finite vectors, those of another size than most, and rows
    without an id take no part; fewer than k others are all returned; equal cosines go by id; other columns are ignored.
    ``confidence`` scales the bound: 1.9 misses few neighbours, 3 hardly any. Blocks have about
    ``block`` rows by a hash of the id, so vectors that crowd together are spread over all blocks.
    """
    rows = usable(vectors, key, vector)
    n = rows.count()
    size = len(rows.first()["vector"]) if n else 1
    turn = vectors.sparkSession.sparkContext.broadcast(rotation(size, seed))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                codes, fit = encode(np.stack(pdf["vector"]), turn.value)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "vector": pdf["vector"], "code": [c.tobytes() for c in codes], "fit": fit})

    asked = rows.where(is_query)
    m = asked.count()
    across, down = max(1, -(-n // block)), max(1, -(-m // block))
    place = lambda parts, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    base = rows.mapInPandas(code, CODED).withColumn("a", place(across, "rows")).select("*", every(down).alias("q"))
    wanted = asked.withColumn("q", place(down, "queries")).select("*", every(across).alias("a"))

    def compare(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(queries):
            codes = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
            ids, x, fit = own["vec_id"].to_numpy(np.int64), np.stack(own["vector"]), own["fit"].to_numpy(float)
            for i in range(0, len(queries), 256):
                some = queries.iloc[i : i + 256]
                found += search_block(ids, x, codes, fit, some["vec_id"].to_numpy(np.int64), np.stack(some["vector"]), turn.value, k, confidence)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = base.groupBy("a", "q").cogroup(wanted.groupBy("a", "q")).applyInPandas(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
