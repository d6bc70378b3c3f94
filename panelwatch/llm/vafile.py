"""Centroid clustering over a VA-file: vectors of whole numbers, compressed to a few bits per dimension.

Each dimension is cut into ``2^bits`` cells of about equal population; a vector's code is its cells, packed. For every round a
lookup table holds the least and largest squared distance of each cell to each centroid, so sums over a code's cells
bound the distances to all centroids. Where only one centroid's interval can hold the smallest distance, the code settles the vector; full
vectors are fetched, by a join on the row number, only where intervals overlap or where the vector moves to another
centroid, for sums change only by what moves. The first round moves everything and the last one reports distances, so
these two read codes and vectors side by side.

Everything is whole numbers: sums are exact in any order, and a lost task gives the same rows again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelwatch.llm.common import staged

#: Components beyond this have squared distances that no 64-bit number holds.
LARGEST = float(1 << 18)
_STEP = 4096


def whole_numbers(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, x``: floor(scale * component) of the vectors that take part, as packed 32-bit numbers."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    v = v.where((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= LARGEST)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.floor(scale * np.stack(pdf["v"])).astype("<i4")
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "x": [r.tobytes() for r in x]})

    return v.mapInPandas(run, "vec_id long, x binary")


def _rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), -1).astype(np.int64)


class Grid:
    """Cells of every dimension: cell c of dimension d holds the numbers from ``low[d, c]`` to ``high[d, c]``."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int):
        self.bits, n = bits, 1 << bits
        cuts = np.floor(np.quantile(sample, np.arange(1, n) / n, axis=0)).T.astype(np.int64)  # the last number of each cell but the last
        self.cuts = np.maximum.accumulate(np.clip(cuts, least[:, None] - 1, most[:, None]), axis=1)
        self.low = np.concatenate((least[:, None], self.cuts + 1), axis=1)
        self.high = np.concatenate((self.cuts, most[:, None]), axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[d], x[:, d]) for d in range(x.shape[1])], axis=1).astype(np.uint8)

    def pack(self, cells: np.ndarray) -> list[bytes]:
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [r.tobytes() for r in np.packbits(bits.reshape(len(cells), -1), axis=1)]

    def unpack(self, codes: pd.Series, dims: int) -> np.ndarray:
        packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        bits = np.unpackbits(packed, axis=1, count=dims * self.bits).reshape(len(codes), dims, self.bits)
        return (bits * (1 << np.arange(self.bits - 1, -1, -1, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)


class Bounds:
    """Lookup tables of one round: intervals of the squared distance of each cell of each dimension to each centroid.

    With m the middle of the centroids, |x - c|^2 is |x - m|^2, the same for all centroids, and 2 (x - m)(m - c) + |c - m|^2. The
    intervals are of the latter, which is linear in x and so has its ends at the ends of a cell: they order centroids
    as distances do, but do not carry the spread of |x - m|^2 within a cell.
    """

    def __init__(self, grid: Grid, centroids: np.ndarray):
        self.grid, self.centroids = grid, centroids
        middle = centroids.sum(axis=0) // len(centroids)
        off = (centroids - middle).T[:, None, :]
        at_low, at_high = (off * off - 2 * (ends - middle[:, None])[:, :, None] * off for ends in (grid.low, grid.high))
        self.least, self.most = np.minimum(at_low, at_high), np.maximum(at_low, at_high)

    def candidates(self, codes: pd.Series) -> np.ndarray:
        """rows x centroids: whether a centroid's interval reaches down to the smallest upper bound."""
        dims, _, k = self.least.shape
        out = np.zeros((len(codes), k), bool)
        for i in range(0, len(codes), _STEP):
            cells = self.grid.unpack(codes.iloc[i : i + _STEP], dims)
            low, high = np.zeros((len(cells), k), np.int64), np.zeros((len(cells), k), np.int64)
            for d in range(dims):
                low += self.least[d][cells[:, d]]
                high += self.most[d][cells[:, d]]
            out[i : i + _STEP] = low <= high.min(axis=1, keepdims=True)
        return out

    def exact(self, x: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the candidates the nearest centroid of every vector, ties to the smaller number, and its squared distance."""
        best, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for i in range(0, len(x), _STEP):
            part, mask = x[i : i + _STEP], some[i : i + _STEP]
            r, c = np.nonzero(mask)
            d = np.full(mask.shape, np.iinfo(np.int64).max)
            for j in range(0, len(r), 1 << 15):
                a, b = r[j : j + (1 << 15)], c[j : j + (1 << 15)]
                d[a, b] = ((part[a] - self.centroids[b]) ** 2).sum(axis=1)
            best[i : i + _STEP] = d.argmin(axis=1)
            far[i : i + _STEP] = d.min(axis=1)
        return best, far


class _Sums:
    """What moves: the components that centroids gain and lose, and how many vectors."""

    def __init__(self, k: int, dims: int):
        self.total = np.zeros((k, dims + 1), np.int64)

    def add(self, cluster: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
        np.add.at(self.total, cluster, sign * np.concatenate((x, np.ones((len(x), 1), np.int64)), axis=1))

    def frames(self) -> Iterator[pd.DataFrame]:
        some = np.flatnonzero(self.total.any(axis=1))
        if len(some):
            yield pd.DataFrame({"row": None, "code": None, "cluster": some, "sums": list(self.total[some])}, columns=["row", "code", "cluster", "sums"])


_STATE = "row long, code binary, cluster int, sums array<bigint>"


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", bits: int = 6, sample: int = 4096) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: one row per vector that takes part.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``seed:id`` (all, if there are fewer; rows without an id come last).
    In each round vectors go to the nearest centroid (ties: the smaller number), then every centroid that has vectors becomes the floor of their mean; after the
    last round they are assigned once more. Vectors of another size, with null or non-finite components or with components beyond 2^18 in size
    take no part; repeated rows and rows without an id do; an empty table gives no rows. Other columns are ignored.

    ``sample`` rows at most, those of smallest hash, place the cells; any placement gives the same result.
    """
    spark = vectors.sparkSession
    share = spark.sparkContext.broadcast
    whole = staged(whole_numbers(vectors, key, vector, dims, scale).withColumn("row", F.monotonically_increasing_id()), "va-vectors")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.orderBy(named.asc_nulls_last(), "vec_id", "x").select("x").limit(k).toPandas()
    out_schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(first):
        return spark.createDataFrame([], out_schema)
    centroids = _rows(first["x"])
    k = len(centroids)

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _rows(pdf["x"])
                yield pd.DataFrame({"d": np.arange(dims), "low": x.min(axis=0), "high": x.max(axis=0)})

    ends = whole.select("x").mapInPandas(extremes, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").toPandas()
    drawn = _rows(whole.orderBy(F.xxhash64("x", "vec_id"), "row").select("x").limit(sample).toPandas()["x"])
    shared_grid = share(Grid(drawn, ends["low"].to_numpy(), ends["high"].to_numpy(), bits))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(code=shared_grid.value.pack(shared_grid.value.cells(_rows(pdf["x"]))))

    base = staged(whole.select("vec_id", "row", "x").mapInPandas(code, "vec_id long, row long, x binary, code binary"), "va-file")

    def all_rows(bounds) -> DataFrame:
        """First round: every vector joins the sums of its centroid."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = _Sums(k, dims)
            for pdf in batches:
                if len(pdf):
                    x = _rows(pdf["x"])
                    best, _ = bounds.value.exact(x, bounds.value.candidates(pdf["code"]))
                    sums.add(best, x)
                    yield pd.DataFrame({"row": pdf["row"], "code": pdf["code"], "cluster": best, "sums": None})
            yield from sums.frames()

        return staged(base.select("row", "code", "x").mapInPandas(run, _STATE), "va-round")

    def marked_rows(state: DataFrame, bounds) -> DataFrame:
        """Later rounds, codes only: ``settled`` where one centroid is left and it is the same as before; else the candidates."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    some = bounds.value.candidates(pdf["code"])
                    settled = (some.sum(axis=1) == 1) & some[np.arange(len(pdf)), pdf["cluster"]]
                    mask = np.packbits(some, axis=1)
                    yield pdf.assign(settled=settled, mask=[None if s else m.tobytes() for s, m in zip(settled, mask)])

        return staged(state.select("row", "code", "cluster").mapInPandas(run, "row long, code binary, cluster int, settled boolean, mask binary"), "va-marked")

    def fetched_rows(marked: DataFrame, bounds) -> DataFrame:
        """Full vectors of the others: their centroid, and the sums that change."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = _Sums(k, dims)
            for pdf in batches:
                if len(pdf):
                    x = _rows(pdf["x"])
                    some = np.unpackbits(np.frombuffer(b"".join(pdf["mask"]), np.uint8).reshape(len(pdf), -1), axis=1, count=k).astype(bool)
                    best, _ = bounds.value.exact(x, some)
                    before = pdf["cluster"].to_numpy(np.int64)
                    moved = best != before
                    sums.add(best[moved], x[moved])
                    sums.add(before[moved], x[moved], -1)
                    yield pd.DataFrame({"row": pdf["row"], "code": pdf["code"], "cluster": best, "sums": None})
            yield from sums.frames()

        open_rows = marked.where("NOT settled").select("row", "code", "cluster", "mask").join(base.select("row", "x"), "row")
        return staged(open_rows.select("row", "code", "cluster", "mask", "x").mapInPandas(run, _STATE), "va-round")

    total = np.zeros((k, dims + 1), np.int64)
    state = None
    for _ in range(rounds):
        bounds = share(Bounds(shared_grid.value, centroids))
        if state is None:
            changed = all_rows(bounds)
            state = changed.where("row IS NOT NULL")
        else:
            marked = marked_rows(state, bounds)
            changed = fetched_rows(marked, bounds)
            state = marked.where("settled").select("row", "code", "cluster").unionByName(changed.where("row IS NOT NULL").select("row", "code", "cluster"))
        # one row of dims + 1 sums for each centroid that changes
        for r in changed.where("sums IS NOT NULL").groupBy("cluster").agg(*(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims + 1))).collect():
            total[r["cluster"]] += np.array(r[1:], np.int64)
        filled = total[:, dims] > 0
        centroids = centroids.copy()
        centroids[filled] = total[filled, :dims] // total[filled, dims:]

    bounds = share(Bounds(shared_grid.value, centroids))

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                best, far = bounds.value.exact(_rows(pdf["x"]), bounds.value.candidates(pdf["code"]))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": best, "distance": far})

    final = staged(base.select("vec_id", "code", "x").mapInPandas(report, "vec_id long, cluster int, distance long"), "va-final")
    inertia = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(c, s, sum(inertia.values()), digest(centroids[c])) for c, s in sorted(inertia.items())]
    named_facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(named_facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
