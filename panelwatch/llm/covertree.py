"""Vectors that are alike, by a cover tree and a traversal of pairs of its nodes: all pairs with a cosine of ``threshold`` or more, exactly.

Unit vectors at chord distance ``tau = sqrt(2 - 2 threshold)`` or less are linked. Levels of a tree are nested nets with
halving radii: every point is within the radius of a centre of its level, centres stay centres further down, and each node
knows its covering radius, the distance to its farthest point. A pair of nodes goes no further if their centres are farther
apart than both radii and ``tau``; it needs no descent either if all of its points must be linked. Other pairs split.

The upper levels are a net of a bounded sample (``sample``) with at most ``most`` centres; every vector belongs to its nearest
centre and, by its distance, to a ring around it. Rings whose distance intervals keep them farther than ``tau`` apart never
meet. The innermost ring, ``tau / 2``, needs no comparison: all of it is linked. Cells, that is rings of a centre, are cut into
blocks of at most about ``block`` vectors, each block is a tree of its own, built once, and the blocks of cells that may
touch are traversed in pairs, one task row a pair. A pair of blocks returns sums of links and a spanning forest, never its pairs,
so a large group of near copies costs its rows; equal vectors are one row with a count from the start.

Where vectors have no structure (random directions), no bound can tell nodes apart and the traversal is a product
of matrices over all pairs of centres; the more they crowd, the less is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelwatch.llm import simhash
from panelwatch.llm.common import staged

RADII = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125)
RINGS = len(RADII)
#: Slack of the bounds, above the rounding of single precision; what is near the threshold is decided in double precision.
SLACK = 4e-3
_CHUNK = 1 << 22


def finite(column) -> F.Column:
    """Whether a vector holds no null and no non-finite component, and one that is not zero."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors brought to a moderate size by powers of two, which changes no cosine, and their lengths."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = np.ldexp(x, -np.frexp(top)[1])
    return x, np.sqrt((x * x).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    x, length = scaled(x)
    return x / length[:, None]


def net(g: np.ndarray, centres: list[int], radius: float) -> list[int]:
    """The centres and as many further points, in order, as are needed to have every point within ``radius`` of one; ``g`` holds all cosines."""
    least = 1 - radius * radius / 2
    centres = list(centres)
    covered = (g[centres] >= least).any(axis=0)
    covered[centres] = True
    at = 0
    while True:
        rest = np.flatnonzero(~covered[at : at + 512])
        if not len(rest):
            at += 512
            if at >= len(covered):
                return centres
            continue
        i = at + int(rest[0])
        centres.append(i)
        covered |= g[i] >= least
        covered[i] = True
        at = i


class Tree:
    """A block of vectors in the order of its tree: nodes of a level are ranges of rows."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.ids, self.weights, self.x, self.levels = ids, weights, x, levels
        self.u = unit(x.astype(np.float64))
        self.u32 = self.u.astype(np.float32)
        self.sums = np.concatenate(([0], np.cumsum(weights)))

    @classmethod
    def build(cls, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> Tree:
        u = unit(x.astype(np.float64)).astype(np.float32)
        n = len(u)
        g = u @ u.T

        def nearest(centres: list[int]) -> np.ndarray:
            """The place among the centres of the one nearest to each point; a centre is its own."""
            at = np.zeros(n, np.int64) if len(centres) == 1 else np.arange(n) if len(centres) == n else np.concatenate([g[i : i + 256][:, centres].argmax(axis=1) for i in range(0, n, 256)])
            at[centres] = np.arange(len(centres))
            return at

        nets, parents = [[0]], []
        for radius in RADII:
            if len(nets[-1]) == n:
                break
            nets.append(net(g, nets[-1], radius))
            above = nearest(nets[-2])
            parents.append(above[nets[-1]])
        at = nearest(nets[-1])
        paths = [at]
        for above in reversed(parents):
            paths.append(above[paths[-1]])
        order = np.lexsort(paths)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        levels = []
        for centres, path in zip(nets, reversed(paths)):
            of = np.asarray(centres)[path[order]]
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            far = np.sqrt(np.maximum(0, 2 - 2 * g[order, of]))
            levels.append((starts, place[of[starts]], np.maximum.reduceat(far, starts)))
        return cls(ids[order], weights[order], x[order], levels)

    def pack(self) -> bytes:
        out = BytesIO()
        np.savez(out, ids=self.ids, weights=self.weights, x=self.x, **{f"{k}{i}": a for i, level in enumerate(self.levels) for k, a in zip("scr", level)})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        a = np.load(BytesIO(data))
        return cls(a["ids"], a["weights"], a["x"], [(a[f"s{i}"], a[f"c{i}"], a[f"r{i}"]) for i in range(sum(k[0] == "s" for k in a.files))])

    def ends(self, level: int) -> np.ndarray:
        return np.append(self.levels[level][0][1:], len(self.ids))

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last child of every node of a level, at the next one (-1: the root); a node of the last level is its own child."""
        if level < 0:
            return np.zeros(1, np.int64), np.ones(1, np.int64)
        starts = self.levels[min(level, len(self.levels) - 1)][0]
        if level + 1 >= len(self.levels):
            return np.arange(len(starts)), np.arange(1, len(starts) + 1)
        below = self.levels[level + 1][0]
        return np.searchsorted(below, starts), np.searchsorted(below, self.ends(level))


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = last - first
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _expand(p: np.ndarray, q: np.ndarray, a: tuple, b: tuple, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Members of the pairs of ranges: lists of pairs (true), or two lists that meet in all pairs (false).

    With ``own`` both sides are one and lists that meet may give a pair both ways; it counts with its smaller member first.
    """
    single = (a[1][p] - a[0][p] == 1) & (b[1][q] - b[0][q] == 1)
    if single.any():
        yield a[0][p[single]], b[0][q[single]], True
    p, q = p[~single], q[~single]
    order = np.argsort(p, kind="stable")
    p, q = p[order], q[order]
    cuts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True]))) if len(p) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1], cuts[1:]):
        left, right = np.arange(a[0][p[i]], a[1][p[i]]), _spread(b[0][q[i:j]], b[1][q[i:j]])
        step = max(1, _CHUNK // len(left))
        for k in range(0, len(right), step):
            yield left, right[k : k + step], False


def _dots(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = max(1, _CHUNK // u.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", u[i[k : k + step]], v[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0, u.dtype)])


def _cosines(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, dot: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that reach the threshold; close ones are decided by the plain formula."""
    some = dot >= threshold - 1e-9
    i, j, dot = i[some], j[some], dot[some].astype(np.float64)
    close = np.flatnonzero(np.abs(dot - threshold) <= 1e-9)
    if len(close):
        (x, nx), (y, ny) = scaled(a.x[i[close]].astype(np.float64)), scaled(b.x[j[close]].astype(np.float64))
        dot[close] = (x * y).sum(axis=1) / (nx * ny)
    some = dot >= threshold
    return i[some], j[some], dot[some]


def traverse(a: Tree, b: Tree, threshold: float, own: bool, whole: bool = True) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[tuple[int, np.ndarray, np.ndarray]], int]:
    """Links of two blocks (``own``: of one): lists ``row of a, row of b, cosine``, node pairs ``level, node of a, node of b``
    all of whose points are linked (only if ``whole``), and how many distances were computed."""
    tau = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    depth = max(len(a.levels), len(b.levels))
    p = q = np.zeros(1, np.int64)
    links, inside, seen = [], [], 0
    for level in range(-1, depth - 1):
        la, lb = min(level + 1, len(a.levels) - 1), min(level + 1, len(b.levels) - 1)
        (_, ca, ra), (_, cb, rb) = a.levels[la], b.levels[lb]
        ps, qs = [], []
        for i, j, listed in _expand(p, q, a.children(level), b.children(level), own):
            if listed:
                dot, sums = _dots(a.u32, b.u32, ca[i], cb[j]), ra[i] + rb[j]
            else:
                dot, sums = a.u32[ca[i]] @ b.u32[cb[j]].T, ra[i][:, None] + rb[j]
            seen += dot.size
            far = np.sqrt(np.maximum(0, 2 - 2 * dot))
            near = far <= sums + (tau + SLACK)
            if own and not listed:
                near &= i[:, None] <= j
            done = near & (far + sums <= tau - SLACK) if whole else None
            if whole and done.any():
                near &= ~done
                at = np.nonzero(done)
                inside.append((la, lb, i[at[0]], j[at[0]] if listed else j[at[1]]))
            at = np.nonzero(near)
            ps.append(i[at[0]])
            qs.append(j[at[0]] if listed else j[at[1]])
        p, q = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ps, qs))
        if not len(p):
            return links, inside, seen
    last = lambda t: (t.levels[-1][0], t.ends(len(t.levels) - 1))
    for i, j, listed in _expand(p, q, last(a), last(b), own):
        if listed:
            dot = _dots(a.u, b.u, i, j)
        else:
            dot = a.u[i] @ b.u[j].T
            at = np.nonzero(dot >= threshold - 1e-9)
            seen += dot.size - len(at[0])
            i, j, dot = i[at[0]], j[at[1]], dot[at]
        seen += len(i)
        if own:
            some = i < j
            i, j, dot = i[some], j[some], dot[some]
        links.append(_cosines(a, b, i, j, dot, threshold))
    return links, inside, seen


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` nodes reaches over the edges."""
    label = np.arange(n)
    while len(u):
        x, y = label[u], label[v]
        some = x != y
        if not some.any():
            break
        u, v, x, y = u[some], v[some], x[some], y[some]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def sums_and_forest(a: Tree, b: Tree, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two blocks: weights linked to each row of a and of b, and edges ``id, id`` that join what is linked."""
    links, inside, _ = traverse(a, b, threshold, own)
    na, nb = len(a.ids), len(b.ids)
    shift = 0 if own else na
    more_a, more_b = np.zeros(na + 1, np.int64), np.zeros(nb + 1, np.int64)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, _ in links:
        np.add.at(more_a, i, b.weights[j])
        np.add.at(more_b, j, a.weights[i])
        us.append(i)
        vs.append(j + shift)
    if own:
        more_a[:-1] += more_b[:-1]
    range_a, range_b = np.zeros(na + 1, np.int64), np.zeros(nb + 1, np.int64)
    joined: dict[tuple[int, int], list[np.ndarray]] = {}
    for la, lb, p, q in inside:
        (sa, ca, _), (sb, cb, _) = a.levels[la], b.levels[lb]
        ea, eb = a.ends(la), b.ends(lb)
        wa, wb = a.sums[ea[p]] - a.sums[sa[p]], b.sums[eb[q]] - b.sums[sb[q]]
        np.add.at(range_a, sa[p], wb)
        np.add.at(range_a, ea[p], -wb)
        both = ~(p == q) if own else np.ones(len(p), bool)  # a node with itself counts once
        target = range_a if own else range_b
        np.add.at(target, sb[q[both]], wa[both])
        np.add.at(target, eb[q[both]], -wa[both])
        us.append(ca[p])
        vs.append(cb[q] + shift)
        joined.setdefault((0, la), []).append(p)
        joined.setdefault((0 if own else 1, lb), []).append(q)
        if own:  # a row is in its own node, but not linked to itself
            p = p[~both]
            rows = _spread(sa[p], ea[p])
            more_a[rows] -= a.weights[rows]
    for (side, level), nodes in joined.items():
        tree, by = (b, shift) if side else (a, 0)
        nodes = np.unique(np.concatenate(nodes))
        first, last = tree.levels[level][0][nodes], tree.ends(level)[nodes]
        us.append(_spread(first, last) + by)
        vs.append(np.repeat(tree.levels[level][1][nodes], last - first) + by)
    label = _roots(na + (0 if own else nb), np.concatenate(us), np.concatenate(vs))
    ids = a.ids if own else np.concatenate((a.ids, b.ids))
    some = np.flatnonzero(label != np.arange(len(label)))
    return more_a[:-1] + np.cumsum(range_a)[:-1], (np.zeros(nb, np.int64) if own else more_b[:-1] + np.cumsum(range_b)[:-1]), ids[some], ids[label[some]], ids


def pivots(u: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample that are the centres of the upper levels: whole nets while they have at most ``most``, then a part of the next."""
    g = u @ u.T
    centres = [0]
    for radius in RADII:
        finer = net(g, centres, radius)
        if len(finer) >= most:
            return u[finer[:most]]
        centres = finer
    return u[centres]


class _Blocks:
    """The vectors of one size, dealt to blocks, and the pairs of blocks that may hold links."""

    def __init__(self, classes: DataFrame, n: int, size: int, threshold: float, block: int, sample: int, most: int, whole: bool = True):
        spark = classes.sparkSession
        self.tau = tau = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        rows, block = (max(64, min(x, (1 << 22) // size)) for x in (sample, block))
        drawn = np.array([r[0] for r in classes.orderBy(F.xxhash64("c", F.lit("pivots")), "c").select("vector").limit(rows).collect()], np.float64)
        centres = pivots(unit(drawn), min(most, max(1, -(-n // block))))
        edges = np.array([tau / 2 - SLACK, *(r for r in reversed(RADII) if r > tau / 2)])
        shared = spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i in range(0, len(pdf), 4096):
                    part = pdf.iloc[i : i + 4096]
                    u = unit(np.stack(part["vector"]).astype(np.float64))
                    dot = u @ shared.value.T
                    at = dot.argmax(axis=1)
                    far = np.sqrt(((u - shared.value[at]) ** 2).sum(axis=1))
                    yield part[["c", "m", "vector"]].assign(cell=at * (RINGS + 2) + np.searchsorted(edges, far), far=far)

        kind = classes.schema["vector"].dataType.simpleString()
        self.placed = staged(classes.select("c", "m", "vector").mapInPandas(place, f"c long, m long, vector {kind}, cell long, far double"), "cover-placed")
        cells = self.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("w"), F.min("far").alias("low"), F.max("far").alias("high"), F.min("c").alias("one")).toPandas().sort_values("cell", ignore_index=True)
        cells["parts"] = -(-cells["n"] // block)

        # cells in pairs: apart, all linked, or to be traversed; at most (most x rings)^2 / 2 numbers
        of, ring = cells["cell"].to_numpy() // (RINGS + 2), cells["cell"].to_numpy() % (RINGS + 2)
        low, high = cells["low"].to_numpy(), cells["high"].to_numpy()
        x, y = np.triu_indices(len(cells))
        d = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))[of[x], of[y]]
        least = np.maximum(d - high[x] - high[y], np.maximum(low[x] - d - high[y], low[y] - d - high[x]))
        linked = d + high[x] + high[y] <= tau - SLACK
        linked |= (x == y) & (ring[x] == 0)  # any two points within half of tau
        linked &= whole
        touch = (least <= tau + SLACK) & ~linked
        w, one = cells["w"].to_numpy(), cells["one"].to_numpy()
        extra = np.zeros(len(cells), np.int64)
        np.add.at(extra, x[linked], w[y[linked]])
        two = linked & (x != y)
        np.add.at(extra, y[two], w[x[two]])
        joins = np.bincount(np.concatenate((x[linked], y[linked])), minlength=len(cells)) > 0
        inner = np.bincount(x[linked & (x == y)], minlength=len(cells)) > 0
        table = pd.DataFrame({"cell": cells["cell"], "parts": cells["parts"], "extra": extra, "inner": inner, "joins": joins, "one": one})
        self.cells = F.broadcast(spark.createDataFrame(table, "cell long, parts long, extra long, inner boolean, joins boolean, one long"))  # at most most x rings rows
        self.ties = [(int(one[i]), int(one[j])) for i, j in zip(x[two], y[two])]
        c = cells["cell"].to_numpy()
        self.touching = spark.createDataFrame(pd.DataFrame({"ca": c[x[touch]], "cb": c[y[touch]], "d": d[touch]}), "ca long, cb long, d double")

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf["vector"])
            tree = Tree.build(pdf["c"].to_numpy(np.int64), pdf["m"].to_numpy(np.int64), x)
            return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "part": [pdf["part"].iloc[0]], "low": [pdf["far"].min()], "high": [pdf["far"].max()], "tree": [tree.pack()]})

        dealt = self.placed.join(self.cells.select("cell", "parts"), "cell").withColumn("part", F.pmod(F.xxhash64("c"), "parts"))
        blocks = dealt.select("c", "m", "vector", "cell", "part", "far").groupBy("cell", "part").applyInPandas(build, "cell long, part long, low double, high double, tree binary")
        self.blocks = staged(blocks.withColumn("block", F.monotonically_increasing_id()), "cover-blocks")

    def map_pairs(self, fn, schema: str) -> DataFrame:
        """``fn(tree, tree, own)`` gives the rows of each pair of blocks whose bounds let them touch."""
        side = lambda s: self.blocks.select(*(F.col(c).alias(f"{c}_{s}") for c in ("cell", "block", "low", "high")))
        met = self.touching.join(side("a"), F.col("ca") == F.col("cell_a")).join(side("b"), F.col("cb") == F.col("cell_b"))
        met = met.where((F.col("ca") != F.col("cb")) | (F.col("block_a") <= F.col("block_b")))
        met = met.where(F.greatest(F.col("d") - F.col("high_a") - F.col("high_b"), F.col("low_a") - F.col("d") - F.col("high_b"), F.col("low_b") - F.col("d") - F.col("high_a")) <= self.tau + SLACK)
        tree = lambda s: self.blocks.select(F.col("block").alias(f"block_{s}"), F.col("tree").alias(f"tree_{s}"))
        pairs = met.select("block_a", "block_b").join(tree("a"), "block_a").join(tree("b"), "block_b")
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a, b, x, y in zip(pdf["block_a"], pdf["block_b"], pdf["tree_a"], pdf["tree_b"]):
                    left = Tree.unpack(x)
                    yield pd.DataFrame(dict(zip(names, fn(left, left if a == b else Tree.unpack(y), a == b))))

        return pairs.select("block_a", "block_b", "tree_a", "tree_b").mapInPandas(run, schema)


def _classes(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """All rows with the class of equal vectors they belong to, the classes, and how many classes each size of vector has."""
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    ok = finite("vector")
    v = v.select("vec_id", F.when(ok, F.col("vector")).alias("vector")).withColumns({"k1": F.when(ok, F.xxhash64("vector")), "k2": F.when(ok, F.xxhash64(F.lit(1), "vector"))})
    classes = v.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("first_id"), F.any_value("vector").alias("vector"))
    classes = staged(classes.withColumns({"c": F.monotonically_increasing_id(), "size": F.size("vector")}), "cover-classes")
    sizes = [(r["size"], r["n"]) for r in classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()]
    return v.select("vec_id", "k1", "k2"), classes, sizes


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, block: int = 4096, sample: int = 4096, most: int = 128) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    ``n_links`` counts the other rows of cosine ``threshold`` or more, ``component_id`` is the smallest id reached over links,
    itself included. Null, zero and non-finite vectors are linked with nothing, vectors of different sizes are never linked.
    Repeated rows are linked like any others. A row without an id stays, its component is the smallest id it reaches, null
    if there is none. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, classes, sizes = _classes(vectors, key, vector)
    counts, edges = [], []
    for size, n in sizes:
        if n < 2:
            continue
        some = _Blocks(classes.where(F.col("size") == size), n, size, threshold, block, sample, most)

        def work(a: Tree, b: Tree, own: bool) -> tuple[np.ndarray, ...]:
            wa, wb, u, v, _ = sums_and_forest(a, b, threshold, own)
            i, j = np.flatnonzero(wa), np.flatnonzero(wb)
            none = np.full(len(i) + len(j), -1, np.int64)
            return np.concatenate((a.ids[i], b.ids[j], u)), np.concatenate((none, v)), np.concatenate((wa[i], wb[j], np.zeros(len(u), np.int64)))

        found = staged(some.map_pairs(work, "x long, y long, w long"), "cover-found")
        counts.append(found.where("w > 0").select(F.col("x").alias("c"), "w"))
        edges.append(found.where("y >= 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
        inner = some.placed.join(some.cells, "cell").where("joins")
        counts.append(inner.select("c", (F.col("extra") - F.when(F.col("inner"), F.col("m")).otherwise(0)).alias("w")))
        edges.append(inner.select(F.col("c").alias("a"), F.col("one").alias("b")))
        if some.ties:
            edges.append(spark.createDataFrame(some.ties, "a long, b long"))
    total = classes.select("c", "k1", "k2", "m", "first_id")
    if counts:
        union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
        sums = union(counts).groupBy("c").agg(F.sum("w").alias("w"))
        roots = simhash.components(union(edges)).withColumnRenamed("node", "c")
        total = total.join(sums, "c", "left").join(roots, "c", "left")
    else:
        total = total.withColumns({"w": F.lit(0).cast("long"), "root": F.lit(None).cast("long")})
    total = staged(total.select("c", "k1", "k2", "first_id", (F.col("m") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("root", "c").alias("root")), "cover-total")
    first = total.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = total.join(first, "root").select("k1", "k2", "n_links", "component_id")
    found = rows.join(known, ["k1", "k2"], "left")
    own = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def pairs(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, block: int = 4096, sample: int = 4096, most: int = 128) -> DataFrame:
    """``a, b, cosine``: every pair of different vectors of cosine ``threshold`` or more, each vector by the smallest id that has it.

    Equal vectors are one; the rows grow with the number of links, so :func:`link` suits large groups of near copies better.
    """
    spark = vectors.sparkSession
    _, classes, sizes = _classes(vectors, key, vector)
    out = spark.createDataFrame([], "x long, y long, cosine double")
    for size, n in sizes:
        if n < 2:
            continue
        some = _Blocks(classes.where(F.col("size") == size), n, size, threshold, block, sample, most, whole=False)

        def work(a: Tree, b: Tree, own: bool) -> tuple[np.ndarray, ...]:
            links, _, _ = traverse(a, b, threshold, own, whole=False)
            i, j, cos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*links)) or ((), (), ())))
            return a.ids[i.astype(np.int64)], b.ids[j.astype(np.int64)], cos.astype(np.float64)

        out = out.unionByName(some.map_pairs(work, "x long, y long, cosine double"))
    of = lambda c, name: classes.select(F.col("c").alias(c), F.col("first_id").alias(name))
    named = out.join(of("x", "i"), "x").join(of("y", "j"), "y")
    return named.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "cosine")
