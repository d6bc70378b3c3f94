"""Near copies by the overlap of their shingles: documents whose sets of ``width`` words have a Jaccard similarity of 0.8 or more.

Fingerprints of such pairs differ in up to a dozen bits and more, too many to look up. So candidates come from bands of
minima: ``BANDS`` keys a document, each of ``ROWS`` minima of the shingle hashes. A pair of similarity 0.8 shares no key
with probability (1 - 0.8^5)^40, about 10^-7, more similar pairs with less. Candidates are joined and verified on their
whole shingle sets.

The members of a key are first compared with one of them, the pivot: one pair a member. Members like the pivot are
linked through it, so a large group of near copies is a star. What is unlike the pivot can still be like other members that are
not linked to it; the distance 1 - similarity is a metric, so only like those whose distances to the pivot are as close as the
threshold allows. These comparisons never become rows: the members of a key are dealt to blocks, each pair of
blocks is one group of bounded size, its pairs are verified on the whole sets inside the task, in the first key that a pair shares,
and what leaves is a forest of the links. So a group whose members are all just below the threshold still costs a
comparison for each such pair, spread over as many tasks as it has pairs of blocks, but rows only in proportion to its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelwatch.llm import simhash
from panelwatch.llm.common import by_row, chunks_of_words, cut, spare

BANDS, ROWS = 40, 5
_draw = np.random.default_rng(42)
_FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_PLACES = _draw.integers(0, 1 << 64, 64, np.uint64, endpoint=False) | np.uint64(1)
_STEP = 1 << 12


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _joined(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` of the hashed words."""
    n = len(words) - width + 1
    return _mix(sum(_mix(words[i : n + i] * _PLACES[i]) * _PLACES[-1 - i] for i in range(width)))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Different 64-bit hashes of all shingles, in order; a text of fewer words is one shingle, one without words none."""
    out, held = [], np.zeros(0, np.uint64)
    for words in chunks_of_words(text or ""):
        held = np.concatenate((held, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))))
        if len(held) >= width:
            out.append(np.unique(_joined(held, width)))
            held = held[len(held) - width + 1 :]
    if not out:
        return _joined(held, len(held)) if len(held) else held
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: equal if all minima of the band are; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i : i + _STEP]
        np.minimum(least, np.multiply.outer(_FACTORS, part).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    mixed = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i in range(ROWS):
        mixed = _mix(mixed ^ bands[:, i])
    return mixed.view(np.int64)


def _mapped(rows: DataFrame, fn, name: str) -> DataFrame:
    """``d`` and an array of numbers made of the text of every row of ``d, text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from by_row(lambda d, t: [(d, fn(t))], batches, ["d", name], 1000)

    return rows.select("d", "text").mapInPandas(run, f"d long, {name} array<bigint>")


def block_links(pdf: pd.DataFrame, threshold: float) -> list[tuple[int, int, float]]:
    """Links ``a, b, similarity`` of the members of one key in one pair of blocks: as many as join what is linked and was not before.

    Columns: ``k, p, q`` the group, ``part`` a member's block, ``d``, ``j`` its similarity to the pivot, ``root`` what it is linked
    to already, ``keys``, ``s`` its sorted shingles.
    """
    d, j, root = (pdf[c].to_numpy() for c in ("d", "j", "root"))
    wanted = root[:, None] != root
    wanted &= np.abs(j[:, None] - j) <= 1 - threshold + 1e-9
    wanted &= (j[:, None] < threshold) | (j < threshold)
    part, p, q = pdf["part"].to_numpy(), pdf["p"].iloc[0], pdf["q"].iloc[0]
    wanted &= d[:, None] < d if p == q else (part[:, None] == p) & (part == q)
    if not wanted.any():
        return []
    keys_of = np.stack(pdf["keys"])
    for band in range(int(np.flatnonzero(keys_of[0] == pdf["k"].iloc[0])[0])):
        wanted &= keys_of[:, band][:, None] != keys_of[:, band]  # decided in that key
    sizes = np.array([len(x) for x in pdf["s"]])
    rows, others = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(rows):
        return []
    flat = np.concatenate([pdf["s"].iloc[y] for y in others])
    owner = np.repeat(others, sizes[others])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    out = []
    for x in rows:
        own = np.asarray(pdf["s"].iloc[x])
        first, last = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        n = last - first
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(d))
        like = common / np.maximum(1, sizes[x] + sizes - common)
        for y in np.flatnonzero(wanted[x] & (like >= threshold)):
            u, v = top(root[x]), top(root[y])
            if u != v:
                above[max(u, v)] = min(u, v)
                out.append((int(d[x]), int(d[y]), float(like[y])))
    return out


def similar(rows: DataFrame, ids: DataFrame | None = None, width: int = 5, threshold: float = 0.8, block: int = 512) -> DataFrame:
    """Pairs ``a, b, j`` that link all documents of ``rows`` (``d, text``; among those of ``ids``) with a similarity of ``threshold`` or more.

    The pairs have the same connected components as all such pairs; two documents that are linked through others
    may have no row of their own. Rows of the same ``d`` must be alike.
    """
    banded = _mapped(rows, lambda t: keys(shingles(t, width)), "keys")
    if ids is not None:
        banded = banded.join(ids, "d", "left_semi")
    banded = cut(banded.dropDuplicates(["d"]))
    single = banded.select("d", F.explode("keys").alias("k"))
    shared = single.groupBy("k").agg(F.min("d").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(single.join(shared, "k"))

    wanted = members.select("d").distinct()
    sets = cut(_mapped(rows.join(wanted, "d", "left_semi"), lambda t: np.sort(shingles(t, width).view(np.int64)), "s").dropDuplicates(["d"]))

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda side: sets.select(F.col("d").alias(side), F.col("s").alias(f"s{side}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return cut(both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("j")))

    first = verified(members.where("d <> pivot").select(F.col("pivot").alias("a"), F.col("d").alias("b")).distinct())

    # keys with a member that is unlike the pivot and not linked to all others yet
    near = members.where("n > 2 AND d <> pivot").join(first.select(F.col("a").alias("pivot"), F.col("b").alias("d"), "j"), ["pivot", "d"])
    linked = cut(simhash.components(first.where(F.col("j") >= threshold)).withColumnRenamed("node", "d"))
    near = near.join(linked, "d", "left").select("k", "d", "j", F.coalesce("root", "d").alias("root"))
    near = cut(near.join(sets.select("d", F.size("s").alias("size")), "d"))
    undecided = near.groupBy("k").agg(F.min("j").alias("least"), F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    undecided = undecided.where((F.col("least") < threshold) & (F.col("low") < F.col("high")))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all") / (block << 12))).cast("long").alias("parts")
    dealt = near.join(undecided.select("k", parts), "k").withColumn("part", F.pmod(F.xxhash64("d", F.lit(1)), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("k", "d", "j", "root", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    whole = dealt.join(banded, "d").join(sets, "d").select("k", "p", "q", "part", "d", "j", "root", "keys", "s")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_links(pdf, threshold), columns=["a", "b", "j"])

    rest = cut(whole.groupBy("k", "p", "q").applyInPandas(compare, "a long, b long, j double"))
    return first.where(F.col("j") >= threshold).unionByName(rest)


def keep_one(docs: DataFrame, text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each group of near copies, all columns of ``docs``.

    First one of each component of linked fingerprints, as operator 6 has them; of those, one of each group that is linked
    by a similarity of ``threshold`` or more. So no two rows that stay are that similar. Null and repeated ids do no harm, columns may
    have any names; an empty table stays empty.
    """
    row = spare(docs.columns, "_row")
    marked = docs.withColumn(row, F.xxhash64(*docs.columns))
    kept = simhash.kept_rows(marked, text, row=row)
    rows = marked.select(F.col(row).alias("d"), F.col(text).cast("string").alias("text"))
    found = simhash.components(similar(rows, kept.select(F.col(row).alias("d")), width, threshold).select("a", "b"))
    others = found.where("node <> root").select(F.col("node").alias(row))
    return simhash.take_rows(marked, cut(kept.join(others, row, "left_anti")), row).select(*docs.columns)
