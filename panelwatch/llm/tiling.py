"""Benchmark decontamination by greedy string tiling.

Words that documents and test items share are found by a join on the hashes of runs of ``min_match`` words
(rolling Karp-Rabin sums over word numbers). From these seeds the longest common unmarked runs are marked one
after the other, longest first, without overlap on either side; what share of an item the tiles cover is its
coverage. Tiles may come in any order, so reordered passages are caught like whole ones.

The test items are given as blocks of bounded size, one after the other, against all documents: a block's
words and seeds are what is broadcast.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from panelwatch.llm.common import bounded_batches

WORD = re.compile(r"[^\W_]+")
STEP = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
HITS = "array<struct<item_id: bigint, coverage: double, n_tiles: int, longest: int>>"


def words_of(text: str) -> Iterator[str]:
    """Lower-case words of letters and digits, in steps for long texts (a step ends at white space)."""
    at = 0
    while at < len(text):
        end = at + STEP
        while end < len(text) and not text[end].isspace():
            end += 1
        yield from WORD.findall(text[at:end].lower())
        at = end


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin value of every run of ``width`` word numbers, modulo 2^64."""
    out = np.zeros(max(0, len(ids) - width + 1), _U)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = out * _U(_BASE) + ids[i : len(ids) - width + 1 + i].astype(_U)
    return out


class Block:
    """Word numbers and seeds of a bounded set of test items."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray, int]] = []
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")], np.int64)
            if not len(ids):
                continue
            width = min(min_match, len(ids))
            self.items.append((item_id, ids, width))
            for at, h in enumerate(rolling(ids, width).tolist()):
                seeds.setdefault(width, []).append((h, len(self.items) - 1, at))
        self.seeds = {}
        for width, found in seeds.items():
            found.sort()
            self.seeds[width] = (np.array([f[0] for f in found], _U), np.array([f[1:] for f in found], np.int64))

    def hits(self, text: str, threshold: float) -> list[tuple[int, float, int, int]]:
        get = self.number.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        pairs: dict[int, list[tuple[int, int]]] = {}
        for width, (hashes, where) in self.seeds.items():
            if len(ids) < width:
                continue
            unknown = np.concatenate(([0], np.cumsum(ids == 0)))
            at = np.flatnonzero(unknown[width:] == unknown[:-width])  # runs of known words
            if not len(at):
                continue
            h = rolling(ids, width)[at]
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for i, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                for item, j in where[a:b].tolist():
                    pairs.setdefault(item, []).append((i, j))
        out = []
        for item, seeds in pairs.items():
            item_id, own, width = self.items[item]
            covered, n, longest = tile(ids, own, seeds, width)
            if covered >= threshold * len(own):
                out.append((item_id, covered / len(own), n, longest))
        return sorted(out, key=lambda x: (x[0] is not None, x[0]))


def tile(text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], width: int) -> tuple[int, int, int]:
    """Item words covered, tiles and longest tile. ``seeds`` are all (text, item) places of equal runs of ``width`` words.

    Seeds next to each other on a diagonal make a match. The longest match is marked first (ties: the earlier);
    what is left of a match that is marked in part goes back as shorter matches.
    """
    heap, open_runs = [], {}
    for i, j in sorted(seeds):
        if (text[i : i + width] != item[j : j + width]).any():  # equal sums of different words
            continue
        run = open_runs.get(i - j)
        if run and run[0] + run[2] == i:
            run[2] += 1
        else:
            if run:
                heap.append((-(run[2] + width - 1), run[0], run[1]))
            open_runs[i - j] = [i, j, 1]
    heap += [(-(r[2] + width - 1), r[0], r[1]) for r in open_runs.values()]
    heapq.heapify(heap)
    marked, own, tiles = set(), np.zeros(len(item), bool), []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [not own[j + x] and i + x not in marked for x in range(-n)]
        if all(free):
            own[j : j - n] = True
            marked.update(range(i, i - n))
            tiles.append(-n)
            continue
        x = 0
        while x < len(free):
            y = x
            while y < len(free) and free[y]:
                y += 1
            if y - x >= width:
                heapq.heappush(heap, (x - y, i + x, j + x))
            x = y + 1
    return int(own.sum()), len(tiles), max(tiles, default=0)


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", min_match: int = 5, block_chars: int = 1 << 23) -> Iterator[Block]:
    """The test items in blocks of about ``block_chars`` characters; each is what one pass broadcasts (some 100 MB at most)."""
    items = benchmark.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield Block(sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r)), min_match)


def hits_column(df: DataFrame, text: str, block: Block, threshold: float) -> Column:
    """The items of a block that a text covers enough, as an array."""
    share = df.sparkSession.sparkContext.broadcast(block)
    bounded_batches(df.sparkSession)

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        names = ("item_id", "coverage", "n_tiles", "longest")
        return pd.Series([[dict(zip(names, h)) for h in share.value.hits(t, threshold)] if t else [] for t in texts], dtype=object)

    return hits(F.col(text).cast("string"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles, longest``: a row for each test item whose words a document covers to ``threshold``.

    Documents with a null or empty text have no row, nor have items without words; items shorter than ``min_match``
    are matched whole. Repeated rows give repeated rows, a null id is kept, other columns are ignored.
    """
    rows, out = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), None
    for block in blocks(benchmark, item_key, item_text, min_match):
        part = rows.select("doc_id", F.explode(hits_column(rows, "text", block, threshold)).alias("h")).select("doc_id", "h.*")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_match: int = 5, threshold: float = 0.8, **keys: str) -> DataFrame:
    """The rows of ``docs``, all columns, that cover no test item to ``threshold``."""
    for block in blocks(benchmark, min_match=min_match, **keys):
        docs = docs.where(F.size(hits_column(docs, text, block, threshold)) == 0)
    return docs
