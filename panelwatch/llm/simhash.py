"""Near-duplicates by SimHash: fingerprints, multi-index hashing, connected components.

A fingerprint is cut into segments. If two fingerprints differ in at most r bits, some
segment differs in few: with r = m a + b, one of the first b + 1 of m segments differs in
at most a bits or one of the others in at most a - 1. So every fingerprint stands once per
segment in a table, looks up the small Hamming ball around each of its segment values, and
the matches are verified on all 64 bits. Equal fingerprints are one row from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelwatch.llm.common import by_row, chunks_of_words, cut, spare

BITS = 64


def bit_totals(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, the highest bit first."""
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(bits), 255):
        total += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the hashes of all shingles of ``width`` words; 0 without words. Works through long texts in steps."""
    total, n, held = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in chunks_of_words(text or ""):
        held += words
        if len(held) < width:
            continue
        line = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(line[a:b], seed) for a, b in zip(starts[: len(held) - width + 1].tolist(), ends[width - 1 :].tolist())]
        total += bit_totals(hashes)
        n += len(hashes)
        held = held[len(held) - width + 1 :]
    if not n:
        if not held:
            return 0
        total, n = bit_totals([digest(b" ".join(held), seed)]), 1
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from by_row(lambda d, t: [(d, fp - (1 << 64) if (fp := fingerprint(t, width)) >> 63 else fp)], batches, ["doc_id", "fp"])

    return docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def layout(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment; a radius below 0 need not be looked up."""
    a, b = divmod(distance, segments)
    sizes = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    return [(BITS - sum(sizes[: i + 1]), sizes[i], a if i <= b else a - 1) for i in range(segments)]


def links(prints: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints that differ in at most ``distance`` bits; a pair may come twice.

    ``prints`` has one row per distinct ``fp``. Three segments (a ball of 22 or 23 values in two of
    them) keep the lookups at 45 a fingerprint and suit up to some 10^8 of them; two segments with
    562 lookups suit more. The result is the same. Lookups meet the table on (segment, value); a hot
    value is split by the skew join, and only verified pairs leave the join.
    """
    table, probes = [], []
    for i, (shift, bits, radius) in enumerate(layout(segments, distance)):
        if radius < 0:
            continue
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(i << 56))
        table.append(value)
        masks = [sum(1 << p for p in spots) for r in range(radius + 1) for spots in combinations(range(bits), r)]
        probes.append(F.transform(F.lit(masks).cast("array<bigint>"), value.bitwiseXOR))
    t = prints.select(F.col("fp").alias("b"), F.explode(F.array(*table)).alias("k"))
    p = prints.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("k"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return p.join(t, (p["k"] == t["k"]) & near).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node with a link, the smallest node of its component as root.

    Alternating large-star and small-star rounds: each links the larger (then the smaller) neighbours of
    a node to its smallest one, until every node has one link, to its root. The minimum is combined
    before the shuffle and joined back, so the hub of a large star is not gathered anywhere. The
    rounds grow with the logarithm of the size; each is checkpointed.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while (now := e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != state:
        state = now
        if not now[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small.where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: one row per row of ``docs``, with the smallest id its fingerprint reaches.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null id stay; their
    component is the smallest id reached, null if there is none. Repeated rows are kept. Other columns are ignored.
    """
    marked = cut(fingerprints(docs, key, text, width))
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(prints, distance, segments))
    roots = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(roots.join(first, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def kept_rows(marked: DataFrame, text: str = "text", width: int = 4, distance: int = 4, segments: int = 3, row: str = "_row") -> DataFrame:
    """``row, _n``: the row hash that stays of each component, and how many rows have it."""
    found = near_duplicates(marked, row, text, width, distance, segments)
    return cut(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(row)).agg(F.count(F.lit(1)).alias("_n")))


def take_rows(marked: DataFrame, kept: DataFrame, row: str = "_row") -> DataFrame:
    """One row of ``marked`` for each ``row`` of ``kept``."""
    alone = marked.join(kept.where("_n = 1"), row, "left_semi")
    alike = marked.join(kept.where("_n > 1"), row, "left_semi").dropDuplicates([row])
    return alone.unionByName(alike)


def keep_one(docs: DataFrame, text: str = "text", width: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """One row of each component, all columns of ``docs``.

    Rows are told apart by a hash of all columns, so null and repeated ids do no harm; of rows that are alike in all
    columns one stays. Columns may have any names. An empty table stays empty.
    """
    row = spare(docs.columns, "_row")
    marked = docs.withColumn(row, F.xxhash64(*docs.columns))
    return take_rows(marked, kept_rows(marked, text, width, distance, segments, row), row).select(*docs.columns)
