"""Ranked lexical search: a few highest-scoring documents for each of a table of queries.

Documents are indexed in blocks, inside the tasks that read them: a block holds its documents by ascending id and, for terms
that queries may hold, the lists of documents and occurrences. Which terms to keep is told by a bitmap of hashed query terms of
fixed size, so however many the queries, what is broadcast stays the same; a term that only shares a bit is dropped by the join.

A query is answered in each block by a hybrid of two ways. Its short lists are taken term at a time: their scores are
summed into accumulators, one materialised list. That list then is one iterator, with an upper bound, besides the
long lists, and these are walked document at a time over windows of documents: a window whose bounds can't beat the current
threshold is skipped; in others the iterators of smallest bounds, which together can't beat it either, give no candidates and are only
looked up for documents that others found and that can still win. Scores are whole numbers, so bounds are exact.
The best of every block meet in a window per query.

A block meets the queries in groups: each (block, group) is one key, both sides of which are bounded.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from panelwatch.llm.common import STEP, staged

#: Terms are the maximal matches; only A to Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
MAP_BITS = 1 << 22
_BUCKET = 32768  # bits of one row of a bitmap aggregate
INDEX = "terms array<string>, found array<int>, documents long, total long, data binary"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a whole text in order, in lists of bounded size unless a single term is longer."""
    text = text or ""
    held: list[bytes] = []
    for i in range(0, len(text), STEP):
        part = text[i : i + STEP].encode().lower()
        whole = part.rstrip(_LETTERS) if i + STEP < len(text) else part
        if whole or i + STEP >= len(text):
            held.append(whole)
            yield _TERM.findall(b"".join(held))
            held = []
        if len(whole) < len(part):
            held.append(part[len(whole) :])
    if held:
        yield _TERM.findall(b"".join(held))


class Block:
    """Documents of one block, their lengths, and the lists of its terms."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, names: list[str], starts: np.ndarray, docs: np.ndarray, times: np.ndarray):
        self.ids, self.known, self.lengths, self.starts, self.docs, self.times = ids, known, lengths, starts, docs, times
        self.place = {t: i for i, t in enumerate(names)}
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @staticmethod
    def pack(rows: list[tuple[int | None, int, list[tuple[bytes, int]]]]) -> tuple[list[str], np.ndarray, int, int, bytes]:
        """Of rows ``id, length, [(term, occurrences)]`` the row of the index."""
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        number: dict[bytes, int] = {}
        of, docs, times = array("i"), array("i"), array("q")
        for i, (_, _, counts) in enumerate(rows):
            for t, n in counts:
                of.append(number.setdefault(t, len(number)))
                docs.append(i)
                times.append(n)
        of = np.frombuffer(of, np.int32)
        order = np.argsort(of, kind="stable")
        found = np.bincount(of, minlength=len(number))
        lengths = np.array([r[1] for r in rows], np.int64)
        out = BytesIO()
        np.savez(out, ids=np.array([r[0] or 0 for r in rows], np.int64), known=np.array([r[0] is not None for r in rows], bool), lengths=lengths, starts=np.concatenate(([0], np.cumsum(found))), docs=np.frombuffer(docs, np.int32)[order], times=np.frombuffer(times, np.int64)[order])
        return [t.decode() for t in number], found.astype(np.int32), int((lengths > 0).sum()), int(lengths.sum()), out.getvalue()

    @classmethod
    def unpack(cls, data: bytes, names: list[str]) -> Block:
        a = np.load(BytesIO(data))
        return cls(a["ids"], a["known"], a["lengths"], names, a["starts"], a["docs"], a["times"])

    def weigh(self, documents: int, total: int, window: int) -> None:
        """What the corpus says of the documents: their length parts."""
        self.m = 100 - 25 + (25 * self.lengths * documents) // max(1, total)
        self.window = window
        self.edges = np.arange(0, len(self.ids) + window, window)

    def list_of(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, their parts before the weight of the term, and the largest part in each window."""
        if i not in self.lists:
            docs, times = (x[self.starts[i] : self.starts[i + 1]] for x in (self.docs, self.times))
            part = (1_000_000_000 * times) // (1000 * times + 12 * self.m[docs])
            self.lists[i] = docs, part, _window_max(docs, part, self.edges)
        return self.lists[i]


def _window_max(docs: np.ndarray, values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.zeros(len(edges) - 1, np.int64)
    if len(docs):
        at = docs // (edges[1] - edges[0])
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[first]] = np.maximum.reduceat(values, first)
    return out


def best(block: Block, query: list[tuple[str, int]], k: int, short: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the k best documents of a block for ``[(term, weight times repeats)]``, ties to the earlier row, and how many documents were scored.

    Lists of at most ``short`` documents go to the accumulators.
    """
    none = np.zeros(0, np.int64)
    docs, sums, long_lists = [], [], []
    for t, w in query:
        i = block.place.get(t)
        if i is None or w <= 0:
            continue
        d, part, top = block.list_of(i)
        if len(d) <= short:
            docs.append(d)
            sums.append(w * part)
        else:
            long_lists.append((d, part, w, w * top))
    threshold, iterators = 0, long_lists
    if docs:
        d, s = np.concatenate(docs), np.concatenate(sums)
        order = np.argsort(d, kind="stable")
        d, s = d[order], s[order]
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        d, s = d[first], np.add.reduceat(s, first)
        iterators = [*long_lists, (d, s, 1, _window_max(d, s, block.edges))]
        if len(s) >= k:
            threshold = max(0, int(np.partition(s, -k)[-k]) - 1)  # k documents score more than this
    if not iterators:
        return none, none, 0
    bounds = np.stack([x[3] for x in iterators])
    reach = bounds.sum(axis=0)
    cuts = [np.searchsorted(x[0], block.edges) for x in iterators]
    rows, scores, scored = none, none, 0
    for v in np.flatnonzero(reach > threshold):
        if reach[v] <= threshold:
            continue
        start = block.edges[v]
        order = np.argsort(bounds[:, v], kind="stable")
        prefix = np.cumsum(bounds[order, v])
        inert = int(np.searchsorted(prefix, threshold, side="right"))  # iterators that together can't beat the threshold
        total = np.zeros(block.window, np.int64)
        for x in order[inert:]:
            d, part, w, _ = iterators[x]
            a, b = cuts[x][v], cuts[x][v + 1]
            total[d[a:b] - start] += w * part[a:b]
        alive = np.flatnonzero(total)
        scored += len(alive)
        for y in range(inert - 1, -1, -1):
            alive = alive[total[alive] + prefix[y] > threshold]
            if not len(alive):
                break
            d, part, w, _ = iterators[order[y]]
            a, b = cuts[order[y]][v], cuts[order[y]][v + 1]
            if a < b:
                at = np.minimum(np.searchsorted(d[a:b], alive + start), b - a - 1) + a
                hit = d[at] == alive + start
                total[alive[hit]] += w * part[at[hit]]
        alive = alive[total[alive] > threshold]
        if len(alive):
            rows, scores = np.concatenate((rows, alive + start)), np.concatenate((scores, total[alive]))
            keep = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[keep], scores[keep]
            if len(rows) == k:
                threshold = max(threshold, int(scores[-1]))
    return rows, scores, scored


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``i, item_id, term, times``: the terms of every query; alike rows are one query."""
    q = queries.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    q = q.withColumn("i", F.monotonically_increasing_id()).withColumn("term", F.explode(F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(TERM), F.lit(0))))
    return q.groupBy("i", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def term_map(found: DataFrame) -> np.ndarray:
    """A bit for each hashed term: at most ``MAP_BITS / 32768`` rows of a bitmap aggregate reach the driver."""
    at = F.pmod(F.xxhash64("term"), F.lit(MAP_BITS)) + 1  # buckets of the aggregate are counted from 1
    rows = found.select("term").distinct().select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["b"] - 1) * _BUCKET // 8 :][: len(part)] |= part
    return bits


def index(docs: DataFrame, wanted: np.ndarray, key: str, text: str, chars: int) -> DataFrame:
    """One row per block of about ``chars`` characters: its terms that may be wanted, in how many documents each is, totals, the packed block."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted.tobytes())  # MAP_BITS / 8 bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, known, digest = shared.value, {}, xxhash.xxh64_intdigest
        rows, held = [], 0
        made = lambda: pd.DataFrame([Block.pack(rows)], columns=["terms", "found", "documents", "total", "data"])
        for pdf in batches:
            for doc_id, t in zip(pdf["doc_id"], pdf["text"]):
                counts = Counter()
                for part in terms(t):
                    counts.update(part)
                some = []
                for term, n in counts.items():
                    ok = known.get(term)
                    if ok is None:
                        p = digest(term, 42) % MAP_BITS  # a power of two, so the same for signed and unsigned hashes
                        ok = bool(bits[p >> 3] >> (p & 7) & 1)
                        if len(known) < 1 << 19:
                            known[term] = ok
                    if ok:
                        some.append((term, n))
                rows.append((None if pd.isna(doc_id) else int(doc_id), counts.total(), some))
                held += len(t or "") + 100
                if held >= chars:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()

    return docs.select(F.col(key).cast("long").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, INDEX)


def search(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", k: int = 20, chars: int = 1 << 24, window: int = 1024, short: float = 1 / 16, group: int = 1 << 18) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k highest-scoring documents of each query, scores above 0 only, ties to the smaller id.

    A null or empty text has no terms: such a document is in no result and not counted, such a query has no rows. Alike rows of ``queries`` are
    one query, rows with one id and different texts are queries of their own. Every row of ``docs`` is a document, so repeated
    rows have ranks of their own; a null id comes after all others. Empty tables give no rows; other columns are ignored.

    ``short`` is the share of a block's documents up to which a list goes to the accumulators, ``group`` the term rows of queries
    that meet a block at a time.
    """
    asked = staged(query_terms(queries, query_key, query_text), "lexical-queries")
    blocks = staged(index(docs, term_map(asked), key, text, chars).withColumn("b", F.monotonically_increasing_id()), "lexical-index")
    documents, total = (x or 0 for x in blocks.agg(F.sum("documents"), F.sum("total")).first())
    found = blocks.select(F.explode(F.arrays_zip("terms", "found")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.found").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    n = asked.count()
    groups = max(1, -(-n // group))
    weighed = asked.join(found, "term").select("i", "item_id", F.struct("term", (F.col("times") * weight).alias("w")).alias("x"))
    wanted = weighed.groupBy("i", "item_id").agg(F.collect_list("x").alias("x")).select(F.pmod(F.xxhash64("i"), F.lit(groups)).alias("g"), "i", F.col("item_id").cast("string").alias("item_id"), F.col("x.term").alias("t"), F.col("x.w").alias("w"))

    numbered = blocks.select("b")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g")
    keys = numbered.select("b", every)
    left = blocks.select("b", "terms", "data", every)
    right = wanted.join(keys, "g")  # every group of queries for every block

    def score(own: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(items):
            block = Block.unpack(own["data"].iloc[0], list(own["terms"].iloc[0]))
            block.weigh(documents, total, window)
            for i, item_id, t, w in zip(items["i"], items["item_id"], items["t"], items["w"]):
                rows, scores, _ = best(block, list(zip(t, (int(y) for y in w))), k, max(k, int(short * len(block.ids))))
                out += [(i, item_id, str(block.ids[r]) if block.known[r] else None, s) for r, s in zip(rows.tolist(), scores.tolist())]
        return pd.DataFrame(out, columns=["i", "item_id", "doc_id", "score"])

    some = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInPandas(score, "i long, item_id string, doc_id string, score long")
    some = some.select("i", F.col("item_id").cast("long").alias("item_id"), F.col("doc_id").cast("long").alias("doc_id"), "score")
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
