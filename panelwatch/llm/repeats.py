"""Repeated byte strings across a corpus, by enhanced suffix arrays over sampled suffixes.

A suffix array of every position would be sorted text many times the corpus. Here the suffixes are
sampled by content: every window of ``length`` bytes picks the position in it whose gram (``gram``
bytes) has the smallest hash, so equal windows anywhere pick the same place, about two in
``length - gram`` positions are picked, and each window belongs to exactly one pick, its anchor.
Anchors whose gram stands alone are dropped. The suffixes of the others are sorted within the anchors of
one gram; a stack scan of the common prefixes gives the tree of prefix intervals, and the same scan of the
reversed left contexts inside an interval tells how far, and for whom, it extends to the left. Groups
that extend no further on either side for all members are the maximal repeats; each has all its occurrences.

Anchors with the same content all around (copies, the inside of long passages) are one row with a count before
any of that. A gram with more different surroundings than ``group_bound`` is not gathered in one task: its
windows are hashed and counted by Spark, which gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelwatch.llm.common import by_row, staged

STEP = 1 << 19
_POS = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n + 1 of each."""
    if not _POWERS or len(_POWERS[0]) <= n:
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, _U), np.full(n, b, _U))), dtype=_U) for b in (_BASE, _INVERSE)]
    return _POWERS


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(31))) * _U(0x7FB5D329728EA185)
        z = (z ^ (z >> _U(27))) * _U(0x81DADEF4BC2DD44D)
        return z ^ (z >> _U(33))


def anchors(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays ``p, back, fore, g, s`` of the anchors of a byte array, worked through in steps.

    The windows of anchor p start from ``p - back`` to ``p - fore``; g is the hash of its gram and s that
    of all bytes of its windows with the anchor's place among them.
    """
    width = length - gram + 1
    for first in range(0, len(data) - length + 1, STEP):
        x = data[first : first + STEP - 1 + length]
        up, down = _powers(STEP + length + 1)
        with np.errstate(over="ignore"):
            prefix = np.concatenate((np.zeros(1, _U), np.cumsum((x.astype(_U) + _U(1)) * up[: len(x)], dtype=_U)))
            grams = _mix((prefix[gram:] - prefix[:-gram]) * down[: len(x) - gram + 1])
        n = len(grams)
        order = (grams & ~_POS) | np.arange(n, dtype=_U)
        blocks = np.full(-(-n // width) * width, np.iinfo(_U).max, _U)
        blocks[:n] = order
        blocks = blocks.reshape(-1, width)
        fore = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        p = (np.minimum(back[: n - width + 1], fore[width - 1 : n]) & _POS).astype(np.int64)
        a = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1))
        b = np.concatenate((a[1:] - 1, [len(p) - 1]))
        p = p[a]
        with np.errstate(over="ignore"):
            whole = (prefix[b + length] - prefix[a]) * down[a]
            s = _mix(whole + _mix(((p - a) * 1024 + (p - b)).astype(_U)))
        yield p + first, p - a, p - b, grams[p].view(np.int64), s.view(np.int64)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def prefix_intervals(strings: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    """Nodes of the tree of common prefixes: ``length, members``, each with at least two members.

    A stack scan over the sorted strings: an interval is closed when a shorter common prefix comes. A string
    that is a prefix of others, or equal to them, belongs to their interval of that length.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    stack: list[tuple[int, int]] = []  # (common prefix, first member)
    for i in range(1, len(order) + 1):
        here = _common(strings[order[i - 1]], strings[order[i]]) if i < len(order) else -1
        first = i - 1
        while stack and stack[-1][0] > here:
            depth, first = stack.pop()
            yield depth, order[first:i]
        if here >= 0 and (not stack or stack[-1][0] < here):
            stack.append((here, first))


def maximal_groups(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """``back, ahead, members``: maximal repeats of at least ``length`` bytes around one gram.

    ``lefts`` are the bytes before it, nearest first, ``rights`` those from it on. All members share ``back``
    bytes before and ``ahead`` bytes from the gram; they differ (or end) on both sides beyond.
    """
    for ahead, members in prefix_intervals(rights):
        for back, sub in prefix_intervals([lefts[i] for i in members]):
            if back + ahead >= length:
                group = [members[i] for i in sub]
                after = {rights[i][ahead : ahead + 1] for i in group}
                if len(after) > 1 or after == {b""}:  # else a longer prefix holds the same group
                    yield back, ahead, group


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals with inclusive ends, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, doc_id, text``: k tells rows apart that repeat an id with another text or have none."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), "text").alias("k"), "doc_id", "text")


def anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        names = ["k", "p", "back", "fore", "g", "s"]
        flush = lambda: pd.DataFrame({n: np.concatenate([h[i] for h in held]) for i, n in enumerate(names)})
        for pdf in batches:
            for k, t in zip(pdf["k"], pdf["text"]):
                data = np.frombuffer(t.encode(), np.uint8)
                for p, back, fore, g, s in anchors(data, length, gram):
                    held.append((np.full(len(p), k), p, back.astype(np.int16), fore.astype(np.int16), g, s))
                    size += len(p)
                if size >= 100_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.where(F.octet_length("text") >= length).select("k", "text").mapInPandas(run, "k long, p long, back short, fore short, g long, s long")


def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes around the wanted anchors, cut out of the texts."""
    lists = wanted.groupBy("k").agg(F.collect_list(F.struct("g", "s", "n", "m", "p", "back", "fore")).alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut_out(t, w):
            data = t.encode()
            return [(x["g"], x["s"], x["n"], x["m"], x["back"], x["fore"], data[x["p"] - x["back"] : x["p"]][::-1], data[x["p"] : x["p"] - x["fore"] + length]) for x in w]

        yield from by_row(cut_out, batches, ["g", "s", "n", "m", "back", "fore", "before", "after"])

    return rows.join(lists, "k").select("text", "w").mapInPandas(run, "g long, s long, n long, m long, back int, fore int, before binary, after binary")


COVER = "g long, s long, lo int, hi int"


def _by_tree(contexts: DataFrame, length: int) -> DataFrame:
    """Offsets of the windows that recur, for anchors of grams with few surroundings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, group, gram = [], [], None

        def close():
            spans: dict[int, list] = {}
            for back, ahead, members in maximal_groups([r[1] for r in group], [r[2] for r in group], length):
                for i in members:
                    spans.setdefault(i, []).append((length - ahead, back))
            for i, found in spans.items():
                out.extend((gram, group[i][0], lo, hi) for lo, hi in _merge(found))

        for pdf in batches:
            for g, s, before, after in zip(pdf["g"], pdf["s"], pdf["before"], pdf["after"]):
                if g != gram:
                    close()
                    group, gram = [], g
                    if len(out) >= 50_000:
                        yield pd.DataFrame(out, columns=["g", "s", "lo", "hi"])
                        out = []
                group.append((s, before, after))
        close()
        yield pd.DataFrame(out, columns=["g", "s", "lo", "hi"])

    return contexts.select("g", "s", "before", "after").repartition("g").sortWithinPartitions("g", "s").mapInPandas(run, COVER)


def _by_window(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams with many surroundings: hash every window of the anchors and count equal ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up, down = _powers(4 * length)
        for pdf in batches:
            for g, s, back, fore, before, after in zip(pdf["g"], pdf["s"], pdf["back"], pdf["fore"], pdf["before"], pdf["after"]):
                x = np.frombuffer(before[::-1] + after, np.uint8)
                n = back - fore + 1
                with np.errstate(over="ignore"):
                    prefix = np.concatenate((np.zeros(1, _U), np.cumsum((x.astype(_U) + _U(1)) * up[: len(x)], dtype=_U)))
                    windows = _mix((prefix[length : length + n] - prefix[:n]) * down[:n])
                yield pd.DataFrame({"g": g, "s": s, "at": np.arange(back, fore - 1, -1, dtype=np.int32), "h": windows.view(np.int64)})

    windows = contexts.select("g", "s", "back", "fore", "before", "after").mapInPandas(run, "g long, s long, at int, h long")
    shared = windows.groupBy("g", "at", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return windows.join(shared, ["g", "at", "h"]).select("g", "s", F.col("at").alias("lo"), F.col("at").alias("hi"))


def repeat_spans(rows: DataFrame, length: int = 200, gram: int = 32, group_bound: int = 20_000) -> DataFrame:
    """``k, start, stop``: byte spans covered by windows of ``length`` bytes that also start elsewhere.

    ``rows`` is the result of ``keyed``. Spans may overlap; their union is exactly the bytes so covered.
    """
    found = staged(anchor_rows(rows, length, gram), "anchors")
    often = found.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.min("s") == F.max("s")).alias("pure")).where("n > 1").drop("n")
    often = staged(often, "grams")  # read as a plain side of the join, which can then split a hot gram
    some = staged(found.join(often, "g"), "repeated")
    alike = some.where("pure").select("k", (F.col("p") - F.col("back")).alias("start"), (F.col("p") - F.col("fore") + length).alias("stop"))

    mixed = some.where("NOT pure").drop("pure")
    distinct = mixed.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "p", "back", "fore")).alias("r")).select("g", "s", "n", "r.*")
    wanted = distinct.join(distinct.groupBy("g").agg(F.count(F.lit(1)).alias("m")), "g")
    contexts = staged(_contexts(rows, wanted, length), "contexts")
    cover = _by_tree(contexts.where(F.col("m") <= group_bound), length).unionByName(_by_window(contexts.where(F.col("m") > group_bound), length))
    whole = contexts.where("n > 1").select("g", "s", F.col("fore").alias("lo"), F.col("back").alias("hi"))
    cover = cover.unionByName(whole).groupBy("g", "s").agg(F.collect_set(F.struct("lo", "hi")).alias("c"))
    parts = mixed.join(cover, ["g", "s"]).select("k", "p", F.explode("c").alias("c"))
    return alike.unionByName(parts.select("k", (F.col("p") - F.col("c.hi")).alias("start"), (F.col("p") - F.col("c.lo") + length).alias("stop")))


KEPT = "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, gram: int = 32, group_bound: int = 20_000, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256`` for every row of ``docs``.

    ``kept`` are the remaining bytes (null without ``with_text``); a cut may fall inside a character, so they are
    not a string. A null text is an empty one; texts shorter than ``length`` stay whole; repeated rows are
    occurrences of each other; rows with a null id are kept; other columns are ignored.
    """
    if not 0 < gram <= length <= 500:
        raise ValueError("the gram must fit into the window, and a window has at most 500 bytes")
    rows = keyed(docs, key, text)
    spans = repeat_spans(rows, length, gram, group_bound).groupBy("k").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut_out(doc_id, t, spans):
            data = t.encode()
            runs = _merge([(x["start"], x["stop"] - 1) for x in spans]) if spans is not None else []
            kept, at = [], 0
            for lo, hi in runs:
                kept.append(data[at:lo])
                at = hi + 1
            kept = b"".join([*kept, data[at:]])
            return [(doc_id, len(data), len(data) - len(kept), len(runs), kept if with_text else None, hashlib.sha256(kept).hexdigest())]

        yield from by_row(cut_out, batches, [c.split()[0] for c in KEPT.split(", ")], flush=2000)

    joined = rows.join(spans, "k", "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "spans")
    return joined.mapInPandas(run, KEPT).withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))
