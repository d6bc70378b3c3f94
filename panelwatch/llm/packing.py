"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Sizes are whole numbers up to the capacity, so documents of one size, and sequences with one
gap, are interchangeable. Spark counts the pieces of each size and ranks every piece among those
of its size; the bulk-synchronous rounds then run on runs of equal sizes, at most one per possible
size whatever the number of documents, and give every rank a sequence and a place in it. A last
pass looks up each piece by size and rank. No piece passes through the driver.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from panelwatch.llm.common import groups, spare, staged

END = 1  # id that ends each document
PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"
RANK_BITS = 44
_MARKS = "!\"#$%&()*+,-./:;=?@[]^_{}~"  # not the apostrophe, which begins pre-tokens of its own, nor the signs of special tokens
_LATIN = "\u0250"  # from here on letters take the whole way, whose case rules are the tokeniser's own
#: The byte alphabet of the vocabulary: printable Latin-1 characters stand for themselves, the others for those from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Token ids of texts as little-endian bytes, by words.

    The pre-tokeniser never joins characters across white space, so the ids of a text are those of its words
    one after the other, and those of letters before closing punctuation are the letters' and the punctuation's.
    Each word of a group of texts is encoded once; at most ``bound`` words are kept for later groups, preferably those that repeat.
    """

    def __init__(self, path: str, bound: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.marks: dict[str, bytes] = {}
        self.bound = bound
        self.known: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> dict[str, bytes]:
        return {w: array("I", e.ids).tobytes() for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False))}

    def _letters(self, word: str) -> bytes | None:
        """A word of Latin letters is one pre-token and goes straight to the merges; null for others."""
        x = word.lower()
        if not x.isascii():
            x = unicodedata.normalize("NFC", word).lower()
            if max(x) >= _LATIN or not x.isalpha():
                return None
            x = x.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.merge(x)]).tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        known, plain, new, others = self.known, {}, {}, []
        for w in words:
            core = w.rstrip(_MARKS)
            found = None
            if core.isalpha():
                # a known word of ASCII letters was encoded by its letters alone; others may not have been, so ids never depend on what came before
                found = plain.get(core) or (known.get(core) if core.isascii() else None) or self._letters(core)
                if found is not None:
                    plain[core] = found
                    if len(core) < len(w):
                        tail = w[len(core) :]
                        if tail not in self.marks:
                            self.marks |= self._each([tail])
                        found += self.marks[tail]
                    new[w] = found
            if found is None:
                others.append(w)
        return new | self._each(others)

    def keep(self, words: Iterator[tuple[str, bytes]]) -> None:
        self.known.update(islice(words, max(0, self.bound - len(self.known))))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each of a group of texts; a group should be some megabytes.

        Words are numbered by Arrow, so only the different ones of the group become Python strings.
        """
        lines = pa.array([(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts], pa.large_string())
        lists = pc.split_pattern(lines, " ")
        coded = lists.flatten().dictionary_encode()
        place, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        found = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = self.learn([words[i] for i in missing])
            for i in missing:
                found[i] = new[words[i]]
            # half of the room is for words that repeat
            single = np.bincount(place, minlength=len(words)) < 2
            self.keep((words[i], found[i]) for i in missing if not single[i] or 2 * len(self.known) < self.bound)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, n = np.frombuffer(b"".join(found), np.uint32), sizes[place]
        ends = np.concatenate(([0], np.cumsum(n)))
        every = flat[np.repeat((np.cumsum(sizes) - sizes)[place] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy()]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield every[a:b].tobytes()
        pa.default_memory_pool().release_unused()


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """The words of a tokenizer, one for each Python worker: later tasks find what earlier ones have encoded."""
    return Words(path)


def pieces(docs: DataFrame, capacity: int = 4096, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per piece: only documents longer than the capacity are cut, into full pieces and a rest.

    A null text is an empty one: its single piece holds the end id alone.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end, wide = words_of(path), END.to_bytes(4, "little"), 4 * capacity
        for ids, texts in groups(batches):
            out = []
            for doc_id, found in zip(ids, words.ids(texts)):
                found += end
                n = len(found) // 4
                out += [(doc_id, i, i * capacity, min(capacity, n - i * capacity), zlib.crc32(found[i * wide : (i + 1) * wide])) for i in range(-(-n // capacity))]
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, PIECE)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def match_rounds(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows ``size, first rank, how many, first sequence, offset`` that place all pieces, and the number of sequences.

    Pieces of a size are taken by rank. A round sweeps pieces and gaps once in ascending order of size: every
    piece waits for its successor gap, the smallest that holds it; where several wait for one gap the largest
    wins, and the others go on to the next gap. Each sequence takes at most one piece a round, then its gap is
    updated. When no piece finds a gap, as many empty sequences are opened as the rest needs at least.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0
    while left:
        matched, waiting = [], []
        sizes, spaces = sorted(left), sorted(gaps)
        at = 0
        for gap in spaces:
            while at < len(sizes) and sizes[at] <= gap:
                waiting.append([sizes[at], left[sizes[at]]])
                at += 1
            if not waiting:
                continue
            rest = gaps.pop(gap)
            while rest and waiting:
                (first, n), (size, wait) = rest.pop(), waiting[-1]
                took = min(n, wait)
                matched.append((gap, size, first, took))
                if took < n:
                    rest.append((first + took, n - took))
                waiting[-1][1] -= took
                if not waiting[-1][1]:
                    waiting.pop()
            if rest:
                gaps[gap] = rest
        if not matched:
            tokens = sum(s * n for s, n in left.items())
            large = sum(n for s, n in left.items() if 2 * s > capacity)
            n = max(large, -(-tokens // capacity))
            gaps.setdefault(capacity, []).append((opened, n))
            opened += n
            continue
        for gap, size, first, n in matched:
            placed.append((size, taken[size], n, first, capacity - gap))
            taken[size] += n
            left[size] -= n
            if not left[size]:
                del left[size]
            if gap > size:
                gaps.setdefault(gap - size, []).append((first, n))
    return np.array(sorted(placed), dtype=np.int64).reshape(-1, 5), opened


def pack(items: DataFrame, capacity: int = 4096, size: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), shards: int = 32) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row of ``items``, which must give the same rows when read again.

    ``size`` is a whole number from 1 to ``capacity``. Rows of one size are ranked within ``shards`` parts of
    themselves, so a size that a third of all rows have is not one task; ``size x shards`` counts, at most
    ``capacity x shards`` numbers, are all that is gathered. Repeated rows are packed like any others. Columns that
    have the names of the new ones are replaced.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    shard, ranked = spare(items.columns, "_shard"), spare(items.columns, "_rank")
    keyed = items.withColumn(shard, F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    counts = keyed.groupBy(F.col(size).alias("s"), F.col(shard).alias("_shard")).count().toPandas().sort_values(["s", "_shard"])
    per_size = {int(s): int(n) for s, n in counts.groupby("s")["count"].sum().items()}
    if not per_size:
        return items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    if min(per_size) < 1 or max(per_size) > capacity:
        raise ValueError("sizes must be from 1 to the capacity")
    placed, _ = match_rounds(per_size, capacity)
    before = counts["count"] .groupby(counts["s"]).cumsum() - counts["count"]
    base = np.zeros((capacity + 1, shards), np.int64)
    base[counts["s"].to_numpy(np.int64), counts["_shard"].to_numpy(np.int64)] = before.to_numpy(np.int64)
    share = spark.sparkContext.broadcast((base, (placed[:, 0] << RANK_BITS) | placed[:, 1], placed[:, 3] - placed[:, 1], placed[:, 4]))
    names = items.columns
    rank = F.row_number().over(Window.partitionBy(size, shard).orderBy(*order)) - 1
    fields = [f for f in items.schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["sequence_id long", "offset long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, keys, shift, offsets = share.value
        for pdf in batches:
            s = pdf[size].to_numpy(np.int64)
            r = pdf[ranked].to_numpy(np.int64) + base[s, pdf[shard].to_numpy(np.int64)]
            i = np.searchsorted(keys, (s << RANK_BITS) | r, side="right") - 1
            yield pdf[names].assign(sequence_id=shift[i] + r, offset=offsets[i])

    return keyed.withColumn(ranked, rank).mapInPandas(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 4096, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Tokenise, cut and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null ids and repeated rows are packed too, an empty table gives no rows, other columns are ignored.
    """
    cut_up = staged(pieces(docs, capacity, key, text, tokenizer).withColumn("doc_id", F.col("doc_id").cast("string")), "pieces")
    return pack(cut_up, capacity).withColumn("doc_id", F.col("doc_id").cast("long"))
