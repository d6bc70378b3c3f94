import random
import re
from itertools import combinations

import pytest
import xxhash

from panelwatch.llm import simhash


def brute_print(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, distance=4):
    """Smallest index that each reaches."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(prints))]


def texts(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 600))] for _ in range(40)]
    out = [None, "", " \t", "One", "one", "ONE two", "A b c d e", "x " * 2000, "É é"]
    for words in base:
        out.append(" ".join(words))
        for _ in range(r.randint(0, 3)):
            w = list(words)
            w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append("\n".join(w).upper() if r.random() < 0.2 else " ".join(w))
    return out


@pytest.mark.parametrize("step", [1 << 20, 50])
def test_fingerprints_equal_brute_force(monkeypatch, step):
    from panelwatch.llm import common

    monkeypatch.setattr(common.chunks_of_words, "__defaults__", (step,))
    for t in texts():
        assert simhash.fingerprint(t) == brute_print(t), t


@pytest.mark.parametrize("segments,distance", [(3, 4), (2, 4), (4, 9)])
def test_links_equal_brute_force(spark, segments, distance):
    r = random.Random(segments)
    values = [r.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for _ in range(3):
            w = v
            for b in r.sample(range(64), r.randint(0, distance + 2)):
                w ^= 1 << b
            values.append(w)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance, segments).collect()}
    assert got == {(a, b) for a, b in combinations(values, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}


def test_components_equal_brute_force(spark):
    all_texts = texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(all_texts)], "doc_id long, text string, fp int").repartition(4)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute_print(t) for t in all_texts]
    want = brute_components(prints)
    assert [(got[i].fp & (1 << 64) - 1, got[i].component_id) for i in range(len(all_texts))] == list(zip(prints, want))
    assert len(set(want)) < len(want)
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert len(kept) == len(set(want)) and {want[i] for i in kept} == set(want)


def test_long_chains(spark):
    chain, v = [], 0
    for i in range(60):
        chain.append(v - (1 << 64) if v >> 63 else v)
        v ^= 1 << i
    found = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in chain], "fp long"), 1, 3)).collect()
    assert {r.node for r in found} == set(chain) and {r.root for r in found} == {min(chain)}


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b"), (5, "a b"), (5, "c d e f g"), (None, "a b"), (9, None), (7, "")]
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 5), (5, 5), (5, 5), (5, 5), (7, 7), (9, 7)]
    assert simhash.keep_one(spark.createDataFrame(rows, schema)).count() == 3
