import hashlib
import random
from collections import Counter

import pytest

from panelwatch.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéß") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(20, 60))) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(3)]
        for p in r.sample(passages, r.randint(0, 2)):
            w = p.split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = word()
            parts.insert(r.randrange(len(parts) + 1), " ".join(w))
        texts.append(" ".join(parts))
    texts += texts[:5] + [None, "", "x" * 700, "ab" * 300, "x" * 30, passages[0] * 3]
    return texts


@pytest.mark.parametrize("seed,bound,length,gram", [(1, 20_000, 50, 12), (2, 3, 50, 12), (3, 20_000, 200, 32), (4, 1, 200, 32)])
def test_removal_equals_brute_force(spark, seed, bound, length, gram):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, k string, g string").repartition(5)
    got = repeats.remove_repeats(docs, length=length, gram=gram, group_bound=bound).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts, length)


def test_small_steps_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 64)
    data = ("abcdefghij" * 40).encode() + bytes(range(256)) * 3
    import numpy as np

    starts = []
    for p, back, fore, g, s in repeats.anchors(np.frombuffer(data, np.uint8), 50, 12):
        for q, a, b in zip(p, back, fore):
            assert 0 <= b <= a <= 38
            starts += range(q - a, q - b + 1)
    assert starts == list(range(len(data) - 49))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).count() == 0
    rows = [(7, "z" * 250), (7, "z" * 250), (None, "q" * 30), (7, "other")]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 30, 0), (7, 5, 0), (7, 250, 250), (7, 250, 250)]


def test_intervals_are_maximal_with_all_occurrences():
    rights = [b"abcx", b"abcy", b"abz", b"abcx"]
    lefts = [b"1", b"1", b"1", b"2"]
    assert sorted((d, sorted(m)) for d, m in repeats.prefix_intervals(rights)) == [(2, [0, 1, 2, 3]), (3, [0, 1, 3]), (4, [0, 3])]
    got = sorted((b, a, sorted(m)) for b, a, m in repeats.maximal_groups(lefts, rights, 3))
    assert got == [(0, 3, [0, 1, 3]), (0, 4, [0, 3]), (1, 2, [0, 1, 2]), (1, 3, [0, 1])]
