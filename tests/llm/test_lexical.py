import math
import re
from collections import Counter

import numpy as np

from panelwatch.llm import lexical

TERM = re.compile(lexical.TERM)
LOW = str.maketrans(lexical.UPPER, lexical.UPPER.lower())


def brute(docs, queries, k):
    counts = [(d, Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(queries):
        scored = []
        for d, c in counts:
            m = 100 - 25 + 25 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(LOW)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=lambda x: (x[0] or 0, x[3], x[1]))


def got(df):
    return sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in df.collect()), key=lambda x: (x[0] or 0, x[3], x[1]))


def test_against_plain_scores(spark):
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(120)]
    share = 1 / np.arange(1, 121)
    draw = lambda n: " ".join(r.choice(words, n, p=share / share.sum()))
    docs = [(i, draw(int(r.integers(1, 60)))) for i in range(1500)]
    docs += [(2000 + i, docs[7][1]) for i in range(40)] + [(3000, "W1, w2; É w1 É"), (3001, "é"), (3002, None), (3003, "?!"), (None, docs[9][1]), (9, docs[9][1])]
    queries = [(i, draw(8)) for i in range(20)] + [(50, "w1 w1 W2 unheard"), (51, None), (52, "..."), (53, docs[7][1]), (53, docs[7][1]), (54, "É é"), (None, "w5 w6")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, score long").repartition(3)
    asked = spark.createDataFrame([(*q, 3) for q in queries], "item_id long, text string, term int")
    want = brute(docs, queries, 20)
    for options in ({}, {"chars": 3000, "window": 16, "short": 0.05}, {"chars": 20_000, "window": 64, "short": 0.0, "group": 30}):
        assert got(lexical.search(frame, asked, **options)) == want


def test_empty_tables(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs, asked).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), asked.limit(0)).count() == 0


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "Ab cé " * 50 + "x" * 333 + " end " + "é" * 200
    want = TERM.findall(text.translate(LOW))
    for step in (1, 7, 64, 5000):
        monkeypatch.setattr(lexical, "STEP", step)
        assert [t.decode() for part in lexical.terms(text) for t in part] == want
    assert [t for part in lexical.terms(None) for t in part] == []


def test_windows_are_skipped():
    r = np.random.default_rng(6)
    rare = set(r.choice(8000, 60, replace=False).tolist())
    rows = [(i, 40, [(b"often", int(r.integers(1, 4))), (b"also", 1)] + ([(b"rare", 2)] if i in rare else [])) for i in range(8000)]
    names, _, documents, total, data = lexical.Block.pack(rows)
    block = lexical.Block.unpack(data, names)
    block.weigh(documents, total, 256)
    query = [("often", 30), ("also", 20), ("rare", 5000)]
    found, scores, scored = lexical.best(block, query, 20, 100)
    every, same, whole = lexical.best(block, query, 20, 0)
    assert (found == every).all() and (scores == same).all() and scored <= 80 and set(found.tolist()) <= rare
