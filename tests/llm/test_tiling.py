import random
import re

import pytest

from panelwatch.llm import tiling


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(text, item, least):
    """Greedy string tiling by looking at all pairs of places again and again."""
    a, b = words(text), words(item)
    least = min(least, len(b))
    used_a, used_b, covered = set(), set(), 0
    while b:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        covered += n
    return covered / len(b) if b else 0.0


def corpus():
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "Straße", "x_y"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(1, 40))) for i in range(25)] + [(90, None), (91, ""), (92, "__ --"), (93, "same same same same same same same same"), (94, "three words here")]
    docs = []
    for i in range(60):
        parts = [text(r.randint(0, 30))]
        w = words(r.choice(items[:25])[1])
        cut = r.randint(0, len(w))
        parts += [" ".join(w[cut:]).upper(), text(r.randint(0, 4)), ", ".join(w[:cut])]
        docs.append((i, " ".join(parts)))
    return docs + [(80, None), (81, ""), (82, "same " * 30), (83, "a three, WORDS here."), (84, "same " * 6)], items


@pytest.mark.parametrize("threshold,chars", [(0.8, 1 << 23), (0.5, 200)])
def test_coverage_equals_brute_force(spark, monkeypatch, threshold, chars):
    docs, items = corpus()
    monkeypatch.setattr(tiling.blocks, "__defaults__", (*tiling.blocks.__defaults__[:-1], chars))
    d = spark.createDataFrame([(*x, 0.0) for x in docs], "doc_id long, text string, coverage double").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in tiling.contamination(d, b, threshold=threshold).collect()}
    want = {(i, k): c for i, t in docs for k, u in items if (c := brute(t, u, 5)) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    assert {r.doc_id for r in tiling.decontaminate(d, b, threshold=threshold).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_odd_rows(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], docs)
    bench = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], items)
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in tiling.contamination(some, bench).collect()) == [(0, 0), (0, 3), (1, 0), (1, 0), (1, 3), (1, 3)]
    assert tiling.contamination(spark.createDataFrame([], docs), bench).count() == 0
    assert tiling.contamination(some, spark.createDataFrame([], items)).count() == 0
    assert tiling.decontaminate(some, spark.createDataFrame([], items)).count() == 3
