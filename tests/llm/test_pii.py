import hashlib
import random
import re

import numpy as np

from panelwatch.llm import pii


def brute(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * n, 10)) if i % 2 else n for i, n in enumerate(reversed(d))) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def name(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def texts(n=400):
    r = random.Random(6)
    parts = ["a@b.co", "@", ".", "x.y", "-", " ", "+", "1", "4532015112830366", "192.168.0.1", "256", "(", ")", "+1 555 123 4567", "é", "😀", "a_b%", "0", "b.c", "4532-0151-1283-0366", "999.1.1.1"]
    return [None, "", "@@@", "a" * 3000 + "@", "1" * 4000, "a@b.c@d.e", "x@-.-", "1.2.3.4.5.6.7.8", "+" * 50, "00000.0.0.0", "٣٣٣٣٣٣٣٣٣٣٣٣٣"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(n)]


def test_base_spans_equal_plain_search(spark):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts())], "doc_id long, text string, base int, spans string").repartition(3)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(got) == len(texts())
    for i, t in enumerate(texts()):
        want = brute(t or "")
        assert got[i].base_sha256 == hashlib.sha256(name(want).encode()).hexdigest(), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x for k, _, _ in want) for x in range(4))
        spans = [s for s in got[i].spans.split(",") if s]
        assert {s for s in name(want).split(",") if s} <= set(spans) and len(spans) == len(want) + got[i].n_added


def test_em_finds_the_reliable_labelers():
    r = np.random.default_rng(1)
    truth = r.random(5000) < 0.3
    accuracy = (0.95, 0.9, 0.85, 0.5)
    votes = np.stack([np.where(r.random(5000) < a, truth, ~truth) * 2 - 1 for a in accuracy], axis=1)
    patterns, where, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, given, prior = pii.reliabilities(patterns, n.astype(float))
    assert abs(prior - 0.3) < 0.05 and ((p[where.ravel()] > 0.5) == truth).mean() > 0.93
    for i, a in enumerate(accuracy):
        assert abs(given[1, i, 2] - a) < 0.06


def test_classifier_adds_spelled_out_addresses_in_context(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        rows.append((i, f"please write mail to user{i}@site.com or email name{i} (at) host (dot) org today" if i % 2 else f"the value was {r.randint(10**15, 10**16 - 1)} in ref {i}"))
    got = {x.doc_id: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(x.n_email == 1 and x.spans.count("email:") == 2 for i, x in got.items() if i % 2)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert pii.find(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, None), (None, "1.2.3.4")]
    assert sorted((x.doc_id or 0, x.n_email, x.n_ip) for x in pii.find(spark.createDataFrame(rows, schema)).collect()) == [(0, 0, 0), (0, 0, 1), (1, 1, 0), (1, 1, 0)]


def test_long_runs_of_zeros():
    from panelwatch.llm import pii

    text = "0" * 5000 + "1.1.1.1 " + "0" * 6000 + "." + "0" * 5000 + ".00.0 256.1.1.1 1." + "9" * 5000 + ".1.1"
    assert [(text[a : a + 3], text[b - 3 : b]) for k, a, b in pii.base_spans(text) if k == 1] == [("000", "1.1"), ("000", "0.0")]
