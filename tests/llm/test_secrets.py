import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from panelwatch.llm import secret_scan as S

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?:", "(?i:", 1), re.A)


def base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def name(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    None, "", "nothing here", "password = 'abcdefghijkl' and Token:xyz", "token=secret:abcdefghijklmnop", "API_KEY: \"aaaabbbbccccdddd\" api-key=aaaabbbbccccdddd",
    "AKIA" + "Q" * 13, "AKIA" + "Q" * 14 + "AKIAAKIA", "deadbeefdeadbeefapi_key=deadbeefdeadbeef", "é😀token=é0123456789abcdef0123😀", "😀" * 5 + "secret=" + "x" * 12,
    "a" * 5000 + "g" + "0123456789abcdef" * 300, "my_password= aaaaaaaaaaaaa.b", ("token: zzzzzzzzzzzz1 " * 1500), "PASSWD\t=aaaaaaaaaaaaaaa", "ſecret=aaaaaaaaaaaaaaa", "aſsecret=aaaaaaaaaaaaaaa",
]


def test_base_spans_equal_plain_search(spark):
    r = random.Random(4)
    parts = ["token", "Secret", "api_key", "=", ":", " ", "'", '"', "abcdef0123456789", "AKIA", "QWERTYUIOP12345", "xyzxyzxyzxyz", "é", "😀", "\n", ".", "-", "password"]
    texts = TEXTS + ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, base string, words string").repartition(3)
    got = {r.doc_id: r for r in S.find(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(name(want).encode()).hexdigest(), t
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        spans = got[i].spans.split(",") if got[i].spans else []
        assert set(name(want).split(",")) - {""} <= set(spans) and len(spans) == len(want) + got[i].n_added


def secret(r, n=32):
    return "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_models_add_random_strings_and_leave_identifiers(spark):
    r = random.Random(5)
    plain = ["customer", "order", "address", "shipping", "handler", "request", "number", "region", "document", "language", "counter", "section"]
    word = lambda: "_".join(r.choice(plain) for _ in range(r.randint(1, 4)))
    rows, planted = [], {}
    for i in range(300):
        words = [word() for _ in range(40)]
        if i % 3 == 0:
            words.insert(7, f"password={secret(r)}")
        if i % 5 == 0:
            words.insert(20, planted.setdefault(i, secret(r)))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, found, false = dict(rows), 0, 0
    for row in S.find(docs).collect():
        added = [texts[row.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in row.spans.split(",") if s) if k == "markov"]
        found += planted.get(row.doc_id) in added
        false += sum(a != planted.get(row.doc_id) for a in added)
    assert found >= 0.95 * len(planted) and false == 0

    out = {row.doc_id: row.text for row in S.redact(docs).collect()}
    assert len(out) == 300
    for i, t in out.items():
        assert not base(t) and t.count(S.MARK) == (i % 3 == 0) + (i % 5 == 0)
        assert [w for w in t.split(" ") if w != S.MARK] == [w for w in texts[i].split(" ") if "=" not in w and w != planted.get(i)]


def test_ratio_equals_plain_sum(spark):
    samples = spark.createDataFrame([("a1B2c3", True), ("abcabc", False), ("", False), (None, True), ("é", True)], "token string, random boolean")
    model = S.train(samples)
    code = lambda c: S.ALPHABET.find(c) + 1
    for token in ["abc1", "x", "", "é1é", "zz" * 3000]:
        want = sum(model.ratios[code(a) * S._SIDE + code(b)] for a, b in zip(token, token[1:]))
        got = spark.createDataFrame([(token,)], "t string").select(S.log_ratio(F.col("t"), model)).first()[0]
        assert got == pytest.approx(want, abs=1e-6)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert S.find(spark.createDataFrame([], schema)).count() == 0
    assert S.redact(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "token=abcdefghijklm"), (1, "token=abcdefghijklm"), (None, None), (None, "deadbeefdeadbeef")]
    got = sorted((r.doc_id or 0, r.n_assign, r.n_hex) for r in S.find(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, 0), (0, 0, 1), (1, 1, 0), (1, 1, 0)]
    out = sorted((r.doc_id or 0, r.text or "") for r in S.redact(spark.createDataFrame(rows, schema)).collect())
    assert out == [(0, ""), (0, S.MARK), (1, S.MARK), (1, S.MARK)]
