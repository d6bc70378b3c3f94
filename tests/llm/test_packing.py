import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from panelwatch.llm import packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


TEXTS = [
    None, "", " ", "Hello, World! It's 1,234.5\nnew\tline", "don't I'LL we've", "naïve café ÉCOLE straße İstanbul ǅ", "<|endoftext|> <|startoftext|>x", "a<|endoftext|>b", "日本語 テスト 😀😀 👩‍👩‍👧", "été   x y​z",
    "____ ### --- ''' \"q\"", "x" * 3000, "ab1cd2", "ﬁ ½ ² Ⅷ", "tab\x0bvt\x0cff\x85nel\x1cfs", "word." * 50, "(a)[b]{c} @d #e $f", "Αθήνα ΣΊΣΥΦΟΣ", "مرحبا שלום",
]


def test_ids_equal_the_tokenizer():
    r = random.Random(3)
    bits = [t for t in TEXTS if t] + ["the", "token", "Ünder", "é", "'s", "'", "…", "—", "0", "99", "<|", "|>", "́", "ß", "I", "İ"]
    texts = TEXTS + ["".join(r.choice(bits)[:12] + r.choice(["", " ", "\n", "  "]) for _ in range(r.randint(1, 30))) for _ in range(400)]
    whole = tokenizer()
    for bound in (1_000_000, 5):
        words = packing.Words(packing.tokenizer_path(), bound)
        for i in range(0, len(texts), 50):
            part = [t or "" for t in texts[i : i + 50]]
            for t, found in zip(part, words.ids(part)):
                assert list(struct.unpack(f"<{len(found) // 4}I", found)) == whole.encode(t, add_special_tokens=False).ids, t


def test_ids_do_not_depend_on_earlier_words():
    r = random.Random(11)
    whole, warm = tokenizer(), packing.Words(packing.tokenizer_path())
    bits = ["İ", "I", "ß", "ﬁ", "e\u0301", "\u0301", "é", "a", "the", "'s", "!", "...", "(", "ǅ", "Σ", "ς", "9"]
    texts = ["İ é ß e\u0301 ﬁ", "İ! é! ß! e\u0301! ﬁ!"] + ["".join(r.choices(bits, k=r.randint(1, 4))) + r.choice(["", "!", ".", " "]) for _ in range(3000)]
    for t in texts:  # one after the other, so that later ones meet a full cache
        cold = packing.Words(packing.tokenizer_path()) if t in texts[:2] else None
        want = whole.encode(t, add_special_tokens=False).ids
        for words in (warm, cold):
            if words:
                found = next(words.ids([t]))
                assert list(struct.unpack(f"<{len(found) // 4}I", found)) == want, t


@pytest.mark.parametrize("capacity", [8, 64])
def test_documents_come_back_from_their_sequences(spark, capacity):
    r = random.Random(capacity)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(r.choice(["a", "of", "token"]) for _ in range(r.randint(0, 40))), None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(4)
    got = packing.pack_documents(docs, capacity).collect()
    whole, by_doc, by_sequence = tokenizer(), defaultdict(list), defaultdict(list)
    for x in got:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append((x.offset, x.length))
    for i, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [packing.END]
        want = [(k, k * capacity, ids[k * capacity : (k + 1) * capacity]) for k in range(-(-len(ids) // capacity))]
        assert sorted((x.piece, x.start, x.length, x.ids_crc32) for x in by_doc[i]) == [(k, a, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for k, a, p in want]
    for spans in by_sequence.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= capacity
    total = sum(x.length for x in got)
    assert len(by_sequence) <= 1.02 * -(-total // capacity) + 1


def test_few_sequences_against_plain_best_fit():
    r = random.Random(8)
    for capacity, low in ((100, 1), (100, 30), (4096, 1000), (50, 26)):
        sizes = [r.randint(low, capacity) for _ in range(2000)]
        gaps = []
        for s in sorted(sizes, reverse=True):  # best-fit decreasing
            fit = min((g for g in range(len(gaps)) if gaps[g] >= s), key=lambda g: gaps[g], default=None)
            if fit is None:
                gaps.append(capacity - s)
            else:
                gaps[fit] -= s
        placed, n = packing.match_rounds(Counter(sizes), capacity)
        used = defaultdict(list)
        for s, first, many, sequence, offset in placed.tolist():
            for i in range(many):
                used[sequence + i].append((offset, s))
        assert sum(map(len, used.values())) == len(sizes) and len(used) <= n
        for spans in used.values():
            spans.sort()
            assert [a for a, _ in spans] == [sum(x for _, x in spans[:k]) for k in range(len(spans))] and sum(x for _, x in spans) <= capacity
        assert len(used) <= 1.03 * len(gaps) + 1, (capacity, low, len(used), len(gaps))


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert packing.pack_documents(spark.createDataFrame([], schema)).count() == 0
    got = packing.pack_documents(spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, None)], schema)).collect()
    assert sorted((x.doc_id or 0, x.length) for x in got) == [(0, 1), (1, 2), (1, 2), (2, 1)]
    assert sorted(x.offset for x in got if x.sequence_id == got[0].sequence_id)[0] == 0 and len({x.sequence_id for x in got}) == 1
