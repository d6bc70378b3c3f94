import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
from panelwatch.llm import langid, secret_scan, tiling
from tests.llm.test_langid import SYLLABLES, sentence
from tests.llm.test_overlap import jaccard
from tests.llm.test_packing import tokenizer
from tests.llm.test_secrets import base
from tests.llm.test_simhash import brute_print


def tables(spark, folder):
    r = random.Random(7)
    docs = [(i, sentence(r, lang := r.choice(list(SYLLABLES)), r.randint(20, 120)), lang if i % 9 else None, f"s{i % 3}") for i in range(150)]
    items = [(i, sentence(r, "aa", 20)) for i in range(5)]
    docs += [(200 + i, docs[i][1], docs[i][2], "copy") for i in range(20)]
    docs += [(300 + i, f"{docs[50 + i][1]} {t} {docs[60 + i][1]}", "aa", "leak") for i, t in items]
    docs += [(400 + i, docs[70 + i][1] + f" token = {i:x}b{'0123456789abcdef' * 2} " + docs[80 + i][1], docs[70 + i][2], "secret") for i in range(10)]
    docs += [(500, None, None, None), (501, "", "aa", "s"), (502, "12345 67890", None, "s"), (503, "qxqx wwww jjqq " * 30, None, "junk"), (None, docs[3][1] + " lokamiten", "aa", None), (10, docs[10][1], docs[10][2], docs[10][3])]
    rows = [(*d, len(d[1]) if d[1] is not None else None) for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    docs = corpus_pipeline.table(spark, folder, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "benchmark", "secrets", "packing"]
    key = lambda x: (x[0] is None, x)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.staged(stage(spark, docs, folder), f"test-{name}")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "language":
            gone = {x.doc_id for x in before} - {x.doc_id for x in after}
            assert {500, 501, 502, 503} <= gone and len(after) >= len(before) - 6 and all(x.lang for x in after)
        elif name == "near_copies":
            prints = {x.text: brute_print(x.text) for x in before}
            like = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4 or jaccard(a, b) >= 0.8
            assert len(after) < len(before) and not any(like(a.text, b.text) for a, b in combinations(after, 2))
            gone = Counter(x.text for x in before) - Counter(x.text for x in after)
            texts = [x.text for x in before]
            for t in gone:  # what goes is a near copy of another row
                assert sum(like(t, u) for u in texts) > 1
            alone = [x for x in before if sum(like(x.text, u) for u in texts) == 1]
            assert {tuple(x) for x in alone} <= {tuple(x) for x in after}
        elif name == "benchmark":
            items = [(x.item_id, x.text) for x in corpus_pipeline.table(spark, folder, "benchmark").collect()]
            block = tiling.Block(items, 5)
            assert sorted((tuple(x) for x in after), key=key) == sorted((tuple(x) for x in before if not block.hits(x.text, 0.8)), key=key)
            assert len(before) - len(after) == 5
        elif name == "secrets":
            assert len(after) == len(before) and not any(base(x.text) for x in after) and all(x.n_chars == len(x.text) for x in after)
            clean = {x.doc_id: x.text for x in before if not base(x.text)}
            assert all(x.text == clean[x.doc_id] for x in after if x.doc_id in clean) and sum(secret_scan.MARK in x.text for x in after) == len(before) - len(clean)
        else:
            whole = tokenizer()
            want = sum(len(whole.encode(x.text, add_special_tokens=False).ids) + 1 for x in before)
            assert sum(x.length for x in after) == want and len({x.sequence_id for x in after}) <= -(-want // 4096) * 1.05 + 1
    run = corpus_pipeline.run(spark, folder)
    assert sorted((tuple(x) for x in run.drop("sequence_id", "offset").collect()), key=key) == sorted((tuple(x) for x in docs.drop("sequence_id", "offset").collect()), key=key)


def test_empty_documents(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert langid.UNKNOWN == "und"
