import random
from itertools import combinations

import corpus_pipeline
from panelwatch.llm import overlap, simhash
from tests.llm.test_simhash import brute_print


def brute_shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    x, y = brute_shingles(a), brute_shingles(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def edited(r, words, n):
    words = list(words)
    for at in r.sample(range(len(words)), n):
        words[at] = f"new{r.randrange(10**6)}"
    return words


def texts(seed=3):
    """Groups of edited texts around the threshold; texts that share a passage; short and empty ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out = [None, "", " \n", "one", "One", "a b c d", "A B c\td", "a b c e"]
    for _ in range(25):
        words = draw(r.randint(60, 500))
        out += [" ".join(edited(r, words, r.randint(0, len(words) // 25))) for _ in range(r.randint(1, 6))]
    shared = draw(200)
    out += [" ".join(shared + draw(r.randint(20, 60))) for _ in range(60)]
    return out


def components(n, edges):
    root = list(range(n))
    for a, b in edges:
        x, y = sorted((root[a], root[b]))
        root = [x if c == y else c for c in root]
    return root


def test_links_equal_brute_force(spark):
    all_texts = texts()
    rows = spark.createDataFrame(list(enumerate(all_texts)), "d long, text string").repartition(3)
    got = {(x.a, x.b): x.j for x in overlap.similar(rows).collect()}
    want = {(a, b): j for a, b in combinations(range(len(all_texts)), 2) if (j := jaccard(all_texts[a], all_texts[b])) >= 0.8}
    assert set(got) <= set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)
    assert components(len(all_texts), got) == components(len(all_texts), want)
    assert any(0.8 <= j < 0.85 for j in want.values()) and len(want) > 60


def test_group_just_below_the_threshold_in_blocks(spark):
    """One text edited more and more: many members are unlike the pivot, some like others; blocks of a few members."""
    r = random.Random(21)
    words = [f"w{r.randrange(5000)}" for _ in range(150)]
    group = [" ".join(edited(r, words, n)) for n in range(12) for _ in range(6)]
    group += [" ".join(edited(r, group[-1].split(), 1)) for _ in range(5)]
    rows = spark.createDataFrame(list(enumerate(group)), "d long, text string").repartition(3)
    want = [(a, b) for a, b in combinations(range(len(group)), 2) if jaccard(group[a], group[b]) >= 0.8]
    unlike = [i for i, t in enumerate(group) if jaccard(t, group[0]) < 0.8]
    for block in (4, 512):
        got = [(x.a, x.b) for x in overlap.similar(rows, block=block).collect()]
        assert {tuple(sorted(p)) for p in got} <= set(want) and components(len(group), got) == components(len(group), want)
    assert len(unlike) > 20 and len(got) < 3 * len(group)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 5, "x"), (3, "other words here", 6, None)], "doc_id long, text string, _row int, _Row_ string")
    for kept in (overlap.keep_one(docs), simhash.keep_one(docs)):
        assert kept.columns == docs.columns and sorted((x[0] in (1, 2), x._row) for x in kept.collect()) == [(False, 6), (True, 5)]


def test_shingles_in_steps(monkeypatch):
    from panelwatch.llm import common

    whole = [overlap.shingles(t).tolist() for t in texts()]
    assert [len(x) for x in whole] == [len(brute_shingles(t)) for t in texts()]
    monkeypatch.setattr(common.chunks_of_words, "__defaults__", (50,))
    assert [overlap.shingles(t).tolist() for t in texts()] == whole


def test_stage_leaves_no_similar_pair(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(3000)}" for _ in range(300)]
    pair = [" ".join(words), " ".join(edited(r, words, 5))]
    assert jaccard(*pair) >= 0.8 and (brute_print(pair[0]) ^ brute_print(pair[1])).bit_count() > 4
    all_texts = pair + texts() + [pair[0]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i % 90 or None, t, "aa", "s", len(t or "")) for i, t in enumerate(all_texts)], schema).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sum(x.text in pair for x in kept) == 1
    assert not any(jaccard(a.text, b.text) >= 0.8 for a, b in combinations(kept, 2))
    bits = [brute_print(x.text) for x in kept]
    for t in all_texts:  # what goes has a link, to another row that may have gone itself
        near = [jaccard(t, u) >= 0.8 or (brute_print(t) ^ brute_print(u)).bit_count() <= 4 for u in all_texts]
        assert sum(near) > 1 or t in [x.text for x in kept]
    assert len(bits) == len(set(bits)) and len(kept) <= simhash.keep_one(docs).count()
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0
