import numpy as np

from panelwatch.llm import covertree


def brute(rows, threshold=0.95):
    """``{row: (links, component)}`` of ``(id, vector)`` rows by all pairs."""
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (i, j))
                if (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    out, seen = {}, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        out |= {j: (len(links[j]), min(ids) if ids else None) for j in group}
    return [(rows[i][0], *out[i]) for i in range(n)]


def key(x):
    return tuple((y is not None, y or 0) for y in x)


def check(spark, rows, schema="vec_id long, embedding array<double>, n_links int, kept string", **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(3)
    got = covertree.link(df, **options).collect()
    want = brute(rows)
    assert sorted(((x.vec_id, x.n_links, x.component_id) for x in got), key=key) == sorted(want, key=key)
    assert all(x.kept == (x.vec_id is not None and x.vec_id == x.component_id) for x in got)
    return df


def vectors(seed, n, dims=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dims))
    spread = r.choice([0.02, 0.1, 0.25, 2.0], size=(n, 1))
    x = centres[r.choice(9, n, p=[0.4, *[0.075] * 8])] + r.normal(size=(n, dims)) * spread
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_links_and_components_against_all_pairs(spark):
    rows = vectors(1, 600)
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, [2 * c for c in rows[5][1]])]
    df = check(spark, rows, block=90, most=6)
    have = {tuple(sorted((x.a, x.b))): x.cosine for x in covertree.pairs(df, block=90, most=6).collect()}
    u = {}
    for i, v in rows:
        u.setdefault(tuple(v), i)
    x = np.array(list(u), float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    ids, s = list(u.values()), x @ x.T
    want = {tuple(sorted((ids[i], ids[j]))) for i, j in zip(*np.nonzero(np.triu(s >= 0.95, 1)))}
    assert set(have) == want and min(have.values()) >= 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [-1.0, 0.0]), (None, [1.0, 0.01]), (9, [1.0]), (10, [3.0]), (11, []), (None, None), (12, [1e300, 1e-300]), (13, [5e-324, 0.0]), (14, [1.0, 0.3])]
    check(spark, rows)
    assert covertree.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert covertree.pairs(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_threshold_is_met_exactly(spark):
    # 3-4-5 triangles: the cosine is 0.96 or 0.8 without a remainder
    rows = [(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(x.a, x.b) for x in covertree.pairs(df, threshold=0.8).orderBy("a").collect()] == [(0, 1), (1, 2)]


def test_group_of_near_copies_is_not_enumerated():
    r = np.random.default_rng(2)
    x = np.concatenate((r.normal(size=(1, 32)) + r.normal(size=(2000, 32)) * 0.02, r.normal(size=(300, 32))))
    tree = covertree.Tree.unpack(covertree.Tree.build(np.arange(2300), np.ones(2300, np.int64), x).pack())
    links, inside, seen = covertree.traverse(tree, tree, 0.95, True)
    assert inside and sum(len(i) for i, _, _ in links) < 50 and seen < 2300 * 2300 / 8
    got, _, u, v, _ = covertree.sums_and_forest(tree, tree, 0.95, True)
    s = covertree.unit(x)
    assert (got == ((s @ s.T >= 0.95).sum(axis=1) - 1)[tree.ids]).all() and len(u) < 2300
    assert all(1e-9 >= abs(radius[0] - 0) or radius.max() <= 2 for _, _, radius in tree.levels)
