import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwatch.functions.columns import normal_cdf
from panelwatch.functions.tails import f_pvalue, t_pvalue
from panelwatch.operators import index as X, inference as I, stats as ST
from tests.conftest import months

E1 = [1.0, -2.0, 0.5, 1.5, -1.0, 2.0, -0.5, 1.0, -1.5, 0.8]
E2 = [0.5, -1.0, 1.0, 1.0, -2.0, 1.0, -1.0, 0.5, -0.5, 1.2]


def loss_frame(spark, e1, e2):
    return spark.createDataFrame([("s", i, a * a - b * b) for i, (a, b) in enumerate(zip(e1, e2))], "g string, month int, d double")


def hand_dm(e1, e2, h):
    d = np.square(e1) - np.square(e2)
    t, c = len(d), np.square(e1) - np.square(e2) - (np.square(e1) - np.square(e2)).mean()
    lrv = c @ c / t
    for k in range(1, h):
        lrv += 2 * (1 - k / h) * (c[k:] @ c[:-k]) / t
    lrv = max(lrv, 1e-12) if h > 1 else lrv
    return d.mean() / math.sqrt(lrv / t) * math.sqrt((t + 1 - 2 * h + h * (h - 1) / t) / t)


@pytest.mark.parametrize("h", [1, 2, 3])
def test_dm_by_hand(spark, h):
    got = I.dm_test(loss_frame(spark, E1, E2), ["g"], h=h).first()
    assert got["dm_stat"] == pytest.approx(hand_dm(E1, E2, h), rel=1e-9)


def test_dm_antisymmetric_and_short(spark):
    a = I.dm_test(loss_frame(spark, E1, E2), ["g"]).first()["dm_stat"]
    b = I.dm_test(loss_frame(spark, E2, E1), ["g"]).first()["dm_stat"]
    assert a == pytest.approx(-b)
    short = I.with_dm_pvalues(I.dm_test(loss_frame(spark, E1[:7], E2[:7]), ["g"])).collect()
    assert {r["p_value"] for r in short} == {None} and {r["conclusion"] for r in short} == {"Echantillon insuffisant"}


def test_normal_cdf_error(spark):
    xs = [-4.0, -1.0, 0.0, 0.3, 1.96, 5.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf("x")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=2e-7)


def test_tails_against_known_values(spark):
    r = spark.createDataFrame([(2.228, 10.0, 4.96, 1.0, 10.0)], "t double, df double, f double, a double, b double").select(t_pvalue("t", "df"), f_pvalue("f", "a", "b")).first()
    assert r[0] == pytest.approx(0.05, abs=2e-4) and r[1] == pytest.approx(0.05, abs=2e-4)


def test_block_indices_agree_with_the_array_draws(spark):
    groups = spark.createDataFrame([("s", 17)], "g string, n int")
    rows = I.block_bootstrap_indices(groups, ["g"], reps=5).orderBy("rep", "pos").collect()
    assert [r["idx"] for r in rows] == I._draws(17, 5, 6, I.SEED).ravel().tolist()
    assert len(rows) == 85


def test_constant_errors_have_a_point_interval(spark):
    d = spark.createDataFrame([([2.0] * 20,)], "e array<double>").select(I.error_intervals(F.col("e"), reps=50).alias("b")).select("b.*").first()
    assert all(v == pytest.approx(2.0) for v in d)


def test_class_metrics_match_a_plain_loop():
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, (30, 15)), rng.integers(0, 5, (30, 15)).astype(float)
    got = I._class_metrics(y, s)
    for i in range(30):
        pos, neg = y[i].sum(), (1 - y[i]).sum()
        pairs = [(a > b) + 0.5 * (a == b) for a in s[i][y[i] == 1] for b in s[i][y[i] == 0]]
        auc = sum(pairs) / (pos * neg) if pos and neg else 0.5
        best = (0.0, 0.0, 0.0)
        for t in np.unique(s[i]):
            tp, fp = ((s[i] >= t) & (y[i] == 1)).sum(), ((s[i] >= t) & (y[i] == 0)).sum()
            f1 = 2 * tp / (tp + fp + pos)
            if pos and f1 > best[0]:
                best = (f1, tp / pos, tp / (tp + fp))
        assert got[i] == pytest.approx([auc, *best])


def test_overlap_rule(spark):
    d = spark.createDataFrame([("s", "RMSE", "a", 0.0, 1.0), ("s", "RMSE", "b", 1.0, 2.0), ("s", "RMSE", "c", 0.5, 3.0)], "g string, metric string, model string, lo double, hi double")
    got = {(r["model_a"], r["model_b"]): r["overlap"] for r in I.ci_overlap(d, ["g"], ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): False, ("a", "c"): True, ("b", "c"): True}


def ols_f(y, x, p):
    n = len(y)
    rows = range(p, n)
    yl = np.array([[y[i - k] for k in range(1, p + 1)] for i in rows])
    xl = np.array([[x[i - k] for k in range(1, p + 1)] for i in rows])
    t, one = np.array(y[p:]), np.ones((n - p, 1))
    rss = lambda a: ((t - a @ np.linalg.lstsq(a, t, rcond=None)[0]) ** 2).sum()
    r, u = rss(np.hstack([one, yl])), rss(np.hstack([one, yl, xl]))
    return (r - u) / p / (u / (n - p - 2 * p - 1))


def test_granger_matches_ols(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=60)
    y = np.convolve(x, [0, 0.8, 0.3])[:60] + rng.normal(size=60)
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "series_id string, month int, y double, x double")
    got = {r["lag"]: r["f_stat"] for r in ST.granger_f(df, "y", "x").collect()}
    for p in (1, 2, 3, 4):
        assert got[p] == pytest.approx(ols_f(y, x, p), rel=1e-6)


def test_pacf_of_an_autoregression_stops_after_its_order(spark):
    rng = np.random.default_rng(7)
    y = [0.0]
    for _ in range(800):
        y.append(0.7 * y[-1] + rng.normal())
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "series_id string, month int, v double")
    p = [r["pacf"] for r in ST.pacf(df, "v", 5).orderBy("lag").collect()]
    assert p[0] == 1.0 and p[1] == pytest.approx(0.7, abs=0.08) and max(abs(v) for v in p[2:]) < 0.12


def test_gram_folds_sum_to_the_total_and_lasso_is_optimal(spark):
    rng = np.random.default_rng(8)
    n = 53
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    y = 2 * a - 1.0 * b + 0.1 * rng.normal(size=n) + 3
    df = spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(zip(a, b, c, y))], "series_id string, month int, a double, b double, c double, y double")
    g = X.gram_by_fold(df, ["a", "b", "c"], "y")
    pdf = g.toPandas()
    assert sorted(pdf.sort_values("fold").n) == [10, 10, 11, 11, 11]
    assert pdf.g_0_3.sum() == pytest.approx(a @ y)
    fit = X.fit_weights(g, ["a", "b", "c"], "lasso").first()
    assert fit["coef"][1] == 0.0 and fit["coef"][0] > 1.5 and sum(fit["weight"]) == pytest.approx(1.0)
    few = X.fit_weights(X.gram_by_fold(df.where("month < 10"), ["a", "b", "c"], "y"), ["a", "b", "c"], "lasso").first()
    assert few["method"] == "equal" and few["weight"] == pytest.approx([1 / 3] * 3)


def coordinate_lasso(x, y, alpha):
    """Positive lasso by plain coordinate descent on centred data."""
    n, beta = len(y), np.zeros(x.shape[1])
    for _ in range(20_000):
        old = beta.copy()
        for j in range(len(beta)):
            q = x[:, j] @ x[:, j]
            if q > 0:
                beta[j] = max(0.0, (x[:, j] @ (y - x @ beta) + q * beta[j] - n * alpha) / q)
        if np.abs(beta - old).max() < 1e-13:
            break
    return beta


@pytest.mark.parametrize("standardise", [True, False])
def test_lasso_equals_coordinate_descent(spark, standardise):
    rng = np.random.default_rng(10)
    rows, want = [], {}
    for name, n in (("p", 40), ("q", 61), ("r", 12)):
        x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 1] + [0, 3, 1, 0]
        x[:, 3] = 0.7 * x[:, 0] + 0.3 * x[:, 3]
        if name == "q":
            x[:, 2] = 2.0  # a constant feature
        y = x @ [1.0, 0.3, -2.0, 0.5] + rng.normal(size=n)
        rows += [(name, i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
        dev = x.std(axis=0) if standardise else np.ones(4)
        z = (x - (x.mean(axis=0) if standardise else 0)) / np.where(dev < 1e-12, 1, dev)
        top = np.abs((z - z.mean(0)).T @ (y - y.mean())).max() / n
        alphas, sizes = top * 1e-3 ** (np.arange(0, 100, 1) / 99), [n // 5 + (i < n % 5) for i in range(5)]
        errors, edges = np.zeros(100), np.cumsum([0, *sizes])
        for a, b in zip(edges[:-1], edges[1:]):
            t = np.r_[0:a, b:n]
            for i, alpha in enumerate(alphas):
                beta = coordinate_lasso(z[t] - z[t].mean(0), y[t] - y[t].mean(), alpha)
                errors[i] += ((y[a:b] - y[t].mean() - (z[a:b] - z[t].mean(0)) @ beta) ** 2).mean()
        want[name] = coordinate_lasso(z - z.mean(0), y - y.mean(), alphas[errors.argmin()])
    df = spark.createDataFrame(rows, "series_id string, month int, a double, b double, c double, d double, y double")
    names = ["a", "b", "c", "d"]
    got = {r.series_id: r for r in X.fit_weights(X.gram_by_fold(df, names, "y"), names, "lasso", standardise=standardise).collect()}
    for name, coef in want.items():
        assert got[name].method == ("lasso" if coef.any() else "equal") and got[name].coef == pytest.approx(coef.tolist(), abs=1e-6)


def test_axis_equals_the_eigenvector(spark):
    rng = np.random.default_rng(12)
    n, rows = 50, []
    for name in "pqr":
        x = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5))
        rows += [(name, i, *map(float, v), 1.0) for i, v in enumerate(x)]
    names = list("abcde")
    df = spark.createDataFrame(rows, f"series_id string, month int, {', '.join(f'{c} double' for c in names)}, y double")
    got = {r.series_id: r.coef for r in X.fit_weights(X.gram_by_fold(df, names, "y"), names, "pca").collect()}
    for name in "pqr":
        axis = np.linalg.eigh(np.corrcoef(np.array([r[2:7] for r in rows if r[0] == name]).T))[1][:, -1]
        assert got[name] == pytest.approx((axis * np.sign(axis[np.abs(axis).argmax()])).tolist(), abs=1e-9)


def test_pca_axis_sign_and_scores(spark):
    rng = np.random.default_rng(11)
    t = rng.normal(size=60)
    df = spark.createDataFrame([("s", i, float(v), float(-v + 0.1 * e), float(i)) for i, (v, e) in enumerate(zip(t, rng.normal(size=60)))], "series_id string, month int, a double, b double, y double")
    fit = X.fit_weights(X.gram_by_fold(df, ["a", "b"], "y"), ["a", "b"], "pca").first()
    assert np.abs(fit["coef"]) == pytest.approx([math.sqrt(0.5)] * 2, abs=1e-6)
    assert max(fit["coef"], key=abs) > 0


def test_break_tests_by_hand(panel):
    pre, post = [1.0, 2.0, 3.0, 2.5, 1.5], [6.0, 7.5, 5.0, 8.0]
    df = panel([("a", m, v) for m, v in zip(months(2020, 9), pre + post)])
    w = ST.break_welch(df, "v", "2020-06-01").first()
    v1, v2 = np.var(pre, ddof=1), np.var(post, ddof=1)
    assert w["t_stat"] == pytest.approx((np.mean(pre) - np.mean(post)) / math.sqrt(v1 / 5 + v2 / 4))
    z = [np.abs(np.array(g) - np.median(g)) for g in (pre, post)]
    gm = np.concatenate(z).mean()
    between = sum(len(g) * (g.mean() - gm) ** 2 for g in z)
    within = sum(((g - g.mean()) ** 2).sum() for g in z)
    assert ST.levene(df, "v", "2020-06-01").first()["w_stat"] == pytest.approx(7 * between / within)


def test_clusters_of_fewer_different_vectors_than_clusters(spark):
    from pyspark.ml.functions import array_to_vector
    from panelwatch.operators import select as S

    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 2.0]), ("c", [1.0, 2.0])], "keyword string, v array<double>").select("keyword", array_to_vector("v").alias("features"))
    one = rows.where("keyword = 'b'")
    assert [(r["keyword"], r["cluster"]) for r in S.cluster(one, one.count()).collect()] == [("b", 0)]
    of = {r["keyword"]: r["cluster"] for r in S.cluster(rows, rows.count()).collect()}
    assert of["b"] == of["c"] != of["a"]


def test_near_copies_of_any_scale_get_their_clusters(spark):
    from pyspark.ml.functions import array_to_vector
    from panelwatch.operators import select as S

    xs = [0.0, 0.001, 0.1, 10.0, 1000.0]
    for first in (1, 3):  # the start draws by place: other orders happened to find all
        rows = spark.createDataFrame([(x, [x, 0.0]) for x in xs[first:] + xs[:first]], "x double, v array<double>").coalesce(1)
        vectors = rows.select("x", array_to_vector("v").alias("features"))
        assert len({r["cluster"] for r in S.cluster(vectors, 5).collect()}) == 5


@pytest.mark.parametrize("follows, kept", [(True, ["BUILDING:1-URGENT"]), (False, [])])
def test_validated_keywords_of_one_and_of_no_kept_keyword(spark, tmp_path, follows, kept):
    """Orders of one keyword that are the yearly price change, or have nothing to do with it."""
    from panelwatch.plans.q_inference import validated_keywords

    rng = np.random.default_rng(0)
    n, other = rng.integers(1, 20, 60).tolist(), rng.integers(1, 20, 60).tolist()
    level = [100.0] * 12
    for i in range(12, 60):
        level.append(level[i - 12] * (1 + (n if follows else other)[i] / 100))
    orders = [m for m, c in zip(months(1995, 60), n) for _ in range(c)]
    spark.createDataFrame([(1, "BUILDING")], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(f"{m}-03",) for m in orders], "d string").selectExpr(
        "1L AS o_custkey", "'1-URGENT' AS o_orderpriority", "to_timestamp_ntz(d) AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(f"{m}-03", v) for m, v in zip(months(1995, 60), level)], "d string, v double").selectExpr(
        "1D AS l_quantity", "v AS l_extendedprice", "to_timestamp_ntz(d) AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = validated_keywords(spark, str(tmp_path))
    assert got.columns[:2] == ["cluster", "keyword"] and [r["keyword"] for r in got.collect()] == kept
