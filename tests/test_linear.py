import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwatch.functions import linear
from panelwatch.functions.tails import f_pvalue, log_gamma, t_pvalue


def frame(spark, systems):
    return spark.createDataFrame([(i, np.asarray(m, float).tolist()) for i, m in enumerate(systems)], "i int, m array<array<double>>")


def test_solve_and_residual_equal_least_squares(spark):
    r = np.random.default_rng(1)
    systems, want, left = [], [], []
    for _ in range(20):
        x, y = r.normal(size=(30, 4)) * [1, 10, 0.1, 3], r.normal(size=30)
        both = np.column_stack((x, y))
        systems.append(both.T @ both)
        want.append(np.linalg.lstsq(x, y, rcond=None)[0])
        left.append([((y - x[:, :k] @ np.linalg.lstsq(x[:, :k], y, rcond=None)[0]) ** 2).sum() for k in (1, 4)])
    rows = frame(spark, systems).selectExpr("i", f"{linear.solve('slice(m, 1, 4)', 4)} AS b", f"{linear.residual('m', 4, 1)} AS one", f"{linear.residual('m', 4, 4)} AS every").orderBy("i").collect()
    assert np.allclose([x.b for x in rows], want) and np.allclose([(x.one, x.every) for x in rows], left)


def test_singular_or_unknown_equations_give_null(spark):
    ok = [[2.0, 1.0, 3.0], [1.0, 2.0, 3.0]]
    rows = spark.createDataFrame([(0, ok), (1, [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]), (2, [[0.0, 0.0, 0.0], [0.0, 1.0, 1.0]]), (3, [[None, 1.0, 3.0], [1.0, 2.0, 3.0]]), (4, None)], "i int, m array<array<double>>")
    got = [x.b for x in rows.selectExpr("i", f"{linear.solve('m', 2)} AS b").orderBy("i").collect()]
    assert got[0] == pytest.approx([1.0, 1.0]) and all(b is None or set(b) == {None} for b in got[1:])


def test_two_right_hand_sides(spark):
    m = [[4.0, 1.0, 1.0, 2.0], [1.0, 3.0, 1.0, 5.0]]
    (one, two), = [x[0] for x in frame(spark, [m]).selectExpr(linear.solve("m", 2, 2)).collect()]
    a = np.array(m)
    assert np.allclose(one, np.linalg.solve(a[:, :2], a[:, 2])) and np.allclose(two, np.linalg.solve(a[:, :2], a[:, 3]))


def test_tails_against_closed_forms(spark):
    ts = [-30.0, -2.5, -0.01, 0.0, 0.3, 1.0, 4.0, 200.0]
    got = spark.createDataFrame([(t,) for t in ts], "t double").select(t_pvalue("t", F.lit(1)), t_pvalue("t", F.lit(2)), t_pvalue("t", F.lit(5000))).collect()
    for t, (one, two, many) in zip(ts, got):
        assert one == pytest.approx(1 - 2 / math.pi * math.atan(abs(t)), abs=1e-12)
        assert two == pytest.approx(1 - abs(t) / math.sqrt(2 + t * t), abs=1e-12)
        assert many == pytest.approx(math.erfc(abs(t) / math.sqrt(2)), abs=2e-4)
    fs = [(0.0, 7.0), (0.2, 3.0), (1.0, 10.0), (9.0, 80.0), (3.0, 4000.0)]
    got = spark.createDataFrame(fs, "f double, b double").select(f_pvalue("f", F.lit(2), "b")).collect()
    assert [x[0] for x in got] == pytest.approx([(1 + 2 * f / b) ** (-b / 2) for f, b in fs], abs=1e-12)
    odd = spark.createDataFrame([(None, 3.0), (float("nan"), 3.0), (1.0, 0.0)], "t double, v double").select(t_pvalue("t", "v"), f_pvalue("t", "v", "v")).collect()
    assert all(x[0] is None and x[1] is None for x in odd)


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.5, 40.0, 3000.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-13, abs=1e-12)
