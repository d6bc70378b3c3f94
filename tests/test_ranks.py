import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from panelwatch.operators import classify as CL, ranks


def brute_counts(pdf):
    out = []
    for t in sorted(pdf.score.unique(), reverse=True):
        hit = pdf.score >= t
        out.append((t, int((hit & (pdf.y == 1)).sum()), int((hit & (pdf.y == 0)).sum())))
    return out


@pytest.mark.parametrize("bounded", [True, False])
def test_curve_counts_match_brute_force_with_ties_and_crowding(spark, bounded):
    rng = np.random.default_rng(1)
    # nearly all scores sit in a millionth of the range, some far away, many tied
    s = np.concatenate([rng.integers(0, 40, 300) * 1e-7, rng.normal(0, 1, 60), [1e6, -1e6]])
    pdf = pd.DataFrame({"g": "a", "score": s, "y": rng.integers(0, 2, len(s))})
    c = CL.threshold_curve(spark.createDataFrame(pdf), ["g"], bounded=bounded).toPandas().sort_values("threshold", ascending=False)
    assert [(r.threshold, r.tp, r.fp) for r in c.itertuples()] == brute_counts(pdf)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    frames = {"n": rng.normal(size=501), "ties": rng.integers(0, 4, 200).astype(float), "crowd": np.append(rng.random(300) * 1e-9, 1e9), "one": np.array([3.5]), "tail": np.append(rng.random(400), [1e15, -1e15, 1e300])}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in frames.items()])
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = ranks.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas().set_index("k")
    for k, v in frames.items():
        assert [got.loc[k, ranks.quantile_name(p)] for p in probs] == pytest.approx(list(np.percentile(v, [100 * p for p in probs])), rel=1e-12, abs=1e-15)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=2, max_size=25))
def test_auc_symmetry_and_monotone_maps(spark, rows):
    pdf = pd.DataFrame([("p", float(s), y) for s, y in rows] + [("neg", -float(s), y) for s, y in rows] + [("cube", float(s) ** 3, y) for s, y in rows], columns=["g", "score", "y"])
    a = {r["g"]: r["auc"] for r in CL.areas(CL.threshold_curve(spark.createDataFrame(pdf), ["g"], bounded=True), ["g"]).collect()}
    assert a["p"] + a["neg"] == pytest.approx(1.0)
    assert a["p"] == pytest.approx(a["cube"])
