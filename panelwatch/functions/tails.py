"""Tail probabilities of t and F in built-in functions, so that a test's p-value is a column like any other."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from panelwatch.functions.columns import as_col

# fixed values: the usual approximation of the gamma function (g = 7, nine terms), good to the last digits of a double
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a number of at least 0.5."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        total = total + c / (x + float(i))
    t = x + 6.5
    return (x - 0.5) * F.log(t) - t + F.log(total) + 0.5 * math.log(2 * math.pi)


def _away(v: Column) -> Column:
    return F.when(F.abs(v) < _TINY, _TINY).otherwise(v)


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta of ``x``; ``rest`` is 1 - x, given apart because it may be tiny. Null if anything is null.

    The continued fraction is folded step by step over as many steps as it needs, about the square root of the
    larger parameter; beyond the mean the other tail is taken.
    """

    def fraction(s: Column) -> Column:
        p, q, u = s["p"], s["q"], s["u"]

        def step(acc: Column, k: Column) -> Column:
            m = F.floor(k / 2)
            even = m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))
            num = F.when(k % 2 == 0, even).otherwise(odd)
            d, c = 1.0 / _away(1.0 + num * acc["d"]), _away(1.0 + num / acc["c"])
            return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

        first = 1.0 / _away(1.0 - (p + q) * u / (p + 1.0))
        steps = F.sequence(F.lit(2), (F.lit(240) + 12 * F.sqrt(F.greatest(p, q))).cast("int"))
        folded = F.aggregate(steps, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step)["h"]
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(u) + q * F.log(s["w"])) / p
        return F.when(s["other"], 1.0 - front * folded).otherwise(front * folded)

    other = x > (a + 1.0) / (a + b + 2.0)
    pick = lambda one, two: F.when(other, one).otherwise(two)
    # bound to one element, so that the arguments are worked out once a row
    bound = F.array(F.struct(pick(b, a).alias("p"), pick(a, b).alias("q"), pick(rest, x).alias("u"), pick(x, rest).alias("w"), other.alias("other")))
    inside = F.element_at(F.transform(bound, fraction), 1)
    return F.when((x > 0) & (rest > 0), inside).when(x <= 0, 0.0).when(rest <= 0, 1.0)


def t_pvalue(t, df) -> Column:
    """Two-sided p-value of a t statistic; null where the statistic is null or not a number, or there are no degrees of freedom."""
    t, v = as_col(t).cast("double"), as_col(df).cast("double")
    whole = v + t * t
    return F.when(~F.isnan(t) & (v > 0), incomplete_beta(v / 2, F.lit(0.5), v / whole, t * t / whole))


def f_pvalue(f, df1, df2) -> Column:
    """Upper-tail p-value of an F statistic (a negative one counts as 0); null as for t."""
    f, a, b = (as_col(c).cast("double") for c in (f, df1, df2))
    f = F.when(f.isNotNull() & ~F.isnan(f), F.greatest(f, F.lit(0.0)))  # greatest would skip a null
    whole = b + a * f
    return F.when((a > 0) & (b > 0), incomplete_beta(b / 2, a / 2, b / whole, a * f / whole))
