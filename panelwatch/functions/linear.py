"""Small linear algebra on arrays, as higher-order functions in the JVM: no rows leave it for a solve."""

from __future__ import annotations

from collections.abc import Sequence

#: A pivot this much smaller than its diagonal element was is taken for zero: the equations are singular.
SINGULAR = "1e-9D"


def matrix(rows: Sequence[Sequence[str]]) -> str:
    """SQL of an array of rows."""
    return f"array({', '.join('array(' + ', '.join(r) + ')' for r in rows)})"


def _eliminated(name: str, steps: int) -> str:
    """The rows after elimination of the first columns, each pivot 1; null where the equations are singular."""
    pivot = f"CASE WHEN m[p][p] > {SINGULAR} * {name}[p][p] THEN m[p][p] END"
    step = "transform(m, (r, i) -> CASE WHEN i = p THEN transform(r, v -> v / d) ELSE zip_with(r, m[p], (v, u) -> v - u * r[p] / d) END)"
    # the pivot is bound by a lambda of one element, so it is worked out once a step
    return f"aggregate(sequence(0, {steps - 1}), {name}, (m, p) -> transform(array({pivot}), d -> {step})[0])"


def solve(name: str, k: int, sides: int = 1) -> str:
    """SQL of the solution of ``k`` normal equations (with more ``sides`` an array of solutions); null if they are singular or hold a null.

    ``name`` is a column of ``k`` rows of ``k + sides`` numbers, the right-hand sides last. The matrix must be symmetric and not
    negative, as sums of products are; then elimination down the diagonal needs no exchange of rows.
    """
    if sides == 1:
        return f"transform({_eliminated(name, k)}, r -> r[{k}])"
    return f"transform(array({_eliminated(name, k)}), m -> array({', '.join(f'transform(m, r -> r[{k + j}])' for j in range(sides))}))[0]"


def residual(name: str, k: int, steps: int) -> str:
    """SQL of the sum of squares that the first ``steps`` regressors leave.

    ``name`` holds the products of ``k`` regressors and, last, the target; elimination leaves the rest of the target's square in its corner.
    """
    return f"{_eliminated(name, steps)}[{k}][{k}]"


def dot(name: str, terms: Sequence[str]) -> str:
    """SQL of the sum of a coefficient array's elements times the terms."""
    return "(" + " + ".join(f"{name}[{i}] * {t}" for i, t in enumerate(terms)) + ")"


def principal_axis(name: str, k: int, sweeps: int = 12) -> str:
    """SQL of the unit eigenvector of the largest eigenvalue of a symmetric ``k x k`` array matrix, by cyclic rotations.

    Each rotation clears one pair of elements; a fixed number of sweeps brings any small matrix to rounding. The sign
    makes the largest loading positive (equal ones, to nine decimals: the first).
    """
    if k == 1:
        return "array(1D)"
    pairs = [(p, q) for p in range(k) for q in range(p + 1, k)]
    ps, qs = (f"array({', '.join(str(x[i]) for x in pairs)})" for i in (0, 1))
    tau = "((m.a[x.q][x.q] - m.a[x.p][x.p]) / (2D * m.a[x.p][x.q]))"
    tan = f"CASE WHEN m.a[x.p][x.q] = 0 THEN 0D ELSE (CASE WHEN {tau} < 0 THEN -1D ELSE 1D END) / (abs({tau}) + sqrt(1D + {tau} * {tau})) END"
    turn = "(r, j) -> CASE WHEN j = x.p THEN c.c * {0}[x.p] - c.s * {0}[x.q] WHEN j = x.q THEN c.s * {0}[x.p] + c.c * {0}[x.q] ELSE r END"
    columns = lambda of: f"transform({of}, u -> transform(u, {turn.format('u')}))"
    # rows p and q of the matrix whose columns are turned already
    rows = (f"transform(array({columns('m.a')}), n -> transform(n, (u, i) -> CASE WHEN i = x.p THEN zip_with(n[x.p], n[x.q], (g, h) -> c.c * g - c.s * h) "
            "WHEN i = x.q THEN zip_with(n[x.p], n[x.q], (g, h) -> c.s * g + c.c * h) ELSE u END))[0]")
    turned = f"named_struct('a', {rows}, 'v', {columns('m.v')})"
    by_angle = f"transform(transform(array({tan}), t -> named_struct('c', 1D / sqrt(1D + t * t), 's', t / sqrt(1D + t * t))), c -> {turned})[0]"
    step = f"transform(array(named_struct('p', {ps}[i % {len(pairs)}], 'q', {qs}[i % {len(pairs)}])), x -> {by_angle})[0]"
    unit = f"array({', '.join('array(' + ', '.join('1D' if i == j else '0D' for j in range(k)) + ')' for i in range(k))})"
    done = f"aggregate(sequence(0, {sweeps * len(pairs) - 1}), named_struct('a', {name}, 'v', {unit}), (m, i) -> {step})"
    places = f"array({', '.join(f'named_struct({chr(39)}l{chr(39)}, m.a[{i}][{i}], {chr(39)}i{chr(39)}, {-i})' for i in range(k))})"
    axis = f"transform(array({done}), m -> transform(m.v, u -> u[-array_max({places}).i]))[0]"
    largest = "filter(w, l -> round(abs(l), 9) = round(array_max(transform(w, b -> abs(b))), 9))[0]"
    return f"transform(array({axis}), w -> transform(w, l -> l * sign({largest})))[0]"
