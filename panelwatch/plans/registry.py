"""Query registry and the composition of oracle SQL from named common table expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}  # bodies; ``compose`` adds the named blocks
_CTE: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Name a SQL block that later blocks and queries may select from."""
    _CTE[name] = sql


def compose(body: str) -> str:
    """Prefix ``body`` with the named blocks it needs, directly or through others."""
    order: list[str] = []

    def visit(sql: str, self_name: str | None = None) -> None:
        for name in _CTE:
            if name != self_name and name not in order and re.search(rf"\b{name}\b", sql):
                visit(_CTE[name], name)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({_CTE[n]})" for n in order)
    own = body.lstrip()
    if own.startswith("WITH "):
        return f"WITH {blocks},\n{own[5:]}"
    return f"WITH {blocks}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a query and, when it has one, its oracle."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def sql_solve(source: str, systems: dict[str, list[str]], rhs: str = "w") -> str:
    """``source`` with columns ``{tag}_b0, {tag}_b1, ...`` more: the solutions of normal equations ``tag: terms``.

    Sums are named ``{tag}_{a}_{b}`` (a before b in ``terms``). Plain elimination of the symmetric matrix, one level of SQL for each step; a
    pivot that shrinks to 1e-9 of its element makes the solution null.
    """
    levels: dict[int, list[str]] = {}
    for tag, terms in systems.items():
        k, cols = len(terms), [*terms, rhs]
        at = lambda p, i, j: f"{tag}_{terms[i]}_{cols[j]}" if p == 0 else f"{tag}_s{p}_{i}_{j}"
        d = lambda p: f"(CASE WHEN {at(p, p, p)} > 1e-9 * {at(0, p, p)} THEN {at(p, p, p)} END)"
        for p in range(k - 1):
            levels.setdefault(p, []).extend(f"{at(p, i, j)} - {at(p, p, i)} * {at(p, p, j)} / {d(p)} AS {tag}_s{p + 1}_{i}_{j}" for i in range(p + 1, k) for j in range(i, k + 1))
        for i in reversed(range(k)):
            known = "".join(f" - {at(i, i, j)} * {tag}_b{j}" for j in range(i + 1, k))
            levels.setdefault(2 * k - 2 - i, []).append(f"({at(i, i, k)}{known}) / {d(i)} AS {tag}_b{i}")
    for _, items in sorted(levels.items()):
        source = f"(SELECT *, {', '.join(items)} FROM {source})"
    return source


def sql_dot(tag: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"{tag}_b{i} * {t}" for i, t in enumerate(terms)) + ")"


def sql_beta(a: str, b: str, x: str, rest: str) -> str:
    """Regularised incomplete beta by its power series, from the side where that converges fast."""
    series = (f"(lambda_p.w ** lambda_p.q) * (lambda_p.u ** lambda_p.p) / lambda_p.p * exp(lgamma(lambda_p.p + lambda_p.q) - lgamma(lambda_p.p) - lgamma(lambda_p.q)) * "
              "list_sum(list_transform(range(0, 3000), lambda i_: exp(lgamma(lambda_p.p + lambda_p.q + i_) - lgamma(lambda_p.p + lambda_p.q) - lgamma(lambda_p.p + 1 + i_) + lgamma(lambda_p.p + 1) + i_ * ln(lambda_p.u))))")

    def side(p: str, q: str, u: str, w: str) -> str:
        return series.replace("lambda_p.p", f"({p})").replace("lambda_p.q", f"({q})").replace("lambda_p.u", f"({u})").replace("lambda_p.w", f"({w})")

    return f"(CASE WHEN {x} <= 0 THEN 0 WHEN {rest} <= 0 THEN 1 WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {side(b, a, rest, x)} ELSE {side(a, b, x, rest)} END)"


def sql_t_tail(t: str, v: str) -> str:
    return f"CASE WHEN {t} IS NOT NULL AND {v} > 0 THEN {sql_beta(f'({v} / 2.0)', '0.5', f'({v} / ({v} + {t} * {t}))', f'({t} * {t} / ({v} + {t} * {t}))')} END"


def sql_f_tail(f: str, a: str, b: str) -> str:
    g = f"greatest({f}, 0)"
    return f"CASE WHEN {f} IS NOT NULL AND {a} > 0 AND {b} > 0 THEN {sql_beta(f'({b} / 2.0)', f'({a} / 2.0)', f'({b} / ({b} + {a} * {g}))', f'({a} * {g} / ({b} + {a} * {g}))')} END"
