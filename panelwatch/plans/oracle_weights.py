"""Oracle SQL of the learned weights: the positive lasso tested set by set at every penalty, and the axis by repeated squaring."""

from __future__ import annotations

from panelwatch.plans.registry import cte, sql_solve


def lasso_blocks(prefix: str, source: str, features: list[str], standardise: bool = True) -> None:
    """Block ``{prefix}_fit``: series_id, method, n_train, and c (coefficients), m (means), d (deviations), g (weights) of every feature.

    Residuals are taken row by row, and each candidate set is tested at each penalty, so nothing is shared with the operator but the definition.
    """
    k, idx = len(features), range(len(features))
    complete = " AND ".join(f"{f} IS NOT NULL" for f in [*features, "y"])
    cte(f"{prefix}_rows", f"""
  WITH c AS (SELECT series_id, month, y::DOUBLE AS y, {', '.join(f'{f}::DOUBLE AS x{i}' for i, f in enumerate(features))}, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n
    FROM {source} WHERE {complete} WINDOW w AS (PARTITION BY series_id ORDER BY month))
  SELECT *, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS INTEGER) AS fold FROM c""")
    mean = lambda i: f"avg(x{i})" if standardise else "0.0::DOUBLE"
    dev = lambda i: f"CASE WHEN stddev_pop(x{i}) < 1e-12 THEN 1 ELSE stddev_pop(x{i}) END" if standardise else "1.0::DOUBLE"
    cte(f"{prefix}_scale", f"SELECT series_id, count(*)::DOUBLE AS n, {', '.join(f'{mean(i)} AS m{i}, {dev(i)} AS d{i}' for i in idx)} FROM {prefix}_rows GROUP BY 1")
    cte(f"{prefix}_z", f"SELECT r.series_id, fold, y, s.n AS n_all, {', '.join(f'(x{i} - m{i}) / d{i} AS z{i}' for i in idx)} FROM {prefix}_rows r JOIN {prefix}_scale s USING (series_id)")
    names = [f"z{i}" for i in idx]
    cov = ", ".join(f"covar_pop({a}, {b}) * count(*) AS t_{a}_{b}" for i, a in enumerate(names) for b in names[i:])
    cte(f"{prefix}_train", f"""
  SELECT series_id, f.f, count(*)::DOUBLE AS n, avg(y) AS ym, {', '.join(f'avg({z}) AS {z}m' for z in names)}, {cov}, {', '.join(f'covar_pop({z}, y) * count(*) AS t_{z}_y' for z in names)}
  FROM {prefix}_z, (SELECT unnest(range(-1, 5)) AS f) f WHERE f.f <> fold AND n_all >= 12 GROUP BY 1, 2""")
    on = [f"(mask & {1 << i}) <> 0" for i in idx]
    masked = []
    for tag in "uv":
        for i, a in enumerate(names):
            masked += [f"CASE WHEN {on[i]} AND {on[j]} THEN t_{a}_{names[j]} ELSE {1 if i == j else 0}::DOUBLE END AS {tag}_{a}_{names[j]}" for j in range(i, k)]
            masked.append(f"CASE WHEN {on[i]} THEN {f't_{a}_y' if tag == 'u' else '1'} ELSE 0::DOUBLE END AS {tag}_{a}_w")
    sets = f"(SELECT *, {', '.join(masked)} FROM {prefix}_train, (SELECT unnest(range(0, {2**k})) AS mask))"
    cte(f"{prefix}_sets", f"SELECT series_id, f, n, ym, mask, {', '.join(f'{z}m, t_{z}_y, u_b{i}, v_b{i}' for i, z in enumerate(names))}, {', '.join(f't_{a}_{b}' for i, a in enumerate(names) for b in names[i:])} FROM {sql_solve(sets, {'u': names, 'v': names})} WHERE {' AND '.join(f'u_b{i} IS NOT NULL' for i in idx)}")
    at = lambda i, j: f"t_z{min(i, j)}_z{max(i, j)}"
    top = f"(SELECT series_id, greatest({', '.join(f'abs(t_{z}_y)' for z in names)}) / n AS top FROM {prefix}_train WHERE f = -1)"
    fit = " AND ".join(f"CASE WHEN {on[i]} THEN u_b{i} - l * v_b{i} >= -1e-9 * abs(u_b{i}) ELSE t_z{i}_y - ({' + '.join(f'{at(i, j)} * (u_b{j} - l * v_b{j})' for j in idx)}) <= l * (1 + 1e-9) END" for i in idx)
    cte(f"{prefix}_path", f"""
  WITH g AS (SELECT s.*, a, n * top * power(1e-3, a / 99.0) AS l FROM {prefix}_sets s JOIN {top} USING (series_id), (SELECT unnest(range(0, 100)) AS a) WHERE top > 0)
  SELECT series_id, f, a, ym, {', '.join(f'{z}m' for z in names)}, {', '.join(f'greatest(u_b{i} - l * v_b{i}, 0) AS b{i}' for i in idx)} FROM g WHERE {fit} QUALIFY row_number() OVER (PARTITION BY series_id, f, a ORDER BY mask) = 1""")
    cte(f"{prefix}_best", f"""
  WITH e AS (SELECT p.series_id, p.f, a, avg(power(y - ym - ({' + '.join(f'b{i} * (z{i} - z{i}m)' for i in idx)}), 2)) AS e FROM {prefix}_path p JOIN {prefix}_z z ON z.series_id = p.series_id AND z.fold = p.f GROUP BY 1, 2, 3),
  s AS (SELECT series_id, a, sum(e) AS e FROM e GROUP BY 1, 2)
  SELECT series_id, a FROM s QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY e, a) = 1""")
    total = " + ".join(f"coalesce(b{i}, 0)" for i in idx)
    found = f"({total}) > 0"
    cte(f"{prefix}_fit", f"""
  SELECT s.series_id, CASE WHEN {found} THEN 'lasso' ELSE 'equal' END AS method, s.n AS n_train,
    {', '.join(f'CASE WHEN {found} THEN b{i} ELSE 1 END AS c{i}, m{i}, d{i}, CASE WHEN {found} THEN b{i} / ({total}) ELSE 1.0::DOUBLE / {k} END AS g{i}' for i in idx)}
  FROM {prefix}_scale s LEFT JOIN (SELECT p.* FROM {prefix}_path p JOIN {prefix}_best b ON b.series_id = p.series_id AND b.a = p.a WHERE p.f = -1) p ON p.series_id = s.series_id""")


def pca_block(name: str, source: str, features: list[str]) -> None:
    """Block ``name`` in the form of the lasso's fits: the axis of the correlation matrix by squaring it thirty times."""
    k, idx = len(features), range(len(features))
    pairs = [(i, j) for i in idx for j in range(i, k)]
    at = lambda i, j: f"m{min(i, j)}_{max(i, j)}"
    complete = " AND ".join(f"{f} IS NOT NULL" for f in [*features, "y"])
    dev = lambda f: f"CASE WHEN stddev_pop({f}) < 1e-12 THEN 1 ELSE stddev_pop({f}) END"
    trace = " + ".join(at(i, i) for i in idx)
    squared = ", ".join(f"({' + '.join(f'{at(i, l)} * {at(l, j)}' for l in idx)}) / power({trace}, 2)" for i, j in pairs)
    largest = f"list_position([{', '.join(at(i, i) for i in idx)}], greatest({', '.join(at(i, i) for i in idx)}))"
    column = f"[{', '.join('[' + ', '.join(at(i, j) for i in idx) + ']' for j in idx)}][{largest}]"
    cte(name, f"""
  SELECT st.series_id, CASE WHEN n >= 12 THEN 'pca' ELSE 'equal' END AS method, n AS n_train, {', '.join(f'CASE WHEN n >= 12 THEN v[{i + 1}] * sg / len_v ELSE 1 END AS c{i}, m{i}, d{i}' for i in idx)}
  FROM (SELECT series_id, count(*)::DOUBLE AS n, {', '.join(f'avg({f}) AS m{i}, {dev(f)} AS d{i}' for i, f in enumerate(features))} FROM {source} WHERE {complete} GROUP BY 1) st
  JOIN (SELECT *, sqrt(list_sum([x * x for x in v])) AS len_v, sign(v[list_position([round(abs(x) / sqrt(list_sum([y * y for y in v])), 9) for x in v], list_max([round(abs(x) / sqrt(list_sum([y * y for y in v])), 9) for x in v]))]) AS sg FROM (
    SELECT series_id, {column} AS v FROM (
      WITH RECURSIVE s AS (
        SELECT series_id, 0 AS r, {', '.join(f'covar_pop({features[i]}, {features[j]}) / (({dev(features[i])}) * ({dev(features[j])})) AS {at(i, j)}' for i, j in pairs)} FROM {source} WHERE {complete} GROUP BY 1
        UNION ALL SELECT series_id, r + 1, {squared} FROM s WHERE r < 30)
      SELECT * FROM s WHERE r = 30))) ax ON ax.series_id = st.series_id""")


def index_sql(fits: str, rows: str, features: list[str], mean: str) -> str:
    """``series_id, month, method, raw``: the fitted index before scaling; ``mean`` is the row mean of the features."""
    z = " + ".join(f"(coalesce({f}, 0) - m{i}) / d{i} * c{i}" for i, f in enumerate(features))
    return f"SELECT r.series_id, r.month, method, CASE WHEN method = 'equal' THEN {mean} ELSE {z} END AS raw FROM {rows} r LEFT JOIN {fits} f ON f.series_id = r.series_id"
