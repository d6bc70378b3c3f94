"""Oracle SQL blocks for the inputs and the silver tables."""

from panelwatch.plans.registry import cte

cte("x_price_raw", """
  SELECT p_brand AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_extendedprice) AS sum_price, sum(l_quantity) AS sum_qty, count(*) AS n_lines
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
cte("x_price_spine", """
  SELECT series_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM x_price_raw GROUP BY series_id""")
cte("x_panel", """
  SELECT s.series_id, s.month,
         100.0 * r.price / avg(CASE WHEN year(s.month) = 1995 THEN r.price END) OVER (PARTITION BY s.series_id) AS ipc_level
  FROM x_price_spine s LEFT JOIN x_price_raw r ON r.series_id = s.series_id AND r.month = s.month""")
cte("x_cpi", """
  SELECT series_id, month, ipc_level,
         (ipc_level / nullif(lag(ipc_level, 1) OVER w, 0) - 1) * 100 AS inflation_mom,
         (ipc_level / nullif(lag(ipc_level, 12) OVER w, 0) - 1) * 100 AS inflation_yoy
  FROM x_panel WINDOW w AS (PARTITION BY series_id ORDER BY month)""")
cte("x_gappy", """
  SELECT series_id, month,
         CASE WHEN month(month) IN (2, 3) OR (year(month) = 1997 AND month(month) BETWEEN 5 AND 9)
                OR month = DATE '1995-01-01' OR month >= DATE '2001-08-01' THEN NULL ELSE ipc_level END AS v
  FROM x_panel""")
cte("x_kw", """
  SELECT series_id, month, keyword, n * 100.0::DOUBLE / max(n) OVER (PARTITION BY series_id) AS value
  FROM (SELECT c_mktsegment AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               o_orderpriority AS keyword, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""")
cte("x_macro_raw", """
  SELECT r_name AS region, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         sum(l_extendedprice) / sum(l_quantity) AS price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
cte("x_articles", """
  SELECT doc_id AS article_id, CAST(DATE '2022-01-01' + INTERVAL (CAST(doc_id % 36 AS INTEGER)) MONTH AS DATE) AS month,
         source, lang AS source_type, text FROM documents""")
cte("x_scores", """
  SELECT lang AS scope, CAST(n_chars AS DOUBLE) AS score, toxic AS y
  FROM labels JOIN documents USING (doc_id)""")
