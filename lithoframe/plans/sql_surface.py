"""The relational surface: one query for each SQL feature, as text that Catalyst plans.

Texts are the same for both engines except where dialects differ; then the second text is the oracle's.
"""

from __future__ import annotations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: name -> (text, oracle's text or None if the same)
TEXTS: dict[str, tuple[str, str | None]] = {
    "sql_s01_scan": ("SELECT * FROM nation", None),
    "sql_s02_projection": ("SELECT o_orderkey, o_totalprice * 2 AS doubled, o_custkey + 1 AS next_cust FROM orders", None),
    "sql_s03_filter": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 42", None),
    "sql_s04_order_by": ("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal NULLS LAST, s_suppkey LIMIT 20", None),
    "sql_s05_count": ("SELECT count(*) AS n FROM lineitem", None),
    "sql_s06_sum": ("SELECT CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(l_quantity), 2) AS quantity FROM lineitem", None),
    "sql_s10_literals": ("SELECT 42 AS i, CAST(3.25 AS DOUBLE) AS r, 'hello' AS t, hex(X'DEADBEEF') AS b, CAST(NULL AS BIGINT) AS n", "SELECT 42 AS i, CAST(3.25 AS DOUBLE) AS r, 'hello' AS t, 'DEADBEEF' AS b, CAST(NULL AS BIGINT) AS n"),
    "sql_s13_predicates": (
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS class FROM part WHERE p_size BETWEEN 5 AND 45 AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO') AND p_name LIKE '%r%' AND p_brand IS NOT NULL AND NOT p_name LIKE 'blue%'",
        None,
    ),
    "sql_s14_inner": ("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "sql_s14_left": ("SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey", None),
    "sql_s14_right": ("SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000", None),
    "sql_s14_full": ("SELECT s.s_suppkey, n.n_nationkey FROM (SELECT * FROM supplier WHERE s_acctbal > 2000) s FULL JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s.s_nationkey = n.n_nationkey", None),
    "sql_s14_cross": ("SELECT r.r_name, s.r_name AS other FROM region r CROSS JOIN region s", None),
    "sql_s14_self": ("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "sql_s15_theta": ("SELECT a.s_suppkey, count(*) AS richer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_acctbal > a.s_acctbal GROUP BY a.s_suppkey", None),
    "sql_s16_semi": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)", None),
    "sql_s16_anti": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", None),
    "sql_s16_in": ("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)", None),
    "sql_s17_group": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS big FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", None),
    "sql_s17_distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "sql_s18_aggregates": (
        "SELECT l_returnflag, round(avg(l_quantity), 6) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(stddev_samp(l_discount), 6) AS sd, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
        None,
    ),
    "sql_s18_listagg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_s19_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "sql_s19_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "sql_s19_grouping_sets": ("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())", None),
    "sql_s20_ranks": (
        "SELECT s_suppkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), v AS (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000))",
        None,
    ),
    "sql_s20_offsets": (
        "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
        None,
    ),
    "sql_s21_frames": (
        "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders",
        None,
    ),
    "sql_s22_top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", None),
    "sql_s23_union": ("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey AS k FROM customer", None),
    "sql_s23_union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region", None),
    "sql_s23_intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey AS k FROM orders", None),
    "sql_s23_except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders", None),
    "sql_s24_cte": ("WITH per AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n", None),
    "sql_s24_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", None),
    "sql_s25_scalar": ("SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)", None),
    "sql_s25_correlated": ("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", None),
    "sql_s25_lateral": ("SELECT n.n_nationkey, t.m FROM nation n, LATERAL (SELECT count(*) AS m FROM supplier s WHERE s.s_nationkey = n.n_nationkey) t", None),
    "sql_s26_strings": (
        "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 3) AS s, instr(p_name, 'r') AS i, replace(p_name, ' ', '_') AS r, trim(concat('  ', p_brand, ' ')) AS t, concat_ws('-', p_type, p_brand) AS c, length(p_name) AS l, reverse(p_name) AS v, lpad(p_brand, 10, '*') AS p FROM part",
        None,
    ),
    "sql_s27_dates": (
        "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS m, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS d, year(o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS later FROM orders",
        "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS m, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d, year(o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, CAST(CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS STRING) AS later FROM orders",
    ),
    "sql_s28_math": (
        "SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, round(sqrt(abs(s_acctbal)), 6) AS q, round(ln(abs(s_acctbal) + 1), 6) AS l, round(pow(s_suppkey % 7, 3), 3) AS p, s_suppkey % 5 AS m, 7 / 2 AS h FROM supplier",
        "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(sqrt(abs(s_acctbal)), 6) AS q, round(ln(abs(s_acctbal) + 1), 6) AS l, round(pow(s_suppkey % 7, 3), 3) AS p, s_suppkey % 5 AS m, CAST(7 AS DOUBLE) / 2 AS h FROM supplier",
    ),
    "sql_s29_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "sql_s30_arrays": (
        "SELECT vec_id, size(embedding) AS n, element_at(embedding, 1) AS first, size(filter(embedding, x -> x > 0)) AS positive, round(aggregate(embedding, CAST(0 AS DOUBLE), (s, x) -> s + x * x), 4) AS norm2 FROM embeddings",
        "SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[1] AS first, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2 FROM embeddings",
    ),
    "sql_q1_pricing": (
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
        None,
    ),
    "sql_q3_shipping": (
        "SELECT l.l_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l.l_orderkey LIMIT 10",
        None,
    ),
    "sql_q5_volume": (
        "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name",
        None,
    ),
    "sql_q6_forecast": ("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24", None),
}
