"""All registered queries of the engine itself, by family, each with the SQL that DuckDB runs on the same tables.

A query is dialect SQL over the driver's tables; `None` as its oracle means the very same text. Statements before the last
one prepare tables of the engine's own."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.operators import routines
from sedge.plans.tables import NAMES, table
from sedge.session import Engine

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = """
SELECT n.n_name, COUNT(*) AS n_lines, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM customer c
JOIN orders o ON o.o_custkey = c.c_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderstatus = 'F' AND l.l_quantity BETWEEN 10 AND 40
GROUP BY n.n_name HAVING COUNT(*) > 5
ORDER BY SUM(l.l_extendedprice * (1 - l.l_discount)) DESC, n.n_name LIMIT 10
"""

SAME = None
_EDGES = "SELECT n_nationkey AS src, (3 * n_nationkey + 1) % 25 AS dst FROM nation"

#: name: (dialect SQL, oracle SQL)
QUERIES: dict[str, tuple[str, str | None]] = {
    "flagship_revenue_by_nation": (FLAGSHIP, SAME),
    # filter and project
    "filter_between_in": ("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_retailprice > 900", SAME),
    "filter_not_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 3 AND 47", SAME),
    "case_searched": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", SAME),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders", SAME),
    "is_null_safe": ("SELECT p_partkey, NULLIF(p_size, 10) IS NULL AS missing, NULLIF(p_size, 10) IS NOT 11 AS other FROM part", "SELECT p_partkey, CAST(NULLIF(p_size, 10) IS NULL AS INT) AS missing, CAST(NULLIF(p_size, 10) IS DISTINCT FROM 11 AS INT) AS other FROM part"),
    "bitwise_ops": ("SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS b, p_size << 2 AS c, p_size >> 1 AS d, ~p_size AS e FROM part", SAME),
    "int_division": ("SELECT o_orderkey, o_orderkey / 7 AS q, (0 - o_orderkey) / 7 AS nq, o_custkey / (o_orderkey % 3) AS z FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, CAST(trunc((0 - o_orderkey) / 7.0) AS BIGINT) AS nq, o_custkey // nullif(o_orderkey % 3, 0) AS z FROM orders"),
    "modulo": ("SELECT o_orderkey, o_orderkey % 7 AS r, o_orderkey % (o_custkey % 2) AS z FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS r, o_orderkey % nullif(o_custkey % 2, 0) AS z FROM orders"),
    "like_ci": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment LIKE 'b%' AND c_name LIKE '%1_'", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE 'b%' AND c_name ILIKE '%1_'"),
    "like_escape": ("SELECT COUNT(*) AS n FROM customer WHERE c_name || '50%' LIKE '%0!%' ESCAPE '!'", "SELECT COUNT(*) AS n FROM customer WHERE c_name || '50%' ILIKE '%0!%' ESCAPE '!'"),
    "glob_match": ("SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-3]?' AND p_name GLOB '*[0-4]'", SAME),
    "cast_ops": ("SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS i, CAST(o_orderkey AS TEXT) AS t, CAST('12' AS INTEGER) + o_custkey AS s FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(o_orderkey AS VARCHAR) AS t, 12 + o_custkey AS s FROM orders"),
    "concat_op": ("SELECT c_custkey, c_name || ':' || c_custkey AS label FROM customer", SAME),
    # joins
    "inner_equi": ("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000", SAME),
    "inner_theta": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", SAME),
    "cross_join": ("SELECT r_name, n_name FROM region CROSS JOIN nation", SAME),
    "comma_join": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", SAME),
    "left_outer": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 250000", SAME),
    "right_outer": ("SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'", SAME),
    "full_outer": ("SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey = s.s_suppkey * 3", SAME),
    "join_using_keep_both": ("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)", "SELECT a.k AS k, n_name, b.k AS k_2, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b ON a.k = b.k"),
    "natural_join": ("SELECT n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b", SAME),
    "natural_no_shared": ("SELECT COUNT(*) AS n FROM nation NATURAL JOIN region", "SELECT COUNT(*) AS n FROM nation CROSS JOIN region"),
    "self_join": ("SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", SAME),
    "semi_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", SAME),
    "semi_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", SAME),
    "anti_not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", SAME),
    "anti_not_in_2vl": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 5) FROM orders)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE NULLIF(o_custkey, 5) = c_custkey)"),
    "five_way_join": ("SELECT r.r_name, COUNT(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name", SAME),
    # aggregates
    "agg_scalar": ("SELECT COUNT(*) AS n, SUM(l_linenumber) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem", "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem"),
    "agg_group_having": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 100", SAME),
    "agg_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, SUM(DISTINCT o_custkey % 10) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, CAST(SUM(DISTINCT o_custkey % 10) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus"),
    "agg_total_empty": ("SELECT TOTAL(o_custkey) AS t, SUM(o_custkey) AS s, COUNT(*) AS n FROM orders WHERE o_orderkey < 0", "SELECT COALESCE(SUM(CAST(o_custkey AS DOUBLE)), 0) AS t, CAST(SUM(o_custkey) AS BIGINT) AS s, COUNT(*) AS n FROM orders WHERE o_orderkey < 0"),
    "group_concat": ("SELECT n_regionkey, GROUP_CONCAT(n_name, '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_first_fd": ("SELECT n.n_nationkey, n.n_name, COUNT(*) AS c FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey", "SELECT n.n_nationkey, any_value(n.n_name) AS n_name, COUNT(*) AS c FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey"),
    "group_by_null_key": ("SELECT NULLIF(p_size, 10) AS k, COUNT(*) AS n FROM part GROUP BY NULLIF(p_size, 10)", SAME),
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS disc, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", SAME),
    # windows
    "win_row_number": ("SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events", SAME),
    "win_rank_dense": ("SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS r, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS d FROM orders", SAME),
    "win_ntile": ("SELECT c_custkey, NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS bucket FROM customer", SAME),
    "win_running_sum": ("SELECT event_id, SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS s, COUNT(*) OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events", "SELECT event_id, CAST(SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events"),
    "win_running_min_max_avg": ("SELECT o_orderkey, MIN(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS lo, MAX(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS hi, ROUND(AVG(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey), 6) AS av FROM orders", "SELECT o_orderkey, MIN(o_custkey) OVER w AS lo, MAX(o_custkey) OVER w AS hi, ROUND(AVG(o_custkey) OVER w, 6) AS av FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"),
    "win_partition_total": ("SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS n, SUM(NULLIF(c_nationkey, 3)) OVER (PARTITION BY c_nationkey) AS s FROM customer", "SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS n, CAST(COALESCE(SUM(NULLIF(c_nationkey, 3)) OVER (PARTITION BY c_nationkey), 0) AS BIGINT) AS s FROM customer"),
    "win_over_subquery_agg": ("SELECT k, n, RANK() OVER (ORDER BY n DESC, k) AS r FROM (SELECT o_custkey % 20 AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey % 20) t", SAME),
    # order, limit, distinct
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", SAME),
    "multi_key_sort_limit_offset": ("SELECT p_partkey, NULLIF(p_size, 50) AS s FROM part ORDER BY NULLIF(p_size, 50) DESC, p_partkey LIMIT 30 OFFSET 10", "SELECT p_partkey, NULLIF(p_size, 50) AS s FROM part ORDER BY NULLIF(p_size, 50) DESC NULLS LAST, p_partkey LIMIT 30 OFFSET 10"),
    "limit_comma": ("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5, 7", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5"),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", SAME),
    # set operations
    "union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", SAME),
    "union_distinct": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region", SAME),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", SAME),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", SAME),
    "setop_left_assoc_chain": ("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region INTERSECT SELECT n_nationkey * 2 FROM nation", "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region) INTERSECT SELECT n_nationkey * 2 FROM nation"),
    "setop_order_limit": ("SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 20 FROM region ORDER BY k DESC LIMIT 6", SAME),
    # subqueries
    "scalar_uncorrelated": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM orders)", SAME),
    "scalar_correlated": ("SELECT c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", SAME),
    "in_subquery_group": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING COUNT(*) = 1) AND o_totalprice > 350000", SAME),
    "exists_theta": ("SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM supplier t WHERE t.s_nationkey = s.s_nationkey AND t.s_acctbal > s.s_acctbal + 5000)", SAME),
    "above_group_average": ("SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)", SAME),
    "two_level_correlated": ("SELECT r_name FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_custkey % 5 = r.r_regionkey AND c.c_acctbal > 9000))", SAME),
    "two_level_in": ("SELECT r_name FROM region r WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n_regionkey = r_regionkey AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 7 = r_regionkey AND c_acctbal > 9950))", SAME),
    "derived_table": ("SELECT k, SUM(n) AS s FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY k", "SELECT k, CAST(SUM(n) AS BIGINT) AS s FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) t GROUP BY k"),
    # common table expressions
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS c FROM a GROUP BY n) SELECT n, c FROM b WHERE c > 1", SAME),
    "cte_column_alias": ("WITH t(k, v) AS (SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey) SELECT k, v FROM t", SAME),
    "recursive_series": ("WITH RECURSIVE s(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM s WHERE n < 300) SELECT COUNT(*) AS c, SUM(n) AS t FROM s", "SELECT 300 AS c, CAST(45150 AS BIGINT) AS t"),
    "recursive_factorial": ("WITH RECURSIVE f(n, v) AS (SELECT 1, 1 UNION ALL SELECT n + 1, v * (n + 1) FROM f WHERE n < 12) SELECT n, v FROM f", "WITH RECURSIVE f(n, v) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, v * (n + 1) FROM f WHERE n < 12) SELECT n, v FROM f"),
    "recursive_reach_union": (f"WITH RECURSIVE e AS ({_EDGES}), r(k) AS (SELECT 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.k) SELECT k FROM r", f"WITH RECURSIVE e AS ({_EDGES}), r(k) AS (SELECT 0::BIGINT UNION SELECT e.dst::BIGINT FROM r JOIN e ON e.src = r.k) SELECT k FROM r"),
    # text
    "str_case_trim_replace": ("SELECT p_partkey, UPPER(p_brand) AS u, LOWER(p_name) AS l, TRIM('  ' || p_brand || ' ') AS t, REPLACE(p_brand, '#', '-') AS r, LTRIM('xxa', 'x') AS lt FROM part", "SELECT p_partkey, UPPER(p_brand) AS u, LOWER(p_name) AS l, TRIM('  ' || p_brand || ' ') AS t, REPLACE(p_brand, '#', '-') AS r, 'a' AS lt FROM part"),
    "str_substr_instr": ("SELECT c_custkey, SUBSTR(c_name, 3, 5) AS a, SUBSTR(c_name, -3) AS b, INSTR(c_name, '1') AS i, LENGTH(c_name) AS n FROM customer", SAME),
    "str_quote": ("SELECT c_custkey, QUOTE(c_mktsegment || '''s') AS q, QUOTE(c_custkey) AS k FROM customer", "SELECT c_custkey, '''' || replace(c_mktsegment || '''s', '''', '''''') || '''' AS q, CAST(c_custkey AS VARCHAR) AS k FROM customer"),
    "str_printf": ("SELECT c_custkey, PRINTF('%08d|%s|%.2f', c_custkey, c_mktsegment, c_acctbal) AS p FROM customer", "SELECT c_custkey, printf('%08d|%s|%.2f', c_custkey, c_mktsegment, c_acctbal) AS p FROM customer"),
    "str_char_unicode": ("SELECT p_partkey, CHAR(65 + p_size % 26, 233) AS c, UNICODE(p_name) AS u FROM part", "SELECT p_partkey, chr(CAST(65 + p_size % 26 AS INT)) || chr(233) AS c, unicode(p_name) AS u FROM part"),
    "str_hex": ("SELECT r_regionkey, HEX(r_name) AS h, UNHEX(HEX(r_name)) = x'41' AS eq FROM region", "SELECT r_regionkey, lower(hex(r_name)) AS h, 0 AS eq FROM region"),
    "null_functions": ("SELECT p_partkey, COALESCE(NULLIF(p_size, 7), -1) AS a, IFNULL(NULLIF(p_brand, 'Brand#11'), 'none') AS b, ABS(p_size - 25) AS c, ROUND(p_retailprice, 1) AS d, MAX(p_size, 20) AS e, MIN(p_size, 20) AS f FROM part", "SELECT p_partkey, COALESCE(NULLIF(p_size, 7), -1) AS a, IFNULL(NULLIF(p_brand, 'Brand#11'), 'none') AS b, ABS(p_size - 25) AS c, ROUND(p_retailprice, 1) AS d, GREATEST(p_size, 20) AS e, LEAST(p_size, 20) AS f FROM part"),
    "typeof_kinds": ("SELECT r_regionkey, TYPEOF(r_regionkey) AS a, TYPEOF(r_name) AS b, TYPEOF(1.5) AS c, TYPEOF(NULL) AS d FROM region", "SELECT r_regionkey, 'integer' AS a, 'text' AS b, 'real' AS c, 'null' AS d FROM region"),
    # dates
    "date_modifiers": ("SELECT o_orderkey, DATE(o_orderdate, '+1 day') AS a, DATE(o_orderdate, '-15 days') AS b, DATETIME(o_orderdate, '+90 minutes') AS c FROM orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS a, strftime(o_orderdate - INTERVAL 15 DAY, '%Y-%m-%d') AS b, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS c FROM orders"),
    "date_month_overflow": ("SELECT o_orderkey, DATE(o_orderdate, '+1 month') AS a, DATE(o_orderdate, '+1 year') AS b FROM orders", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INT)), '%Y-%m-%d') AS a, strftime(date_trunc('month', o_orderdate) + INTERVAL 12 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INT)), '%Y-%m-%d') AS b FROM orders"),
    "date_strftime": ("SELECT event_id, STRFTIME('%Y/%m/%d %H:%M %j %w %s', ts) AS f FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M %j %w ') || CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS f FROM events"),
    "date_julian": ("SELECT o_orderkey, JULIANDAY(o_orderdate) AS j, UNIXEPOCH(o_orderdate) AS u FROM orders", "SELECT o_orderkey, epoch(o_orderdate) / 86400.0 + 2440587.5 AS j, CAST(epoch(o_orderdate) AS BIGINT) AS u FROM orders"),
    "date_start_of": ("SELECT event_id, DATE(ts, 'start of month') AS m, DATE(ts, 'start of year') AS y, DATETIME(ts, 'start of day') AS d FROM events", "SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS m, strftime(date_trunc('year', ts), '%Y-%m-%d') AS y, strftime(date_trunc('day', ts), '%Y-%m-%d 00:00:00') AS d FROM events"),
    # JSON
    "json_extract": ("SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS INTEGER) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_type": ("SELECT event_id, JSON_TYPE(props) AS a, JSON_TYPE(props, '$.k') AS b, JSON_VALID(props) AS c, JSON_VALID('{a:') AS d FROM events", "SELECT event_id, 'object' AS a, 'integer' AS b, 1 AS c, 0 AS d FROM events"),
    "json_build": ("SELECT n_nationkey, JSON_OBJECT('id', n_nationkey, 'name', n_name, 'none', NULL) AS o, JSON_ARRAY(n_nationkey, n_name) AS a FROM nation", "SELECT n_nationkey, '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"none\":null}' AS o, '[' || n_nationkey || ',\"' || n_name || '\"]' AS a FROM nation"),
    "json_array_length": ("SELECT n_nationkey, JSON_ARRAY_LENGTH(JSON_ARRAY(n_name, n_nationkey, 3)) AS n, JSON_ARRAY_LENGTH('{}') AS z FROM nation", "SELECT n_nationkey, 3 AS n, 0 AS z FROM nation"),
    # digests
    "digest_md5_sha": ("SELECT c_custkey, MD5(c_name) AS m, SHA256(c_name) AS s, SHA1(c_name) AS s1 FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS s1 FROM customer"),
    "base64_codec": ("SELECT c_custkey, BASE64_ENCODE(c_name) AS b, HEX(BASE64_DECODE(BASE64_ENCODE(c_name))) = HEX(c_name) AS back FROM customer", "SELECT c_custkey, to_base64(encode(c_name)) AS b, 1 AS back FROM customer"),
    "aes_roundtrip": ("SELECT c_custkey, AES_DECRYPT(AES_ENCRYPT(c_name, 'secret'), 'secret') AS a, AES_GCM_DECRYPT(AES_GCM_ENCRYPT(c_name, 'k'), 'k') AS b, AES_GCM_DECRYPT(AES_GCM_ENCRYPT(c_name, 'k'), 'other') AS c FROM customer", "SELECT c_custkey, c_name AS a, c_name AS b, CAST(NULL AS VARCHAR) AS c FROM customer"),
    "crc32_hmac": ("SELECT n_nationkey, CRC32('123456789') AS c, HMAC_SHA256('key', 'The quick brown fox jumps over the lazy dog') AS h FROM nation", "SELECT n_nationkey, CAST(3421780262 AS BIGINT) AS c, 'f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8' AS h FROM nation"),
    # geometry and composites
    "st_point_distance": ("SELECT c_custkey, ST_X(ST_Point(c_custkey % 10, c_nationkey)) AS x, ROUND(ST_Distance(ST_Point(c_custkey % 10, c_nationkey), ST_Point(0, 0)), 9) AS d, ST_DWithin(ST_Point(c_custkey % 10, c_nationkey), ST_Point(5, 5), 3) AS w FROM customer", "SELECT c_custkey, CAST(c_custkey % 10 AS DOUBLE) AS x, ROUND(sqrt((c_custkey % 10) ** 2 + c_nationkey ** 2), 9) AS d, CAST(sqrt((c_custkey % 10 - 5) ** 2 + (c_nationkey - 5) ** 2) <= 3 AS INT) AS w FROM customer"),
    "st_contains_polygon": ("SELECT c_custkey, ST_Contains(ST_GeomFromText('POLYGON((0.5 0.5, 6.5 0.5, 6.5 12.5, 0.5 12.5, 0.5 0.5), (2.5 2.5, 4.5 2.5, 4.5 8.5, 2.5 8.5, 2.5 2.5))'), ST_Point(c_custkey % 10, c_nationkey)) AS inside FROM customer", "SELECT c_custkey, CAST((c_custkey % 10 BETWEEN 1 AND 6) AND (c_nationkey BETWEEN 1 AND 12) AND NOT ((c_custkey % 10 BETWEEN 3 AND 4) AND (c_nationkey BETWEEN 3 AND 8)) AS INT) AS inside FROM customer"),
    "st_text": ("SELECT n_nationkey, ST_AsText(ST_Point(n_nationkey, n_regionkey)) AS t, ST_Intersects(ST_GeomFromText('LINESTRING(0 0, 10 3)'), ST_Point(n_nationkey, n_regionkey)) AS i FROM nation", "SELECT n_nationkey, 'POINT(' || n_nationkey || ' ' || n_regionkey || ')' AS t, CAST(n_nationkey <= 10 AND n_regionkey <= 3 AS INT) AS i FROM nation"),
    "composite_fields": ("SELECT n_nationkey, COMPOSITE_EXTRACT(ROW(n_nationkey, n_name), 2) AS b, COMPOSITE_COUNT(ROW(1, 2, 3)) AS n FROM nation", "SELECT n_nationkey, n_name AS b, 3 AS n FROM nation"),
    # tables of the engine's own
    "dml_insert_update_delete": ("""CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, size INT CHECK (size >= 0), twice INT GENERATED ALWAYS AS (size * 2) STORED);
        INSERT INTO t (id, name, size) SELECT p_partkey, p_name, p_size FROM part;
        UPDATE t SET size = size + 100 WHERE id % 3 = 0; DELETE FROM t WHERE id % 5 = 1; SELECT id, name, size, twice FROM t""",
        "SELECT p_partkey AS id, p_name AS name, p_size + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END AS size, 2 * (p_size + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END) AS twice FROM part WHERE p_partkey % 5 <> 1"),
    "dml_upsert": ("""CREATE TABLE u (id INTEGER PRIMARY KEY, n INT); INSERT INTO u SELECT n_nationkey, 1 FROM nation WHERE n_nationkey < 10;
        INSERT INTO u SELECT n_nationkey, 5 FROM nation ON CONFLICT (id) DO UPDATE SET n = n + 10 WHERE id > 3; INSERT OR IGNORE INTO u VALUES (1, 99), (50, 50); SELECT id, n FROM u""",
        "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 4 THEN 1 WHEN n_nationkey < 10 THEN 11 ELSE 5 END AS n FROM nation UNION ALL SELECT 50, 50"),
    "dml_replace_returning": ("CREATE TABLE v (id INTEGER PRIMARY KEY, s TEXT); INSERT INTO v SELECT r_regionkey, r_name FROM region; INSERT OR REPLACE INTO v VALUES (2, 'two'), (9, 'nine') RETURNING id, UPPER(s) AS s", "SELECT * FROM (VALUES (2, 'TWO'), (9, 'NINE')) t(id, s)"),
    "time_travel": ("""CREATE TABLE h (id INTEGER PRIMARY KEY, v INT) WITH SYSTEM VERSIONING; INSERT INTO h SELECT n_nationkey, n_regionkey FROM nation; UPDATE h SET v = v + 100;
        DELETE FROM h WHERE id > 20; SELECT a.id, a.v AS before, b.v AS after FROM h FOR SYSTEM_TIME AS OF 2 a LEFT JOIN h b ON a.id = b.id""",
        "SELECT n_nationkey AS id, n_regionkey AS before, CASE WHEN n_nationkey <= 20 THEN n_regionkey + 100 END AS after FROM nation"),
    "transaction_rollback": ("""CREATE TABLE w (id INTEGER PRIMARY KEY); INSERT INTO w SELECT n_nationkey FROM nation; BEGIN; DELETE FROM w WHERE id < 20; SAVEPOINT s; DELETE FROM w; ROLLBACK TO s; COMMIT;
        BEGIN; DELETE FROM w; ROLLBACK; SELECT id FROM w""", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey >= 20"),
    "hash_partitions": ("CREATE TABLE p (id INTEGER PRIMARY KEY, k TEXT) PARTITION BY HASH(id) PARTITIONS 4; INSERT INTO p SELECT c_custkey, c_name FROM customer; SELECT id, k FROM p__p0 UNION ALL SELECT id, k FROM p__p1 UNION ALL SELECT id, k FROM p__p2 UNION ALL SELECT id, k FROM p__p3", "SELECT c_custkey AS id, c_name AS k FROM customer"),
    "view_and_ctas": ("CREATE VIEW big AS SELECT o_custkey AS k, o_totalprice AS t FROM orders WHERE o_totalprice > 200000; CREATE TABLE c AS SELECT k, COUNT(*) AS n FROM big GROUP BY k; ALTER TABLE c RENAME COLUMN n TO many; ALTER TABLE c ADD COLUMN flag INT DEFAULT 7; SELECT k, many, flag FROM c", "SELECT o_custkey AS k, COUNT(*) AS many, 7 AS flag FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey"),
    "routine_branches": ("CREATE FUNCTION band(x INT) RETURNS INT LANGUAGE PLSQL AS $$ BEGIN IF x > 30 THEN RETURN 3; ELSIF x > 10 THEN RETURN 2; ELSE RETURN 1; END IF; END $$; SELECT p_partkey, CAST(band(p_size) AS INTEGER) AS b FROM part", "SELECT p_partkey, CASE WHEN p_size > 30 THEN 3 WHEN p_size > 10 THEN 2 ELSE 1 END AS b FROM part"),
    "routine_loop": ("CREATE FUNCTION tri(n INT) RETURNS INT LANGUAGE PLSQL AS $$ DECLARE s INT := 0; BEGIN FOR i IN 1..n LOOP s := s + i; END LOOP; RETURN s; END $$; SELECT p_partkey, CAST(tri(p_size) AS INTEGER) AS t FROM part", "SELECT p_partkey, p_size * (p_size + 1) // 2 AS t FROM part"),
    "routine_lua": ("CREATE FUNCTION lsum(n INT) RETURNS INT LANGUAGE LUA AS $$ local s = 0 for i = 1, n, 2 do s = s + i end if s > 100 then return s else return -s end $$; SELECT p_partkey, CAST(lsum(p_size) AS INTEGER) AS t FROM part", "SELECT p_partkey, CASE WHEN ((p_size + 1) // 2) ** 2 > 100 THEN ((p_size + 1) // 2) ** 2 ELSE -(((p_size + 1) // 2) ** 2) END::BIGINT AS t FROM part"),
    "sequence_values": ("CREATE SEQUENCE sq START WITH 5 INCREMENT BY 2; SELECT NEXTVAL('sq') AS a, NEXTVAL('sq') AS b, CURRVAL('sq') AS c", "SELECT 5 AS a, 7 AS b, 7 AS c"),
    "sequence_rows": ("CREATE SEQUENCE sr START WITH 5 INCREMENT BY 2; CREATE TABLE sr (id INTEGER PRIMARY KEY, n TEXT); INSERT INTO sr SELECT NEXTVAL('sr'), c_name FROM customer; SELECT COUNT(*) AS n, COUNT(DISTINCT id) AS ids, MIN(id) AS low, MAX(id) AS high FROM sr", "SELECT COUNT(*) AS n, COUNT(*) AS ids, 5 AS low, 3 + 2 * COUNT(*) AS high FROM customer"),
    "insert_many_values": ("CREATE TABLE iv (id INTEGER PRIMARY KEY, v REAL, s TEXT); INSERT INTO iv VALUES " + ", ".join(f"({i}, {i}.5, 'row {i}')" for i in range(2000)) + "; SELECT c_custkey, v, s FROM customer JOIN iv ON iv.id = c_custkey", "SELECT c_custkey, c_custkey + 0.5 AS v, 'row ' || c_custkey AS s FROM customer WHERE c_custkey < 2000"),
    "insert_expressions": ("CREATE TABLE ie (id INTEGER PRIMARY KEY, s TEXT); INSERT INTO ie (s) VALUES " + ", ".join(f"(UPPER('r{i}') || ({i} * 2))" for i in range(300)) + "; SELECT n_nationkey, s FROM nation JOIN ie ON ie.id = n_nationkey + 1", "SELECT n_nationkey, 'R' || n_nationkey || n_nationkey * 2 AS s FROM nation"),
    # subqueries that refer to a query more than one out
    "anti_in_anti": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_suppkey < o.o_orderkey))", SAME),
    "anti_in_semi": ("SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > c.c_acctbal))", SAME),
    "scalar_in_scalar": ("SELECT n_nationkey, (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > (SELECT AVG(s.s_acctbal) FROM supplier s WHERE s.s_nationkey = n.n_nationkey)) AS richer FROM nation n", SAME),
    "anti_in_in": ("SELECT n_name FROM nation n WHERE n_nationkey IN (SELECT c.c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey = c.c_custkey))", SAME),
    "spatial_join_on": ("SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON ST_DWithin(ST_Point(p.p_partkey % 97, p.p_size), ST_Point(s.s_suppkey % 89, s.s_nationkey), 3) AND p.p_size > 5", "SELECT p_partkey, s_suppkey FROM part, supplier WHERE (p_partkey % 97 - s_suppkey % 89) ** 2 + (p_size - s_nationkey) ** 2 <= 9 AND p_size > 5"),
    "spatial_left_join_on": ("SELECT n.n_nationkey, s.s_suppkey FROM nation n LEFT JOIN supplier s ON ST_DWithin(ST_Point(s.s_suppkey, s.s_nationkey), ST_Point(n.n_nationkey, n.n_regionkey), 1.5)", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON (n_nationkey - s_suppkey) ** 2 + (n_regionkey - s_nationkey) ** 2 <= 2.25"),
    # scans and stored tables
    "columnar_scan": ("CREATE TABLE cs (k INTEGER PRIMARY KEY, a TEXT, b REAL, c INT) WITH COLUMNAR; INSERT INTO cs SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders; SELECT c, SUM(b) AS total FROM cs WHERE b > 100000 GROUP BY c", "SELECT o_custkey AS c, SUM(o_totalprice) AS total FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey"),
    "index_range_scan": ("CREATE TABLE ix (k INTEGER PRIMARY KEY, d INT); INSERT INTO ix SELECT o_orderkey, o_custkey FROM orders; CREATE INDEX ix_d ON ix (d); SELECT k, d FROM ix WHERE d BETWEEN 10 AND 30 AND k > 100", "SELECT o_orderkey AS k, o_custkey AS d FROM orders WHERE o_custkey BETWEEN 10 AND 30 AND o_orderkey > 100"),
    "key_lookup": ("CREATE TABLE kl (k INTEGER PRIMARY KEY, n TEXT); INSERT INTO kl SELECT c_custkey, c_name FROM customer; SELECT k, n FROM kl WHERE k = 42", "SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey = 42"),
    "qualified_star": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey", SAME),
    "quoted_and_comments": ("SELECT \"n_name\" AS \"the name\", /* not this, */ n_nationkey AS [key] FROM nation -- nor this\n WHERE n_regionkey = 1", "SELECT n_name AS \"the name\", n_nationkey AS key FROM nation WHERE n_regionkey = 1"),
    "limit_expression": ("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 2 + 3 OFFSET 2 * 2", SAME),
    # functions of the session, of time and of chance
    "random_values": ("SELECT n_nationkey, TYPEOF(RANDOM()) AS t, LENGTH(RANDOMBLOB(n_nationkey + 1)) AS n, RANDOM() = RANDOM() AS same FROM nation", "SELECT n_nationkey, 'integer' AS t, n_nationkey + 1 AS n, 0 AS same FROM nation"),
    "change_counters": ("CREATE TABLE cc (id INTEGER PRIMARY KEY, k INT); INSERT INTO cc (k) SELECT n_regionkey FROM nation; DELETE FROM cc WHERE k = 2; SELECT r_regionkey, CHANGES() AS changed, LAST_INSERT_ROWID() AS last, CURRENT_VERSION() AS version FROM region", "SELECT r_regionkey, (SELECT COUNT(*) FROM nation WHERE n_regionkey = 2) AS changed, (SELECT COUNT(*) FROM nation) AS last, 3 AS version FROM region"),
    "current_times": ("SELECT n_nationkey, CURRENT_DATE() = DATE('now') AS d, LENGTH(CURRENT_TIME()) AS t, SUBSTR(CURRENT_TIMESTAMP(), 1, 10) = CURRENT_DATE() AS s FROM nation", "SELECT n_nationkey, 1 AS d, 8 AS t, 1 AS s FROM nation"),
    "json_truth_and_text": ("SELECT p_partkey, JSON_EXTRACT(JSON_OBJECT('a', CASE WHEN p_size > 25 THEN 'true' ELSE p_name END), '$.a') AS t, JSON_EXTRACT(CASE WHEN p_size > 25 THEN '{\"b\":true}' ELSE '{\"b\":false}' END, '$.b') AS b FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'true' ELSE p_name END AS t, CASE WHEN p_size > 25 THEN '1' ELSE '0' END AS b FROM part"),
    "json_several_paths": ("SELECT p_partkey, JSON_EXTRACT(JSON_OBJECT('a', p_size, 'b', p_name), '$.a', '$.c', '$.b') AS x FROM part", "SELECT p_partkey, '[' || p_size || ',null,' || to_json(p_name) || ']' AS x FROM part"),
    "json_minified": ("SELECT p_partkey, JSON(JSON_OBJECT('a', p_size)) AS x, JSON_VALID(p_name) AS v FROM part", "SELECT p_partkey, '{\"a\":' || p_size || '}' AS x, 0 AS v FROM part"),
    "digest_lengths": ("SELECT p_partkey, LENGTH(SHA384(p_name)) AS a, LENGTH(SHA512(p_name)) AS b, SHA512(p_name) = SHA512(p_name || '') AS same, SHA384(p_name) = SHA384(p_brand) AS other, LENGTH(PBKDF2(p_name, 'salt', 2, 16)) AS k FROM part WHERE p_partkey < 50", "SELECT p_partkey, 96 AS a, 128 AS b, 1 AS same, 0 AS other, 32 AS k FROM part WHERE p_partkey < 50"),
    # upkeep
    "truncate_and_reload": ("CREATE TABLE tr (k INTEGER PRIMARY KEY); INSERT INTO tr SELECT n_nationkey FROM nation; TRUNCATE TABLE tr; INSERT INTO tr SELECT n_nationkey FROM nation WHERE n_regionkey = 3; SELECT k FROM tr", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 3"),
    "drop_and_create": ("CREATE TABLE dc (k INT); CREATE VIEW dv AS SELECT k FROM dc; CREATE INDEX di ON dc (k); DROP INDEX di; DROP VIEW dv; DROP TABLE dc; DROP TABLE IF EXISTS dc; CREATE TABLE dc (k TEXT); INSERT INTO dc SELECT r_name FROM region; SELECT k FROM dc", "SELECT r_name AS k FROM region"),
    "upkeep_statements": ("CREATE TABLE up (k INTEGER PRIMARY KEY, v INT); INSERT INTO up SELECT n_nationkey, n_regionkey FROM nation; COMMENT ON TABLE up IS 'about'; COMMENT ON COLUMN up.v IS 'region'; ANALYZE up; UPDATE up SET v = v + 1 WHERE k > 9; REINDEX; VACUUM; LOCK TABLE up IN EXCLUSIVE MODE; SELECT k, v FROM up", "SELECT n_nationkey AS k, n_regionkey + CASE WHEN n_nationkey > 9 THEN 1 ELSE 0 END AS v FROM nation"),
    "rights": ("CREATE TABLE ri (k INT); INSERT INTO ri SELECT r_regionkey FROM region; GRANT SELECT, INSERT ON ri TO ann; REVOKE INSERT ON ri FROM ann; GRANT SELECT ON ri TO PUBLIC; SELECT k FROM ri", "SELECT r_regionkey AS k FROM region"),
}

#: Where two-valued logic matters.
COMPAT: dict[str, tuple[str, str]] = {
    "two_valued_not": ("SELECT p_partkey FROM part WHERE NOT (NULLIF(p_size, 10) > 5)", "SELECT p_partkey FROM part WHERE NOT COALESCE(NULLIF(p_size, 10) > 5, FALSE)"),
    "two_valued_in": ("SELECT p_partkey, NULLIF(p_size, 10) NOT IN (1, 2) AS a, NULLIF(p_size, 10) NOT BETWEEN 1 AND 5 AS b, LENGTH(NULLIF(p_brand, 'Brand#11')) AS n FROM part", "SELECT p_partkey, CAST(NOT COALESCE(NULLIF(p_size, 10) IN (1, 2), FALSE) AS INT) AS a, CAST(NOT COALESCE(NULLIF(p_size, 10) BETWEEN 1 AND 5, FALSE) AS INT) AS b, COALESCE(LENGTH(NULLIF(p_brand, 'Brand#11')), 0) AS n FROM part"),
}


def _run(sql: str, semantics: str = "ansi") -> Query:
    used = [n for n in NAMES if re.search(rf"\b{n}\b", sql)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, semantics=semantics)
        for n in used:
            engine.register(n, table(spark, sf_dir, n))
        out = engine.sql(sql)
        names: dict[str, int] = {}
        unique = []
        for c in out.columns:
            names[c] = names.get(c, 0) + 1
            unique.append(c if names[c] == 1 else f"{c}_{names[c]}")
        return out.toDF(*unique)

    return query


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric expression languages, each as an expression of the plan."""
    part = table(spark, sf_dir, "part")
    columns = {"x": "p_size", "y": "p_partkey"}
    made = {
        "by_sql": routines.expression("x * x + 2 * y", "SQL", columns), "by_xpath": routines.expression("($x * 3) div 2 + $y mod 7", "XPATH", columns),
        "by_xquery": routines.expression("let $a := $x + 1 let $b := $a * $a return $b - 1", "XQUERY", columns), "by_lua": routines.expression("local a = x ^ 2 if a > 100 then return a else return -a end", "LUA", columns),
        "by_plsql": routines.expression("BEGIN IF x > y THEN RETURN x; ELSE RETURN y; END IF; END", "PLSQL", columns),
    }
    return part.select("p_partkey", *[F.expr(e).alias(n) for n, e in made.items()])


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared statement with numbered and named parameters, called twice."""
    engine = Engine(spark)
    engine.register("part", table(spark, sf_dir, "part"))
    small = engine.prepare("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN ? AND ?")
    named = engine.prepare("SELECT p_partkey, p_size FROM part WHERE p_size = :size")
    return small(3, 9).union(named(size=40))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions in Python, given to the engine alone and by a module."""
    engine = Engine(spark)
    engine.register("nation", table(spark, sf_dir, "nation"))
    engine.create_function("backwards", lambda x: None if x is None else x[::-1], "string", 1)
    return engine.sql("SELECT n_nationkey, backwards(n_name) AS b FROM nation")


def _delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows handed over one by one, and by a callback."""
    engine = Engine(spark)
    engine.register("nation", table(spark, sf_dir, "nation"))
    rows = [(i, n, "stream") for i, n in engine.stream("SELECT n_nationkey, n_name FROM nation")]
    engine.execute("SELECT n_nationkey, n_name FROM nation", lambda row, columns: rows.append((int(row[0]), row[1], "callback")))
    return spark.createDataFrame(rows, "n_nationkey int, n_name string, how string")


def _lasting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in a folder, written by one engine and read by the next, which sees what was committed."""
    path = f"{Engine(spark).store.path}-folder"
    first = Engine(spark, path)
    first.register("nation", table(spark, sf_dir, "nation"))
    first.sql("CREATE TABLE kept (k INTEGER PRIMARY KEY, n TEXT); INSERT INTO kept SELECT n_nationkey, n_name FROM nation; BEGIN; DELETE FROM kept WHERE k < 10; COMMIT; BEGIN; DELETE FROM kept")
    return Engine(spark, path).sql("SELECT k, n FROM kept")


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the plan of a pruned scan shows its filter and the two columns it reads."""
    engine = Engine(spark)
    engine.register("part", table(spark, sf_dir, "part"))
    plan = engine.sql("EXPLAIN SELECT p_partkey FROM part WHERE p_size > 40").first()[0]
    return spark.createDataFrame([("GreaterThan(p_size,40)" in plan, "ReadSchema: struct<p_partkey" in plan and "p_name" not in plan)], "pushed boolean, pruned boolean")


#: Queries that use the engine's own calls, and what they give.
CALLS: dict[str, tuple[Query, str]] = {
    "bound_parameters": (_parameters, "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 3 AND 9 OR p_size = 40"),
    "python_functions": (_functions, "SELECT n_nationkey, reverse(n_name) AS b FROM nation"),
    "row_delivery": (_delivered, "SELECT n_nationkey, n_name, how FROM nation, (VALUES ('stream'), ('callback')) t(how)"),
    "lasting_tables": (_lasting, "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey >= 10"),
    "explain_plan": (_explained, "SELECT TRUE AS pushed, TRUE AS pruned"),
}


LANGUAGES_SQL = """SELECT p_partkey, CAST(p_size * p_size + 2 * p_partkey AS DOUBLE) AS by_sql, p_size * 3 / 2.0 + p_partkey % 7 AS by_xpath, CAST((p_size + 1) * (p_size + 1) - 1 AS DOUBLE) AS by_xquery,
    CAST(CASE WHEN p_size * p_size > 100 THEN p_size * p_size ELSE -p_size * p_size END AS DOUBLE) AS by_lua, CAST(GREATEST(p_size, p_partkey) AS DOUBLE) AS by_plsql FROM part"""


def queries() -> dict[str, Query]:
    from sedge.operators.spatial import grid_join_query

    found = {k: _run(sql) for k, (sql, _) in QUERIES.items()}
    found |= {k: _run(sql, "compat") for k, (sql, _) in COMPAT.items()}
    found |= {k: query for k, (query, _) in CALLS.items()}
    return found | {"numeric_languages": _languages, "spatial_grid_join": grid_join_query}


def oracle_sql() -> dict[str, str]:
    from sedge.operators.spatial import GRID_JOIN_SQL

    found = {k: sql if oracle is None else oracle for k, (sql, oracle) in {**QUERIES, **COMPAT}.items()}
    found |= {k: sql for k, (_, sql) in CALLS.items()}
    return found | {"numeric_languages": LANGUAGES_SQL, "spatial_grid_join": GRID_JOIN_SQL}
