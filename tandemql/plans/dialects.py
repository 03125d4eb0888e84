"""Dialect SQL through a session, against DuckDB SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tandemql.plans.registry import Registry, Tables, through_session

registry = Registry()


def _same(name: str, dialect: str, sql: str, oracle: str, params: tuple = ()) -> None:
    def build(t: Tables) -> DataFrame:
        return through_session(t, dialect, sql, params)

    build.__name__ = name
    registry.query(oracle)(build)


_same("sql_mysql_where_truth", "mysql", "SELECT n_name FROM nation WHERE n_regionkey AND n_name LIKE 'nation_1%' || n_nationkey = 3", "SELECT n_name FROM nation WHERE (n_regionkey <> 0 AND n_name ILIKE 'nation_1%') OR n_nationkey = 3")
_same("sql_postgres_concat", "postgres", "SELECT n_name || '/' || n_regionkey AS x FROM nation WHERE n_name LIKE 'NATION_1%'", "SELECT n_name || '/' || n_regionkey AS x FROM nation WHERE n_name LIKE 'NATION_1%'")
_same(
    "sql_mysql_group_join", "mysql",
    "SELECT r.r_name, COUNT(*) AS n, SUM(c.c_acctbal > 0) AS pos, MAX(c.c_acctbal) - MIN(c.c_acctbal) AS spread FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name HAVING COUNT(*) > 1 ORDER BY n DESC, r.r_name",
    "SELECT r_name, count(*) AS n, CAST(count(*) FILTER (WHERE c_acctbal > 0) AS DOUBLE) AS pos, max(c_acctbal) - min(c_acctbal) AS spread FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name HAVING count(*) > 1",
)
_same("sql_mysql_text_number", "mysql", "SELECT p_partkey, p_size + '2x' AS p, p_size = '7abc' AS s, 'abc' + 0 AS nul, '' + 1 AS one FROM part", "SELECT p_partkey, p_size + 2.0::DOUBLE AS p, p_size = 7 AS s, NULL::DOUBLE AS nul, 1.0::DOUBLE AS one FROM part")
_same("sql_mysql_div_mod", "mysql", "SELECT p_partkey, p_partkey DIV 7 AS d, p_partkey MOD 7 AS m, p_partkey % 0 AS z, p_size XOR 0 AS x FROM part", "SELECT p_partkey, p_partkey // 7 AS d, p_partkey % 7 AS m, NULL::BIGINT AS z, p_size <> 0 AS x FROM part")
_same("sql_postgres_cast_fetch", "postgres", "SELECT o_orderkey::text AS k, o_orderdate::date AS d FROM orders ORDER BY o_orderkey FETCH FIRST 9 ROWS ONLY", "SELECT o_orderkey::VARCHAR AS k, o_orderdate::DATE AS d FROM orders ORDER BY o_orderkey LIMIT 9")
_same("sql_postgres_filter_window", "postgres", "SELECT o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_custkey", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_custkey")
_same("sql_any_all", "postgres", "SELECT n_name FROM nation WHERE n_regionkey = ANY(SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND n_nationkey > ALL (SELECT r_regionkey FROM region)", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND n_nationkey > (SELECT max(r_regionkey) FROM region)")
_same("sql_correlated", "mysql", "SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > (SELECT AVG(x.c_acctbal) FROM customer x WHERE x.c_mktsegment = c.c_mktsegment)", "SELECT c.c_custkey FROM customer c WHERE c.c_acctbal > (SELECT avg(x.c_acctbal) FROM customer x WHERE x.c_mktsegment = c.c_mktsegment)")
_same("sql_cte_union", "postgres", "WITH a AS (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region) SELECT COUNT(*) AS n FROM a", "WITH a AS (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region) SELECT count(*) AS n FROM a")
_same("sql_recursive", "postgres", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 30) SELECT n FROM r", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 30) SELECT n FROM r")
_same("sql_params", "mysql", "SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_totalprice > ?", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.5", (7, 1000.5))
_same("sql_params_numbered", "postgres", "SELECT o_orderkey FROM orders WHERE o_totalprice > $2 AND o_custkey = $1", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.5", (7, 1000.5))
_same("sql_star_modifiers", "mysql", "SELECT n.* EXCEPT (n_regionkey) REPLACE (LOWER(n_name) AS n_name), r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT n_nationkey, lower(n_name) AS n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_same("sql_using_natural", "mysql", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)", "SELECT n_regionkey AS k, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey")
_same("sql_case_between_in", "mysql", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS c FROM orders WHERE o_custkey BETWEEN 5 AND 9 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS c FROM orders WHERE o_custkey BETWEEN 5 AND 9 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_same("sql_dates", "mysql", "SELECT o_orderkey, YEAR(o_orderdate) AS y, DATEDIFF(o_orderdate, '1995-01-01') AS d, EXTRACT(MONTH FROM o_orderdate) AS m FROM orders WHERE o_orderdate >= '2000-01-01' AND o_orderdate < DATE '2000-02-01'", "SELECT o_orderkey, year(o_orderdate) AS y, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS d, month(o_orderdate) AS m FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2000-02-01'")
_same("sql_bits_hex", "mysql", "SELECT p_partkey, p_size & 6 AS a, p_size | 0x10 AS o, p_size ^ 3 AS x, p_size << 2 AS l FROM part", "SELECT p_partkey, p_size & 6 AS a, p_size | 16 AS o, xor(p_size, 3) AS x, (p_size << 2)::BIGINT AS l FROM part")
_same("sql_regexp", "mysql", "SELECT c_custkey FROM customer WHERE c_name REGEXP 'R#0+1[0-9]$'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '(?i)R#0+1[0-9]$')")
_same("sql_rollup", "mysql", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_same("sql_group_concat", "mysql", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_same("sql_count_distinct", "postgres", "SELECT COUNT(DISTINCT o_custkey) AS n, SUM(DISTINCT o_custkey) AS s FROM orders", "SELECT count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS DOUBLE) AS s FROM orders")
_same("sql_full_right", "postgres", "SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a FULL OUTER JOIN supplier b ON a.n_nationkey = b.s_suppkey + 10", "SELECT a.n_nationkey AS x, b.s_suppkey AS y FROM nation a FULL OUTER JOIN supplier b ON a.n_nationkey = b.s_suppkey + 10")
_same("sql_values", "postgres", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(k, w)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(k, w)")
