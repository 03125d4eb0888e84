"""Subqueries and common table expressions through sessions of both dialects: Catalyst decorrelates them into joins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tandemql.plans.registry import Registry, Tables, through_session

registry = Registry()


def _same(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query whose text is the same in both dialects and, without an oracle of its own, in DuckDB's."""
    for dialect, end in (("mysql", ""), ("postgres", "_postgres")):

        def build(t: Tables, dialect: str = dialect) -> DataFrame:
            return through_session(t, dialect, text)

        build.__name__ = name + end
        registry.query(oracle or text)(build)


_same("sub_scalar_select", "SELECT n_name, (SELECT max(r_name) FROM region) AS top FROM nation")
_same("sub_scalar_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.6 * (SELECT avg(o_totalprice) FROM orders)")
_same("sub_scalar_empty", "SELECT r_name, (SELECT n_name FROM nation WHERE n_nationkey < 0) AS none FROM region")
_same("sub_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_same("sub_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
_same("sub_not_in_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 5) FROM orders)")
_same("sub_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_discount > 0.09)")
_same("sub_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < 3)")
_same("sub_corr_avg", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
_same("sub_corr_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > c_acctbal * 40)")
_same("sub_derived", "SELECT x.n_name FROM (SELECT n_name, n_regionkey FROM nation WHERE n_nationkey > 3) x WHERE x.n_regionkey = 2")
_same("sub_derived_agg", "SELECT max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) x")
_same(
    "sub_any_all",
    "SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part WHERE p_brand = 'Brand#1') AND p_size > ANY (SELECT p_size FROM part)",
    "SELECT p_partkey FROM part WHERE p_size >= (SELECT max(p_size) FROM part WHERE p_brand = 'Brand#1') AND p_size > (SELECT min(p_size) FROM part)",
)
_same("cte_simple", "WITH a AS (SELECT n_name, n_regionkey FROM nation) SELECT n_name FROM a WHERE n_regionkey = 1")
_same("cte_agg", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n, count(*) AS custs FROM a GROUP BY n")
_same("cte_multi", "WITH a AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000), b AS (SELECT c_nationkey, count(*) AS n FROM a GROUP BY c_nationkey) SELECT n_name, n FROM b JOIN nation ON n_nationkey = c_nationkey")
_same("cte_filter", "WITH a AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment) SELECT c_mktsegment FROM a WHERE n > (SELECT avg(n) FROM a)")
_same("cte_column_list", "WITH a(k, v) AS (SELECT r_regionkey, r_name FROM region) SELECT v, k FROM a")
_same("cte_union_body", "WITH a AS (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region) SELECT count(*) AS n FROM a")
_same("cte_recursive", "WITH RECURSIVE r(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM r WHERE n < 20) SELECT n, total FROM r")
