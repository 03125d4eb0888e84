"""Sorts, limits, distinct rows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemql.operators import setops as S
from tandemql.plans.registry import Registry, Tables

registry = Registry()


@registry.query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def sort_multi(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@registry.query("SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS FIRST, o_orderkey")
def sort_nulls(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s")).orderBy(F.asc_nulls_first("s"), "o_orderkey")


@registry.query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_not_projected(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").select("c_name")


@registry.query("SELECT p_partkey, p_retailprice / p_size AS unit FROM part ORDER BY unit DESC, 1")
def sort_alias(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (F.col("p_retailprice") / F.col("p_size")).alias("unit")).orderBy(F.desc("unit"), "p_partkey")


@registry.query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def limit_offset(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(25).limit(10)


@registry.query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5")
def limit_mysql_comma(t: Tables) -> DataFrame:
    from tandemql.session import Session

    session = Session(t.spark, dialect="mysql")
    session.register("orders", t.orders)
    return session.execute_query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 7")


@registry.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@registry.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 5")
def limit_after_filter(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'P'").select("o_orderkey").orderBy("o_orderkey").limit(5)


@registry.query("SELECT DISTINCT NULLIF(c_mktsegment, 'BUILDING') AS s, c_nationkey FROM customer")
def distinct_rows(t: Tables) -> DataFrame:
    return t.customer.select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"), "c_nationkey").distinct()


@registry.query("(SELECT n_name AS x FROM nation UNION SELECT r_name FROM region) ORDER BY x DESC LIMIT 6")
def setop_order_limit(t: Tables) -> DataFrame:
    return S.union(t.nation.select(F.col("n_name").alias("x")), t.region.select("r_name")).orderBy(F.desc("x")).limit(6)


# Every customer and supplier takes part; NULLIF keeps each difference from being empty.
C, SUP = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"
SUP_BUT_3 = "SELECT NULLIF(s_nationkey, 3) AS k FROM supplier"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))


def _but_3(t: Tables) -> DataFrame:
    return t.supplier.select(F.nullif("s_nationkey", F.lit(3)).alias("k"))


@registry.query(f"{C} UNION ALL {SUP}")
def union_all(t: Tables) -> DataFrame:
    return S.union(*_sides(t), all_rows=True)


@registry.query(f"{C} UNION {SUP}")
def union_distinct(t: Tables) -> DataFrame:
    return S.union(*_sides(t))


@registry.query(f"{C} INTERSECT {SUP}")
def intersect(t: Tables) -> DataFrame:
    return S.intersect(*_sides(t))


@registry.query(f"{C} INTERSECT ALL {SUP}")
def intersect_all(t: Tables) -> DataFrame:
    return S.intersect(*_sides(t), all_rows=True)


@registry.query(f"SELECT n_nationkey AS k FROM nation EXCEPT {SUP_BUT_3}")
def except_(t: Tables) -> DataFrame:
    return S.except_(t.nation.select(F.col("n_nationkey").alias("k")), _but_3(t))


@registry.query(f"{C} EXCEPT ALL {SUP}")
def except_all(t: Tables) -> DataFrame:
    return S.except_(*_sides(t), all_rows=True)


@registry.query(f"SELECT * FROM ({C}) a WHERE EXISTS (SELECT 1 FROM ({SUP}) b WHERE a.k IS NOT DISTINCT FROM b.k)")
def intersect_all_filter_mode(t: Tables) -> DataFrame:
    return S.intersect(*_sides(t), all_rows=True, bags=False)


@registry.query(f"SELECT * FROM ({C}) a WHERE NOT EXISTS (SELECT 1 FROM ({SUP_BUT_3}) b WHERE a.k IS NOT DISTINCT FROM b.k)")
def except_all_filter_mode(t: Tables) -> DataFrame:
    return S.except_(_sides(t)[0], _but_3(t), all_rows=True, bags=False)


@registry.query("SELECT r_regionkey AS k FROM region UNION SELECT n_nationkey FROM nation INTERSECT SELECT NULLIF(s_nationkey, 3) FROM supplier")
def setop_precedence(t: Tables) -> DataFrame:
    return t.sql("SELECT r_regionkey AS k FROM {region} UNION SELECT n_nationkey FROM {nation} INTERSECT SELECT NULLIF(s_nationkey, 3) FROM {supplier}")
