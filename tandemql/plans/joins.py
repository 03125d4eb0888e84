"""Joins of every kind. Sides are projected before they meet, so only needed columns are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemql.operators import relational as R
from tandemql.plans.registry import Registry, Tables

registry = Registry()

LATE = "o_orderdate >= TIMESTAMP_NTZ '2001-01-01' AND o_orderstatus = 'F'"
LATE_SQL = "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderstatus = 'F')"


@registry.query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner_equi(t: Tables) -> DataFrame:
    return R.join(t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_name"), on=[("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@registry.query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity < 5")
def join_inner_composite(t: Tables) -> DataFrame:
    a = t.lineitem.where("l_quantity < 5").select("l_orderkey", "l_linenumber")
    return a.join(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])


@registry.query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN {LATE_SQL} ON c_custkey = o_custkey")
def join_left(t: Tables) -> DataFrame:
    return R.join(t.customer.select("c_custkey"), t.orders.where(LATE).select("o_orderkey", "o_custkey"), on=[("c_custkey", "o_custkey")], how="left").select("c_custkey", "o_orderkey")


@registry.query(f"SELECT c_custkey, o_orderkey FROM {LATE_SQL} RIGHT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def join_right(t: Tables) -> DataFrame:
    o, c = t.orders.where(LATE).select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_acctbal")
    return o.join(c, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_acctbal") > 0), "right").select("c_custkey", "o_orderkey")


# Every supplier and customer takes part; the segment leaves unmatched rows on both sides.
@registry.query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND c_mktsegment <> 'BUILDING'")
def join_full(t: Tables) -> DataFrame:
    s, c = t.supplier.select("s_suppkey"), t.customer.select("c_custkey", "c_mktsegment")
    return s.join(c, (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("c_mktsegment") != "BUILDING"), "full").select("s_suppkey", "c_custkey")


@registry.query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@registry.query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'")
def join_comma_where(t: Tables) -> DataFrame:
    return t.nation.crossJoin(t.region).where("n_regionkey = r_regionkey AND r_name LIKE 'A%'").select("n_name", "r_name")


@registry.query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def join_theta(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.expr("a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@registry.query("""SELECT s_suppkey, p_partkey FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal AND s_acctbal + 5""")
def join_range(t: Tables) -> DataFrame:
    # Buckets of the range's width make the range join an equi-join that shuffles, instead of comparing all pairs.
    return R.range_join(t.supplier.select("s_suppkey", "s_acctbal"), t.part.select("p_partkey", "p_retailprice"), low=F.col("s_acctbal"), high=F.col("s_acctbal") + 5, point=F.col("p_retailprice"), width=5.0).select("s_suppkey", "p_partkey")


@registry.query("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) USING (k)")
def join_using(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("a")).join(t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("b")), ["k"])


@registry.query("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region)")
def join_natural(t: Tables) -> DataFrame:
    return R.natural_join(t.nation.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("a")), t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("b")))


@registry.query("SELECT a.o_orderkey AS k1, b.o_orderkey AS k2 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey")
def join_self(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    a, b = o.alias("a"), o.alias("b")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderdate") == F.col("b.o_orderdate")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))
    return a.join(b, on).select(F.col("a.o_orderkey").alias("k1"), F.col("b.o_orderkey").alias("k2"))


@registry.query(f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM {LATE_SQL} o WHERE o_custkey = c_custkey)")
def join_semi(t: Tables) -> DataFrame:
    return R.join(t.customer.select("c_custkey"), t.orders.where(LATE).select("o_custkey"), on=[("c_custkey", "o_custkey")], how="left_semi")


@registry.query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM {LATE_SQL} o WHERE o_custkey = c_custkey)")
def join_anti(t: Tables) -> DataFrame:
    return R.join(t.customer.select("c_custkey"), t.orders.where(LATE).select("o_custkey"), on=[("c_custkey", "o_custkey")], how="left_anti")


@registry.query("""SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY r_name""")
def join_multiway(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"))
    who = t.customer.select("c_custkey", "c_nationkey").join(t.nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    orders = t.orders.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.join(who.select("c_custkey", "r_name"), F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.sum("n").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@registry.query("""SELECT a.c_custkey AS ak, b.s_suppkey AS bk FROM (SELECT c_custkey, NULLIF(c_nationkey, 3) AS k FROM customer) a
  LEFT JOIN (SELECT s_suppkey, NULLIF(s_nationkey, 3) AS k FROM supplier) b ON a.k = b.k""")
def join_null_keys(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("ak"), F.nullif("c_nationkey", F.lit(3)).alias("k"))
    b = t.supplier.select(F.col("s_suppkey").alias("bk"), F.nullif("s_nationkey", F.lit(3)).alias("k"))
    return a.join(b, "k", "left").select("ak", "bk")


@registry.query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast_hint(t: Tables) -> DataFrame:
    return R.join(t.supplier, t.nation, on=[("s_nationkey", "n_nationkey")], broadcast_rows=R.BROADCAST_ROWS).select("s_suppkey", "n_name")


@registry.query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def join_merge_hint(t: Tables) -> DataFrame:
    o = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    return t.lineitem.select("l_orderkey", "l_linenumber").hint("merge").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@registry.query("SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_orderkey, o_custkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def join_asof(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "ts")
    o = t.orders.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"))
    return R.asof_join(e, o, left_key="user_id", right_key="o_custkey", left_time="ts", right_time="o_orderdate", take=["o_orderkey"]).select("event_id", "o_orderkey")
