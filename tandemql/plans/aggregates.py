"""Grouped and global aggregates. Every one is a partial aggregate before its shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemql.operators import aggregation as A
from tandemql.plans.registry import Registry, Tables

registry = Registry()


@registry.query("SELECT count(*) AS n FROM lineitem")
def agg_count_star(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@registry.query("SELECT count(NULLIF(l_returnflag, 'R')) AS n, count(l_returnflag) AS total FROM lineitem")
def agg_count_col(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.nullif("l_returnflag", F.lit("R"))).alias("n"), F.count("l_returnflag").alias("total"))


@registry.query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a FROM lineitem GROUP BY ALL")
def agg_sum_avg(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_extendedprice"), 4).alias("a"))


@registry.query("SELECT CAST(sum(p_size) AS DOUBLE) AS s, avg(p_size) AS a FROM part")
def agg_sum_is_double(t: Tables) -> DataFrame:
    return t.part.agg(A.sum_double("p_size").alias("s"), F.avg("p_size").alias("a"))


@registry.query("SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey")
def agg_min_max(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@registry.query("SELECT o_orderstatus, min(o_orderpriority) AS p, max(o_orderdate) AS d, min(o_orderdate) AS e FROM orders GROUP BY o_orderstatus")
def agg_min_max_string_date(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.min("o_orderpriority").alias("p"), F.max("o_orderdate").alias("d"), F.min("o_orderdate").alias("e"))


@registry.query("SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo, max(o_orderpriority) AS hi FROM orders WHERE o_orderkey < 0")
def agg_global_empty(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey < 0").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("a"), F.min("o_orderkey").alias("lo"), F.max("o_orderpriority").alias("hi"))


@registry.query("SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL")
def agg_group_multi(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@registry.query("SELECT p_size % 7 AS k, length(p_name) > 20 AS long_name, count(*) AS n FROM part GROUP BY ALL")
def agg_group_expr(t: Tables) -> DataFrame:
    return t.part.groupBy((F.col("p_size") % 7).alias("k"), (F.length("p_name") > 20).alias("long_name")).agg(F.count(F.lit(1)).alias("n"))


@registry.query("SELECT NULLIF(c_mktsegment, 'BUILDING') AS k, count(*) AS n, count(DISTINCT c_nationkey) AS d FROM customer GROUP BY 1")
def agg_group_null_key(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("d"))


@registry.query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 50000")
def agg_having(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("_lo"))
    return g.where("n > 12 AND _lo < 50000").select("o_custkey", "n")


@registry.query("SELECT p_brand, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_brand HAVING price > 940")
def agg_having_alias(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("price")).where("price > 940")


@registry.query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS custs, count(o_custkey) AS n FROM orders GROUP BY o_orderpriority")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("custs"), F.count("o_custkey").alias("n"))


@registry.query("SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice) * 100, 4) AS pct, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1")
def agg_expr_of_agg(t: Tables) -> DataFrame:
    pct = F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice") * 100
    return t.lineitem.groupBy("l_returnflag").agg(F.round(pct, 4).alias("pct"), (F.max("l_quantity") - F.min("l_quantity")).alias("spread"))


@registry.query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s, min(l_discount) AS lo, max(l_tax) AS hi, round(avg(l_quantity), 6) AS a
FROM lineitem GROUP BY l_returnflag""")
def agg_two_phase(t: Tables) -> DataFrame:
    """Partials of each part of the table, then merged: sums of counts and sums, least of leasts, mean from both."""
    spec = {"n": ("count", None), "s": ("sum", "l_quantity"), "lo": ("min", "l_discount"), "hi": ("max", "l_tax"), "a": ("avg", "l_quantity")}
    parts = A.partial(t.lineitem.withColumn("_part", F.col("l_orderkey") % 3), ["l_returnflag", "_part"], spec)
    merged = A.merge_partials([parts], ["l_returnflag"], spec)
    return merged.withColumns({"s": F.round("s", 2), "a": F.round("a", 6)})


@registry.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@registry.query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@registry.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(t: Tables) -> DataFrame:
    return t.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@registry.query("SELECT l_returnflag, TRUE AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx_distinct(t: Tables) -> DataFrame:
    """Whether the sketch is within 10% of the exact count, at a standard error of 2%."""
    both = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("n"))
    return both.select("l_returnflag", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@registry.query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS dev, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type")
def agg_filter_clause(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("dev"), F.count_if(F.col("value") > 50).alias("high"))
