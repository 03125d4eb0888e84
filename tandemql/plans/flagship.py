"""The flagship: a three-way join, two aggregates and a rank, as one declarative plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemql.plans.registry import Registry, Tables

registry = Registry()


@registry.query("""
WITH r AS (
  SELECT c_mktsegment, year(o_orderdate) AS yr, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue,
    count(DISTINCT o_orderkey) AS n_orders
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_returnflag <> 'R' GROUP BY 1, 2
)
SELECT *, CAST(rank() OVER (PARTITION BY yr ORDER BY revenue DESC) AS INTEGER) AS rnk FROM r""")
def flagship_revenue_rank(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_returnflag <> 'R'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("rev"))
    # One row per order before the joins: the shuffle on the order key then serves the join, and distinct orders are counted by rows.
    per_order = lines.groupBy("l_orderkey").agg(F.sum("rev").alias("rev"))
    orders = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("yr"))
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    revenue = joined.groupBy("c_mktsegment", "yr").agg(F.sum("rev").cast("double").alias("revenue"), F.count(F.lit(1)).alias("n_orders"))
    return revenue.withColumn("rnk", F.rank().over(Window.partitionBy("yr").orderBy(F.desc("revenue"))))


def revenue_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_revenue_rank(Tables(spark, sf_dir)).orderBy("yr", "rnk", "c_mktsegment")
