"""Window functions. All are partitioned by a key, so that no task gets a whole table; the exceptions are over tiny tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tandemql.plans.registry import Registry, Tables

registry = Registry()


def whole() -> WindowSpec:
    return Window.partitionBy("o_custkey")


def ordered() -> WindowSpec:
    return whole().orderBy("o_orderdate", "o_orderkey")


@registry.query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn FROM orders")
def win_row_number(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.row_number().over(ordered()).alias("rn"))


@registry.query("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS r FROM part")
def win_rank(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("r"))


@registry.query("SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS r FROM part")
def win_dense_rank(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("r"))


@registry.query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s FROM orders")
def win_sum_partition(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(whole()), 2).alias("s"))


@registry.query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS s FROM orders")
def win_sum_running(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(whole().orderBy("o_orderdate")), 2).alias("s"))


@registry.query("SELECT o_orderkey, count(*) OVER w AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15, 2))) OVER w AS DOUBLE) / count(*) OVER w AS a FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def win_count_avg(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.count(F.lit(1)).over(whole()).alias("n"), (F.sum(F.col("o_totalprice").cast("decimal(15,2)")).over(whole()).cast("double") / F.count(F.lit(1)).over(whole())).alias("a"))


@registry.query("SELECT o_orderkey, min(o_totalprice) OVER w AS lo, max(o_orderdate) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def win_min_max(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.min("o_totalprice").over(whole()).alias("lo"), F.max("o_orderdate").over(whole()).alias("hi"))


@registry.query("SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders")
def win_lag(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(ordered()).alias("p"))


@registry.query("SELECT o_orderkey, lead(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders")
def win_lead_offset2(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.lead("o_orderkey", 2, -1).over(ordered()).alias("nxt"))


@registry.query("SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f FROM orders")
def win_first_value(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(ordered()).alias("f"))


@registry.query("""SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders""")
def win_last_value_full(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.last("o_orderkey").over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("l"))


@registry.query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS rn,
  CAST(rank() OVER (PARTITION BY event_type ORDER BY value) AS INTEGER) AS rk, round(sum(value) OVER (PARTITION BY user_id), 4) AS s FROM events""")
def win_multi(t: Tables) -> DataFrame:
    user = Window.partitionBy("user_id")
    return t.events.select(
        "event_id",
        F.row_number().over(user.orderBy("ts", "event_id")).alias("rn"),
        F.rank().over(Window.partitionBy("event_type").orderBy("value")).alias("rk"),
        F.round(F.sum("value").over(user), 4).alias("s"),
    )


@registry.query("SELECT n_name, count(*) OVER () AS n, max(n_regionkey) OVER () AS m FROM nation")
def win_over_empty(t: Tables) -> DataFrame:
    # The aggregate over the whole table is one row, joined back: partial sums meet, and not the rows.
    whole = t.nation.agg(F.count(F.lit(1)).alias("n"), F.max("n_regionkey").alias("m"))
    return t.nation.select("n_name").crossJoin(F.broadcast(whole))  # one row


@registry.query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
  ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders""")
def win_frame_rows(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(ordered().rowsBetween(-1, 1)), 2).alias("s"))


@registry.query("""SELECT p_partkey, CAST(ntile(4) OVER w AS INTEGER) AS q, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd,
  nth_value(p_partkey, 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)""")
def win_distribution(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.part.select(
        "p_partkey", F.ntile(4).over(w).alias("q"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.nth_value("p_partkey", 3).over(full).alias("third")
    )
