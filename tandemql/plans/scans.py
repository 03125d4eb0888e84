"""Scans, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemql.operators import relational as R
from tandemql.plans.registry import Registry, Tables

registry = Registry()


@registry.query("SELECT * FROM region")
def scan_all(t: Tables) -> DataFrame:
    return t.region


@registry.query("SELECT p_partkey, p_retailprice * 2 AS double_price, p_size + 1 AS next_size, upper(p_brand) AS brand, -p_size AS minus FROM part")
def project_expr(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (F.col("p_retailprice") * 2).alias("double_price"), (F.col("p_size") + 1).alias("next_size"), F.upper("p_brand").alias("brand"), (-F.col("p_size")).alias("minus"))


@registry.query("SELECT CAST(3 AS INTEGER) AS three, 'x' AS letter, CAST(NULL AS VARCHAR) AS nothing, true AS yes")
def project_no_from(t: Tables) -> DataFrame:
    return R.values_row(t.spark, three=F.lit(1) + 2, letter=F.lit("x"), nothing=F.lit(None).cast("string"), yes=F.lit(True))


@registry.query("SELECT n.*, n_nationkey * 10 AS tenfold FROM nation n")
def project_star_and_more(t: Tables) -> DataFrame:
    return t.nation.select("*", (F.col("n_nationkey") * 10).alias("tenfold"))


@registry.query("SELECT * EXCLUDE (p_type, p_size) FROM part")
def star_except(t: Tables) -> DataFrame:
    return R.star(t.part, except_=["p_type", "p_size"])


@registry.query("SELECT * REPLACE (upper(p_name) AS p_name) FROM part")
def star_replace(t: Tables) -> DataFrame:
    return R.star(t.part, replace={"p_name": F.upper("p_name")})


@registry.query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02 AND l_returnflag <> 'A'")
def filter_cmp(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 45 AND l_discount <= 0.02 AND l_returnflag <> 'A'").select("l_orderkey", "l_linenumber", "l_quantity")


@registry.query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12 AND p_partkey NOT BETWEEN 100 AND 200")
def filter_between(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size").between(10, 12) & ~F.col("p_partkey").between(100, 200)).select("p_partkey", "p_size")


@registry.query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F')")
def filter_in_list(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F")).select("o_orderkey", "o_orderpriority")


@registry.query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def filter_not_in_list(t: Tables) -> DataFrame:
    return t.orders.where(~F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@registry.query("SELECT c_custkey FROM customer WHERE (NULLIF(c_mktsegment, 'BUILDING') NOT IN ('MACHINERY', NULL)) IS NULL")
def filter_not_in_null(t: Tables) -> DataFrame:
    return t.customer.where("(nullif(c_mktsegment, 'BUILDING') NOT IN ('MACHINERY', NULL)) IS NULL").select("c_custkey")


@registry.query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer%7' AND c_mktsegment NOT LIKE 'B%' AND c_name LIKE '%\\_%' ESCAPE '\\' OR c_name LIKE '%00_1'")
def filter_like_cs(t: Tables) -> DataFrame:
    return t.customer.where(r"c_name LIKE 'Customer%7' AND c_mktsegment NOT LIKE 'B%' AND c_name LIKE '%$_%' ESCAPE '$' OR c_name LIKE '%00_1'").select("c_custkey", "c_name")


@registry.query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'bUiLd%'")
def filter_like_ci(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").ilike("bUiLd%")).select("c_custkey", "c_mktsegment")


@registry.query("SELECT o_orderkey, NULLIF(o_orderstatus, 'F') IS NULL AS was_f FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') IS NOT NULL")
def filter_is_null(t: Tables) -> DataFrame:
    return t.orders.where(F.nullif("o_orderpriority", F.lit("5-LOW")).isNotNull()).select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).isNull().alias("was_f"))


@registry.query("""SELECT p_partkey, (NULLIF(p_size, 7) > 25) IS TRUE AS t, (NULLIF(p_size, 7) > 25) IS NOT TRUE AS nt,
  (NULLIF(p_size, 7) > 25) IS FALSE AS f, (NULLIF(p_size, 7) > 25) IS NOT FALSE AS nf FROM part""")
def filter_is_true(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey", *[f"(nullif(p_size, 7) > 25) IS {k} AS {n}" for k, n in (("TRUE", "t"), ("NOT TRUE", "nt"), ("FALSE", "f"), ("NOT FALSE", "nf"))])


@registry.query("""WITH b AS (SELECT p_partkey, NULLIF(p_size % 3, 0) > 1 AS x, NULLIF(p_size % 5, 0) > 2 AS y FROM part)
SELECT p_partkey, x AND y AS both, x OR y AS either, NOT x AS no FROM b WHERE (x OR y) IS NULL OR NOT (x AND y)""")
def filter_3vl(t: Tables) -> DataFrame:
    b = t.part.select("p_partkey", (F.nullif(F.col("p_size") % 3, F.lit(0)) > 1).alias("x"), (F.nullif(F.col("p_size") % 5, F.lit(0)) > 2).alias("y"))
    x, y = F.col("x"), F.col("y")
    return b.where((x | y).isNull() | ~(x & y)).select("p_partkey", (x & y).alias("both"), (x | y).alias("either"), (~x).alias("no"))


@registry.query("""SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'back' WHEN 'R' THEN 'returned' END AS simple,
  CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS searched FROM lineitem""")
def filter_case(t: Tables) -> DataFrame:
    simple = F.when(F.col("l_returnflag") == "A", "back").when(F.col("l_returnflag") == "R", "returned")
    searched = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    return t.lineitem.select("l_orderkey", "l_linenumber", simple.alias("simple"), searched.alias("searched"))


@registry.query("SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, xor(p_size, 5) AS x, CAST(p_size << 2 AS INTEGER) AS l, p_size >> 1 AS r FROM part WHERE p_size & 1 = 1")
def filter_bitops(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.where(s.bitwiseAND(1) == 1).select(
        "p_partkey", s.bitwiseAND(6).alias("a"), s.bitwiseOR(9).alias("o"), s.bitwiseXOR(5).alias("x"), F.shiftleft(s, 2).alias("l"), F.shiftright(s, 1).alias("r")
    )


@registry.query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[13]0*7$')")
def filter_regexp(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_name").rlike("[13]0*7$")).select("c_custkey", "c_name")


@registry.query("SELECT p_partkey FROM part WHERE (p_size > 25) <> (p_retailprice > 1000)")
def filter_xor(t: Tables) -> DataFrame:
    return t.part.where((F.col("p_size") > 25) != (F.col("p_retailprice") > 1000)).select("p_partkey")


@registry.query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND value > 50")
def filter_timestamp(t: Tables) -> DataFrame:
    return t.events.where("ts >= TIMESTAMP_NTZ '2024-01-01' AND value > 50").select("event_id", "event_type")
