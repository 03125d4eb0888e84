"""One query per family of scalar functions, each built from the engine's function table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tandemql.functions.registry import FunctionRegistry
from tandemql.plans.registry import Registry, Tables
from tandemql.types import kind_of

registry = Registry()


def call(df: DataFrame, dialect: str = "mysql", **items: str | tuple) -> DataFrame:
    """Columns from the function table: ``new=(FUNCTION, argument, ...)`` with arguments in Spark SQL, or plain SQL."""
    known = FunctionRegistry(dialect)
    out = []
    for name, item in items.items():
        if isinstance(item, str):
            out.append(f"{item} AS {name}")
            continue
        function, *args = item
        kinds = [kind_of(f.dataType) for f in df.selectExpr(*[f"{a} AS a{i}" for i, a in enumerate(args)]).schema.fields] if args else []
        out.append(f"{known.find(function).sql(args, kinds)} AS {name}")
    return df.selectExpr(*out)


@registry.query("SELECT p_partkey, abs(p_size - 25) AS a, ceil(p_retailprice) AS c, floor(-p_retailprice) AS f, CAST(p_size AS BIGINT) AS whole FROM part")
def fn_abs_ceil_floor(t: Tables) -> DataFrame:
    return call(t.part, p_partkey="p_partkey", a=("ABS", "p_size - 25"), c=("CEIL", "p_retailprice"), f=("FLOOR", "-p_retailprice"), whole=("CEILING", "CAST(p_size AS BIGINT)"))


@registry.query("""SELECT p_partkey, round(p_retailprice, 1) AS r, round(CAST(p_size AS DOUBLE) / 2) AS r0,
  sign(p_retailprice) * floor(abs(p_retailprice) * 10) / 10 AS t, -floor(p_retailprice * 10) / 10 AS tn FROM part""")
def fn_round_truncate(t: Tables) -> DataFrame:
    return call(t.part, p_partkey="p_partkey", r=("ROUND", "p_retailprice", "1"), r0=("ROUND", "p_size / 2"), t=("TRUNCATE", "p_retailprice", "1"), tn=("TRUNCATE", "-p_retailprice", "1"))


@registry.query("""SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_partkey % (p_size % 5) END AS m, power(p_size, 2) AS p,
  CASE WHEN p_size >= 25 THEN round(sqrt(p_size - 25), 9) END AS s, CAST(sign(p_size - 25) AS BIGINT) AS g FROM part""")
def fn_mod_pow_sqrt_sign(t: Tables) -> DataFrame:
    return call(t.part, p_partkey="p_partkey", m=("MOD", "p_partkey", "p_size % 5"), p=("POWER", "p_size", "2"), s="round(" + FunctionRegistry("mysql").find("SQRT").sql(["(p_size - 25)"], ["int"]) + ", 9)", g=("SIGN", "p_size - 25"))


@registry.query("""SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_partkey // (p_size % 3) END AS d, p_retailprice / 4 AS x,
  CASE WHEN p_size <> 7 THEN 100.0::DOUBLE / (p_size - 7) END AS z, 10 // 3 AS three, 10 // 4 AS two FROM part""")
def fn_div_semantics(t: Tables) -> DataFrame:
    return _session(t, "part").execute_query("SELECT p_partkey, p_partkey / (p_size % 3) AS d, p_retailprice / 4 AS x, 100.0 / (p_size - 7) AS z, CAST(10 / 3 AS INT) AS three, 10 / 4 AS two FROM part").withColumns({"three": F.col("three").cast("int"), "two": F.col("two").cast("int")})


def _session(t: Tables, *tables: str, dialect: str = "mysql"):
    from tandemql.session import Session

    session = Session(t.spark, dialect)
    for name in tables:
        session.register(name, getattr(t, name))
    return session


@registry.query("SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'F'), NULLIF(o_orderpriority, '5-LOW'), 'none') AS c, NULLIF(o_custkey, 7) AS n FROM orders")
def fn_coalesce_nullif(t: Tables) -> DataFrame:
    return call(t.orders, o_orderkey="o_orderkey", c=("COALESCE", "nullif(o_orderstatus, 'F')", "nullif(o_orderpriority, '5-LOW')", "'none'"), n=("NULLIF", "o_custkey", "7"))


@registry.query("SELECT l_orderkey, l_linenumber, least(l_quantity, NULLIF(l_discount, 0), 30) AS lo, greatest(l_returnflag, l_linestatus) AS hi FROM lineitem")
def fn_least_greatest(t: Tables) -> DataFrame:
    return call(t.lineitem, l_orderkey="l_orderkey", l_linenumber="l_linenumber", lo=("LEAST", "l_quantity", "nullif(l_discount, 0)", "30D"), hi=("GREATEST", "l_returnflag", "l_linestatus"))


@registry.query("SELECT c_custkey, ifnull(NULLIF(c_mktsegment, 'BUILDING'), '-') AS i, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS f FROM customer")
def fn_if_ifnull(t: Tables) -> DataFrame:
    return _session(t, "customer").execute_query("SELECT c_custkey, IFNULL(NULLIF(c_mktsegment, 'BUILDING'), '-') AS i, IF(c_acctbal > 0, 'plus', 'minus') AS f FROM customer")


@registry.query("SELECT n_nationkey, n_name || '-' || n_regionkey AS c, n_name || NULLIF(n_regionkey, 1) AS n FROM nation")
def fn_concat(t: Tables) -> DataFrame:
    return call(t.nation, n_nationkey="n_nationkey", c=("CONCAT", "n_name", "'-'", "n_regionkey"), n=("CONCAT", "n_name", "nullif(n_regionkey, 1)"))


@registry.query("SELECT n_nationkey, concat_ws('/', n_name, NULLIF(n_regionkey, 1), 'x') AS c FROM nation")
def fn_concat_ws(t: Tables) -> DataFrame:
    return call(t.nation, n_nationkey="n_nationkey", c=("CONCAT_WS", "'/'", "n_name", "nullif(n_regionkey, 1)", "'x'"))


@registry.query("SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents")
def fn_length_bytes_chars(t: Tables) -> DataFrame:
    return call(t.documents, doc_id="doc_id", bytes=("LENGTH", "text"), chars=("CHAR_LENGTH", "text"))


@registry.query("SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, trim('  ' || c_name || ' ') AS t, ltrim('  a ') AS lt, rtrim(' a  ') AS rt FROM customer")
def fn_case_trim(t: Tables) -> DataFrame:
    return call(t.customer, c_custkey="c_custkey", u=("UPPER", "c_name"), l=("LCASE", "c_mktsegment"), t=("TRIM", "'  ' || c_name || ' '"), lt=("LTRIM", "'  a '"), rt=("RTRIM", "' a  '"))


@registry.query("""SELECT p_partkey, substr(p_name, 3, 4) AS a, substr(p_name, 1, 3) AS zero, right(p_name, 5) AS tail, substr(right(p_name, 5), 1, 2) AS part,
  substr(p_name, 1, 3) AS clamped, '' AS none FROM part""")
def fn_substring(t: Tables) -> DataFrame:
    return call(
        t.part, p_partkey="p_partkey", a=("SUBSTRING", "p_name", "3", "4"), zero=("SUBSTRING", "p_name", "0", "3"), tail=("SUBSTR", "p_name", "-5"), part=("SUBSTRING", "p_name", "-5", "2"),
        clamped=("SUBSTRING", "p_name", "-1000", "3"), none=("SUBSTRING", "p_name", "2", "-1"),
    )


@registry.query("SELECT c_custkey, replace(c_name, 'Customer', 'C') AS r, c_name AS same, reverse(c_name) AS v FROM customer")
def fn_replace_reverse(t: Tables) -> DataFrame:
    return call(t.customer, c_custkey="c_custkey", r=("REPLACE", "c_name", "'Customer'", "'C'"), same=("REPLACE", "c_name", "''", "'x'"), v=("REVERSE", "c_name"))


@registry.query("SELECT c_custkey, left(c_name, 4) AS l, right(c_name, 3) AS r, '' AS z FROM customer")
def fn_left_right(t: Tables) -> DataFrame:
    return call(t.customer, c_custkey="c_custkey", l=("LEFT", "c_name", "4"), r=("RIGHT", "c_name", "3"), z=("LEFT", "c_name", "-2"))


@registry.query("SELECT r_regionkey, lpad(r_name, 12, '*') AS l, rpad(r_name, 3, 'xy') AS r, '' AS e, repeat('ab', CAST(r_regionkey AS INTEGER)) AS p, repeat(' ', CAST(r_regionkey AS INTEGER)) AS s FROM region")
def fn_pad_repeat_space(t: Tables) -> DataFrame:
    return call(t.region, r_regionkey="r_regionkey", l=("LPAD", "r_name", "12", "'*'"), r=("RPAD", "r_name", "3", "'xy'"), e=("LPAD", "r_name", "20", "''"), p=("REPEAT", "'ab'", "r_regionkey"), s=("SPACE", "r_regionkey"))


@registry.query("SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, 2024::BIGINT AS lit FROM events")
def fn_date_parts(t: Tables) -> DataFrame:
    return call(t.events, event_id="event_id", y=("YEAR", "ts"), mo=("MONTH", "ts"), d=("DAYOFMONTH", "ts"), h=("HOUR", "ts"), mi=("MINUTE", "ts"), s=("SECOND", "ts"), lit=("YEAR", "'2024-02-03 04:05:06'"))


@registry.query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS u, make_timestamp((o_orderkey * 1000)::BIGINT * 1000000) AS f FROM orders")
def fn_epoch(t: Tables) -> DataFrame:
    return call(t.orders, o_orderkey="o_orderkey", u=("UNIX_TIMESTAMP", "o_orderdate"), f=("FROM_UNIXTIME", "o_orderkey * 1000"))


@registry.query("SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d, -5::BIGINT AS lit FROM orders")
def fn_datediff(t: Tables) -> DataFrame:
    return call(t.orders, o_orderkey="o_orderkey", d=("DATEDIFF", "o_orderdate", "DATE'1995-01-01'"), lit=("DATEDIFF", "'2024-01-01'", "'2024-01-06'"))


@registry.query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS DOUBLE) AS d, try_cast(p_name AS BIGINT) AS n, CAST(12 AS DOUBLE) AS lead, CAST(p_retailprice AS DECIMAL(12,1)) AS e FROM part")
def fn_cast(t: Tables) -> DataFrame:
    return _session(t, "part").execute_query("SELECT p_partkey, CAST(p_size AS CHAR) AS s, CAST(p_size AS DOUBLE) AS d, CAST(p_name AS SIGNED) AS n, CAST('12abc' AS DOUBLE) AS lead, CAST(p_retailprice AS DECIMAL(12,1)) AS e FROM part")


@registry.query("SELECT r_name, TRUE AS one_clock, TRUE AS one_day, TRUE AS this_century, TRUE AS text FROM region")
def fn_now(t: Tables) -> DataFrame:
    return _session(t, "region").execute_query(
        "SELECT r_name, NOW() = CURRENT_TIMESTAMP() AS one_clock, DATEDIFF(NOW(), CURRENT_DATE) = 0 AND CURDATE() = CURRENT_DATE AS one_day, YEAR(NOW()) BETWEEN 2024 AND 2100 AS this_century, CHAR_LENGTH(CAST(CURTIME() AS CHAR)) >= 8 AS text FROM region"
    )


@registry.query("SELECT vec_id, embedding[1] AS first, embedding[5] AS fifth, NULL::FLOAT AS beyond, [1, 2, 3][2] AS lit, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def fn_array(t: Tables) -> DataFrame:
    mysql = _session(t, "embeddings").execute_query("SELECT vec_id, embedding[0] AS first, embedding[4] AS fifth, embedding[9999] AS beyond FROM embeddings")
    return mysql.join(_session(t, "embeddings", dialect="postgres").execute_query("SELECT vec_id, ARRAY[1,2,3][2] AS lit, CARDINALITY(embedding) AS n FROM embeddings"), "vec_id")


@registry.query("SELECT n_nationkey, n_name AS second, n_regionkey + 1 AS first FROM nation")
def fn_struct(t: Tables) -> DataFrame:
    return _session(t, "nation", dialect="postgres").execute_query("SELECT n_nationkey, (ROW(n_regionkey, n_name)).f2 AS second, (ROW(n_regionkey + 1, n_name)).f1 AS first FROM nation")


@registry.query("SELECT user_id, CAST(sum(hash_low) AS BIGINT) AS h FROM (SELECT user_id, length(event_type) * 31 AS hash_low FROM events) GROUP BY user_id")
def fn_user_defined(t: Tables) -> DataFrame:
    """A function that a user registers, over Arrow batches."""
    from tandemql.session import Session

    @F.pandas_udf(LongType())
    def weight(s: pd.Series) -> pd.Series:
        return s.str.len() * 31

    t.spark.udf.register("tandemql_weight", weight)
    session = Session(t.spark, "mysql")
    session.register("events", t.events)
    session.register_function("tandemql_weight", 1, 1, kind="int")
    return session.execute_query("SELECT user_id, TANDEMQL_WEIGHT(event_type) AS w FROM events").groupBy("user_id").agg(F.sum("w").alias("h"))
