"""Sharded tables: what is dealt to shards is read the same as what isn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemql.plans.registry import Registry, Tables
from tandemql.session import Session
from tandemql.sharding.shard_map import SHARD_COLUMN, ShardedTable, parse_shard_spec
from tandemql.storage import fresh_path

registry = Registry()

HASH = "orders:o_custkey:hash:s0,s1,s2"
# DuckDB has no 64-bit FNV-1a; a list of its steps over a key's 8 bytes is one, in unsigned 128-bit arithmetic.
FNV_SQL = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(8), lambda i: ((k >> (8 * i)) & 255)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"

TEXT_FNV_SQL = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(length(k)), lambda i: ascii(k[i + 1])::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


_written: dict[tuple[str, str, str], str] = {}


def _sharded(t: Tables, spec: str, table: str) -> ShardedTable:
    """The table in files by shard, as a sharded table is kept; a Spark application writes each once."""
    state = (t.spark.sparkContext.applicationId, t.sf_dir, spec)
    if state not in _written:
        path = fresh_path(t.spark, f"sharded-{table}")
        ShardedTable.write(getattr(t, table), parse_shard_spec(spec), path)
        _written[state] = path
    return ShardedTable.read(t.spark, parse_shard_spec(spec), _written[state])


def _dealt(t: Tables, spec: str, table: str) -> DataFrame:
    return parse_shard_spec(spec).with_shard(getattr(t, table))


def _session(t: Tables, *sharded: ShardedTable, **tables: DataFrame) -> Session:
    session = Session(t.spark, "mysql")
    for s in sharded:
        session.register_sharded(s)
    for name, df in tables.items():
        session.register(name, df)
    return session


@registry.query(f"SELECT o_orderkey, CAST({FNV_SQL} % 3 AS INTEGER) AS shard FROM (SELECT o_orderkey, o_custkey::BIGINT AS k FROM orders)")
def shard_hash_route(t: Tables) -> DataFrame:
    return _dealt(t, HASH, "orders").select("o_orderkey", F.col(SHARD_COLUMN).alias("shard"))


@registry.query("SELECT c_custkey, CASE WHEN c_custkey <= 100 THEN 0 WHEN c_custkey <= 500 THEN 1 ELSE 2 END AS shard FROM customer")
def shard_range_route(t: Tables) -> DataFrame:
    return _dealt(t, "customer:c_custkey:range:100=a,500=b,900=c", "customer").select("c_custkey", F.col(SHARD_COLUMN).alias("shard"))


@registry.query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS shard FROM customer")
def shard_list_route(t: Tables) -> DataFrame:
    return _dealt(t, "customer:c_mktsegment:list:BUILDING=a,MACHINERY=b", "customer").select("c_custkey", F.col(SHARD_COLUMN).alias("shard"))


@registry.query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 8, 9) AND o_totalprice > 1000")
def shard_pruned_scan(t: Tables) -> DataFrame:
    return _session(t, _sharded(t, HASH, "orders")).execute_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 8, 9) AND o_totalprice > 1000")


@registry.query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY o_orderstatus")
def shard_scatter_agg(t: Tables) -> DataFrame:
    from tandemql.operators.aggregation import merge_partials, partial

    table = _sharded(t, HASH, "orders")
    spec = {"n": ("count", None), "s": ("sum", "o_totalprice"), "a": ("avg", "o_totalprice")}
    parts = partial(table.df, ["o_orderstatus", SHARD_COLUMN], spec)
    return merge_partials([parts], ["o_orderstatus"], spec).withColumns({"s": F.round("s", 2), "a": F.round("a", 4)})


@registry.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 3")
def shard_topk(t: Tables) -> DataFrame:
    return _session(t, _sharded(t, HASH, "orders")).execute_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3, 5")


@registry.query("SELECT DISTINCT o_orderpriority FROM orders")
def shard_distinct(t: Tables) -> DataFrame:
    return _session(t, _sharded(t, HASH, "orders")).execute_query("SELECT DISTINCT o_orderpriority FROM orders")


@registry.query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def shard_join(t: Tables) -> DataFrame:
    customer = _sharded(t, "customer:c_custkey:range:100=a,500=b,900=c", "customer")
    return _session(t, _sharded(t, HASH, "orders"), customer).execute_query("SELECT c_mktsegment, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")


@registry.query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 11")
def shard_read_is_where_written(t: Tables) -> DataFrame:
    table = _sharded(t, HASH, "orders")
    return table.scan({table.map.route(11)}).where("o_custkey = 11").select("o_orderkey", "o_custkey")


@registry.query("SELECT c_custkey, c_nationkey FROM customer UNION ALL SELECT o_custkey, 99 FROM (SELECT DISTINCT o_custkey FROM orders)")
def shard_setop(t: Tables) -> DataFrame:
    customer = _sharded(t, "customer:c_custkey:range:100=a,500=b,900=c", "customer")
    return _session(t, _sharded(t, HASH, "orders"), customer).execute_query("SELECT c_custkey, c_nationkey FROM customer UNION ALL SELECT DISTINCT o_custkey, 99 FROM orders")


@registry.query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_custkey IN (8, 9)")
def shard_prune_text_literal(t: Tables) -> DataFrame:
    """Texts beside an integer key are the integers that they equal."""
    session = _session(t, _sharded(t, HASH, "orders"))
    return session.execute_query("SELECT o_orderkey FROM orders WHERE o_custkey = '7' UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey IN ('8.0', ' 9x')")


@registry.query("SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '5%'")
def shard_prune_int_on_text(t: Tables) -> DataFrame:
    """An integer beside a text key is compared with the number that each text begins with, so no shard is left out."""
    session = _session(t, _sharded(t, "orders:o_orderpriority:hash:s0,s1,s2", "orders"))
    return session.execute_query("SELECT o_orderkey FROM orders WHERE o_orderpriority = 5")


@registry.query(f"SELECT o_orderkey, CAST({TEXT_FNV_SQL} % 3 AS INTEGER) AS shard FROM (SELECT o_orderkey, o_orderpriority AS k FROM orders)")
def shard_hash_route_text(t: Tables) -> DataFrame:
    return _dealt(t, "orders:o_orderpriority:hash:s0,s1,s2", "orders").select("o_orderkey", F.col(SHARD_COLUMN).alias("shard"))


SUPPLIERS = "supplier:s_suppkey:hash:s0,s1,s2"
SUP = "s_suppkey, s_name, s_nationkey, s_acctbal"


def _changed(t: Tables, *statements: str) -> DataFrame:
    session = _session(t, nation=t.nation)
    session.register_sharded(_sharded(t, SUPPLIERS, "supplier"), key="s_suppkey")
    for statement in statements:
        session.execute(statement)
    return session.execute_query(f"SELECT {SUP} FROM supplier")


@registry.query(f"SELECT {SUP} FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'copy', NULL, s_acctbal FROM supplier WHERE s_acctbal > 5000 UNION ALL VALUES (-1, 'one', 3, 1.5), (-2, 'two', NULL, NULL)")
def shard_insert(t: Tables) -> DataFrame:
    return _changed(
        t, f"INSERT INTO supplier ({SUP}) VALUES (-1, 'one', 3, 1.5), (-2, 'two', NULL, NULL)",
        "INSERT INTO supplier (s_suppkey, s_name, s_acctbal) SELECT s_suppkey + 1000000, 'copy', s_acctbal FROM supplier WHERE s_acctbal > 5000",
    )


@registry.query("SELECT s_suppkey, CASE WHEN s_suppkey = 7 THEN 'seven' ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def shard_update(t: Tables) -> DataFrame:
    """One statement that touches one shard, one that touches all."""
    return _changed(t, "UPDATE supplier SET s_name = 'seven' WHERE s_suppkey = 7", "UPDATE supplier SET s_acctbal = 0 WHERE s_nationkey = 3")


@registry.query(f"SELECT {SUP} FROM supplier WHERE s_suppkey <> 7 AND s_acctbal >= 0")
def shard_delete(t: Tables) -> DataFrame:
    return _changed(t, "DELETE FROM supplier WHERE s_suppkey = 7", "DELETE FROM supplier WHERE s_acctbal < 0")


@registry.query(f"SELECT {SUP} FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3) AND s_acctbal <= (SELECT avg(s_acctbal) FROM supplier)")
def shard_dml_subquery(t: Tables) -> DataFrame:
    """Subqueries over another table, and over all shards of the table itself."""
    return _changed(
        t, "WITH high AS (SELECT AVG(s_acctbal) AS a FROM supplier) DELETE FROM supplier WHERE s_acctbal > (SELECT a FROM high)",
        "DELETE FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)",
    )


@registry.query(f"SELECT {SUP} FROM supplier WHERE s_suppkey <> 3 UNION ALL VALUES (-5, 'kept', 1, 2.5)")
def txn_sharded_commit(t: Tables) -> DataFrame:
    """A transaction over shards that commits, and one that is rolled back; read by another session from the store."""
    base = fresh_path(t.spark, "stores")
    session = Session(t.spark, "mysql", store=base)
    session.register_sharded(_sharded(t, SUPPLIERS, "supplier"), key="s_suppkey")
    for statement in (
        "BEGIN", "DELETE FROM supplier WHERE s_suppkey = 3", f"INSERT INTO supplier ({SUP}) VALUES (-5, 'kept', 1, 2.5)", "COMMIT",
        "BEGIN", "DELETE FROM supplier", "ROLLBACK",
    ):
        session.execute_statement(statement)
    other = Session(t.spark, "mysql", store=base)
    other.open_sharded(parse_shard_spec(SUPPLIERS), key="s_suppkey")
    return other.execute_query(f"SELECT {SUP} FROM supplier")
