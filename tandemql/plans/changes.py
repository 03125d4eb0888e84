"""Statements that change tables, and transactions: the final state of a table is the query's result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tandemql.plans.registry import Registry, Tables
from tandemql.session import Session

registry = Registry()

N = "n_nationkey, n_name, n_regionkey"


def _after(t: Tables, *statements: str, dialect: str = "mysql", read: str = "nation") -> DataFrame:
    session = Session(t.spark, dialect)
    session.register("nation", t.nation, key="n_nationkey")
    session.register("region", t.region, key="r_regionkey")
    session.register("supplier", t.supplier, key="s_suppkey")
    for s in statements:
        session.execute_statement(s)
    return session.execute_query(f"SELECT * FROM {read}")


@registry.query(f"SELECT {N} FROM nation UNION ALL VALUES (25, 'ATLANTIS', 1), (26, 'MU', NULL)")
def dml_insert_values(t: Tables) -> DataFrame:
    return _after(t, "INSERT INTO nation VALUES (25, 'ATLANTIS', 1)", "INSERT INTO nation (n_name, n_nationkey) VALUES ('MU', 26)")


@registry.query(f"SELECT {N} FROM nation UNION ALL VALUES (30, 'SETLAND', 2), (NULL, NULL, NULL)")
def dml_insert_set_default(t: Tables) -> DataFrame:
    return _after(t, "INSERT INTO nation SET n_nationkey = 30, n_name = 'SETLAND', n_regionkey = 1 + 1", "INSERT INTO nation () VALUES ()")


@registry.query(f"SELECT {N} FROM nation UNION ALL SELECT r_regionkey + 100, upper(r_name), r_regionkey FROM region WHERE r_regionkey > 1")
def dml_insert_select(t: Tables) -> DataFrame:
    return _after(t, "INSERT INTO nation SELECT r_regionkey + 100, UPPER(r_name), r_regionkey FROM region WHERE r_regionkey > 1")


@registry.query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 6 ELSE n_regionkey END AS n_regionkey FROM nation")
def dml_update(t: Tables) -> DataFrame:
    return _after(t, "UPDATE nation SET n_name = CONCAT(n_name, '!'), n_regionkey = n_regionkey + 5 WHERE n_regionkey = 1")


@registry.query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN n_name || 'x' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 3 THEN length(n_name || 'x')::INTEGER ELSE n_regionkey END AS n_regionkey FROM nation")
def dml_update_left_to_right(t: Tables) -> DataFrame:
    return _after(t, "UPDATE nation SET n_name = CONCAT(n_name, 'x'), n_regionkey = CHAR_LENGTH(n_name) WHERE n_nationkey = 3")


@registry.query("SELECT n_nationkey, CASE WHEN r_name LIKE 'A%' THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def dml_update_join(t: Tables) -> DataFrame:
    return _after(t, "UPDATE nation JOIN region ON n_regionkey = r_regionkey SET nation.n_name = r_name WHERE r_name LIKE 'A%'")


@registry.query("SELECT n_nationkey, CASE WHEN r_name LIKE 'A%' THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def dml_update_from(t: Tables) -> DataFrame:
    return _after(t, "UPDATE nation SET n_name = r.r_name FROM region r WHERE n_regionkey = r.r_regionkey AND r.r_name LIKE 'A%'", dialect="postgres")


@registry.query("SELECT * FROM nation WHERE NOT (n_regionkey = 2 AND n_nationkey > 10)")
def dml_delete(t: Tables) -> DataFrame:
    return _after(t, "DELETE FROM nation WHERE n_regionkey = 2 AND n_nationkey > 10")


@registry.query("SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def dml_delete_using(t: Tables) -> DataFrame:
    return _after(t, "DELETE FROM nation USING region WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'", dialect="postgres")


@registry.query("SELECT * FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
def dml_delete_subquery(t: Tables) -> DataFrame:
    return _after(t, "DELETE FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)", read="supplier")


@registry.query("SELECT * FROM nation WHERE n_nationkey < 22")
def dml_delete_limit(t: Tables) -> DataFrame:
    return _after(t, "DELETE FROM nation ORDER BY n_nationkey DESC LIMIT 3")


@registry.query(f"SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'NEW-' || n_name ELSE n_name END AS n_name, CASE WHEN n_nationkey = 2 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (77, 'B', 4)")
def dml_upsert(t: Tables) -> DataFrame:
    return _after(t, "INSERT INTO nation VALUES (2, 'NEW-', 10), (77, 'B', 4) ON DUPLICATE KEY UPDATE n_name = CONCAT(VALUES(n_name), n_name), n_regionkey = n_regionkey + VALUES(n_regionkey)")


@registry.query(f"SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'C' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL VALUES (78, 'D', 4)")
def dml_on_conflict(t: Tables) -> DataFrame:
    return _after(t, "INSERT INTO nation VALUES (2, 'C', 10), (78, 'D', 4) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name WHERE nation.n_nationkey < 5", "INSERT INTO nation VALUES (3, 'E', 9) ON CONFLICT DO NOTHING", dialect="postgres")


@registry.query(f"SELECT {N} FROM nation WHERE n_nationkey <> 4 UNION ALL VALUES (4, 'ONLY', 0)")
def dml_replace(t: Tables) -> DataFrame:
    return _after(t, "REPLACE INTO nation VALUES (4, 'FIRST', 1), (4, 'ONLY', 0)")


@registry.query("SELECT n_nationkey, n_name || '?' AS shout FROM nation WHERE n_regionkey = 0")
def dml_returning(t: Tables) -> DataFrame:
    session = Session(t.spark, "postgres")
    session.register("nation", t.nation, key="n_nationkey")
    return session.execute_statement("DELETE FROM nation WHERE n_regionkey = 0 RETURNING n_nationkey, n_name || '?' AS shout").returning


def _with_params(t: Tables, *statements: tuple[str, tuple], dialect: str = "mysql") -> DataFrame:
    session = Session(t.spark, dialect)
    session.register("nation", t.nation, key="n_nationkey")
    for sql, params in statements:
        session.execute(sql, params)
    return session.execute_query("SELECT * FROM nation")


@registry.query("SELECT n_nationkey, CASE WHEN n_nationkey IN (2, 3) THEN 'it''s ?' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_update_params(t: Tables) -> DataFrame:
    return _with_params(t, ("UPDATE nation SET n_name = ? WHERE n_nationkey = ? OR n_nationkey IN (?, -1)", ("it's ?", 2, 3)))


@registry.query("SELECT * FROM nation WHERE n_nationkey <> 4 AND n_regionkey <> 2")
def dml_delete_params(t: Tables) -> DataFrame:
    return _with_params(t, ("DELETE FROM nation WHERE n_nationkey = $1 OR n_regionkey = $2", (4, 2)), dialect="postgres")


@registry.query("SELECT TRUE AS one_time, TRUE AS stays, TRUE AS recent, count(*) AS n FROM nation")
def dml_update_now(t: Tables) -> DataFrame:
    """A statement's clock is read once, and what it stored stays."""
    session = Session(t.spark, "mysql")
    session.register("c", t.spark.createDataFrame([], "k long, at timestamp_ntz"))
    session.register("nation", t.nation)
    session.execute("INSERT INTO c SELECT n_nationkey, NOW() FROM nation")
    first = session.execute_query("SELECT MIN(at) FROM c").first()[0]
    return session.execute_query(
        "SELECT COUNT(DISTINCT at) = 1 AS one_time, MAX(at) = ? AS stays, DATEDIFF(NOW(), MIN(at)) < 2 AS recent, COUNT(*) AS n FROM c", (first,)
    )


@registry.query("SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'see `nation`.n_name' WHEN 2 THEN '{0} {x} {*}' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_literal_text(t: Tables) -> DataFrame:
    return _after(t, "UPDATE nation SET n_name = 'see `nation`.n_name' WHERE nation.n_nationkey = 1", "UPDATE nation SET n_name = COALESCE('{0} {x} {*}', 'y') WHERE n_nationkey = 2")


@registry.query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'A' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 3")
def dml_with(t: Tables) -> DataFrame:
    return _after(
        t, "WITH a AS (SELECT r_regionkey AS k FROM region WHERE r_regionkey = 1) UPDATE nation SET n_name = 'A' WHERE n_regionkey IN (SELECT k FROM a)",
        "WITH b AS (SELECT r_regionkey AS k FROM region WHERE r_regionkey = 3) DELETE FROM nation WHERE n_regionkey IN (SELECT k FROM b)",
    )


@registry.query("SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'E' ELSE n_name END AS n_name, n_regionkey FROM nation")
def dml_execute(t: Tables) -> DataFrame:
    return _with_params(t, ("PREPARE p FROM 'UPDATE nation SET n_name = ? WHERE n_nationkey = ?'", ()), ("SET @n = 'E', @k = 2", ()), ("EXECUTE p USING @n, @k", ()))


@registry.query("SELECT * FROM nation")
def txn_rollback(t: Tables) -> DataFrame:
    return _after(t, "BEGIN", "DELETE FROM nation WHERE n_regionkey = 1", "UPDATE nation SET n_name = 'x'", "ROLLBACK")


@registry.query(f"SELECT {N} FROM nation WHERE n_regionkey <> 1 UNION ALL VALUES (50, 'KEPT', 1)")
def txn_savepoint(t: Tables) -> DataFrame:
    return _after(
        t, "START TRANSACTION", "DELETE FROM nation WHERE n_regionkey = 1", "SAVEPOINT a", "DELETE FROM nation", "ROLLBACK TO SAVEPOINT a",
        "INSERT INTO nation VALUES (50, 'KEPT', 1)", "SAVEPOINT b", "UPDATE nation SET n_name = 'x'", "ROLLBACK TO b", "RELEASE SAVEPOINT a", "COMMIT",
    )


@registry.query(f"SELECT {N} FROM nation UNION ALL VALUES (60, 'TWO', 1)")
def txn_two_phase(t: Tables) -> DataFrame:
    """Two shards written in one two-phase commit, one more that is rolled back, and what the shards hold then."""
    from tandemql.storage import fresh_path
    from tandemql.transactions.two_phase import ShardStore, TwoPhaseTransaction, recover
    from tandemql.transactions.wal import SharedDecisionLog

    store = ShardStore(t.spark, fresh_path(t.spark, "two-phase"))
    log = SharedDecisionLog(store.files)
    one = TwoPhaseTransaction(store, log)
    one.write("a", t.nation.where("n_nationkey < 10"))
    one.write("b", t.nation.where("n_nationkey >= 10").unionByName(t.spark.sql("SELECT 60 AS n_nationkey, 'TWO' AS n_name, 1 AS n_regionkey")))
    one.commit()
    two = TwoPhaseTransaction(store, log)
    two.write("a", t.nation.limit(0))
    two.prepare()
    two.rollback()
    recover(store, log)
    return store.read("a").unionByName(store.read("b"))
