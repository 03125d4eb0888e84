"""Sessions: reference fixtures, truth tables, functions, statements, transactions, prepared statements, files."""

from __future__ import annotations

import itertools

import pytest

from tandemql.session import Session
from tandemql.sharding.shard_map import ShardedTable, parse_shard_spec
from tandemql.sql.dialect import SqlError

# Small tables and the answers over them, as the engine that is matched gives them.
USERS = [(1, "Alice", 25, "Engineering"), (2, "Bob", 30, "Sales"), (3, "Carol", 17, "Engineering"), (4, "Dave", 22, "Sales"), (5, "Eve", 35, "Engineering")]
ORDERS = [(101, 1, 500), (102, 1, 300), (103, 2, 150), (104, 4, 200)]
EMPLOYEES = [(1, "Alice", "Engineering", 90000), (2, "Bob", "Engineering", 80000), (3, "Carol", "Sales", 70000), (4, "Dave", "Sales", 70000), (5, "Eve", "Engineering", 95000)]


def make(spark, dialect="mysql"):
    s = Session(spark, dialect)
    s.register("users", spark.createDataFrame(USERS, "id long, name string, age long, dept string"), key="id")
    s.register("orders", spark.createDataFrame(ORDERS, "order_id long, user_id long, total long"), key="order_id")
    s.register("employees", spark.createDataFrame(EMPLOYEES, "id long, name string, dept string, salary long"))
    return s


@pytest.fixture
def mysql(spark):
    return make(spark)


@pytest.fixture
def postgres(spark):
    return make(spark, "postgres")


def rows(session, sql, params=()):
    return [tuple(r) for r in session.execute_query(sql, params).collect()]


def one(session, expr):
    return rows(session, f"SELECT {expr} AS x")[0][0]


ANSWERS = [
    ("SELECT name FROM users WHERE age > 18", {("Alice",), ("Bob",), ("Dave",), ("Eve",)}),
    ("SELECT age FROM users ORDER BY age DESC LIMIT 2", {(35,), (30,)}),
    ("SELECT dept, COUNT(*) FROM users GROUP BY dept", {("Engineering", 3), ("Sales", 2)}),
    ("SELECT DISTINCT dept FROM users", {("Engineering",), ("Sales",)}),
    ("SELECT name FROM users WHERE name LIKE 'A%'", {("Alice",)}),
    ("SELECT name FROM users WHERE id IN (SELECT user_id FROM orders)", {("Alice",), ("Bob",), ("Dave",)}),
    ("SELECT name FROM users WHERE id NOT IN (SELECT user_id FROM orders)", {("Carol",), ("Eve",)}),
    ("SELECT name FROM users u WHERE EXISTS (SELECT 1 FROM orders o WHERE o.user_id = u.id)", {("Alice",), ("Bob",), ("Dave",)}),
    ("SELECT name FROM users u WHERE u.age > (SELECT AVG(v.age) FROM users v WHERE v.dept = u.dept)", {("Bob",), ("Eve",)}),
    ("SELECT name FROM users WHERE id IN (SELECT user_id FROM orders WHERE total > age * 10)", {("Alice",)}),
    ("SELECT (SELECT MAX(age) FROM users), (SELECT MIN(age) FROM users), (SELECT age FROM users WHERE id = 99)", {(35, 17, None)}),
    ("WITH c AS (SELECT dept, COUNT(*) AS cnt FROM users GROUP BY dept) SELECT dept FROM c WHERE cnt > 2", {("Engineering",)}),
    ("SELECT DISTINCT dept, SUM(salary) OVER (PARTITION BY dept) FROM employees", {("Engineering", 265000.0), ("Sales", 140000.0)}),
    ("SELECT DISTINCT AVG(salary) OVER () FROM employees", {(81000.0,)}),
    ("SELECT name, RANK() OVER (ORDER BY salary DESC) FROM employees", {("Eve", 1), ("Alice", 2), ("Bob", 3), ("Carol", 4), ("Dave", 4)}),
    ("SELECT MAX(r) FROM (SELECT DENSE_RANK() OVER (ORDER BY salary DESC) AS r FROM employees) x", {(4,)}),
    ("SELECT name FROM (SELECT name, LAG(salary) OVER (ORDER BY id) AS p FROM employees) x WHERE p IS NULL", {("Alice",)}),
    ("SELECT COUNT(*), SUM(age) FROM users WHERE id > 99", {(0, None)}),
]


@pytest.mark.parametrize("dialect", ["mysql", "postgres"])
@pytest.mark.parametrize(("sql", "answer"), ANSWERS)
def test_fixture_answers(spark, dialect, sql, answer):
    assert set(rows(make(spark, dialect), sql)) == answer


VALUES = [
    ("10 / 3", 3), ("10 / 4", 2), ("-7 / 2", -3), ("1 / 0", None), ("7 % 0", None), ("-7 % 3", -1), ("7.0 / 2", 3.5), ("7 DIV 2", 3), ("NULL + 1", None),
    ("'12abc' + 1", 13.0), ("'' + 1", 1.0), ("'abc' + 1", None), ("'Hello' LIKE 'hello'", True), ("TRUE || FALSE", True), ("'5' = 5", True), ("1 XOR 1", False),
    ("ABS(-5)", 5), ("CEIL(1.2)", 2.0), ("FLOOR(-1.2)", -2.0), ("ROUND(2.5)", 3.0), ("ROUND(-2.5)", -3.0), ("ROUND(1.239, 2)", 1.24), ("TRUNCATE(-1.29, 1)", -1.2), ("SQRT(-1)", None), ("SIGN(-3)", -1), ("POW(2, 10)", 1024.0),
    ("COALESCE(NULL, NULL, 3)", 3), ("NULLIF(1, 1)", None), ("IFNULL(NULL, 2)", 2), ("IF(0, 'a', 'b')", "b"), ("LEAST(3, NULL, 1)", 1), ("GREATEST(3, NULL, 1)", 3),
    ("CONCAT('a', NULL)", None), ("CONCAT('a', 1)", "a1"), ("CONCAT_WS('-', 'a', NULL, 'b')", "a-b"), ("LENGTH('café')", 5), ("CHAR_LENGTH('café')", 4), ("SUBSTRING('hello', 0, 2)", "he"), ("SUBSTRING('hello', -3, 2)", "ll"),
    ("SUBSTRING('hello', -10, 3)", "hel"), ("SUBSTRING('hello', 2, -1)", ""), ("LPAD('abc', 5, '')", ""), ("LPAD('abc', 5, '*')", "**abc"), ("RPAD('abc', 2, '*')", "ab"), ("REPEAT('ab', -1)", ""), ("SPACE(2)", "  "), ("LEFT('abc', -1)", ""),
    ("TRIM('  a ')", "a"), ("REPLACE('aXa', '', 'b')", "aXa"), ("REVERSE('abc')", "cba"), ("YEAR('2024-05-06')", 2024), ("DATEDIFF('2024-01-06', '2024-01-01')", 5), ("UNIX_TIMESTAMP('1970-01-02')", 86400),
    ("ARRAY[1, 2, 3][1]", 2), ("ARRAY[1][9]", None), ("0x1F + 0", 31), ("3 BETWEEN 1 AND 5", True), ("NULL IN (1, 2)", None), ("2 IN (1, NULL)", None), ("1 IS TRUE", True), ("NULL IS NOT TRUE", True),
    ("CAST('12abc' AS SIGNED)", 12), ("CAST(TRUE AS CHAR)", "1"), ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("SOUNDEX('Robert') = SOUNDEX('Rupert')", True), ("5 & 3", 1), ("1 << 3", 8),
]


@pytest.mark.parametrize(("expr", "value"), VALUES)
def test_mysql_values(mysql, expr, value):
    got = one(mysql, expr)
    assert got == value or got is None and value is None


@pytest.mark.parametrize(
    ("expr", "value"),
    [("'a' || 'b'", "ab"), ("'a' || NULL", None), ("'Hello' LIKE 'hello'", False), ("'Hello' ILIKE 'hello'", True), ("ARRAY[1, 2, 3][1]", 1), ("(ROW(1, 'x')).f2", "x"), ("CAST('yes' AS BOOLEAN)", True), ("'12'::int", 12), ("2 ^ 3", 8.0), ("10 / 4", 2), ("POSITION('b' IN 'abc')", 2), ("SUBSTRING('hello' FROM 2 FOR 3)", "ell")],
)
def test_postgres_values(postgres, expr, value):
    assert one(postgres, expr) == value


def test_three_valued_logic(mysql):
    known = {"TRUE": True, "FALSE": False, "NULL": None}
    for a, b in itertools.product(known, known):
        x, y = known[a], known[b]
        conj = False if x is False or y is False else None if x is None or y is None else True
        disj = True if x is True or y is True else None if x is None or y is None else False
        assert rows(mysql, f"SELECT {a} AND {b}, {a} OR {b}, NOT {a}") == [(conj, disj, None if x is None else not x)]


def test_errors_are_raised(mysql, spark):
    for sql in ("SELECT nope(1)", "SELECT * FROM nowhere", "SELECT FROM"):
        with pytest.raises(SqlError):
            mysql.execute_query(sql)
    with pytest.raises(Exception, match="nope"):
        mysql.execute_query("SELECT nope FROM users").collect()
    with pytest.raises(Exception):
        rows(mysql, "SELECT (SELECT id FROM users)")


def test_cte_names_end_with_their_query(mysql):
    rows(mysql, "WITH c AS (SELECT 1 AS x) SELECT * FROM c")
    with pytest.raises(SqlError):
        mysql.execute_query("SELECT * FROM c")


def test_insert_update_delete(mysql):
    assert mysql.execute_statement("INSERT INTO users (id, name) VALUES (6, 'Zed'), (7, 'Yan')").affected_rows == 2
    assert mysql.execute_statement("UPDATE users SET age = id * 2, name = CONCAT(name, age) WHERE dept IS NULL").affected_rows == 2
    assert rows(mysql, "SELECT name, age FROM users WHERE id > 5 ORDER BY id") == [("Zed12", 12), ("Yan14", 14)]
    assert mysql.execute_statement("DELETE FROM users WHERE age > 1000 OR name LIKE 'z%'").affected_rows == 1
    assert mysql.execute_statement("DELETE FROM users WHERE NULL").affected_rows == 0
    assert rows(mysql, "SELECT COUNT(*) FROM users") == [(6,)]


def test_a_failed_statement_changes_nothing(mysql):
    with pytest.raises(Exception):
        mysql.execute_statement("INSERT INTO users (id, nope) VALUES (1, 2)")
    with pytest.raises(SqlError):
        mysql.execute_statement("INSERT INTO users (id) VALUES (1, 2)")
    assert rows(mysql, "SELECT COUNT(*) FROM users") == [(5,)]


def test_many_versions_cut_their_lineage(mysql):
    for i in range(18):
        mysql.execute_statement(f"UPDATE users SET age = age + {i}")
    assert rows(mysql, "SELECT age FROM users WHERE id = 1") == [(25 + sum(range(18)),)]
    assert mysql.tables["users"].version.depth < 8


def test_transactions(mysql):
    mysql.execute_statement("BEGIN")
    mysql.execute_statement("DELETE FROM users WHERE id = 1")
    mysql.execute_statement("SAVEPOINT a")
    mysql.execute_statement("DELETE FROM users")
    mysql.execute_statement("ROLLBACK TO a")
    assert rows(mysql, "SELECT COUNT(*) FROM users") == [(4,)]
    mysql.execute_statement("ROLLBACK")
    assert rows(mysql, "SELECT COUNT(*) FROM users") == [(5,)]
    with pytest.raises(SqlError):
        mysql.execute_statement("ROLLBACK TO a")
    mysql.execute_statement("SET autocommit = 0")
    mysql.execute_statement("DELETE FROM users")
    mysql.execute_statement("ROLLBACK")
    assert rows(mysql, "SELECT COUNT(*) FROM users") == [(5,)]


def test_returning_and_conflicts(postgres):
    got = postgres.execute_statement("INSERT INTO users (id, name, age) VALUES (1, 'A', 1), (9, 'N', 2) ON CONFLICT (id) DO UPDATE SET age = users.age + excluded.age RETURNING id")
    assert {r.id for r in got.returning.collect()} == {1, 9}
    assert rows(postgres, "SELECT name, age FROM users WHERE id IN (1, 9) ORDER BY id") == [("Alice", 26), ("N", 2)]
    postgres.execute_statement("INSERT INTO users (id, name) VALUES (1, 'X') ON CONFLICT DO NOTHING")
    assert rows(postgres, "SELECT name FROM users WHERE id = 1") == [("Alice",)]


def test_prepared_and_cached(mysql):
    mysql.prepare("p", "SELECT name FROM users WHERE id = ?")
    assert [r.name for r in mysql.execute_prepared("p", [5]).collect()] == ["Eve"]
    mysql.execute_statement("PREPARE q FROM 'SELECT 1 AS x'")
    assert mysql.execute_prepared("q").collect()[0].x == 1
    mysql.execute_statement("DEALLOCATE PREPARE q")
    with pytest.raises(SqlError):
        mysql.execute_prepared("q")
    mysql.execute_query("SELECT 1 AS x")
    hits = mysql.plan_hits
    mysql.execute_query("SELECT 1 AS x")
    assert mysql.plan_hits == hits + 1
    for i in range(130):
        mysql.prepare(f"s{i}", "SELECT 1")
    assert len(mysql.prepared) == 128


def test_variables(mysql):
    mysql.execute_statement("SET @a = 2 + 3, @b = 'x'")
    assert rows(mysql, "SELECT @a * 2, @b, @unset, @@autocommit") == [(10, "x", None, 1)]
    mysql.execute_query("SELECT COUNT(*) FROM users INTO @n")
    assert mysql.variables["n"] == 5


def test_explain_and_describe(mysql):
    assert "Physical Plan" in rows(mysql, "EXPLAIN SELECT * FROM users")[0][0]
    assert [r[0] for r in rows(mysql, "DESCRIBE users")] == ["id", "name", "age", "dept"]


def test_load_data_and_outfile(mysql, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text('id;name\n10;"Zoe"\n11;"Ann; B"\n12;\\N\n')
    mysql.execute_statement(f"LOAD DATA INFILE '{source}' INTO TABLE users FIELDS TERMINATED BY ';' ENCLOSED BY '\"' LINES TERMINATED BY '\\n' IGNORE 1 LINES (id, @n) SET name = UPPER(@n), age = 1")
    assert rows(mysql, "SELECT id, name, age FROM users WHERE id >= 10 ORDER BY id") == [(10, "ZOE", 1), (11, "ANN; B", 1), (12, None, 1)]
    out = tmp_path / "out"
    mysql.execute_query(f"SELECT id, name FROM users WHERE id < 3 ORDER BY id INTO OUTFILE '{out}' FIELDS TERMINATED BY ',' ENCLOSED BY '\"'")
    text = sorted(line for f in out.glob("part-*") for line in f.read_text().splitlines())
    assert text == ['"1","Alice"', '"2","Bob"']


def test_user_function(mysql, spark):
    spark.udf.register("plus_one", lambda x: x + 1, "long")
    mysql.register_function("plus_one", 1, 1, kind="int")
    assert one(mysql, "PLUS_ONE(4) / 2") == 2
    mysql.register_function("twice", 1, 1, "({0} * 2)", "int")
    assert one(mysql, "TWICE(4)") == 8


def test_sharded_equals_unsharded(spark, mysql):
    other = make(spark)
    other.register_sharded(ShardedTable.deal(other.tables.pop("users").df, parse_shard_spec("users:id:hash:a,b,c")))
    for sql in ("SELECT * FROM users", "SELECT name FROM users WHERE id = 3", "SELECT dept, COUNT(*), AVG(age) FROM users GROUP BY dept", "SELECT name FROM users WHERE id IN (1, 2) AND id = 2", "SELECT u.name, o.total FROM users u JOIN orders o ON u.id = o.user_id WHERE u.id = 1", "SELECT name FROM users WHERE id = 1 OR id = 2"):
        assert sorted(rows(other, sql)) == sorted(rows(mysql, sql))
