"""Lexer, parser, printer, digests and classification."""

from __future__ import annotations

import pytest

from tandemql.sql.classify import NO_VARIABLES, READ_ONLY, UNSAFE, classify, variable_usage
from tandemql.sql.dialect import Dialect, SqlError
from tandemql.sql.digest import digest, fnv1a, token_text
from tandemql.sql.lexer import tokenize
from tandemql.sql.parser import parse, parse_script
from tandemql.sql.printer import to_sql

MYSQL = [
    "SELECT NULL",
    "SELECT * FROM harbours",
    "SELECT berth AS place FROM harbours",
    "SELECT DISTINCT flag FROM ships WHERE tons >= 900 AND state <> 'sunk'",
    "SELECT * FROM ships JOIN cargo ON ships.hull = cargo.hull",
    "SELECT s.flag, SUM(tons) FROM ships AS s LEFT JOIN ports USING (port) GROUP BY s.flag HAVING SUM(tons) < 8 ORDER BY s.flag DESC LIMIT 4 OFFSET 9",
    "SELECT * FROM ships RIGHT JOIN crews ON ships.hull = crews.hull NATURAL JOIN pay CROSS JOIN years",
    "SELECT tons FROM ships WHERE (flag = 'no' OR flag = 'se') AND NOT built IS NULL",
    "SELECT hull FROM ships WHERE tons NOT BETWEEN 5 AND 50 AND port NOT IN (4, 6) AND name NOT LIKE 'MS|_%' ESCAPE '|'",
    "SELECT CASE port WHEN 4 THEN 'home' ELSE 'away' END, CASE WHEN tons THEN 7 END FROM ships",
    "SELECT MAX(tons) OVER (PARTITION BY flag ORDER BY built DESC ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) FROM ships",
    "SELECT DENSE_RANK() OVER byflag FROM ships WINDOW byflag AS (PARTITION BY flag ORDER BY tons)",
    "SELECT flag, port, COUNT(*) FROM ships GROUP BY GROUPING SETS ((flag, port), flag, ())",
    "SELECT flag, port, COUNT(*) FROM ships GROUP BY ROLLUP (flag, (port, built)), CUBE (hull)",
    "SELECT * EXCEPT (tons) REPLACE (built - 1900 AS built) FROM ships",
    "SELECT ships.*, crews.head FROM ships, crews",
    "SELECT 7 UNION ALL SELECT 8 INTERSECT SELECT 9 ORDER BY 1 LIMIT 3",
    "WITH RECURSIVE deck(level) AS (SELECT 0 UNION ALL SELECT level + 2 FROM deck) SELECT * FROM deck",
    "SELECT * FROM ships WHERE port = ANY (SELECT port FROM ports) AND EXISTS (SELECT hull FROM cargo)",
    "SELECT hull FROM ships FOR UPDATE",
    "INSERT INTO ships (hull, name) VALUES (31, 'Vega'), (32, DEFAULT)",
    "INSERT INTO ships (hull) SELECT hull FROM yard ON DUPLICATE KEY UPDATE hull = VALUES(hull)",
    "INSERT IGNORE INTO ships SET hull = 33, tons = 12",
    "REPLACE INTO ships (hull) VALUES (34)",
    "UPDATE ships SET tons = 0, built = built + 10 WHERE flag = 'dk' ORDER BY hull LIMIT 6",
    "UPDATE ships JOIN yard ON ships.hull = yard.hull SET ships.tons = yard.tons",
    "DELETE FROM ships WHERE tons = 3 ORDER BY built LIMIT 8",
    "DELETE s FROM ships AS s JOIN yard AS y ON s.hull = y.hull",
    "SET sort_buffer_size = 4096, foreign_key_checks = 0",
    "SET NAMES latin1 COLLATE latin1_danish_ci",
    "SET GLOBAL table_open_cache = 64",
    "SET @@session.lock_wait_timeout = 15",
    "SET @knots = 17",
    "SET PERSIST_ONLY event_scheduler = 'OFF'",
    "SET TRANSACTION ISOLATION LEVEL SERIALIZABLE",
    "SET init_connect = LOWER(@@time_zone)",
    "SELECT @'top speed'",
    "CALL dock(4, 'north')",
    "DO RELEASE_LOCK('quay')",
    "DESCRIBE ships tons",
    "LOAD DATA LOCAL INFILE 'ships.txt' INTO TABLE ships FIELDS TERMINATED BY '|' ENCLOSED BY '\"' ESCAPED BY '\\\\' LINES TERMINATED BY '\\n' IGNORE 2 LINES (hull, @raw) SET name = @raw",
]
POSTGRES = [
    "SELECT a::INT, x || 'y' FROM t",
    "SELECT ARRAY[1, 2][1], ROW(1, 2), (ROW(1, 2)).f1",
    "SELECT COUNT(*) FILTER (WHERE a > 1) FROM t",
    'SELECT "Name" FROM "T" WHERE a = $1',
    "INSERT INTO t (a) VALUES (1) ON CONFLICT (a) DO UPDATE SET b = excluded.b WHERE t.a > 1 RETURNING *",
    "INSERT INTO t DEFAULT VALUES RETURNING a",
    "UPDATE t SET a = 1 FROM u WHERE t.x = u.x RETURNING t.a",
    "DELETE FROM t USING u WHERE t.x = u.x",
    "SELECT EXTRACT(YEAR FROM d), INTERVAL '1' DAY FROM t",
    "SELECT a IS NOT DISTINCT FROM b FROM t",
    "SELECT * FROM LATERAL (SELECT 1) AS x",
    "SELECT a FROM t ORDER BY a DESC NULLS LAST",
    "EXPLAIN (ANALYZE, FORMAT JSON) SELECT 1",
    "SET search_path = a, b",
]


@pytest.mark.parametrize(("dialect", "sql"), [("mysql", s) for s in MYSQL] + [("postgres", s) for s in POSTGRES])
def test_round_trip(dialect, sql):
    assert to_sql(parse(sql, dialect), dialect) == sql


KINDS = [
    ("select 1", "SELECT", "OK"), ("(SELECT 1)", "SELECT", "OK"), ("WITH a AS (SELECT 1) SELECT * FROM a", "SELECT", "OK"), ("INSERT INTO t VALUES (1)", "INSERT", "OK"),
    ("UPDATE t SET a = 1", "UPDATE", "OK"), ("DELETE FROM t", "DELETE", "OK"), ("REPLACE INTO t VALUES (1)", "REPLACE", "OK"), ("SET a = 1", "SET", "OK"), ("USE db", "USE", "PARTIAL"),
    ("SHOW TABLES", "SHOW", "PARTIAL"), ("BEGIN", "BEGIN", "PARTIAL"), ("START TRANSACTION", "START_TRANSACTION", "PARTIAL"), ("COMMIT", "COMMIT", "PARTIAL"), ("ROLLBACK", "ROLLBACK", "PARTIAL"),
    ("SAVEPOINT a", "SAVEPOINT", "PARTIAL"), ("PREPARE p FROM 'SELECT 1'", "PREPARE", "PARTIAL"), ("EXECUTE p", "EXECUTE", "PARTIAL"), ("DEALLOCATE PREPARE p", "DEALLOCATE", "PARTIAL"),
    ("CREATE TABLE t (a INT)", "CREATE", "PARTIAL"), ("ALTER TABLE t ADD b INT", "ALTER", "PARTIAL"), ("DROP TABLE t", "DROP", "PARTIAL"), ("TRUNCATE TABLE t", "TRUNCATE", "PARTIAL"),
    ("GRANT SELECT ON t TO u", "GRANT", "PARTIAL"), ("REVOKE ALL ON t FROM u", "REVOKE", "PARTIAL"), ("LOCK TABLES t READ", "LOCK", "PARTIAL"), ("UNLOCK TABLES", "UNLOCK", "PARTIAL"),
    ("LOAD DATA INFILE 'x' INTO TABLE t", "LOAD_DATA", "OK"), ("RESET MASTER", "RESET", "PARTIAL"), ("EXPLAIN SELECT 1", "EXPLAIN", "OK"), ("DESC t", "DESCRIBE", "OK"), ("CALL p()", "CALL", "OK"), ("DO 1", "DO", "OK"),
    ("FOO BAR", "UNKNOWN", "PARTIAL"), ("SELECT FROM WHERE", "SELECT", "ERROR"), ("SELECT 1 2 3", "SELECT", "ERROR"),
]


@pytest.mark.parametrize(("sql", "kind", "status"), KINDS)
def test_classify(sql, kind, status):
    told = classify(sql, "mysql")
    assert (told.kind, told.status) == (kind, status)


def test_targets():
    assert classify("CREATE TABLE IF NOT EXISTS db.t (a INT)").target == ["db", "t"]
    assert classify("DROP VIEW v").target == ["v"]
    assert classify("ROLLBACK TO SAVEPOINT sp").target == ["sp"]
    assert classify("DELETE FROM a.b WHERE x = 1").target == ["a", "b"]


def test_lexer_dialects():
    kinds = lambda s, d: [(t.kind, t.value) for t in tokenize(s, Dialect.of(d))[:-1]]
    assert kinds("'a''b\\n'", "mysql") == [("string", "a'b\n")]
    assert kinds("'a''b\\n'", "postgres") == [("string", "a'b\\n")]
    assert kinds("E'\\t' $$x'y$$ $q$a$$b$q$", "postgres") == [("string", "\t"), ("string", "x'y"), ("string", "a$$b")]
    assert kinds("a /* x /* y */ z */ b", "postgres") == [("word", "a"), ("word", "b")]
    assert kinds("a # c\n -- d\n b /*!50000 c */", "mysql") == [("word", "a"), ("word", "b"), ("word", "c")]
    assert kinds('"x"', "mysql") == [("string", "x")] and kinds('"x"', "postgres") == [("ident", "x")]
    assert kinds("0x1F X'1f' b'01' `a``b`", "mysql") == [("hex", "0x1F"), ("hex", "X'1f'"), ("bit", "b'01'"), ("ident", "a`b")]
    with pytest.raises(SqlError):
        tokenize("/* open", Dialect.POSTGRES)


DIGESTS = [
    ("SELECT name FROM ships WHERE tons > 900", "SELECT name FROM ships WHERE tons > ?"),
    ("select name from ships where flag = 'no' and knots < 17.5 or hull = 0x1F", "SELECT name FROM ships WHERE flag = ? AND knots < ? OR hull = ?"),
    ("SELECT hull FROM ships WHERE port IN (4, 6, 9, 11)", "SELECT hull FROM ships WHERE port IN (?)"),
    ("INSERT INTO ships (hull, name) VALUES (31, 'Vega'), (32, 'Rigel'), (33, 'Mira')", "INSERT INTO ships (hull, name) VALUES (?, ?)"),
    ("SELECT hull FROM ships WHERE built IS NOT NULL", "SELECT hull FROM ships WHERE built IS NOT NULL"),
    ("SELECT @knots", "SELECT @knots"),
    ("SELECT @'top speed'", "SELECT @?"),
    ("SET @`top``speed` = 17", "SET @? = ?"),
    ("CREATE TABLE ships (tons INT DEFAULT 12)", "CREATE TABLE ships (tons INT DEFAULT ?)"),
    ("REVOKE INSERT ON fleet.* FROM 'mate'@'bridge'", "REVOKE INSERT ON fleet.* FROM ?@?"),
    ("DROP INDEX IF EXISTS by_flag", "DROP INDEX IF EXISTS by_flag"),
]


@pytest.mark.parametrize(("sql", "text"), DIGESTS)
def test_digest(sql, text):
    assert digest(sql).text == text
    assert digest(sql).hash == fnv1a(text.encode())
    assert token_text(sql) == text


def test_digest_equal_for_equal_shapes():
    assert digest("SELECT a FROM t WHERE b IN (1)").hash == digest("select a from t where b in (4, 5)").hash
    assert digest("SELECT a AS x FROM t").hash == digest("SELECT a FROM t").hash
    assert digest("SELECT a FROM t").hash != digest("SELECT b FROM t").hash
    assert token_text("SELECT * FROM u WHERE id = $1", "postgres") == "SELECT * FROM u WHERE id = $1"


def test_fnv1a_known_values():
    assert fnv1a(b"") == 0xCBF29CE484222325
    assert fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_precedence():
    same = lambda a, b: to_sql(parse(f"SELECT {a}"), "mysql") and parse(f"SELECT {a}") != parse(f"SELECT {b}")
    assert same("a OR b AND c", "(a OR b) AND c")
    node = parse("SELECT 1 + 2 * 3 = 7 AND NOT a = b OR c").items[0].expr
    assert node.op == "OR" and node.left.op == "AND" and node.left.left.op == "="
    assert node.left.right.op == "NOT" and node.left.right.arg.op == "="
    setop = parse("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3")
    assert setop.op == "UNION" and setop.right.op == "INTERSECT"


def test_mysql_limit_operands():
    tail = parse("SELECT a FROM t LIMIT 5, 10").tail
    assert (tail.offset.value, tail.limit.value) == (5, 10)


def test_script():
    assert len(parse_script("SELECT 1; ; SET a = 2;", "mysql")) == 2


@pytest.mark.parametrize(("sql", "usage"), [("SELECT 1", NO_VARIABLES), ("SELECT @a + 1 FROM t WHERE b = @c", READ_ONLY), ("SELECT f(@a)", UNSAFE), ("SELECT @a := 2", UNSAFE), ("SET @a = 1", UNSAFE), ("SELECT (SELECT @a)", UNSAFE), ("SELECT 1 INTO @a", UNSAFE)])
def test_variable_usage(sql, usage):
    assert variable_usage(sql) == usage
