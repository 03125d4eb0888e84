"""What kind of statement a text is, without running it."""

from __future__ import annotations

from dataclasses import dataclass

from tandemql.sql import nodes as N
from tandemql.sql.dialect import Dialect, SqlError
from tandemql.sql.lexer import Token, tokenize

# The kinds of statements, by first word.
FIRST_WORDS = {
    "SELECT": "SELECT", "VALUES": "SELECT", "TABLE": "SELECT", "(": "SELECT", "INSERT": "INSERT", "UPDATE": "UPDATE", "DELETE": "DELETE",
    "REPLACE": "REPLACE", "SET": "SET", "USE": "USE", "SHOW": "SHOW", "BEGIN": "BEGIN", "START": "START_TRANSACTION", "COMMIT": "COMMIT",
    "END": "COMMIT", "ROLLBACK": "ROLLBACK", "ABORT": "ROLLBACK", "SAVEPOINT": "SAVEPOINT", "RELEASE": "SAVEPOINT", "PREPARE": "PREPARE",
    "EXECUTE": "EXECUTE", "DEALLOCATE": "DEALLOCATE", "CREATE": "CREATE", "ALTER": "ALTER", "DROP": "DROP", "TRUNCATE": "TRUNCATE",
    "GRANT": "GRANT", "REVOKE": "REVOKE", "LOCK": "LOCK", "UNLOCK": "UNLOCK", "LOAD": "LOAD_DATA", "RESET": "RESET", "EXPLAIN": "EXPLAIN",
    "DESCRIBE": "DESCRIBE", "DESC": "DESCRIBE", "CALL": "CALL", "DO": "DO",
}
UNKNOWN = "UNKNOWN"
_BEFORE_NAME = set("TABLE VIEW INDEX DATABASE SCHEMA SEQUENCE FUNCTION PROCEDURE TRIGGER TYPE USER ROLE EXTENSION DOMAIN EVENT TABLES SAVEPOINT PREPARE".split())
_SKIPPED = set("IF NOT EXISTS OR REPLACE TEMPORARY TEMP UNIQUE ONLY CONCURRENTLY MATERIALIZED UNLOGGED RECURSIVE".split())


@dataclass
class Classification:
    kind: str
    status: str  # OK: read whole; PARTIAL: kind and object only; ERROR
    target: list[str]
    node: N.Node | None = None
    error: str = ""


def command_kind(tokens: list[Token]) -> str:
    word = tokens[0].upper or tokens[0].text
    if word == "WITH":
        depth = 0
        for t in tokens:
            depth += (t.text == "(") - (t.text == ")")
            if not depth and t.upper in ("SELECT", "INSERT", "UPDATE", "DELETE", "VALUES"):
                return FIRST_WORDS[t.upper]
    return FIRST_WORDS.get(word, UNKNOWN)


def command_target(tokens: list[Token]) -> list[str]:
    """The object that a command names: the dotted name after its kind of object, or after its first word."""
    words = [t.upper for t in tokens]
    at = next((i + 1 for i, w in enumerate(words) if w in _BEFORE_NAME), None)
    if at is None:
        if words[0] in ("GRANT", "REVOKE") and "ON" in words:
            at = words.index("ON") + 1
        elif words[0] in ("USE", "SAVEPOINT", "TRUNCATE", "EXECUTE", "RESET", "RELEASE"):
            at = 1
        elif words[0] == "ROLLBACK" and "TO" in words:
            at = words.index("TO") + 1
        else:
            return []
    while at < len(tokens) and words[at] in _SKIPPED | _BEFORE_NAME:
        at += 1
    out: list[str] = []
    while at < len(tokens) and (tokens[at].kind in ("word", "ident") or tokens[at].text == "*"):
        out.append(tokens[at].value)
        if at + 1 < len(tokens) and tokens[at + 1].text == ".":
            at += 2
        else:
            break
    return out


def _node_target(node: N.Node) -> list[str]:
    if isinstance(node, N.With):
        return _node_target(node.body)
    if isinstance(node, N.Insert):
        return node.table.parts
    if isinstance(node, (N.Update, N.Delete)):
        root = node.tables if isinstance(node, N.Update) else node.source
        return next((t.parts for t in root.walk() if isinstance(t, N.Table)), [])
    if isinstance(node, (N.Describe, N.LoadData)):
        return node.table
    if isinstance(node, N.CallStatement):
        return node.name
    return getattr(node, "target", []) if isinstance(node, N.Command) else next((t.parts for t in node.walk() if isinstance(t, N.Table)), [])


def classify(sql: str, dialect: Dialect | str = Dialect.MYSQL) -> Classification:
    from tandemql.sql.parser import parse

    dialect = Dialect.of(dialect)
    try:
        tokens = tokenize(sql, dialect)[:-1]
    except SqlError as error:
        first = sql.split(None, 1)[0].upper() if sql.strip() else ""
        return Classification(FIRST_WORDS.get(first, UNKNOWN), "ERROR", [], error=str(error))
    if not tokens:
        return Classification(UNKNOWN, "ERROR", [], error="no statement")
    kind = command_kind(tokens)
    try:
        node = parse(sql, dialect)
    except SqlError as error:
        return Classification(kind, "ERROR", command_target(tokens), error=str(error))
    status = "PARTIAL" if isinstance(node, N.Command) else "OK"
    if isinstance(node, N.Describe):
        kind = "DESCRIBE"
    return Classification(kind, status, _node_target(node), node)


NO_VARIABLES, READ_ONLY, UNSAFE = "none", "read-only", "unsafe or unknown"


def variable_usage(sql: str) -> str:
    """Whether a MySQL statement only reads user variables, in places where reading can't have an effect.

    Such places are a SELECT's items and clauses with operators and comparisons in between. Assignments,
    INTO, function arguments, subqueries, CALL, DO and statements that can't be read whole are not.
    """
    try:
        if not any(t.kind == "uservar" for t in tokenize(sql, Dialect.MYSQL)):
            return NO_VARIABLES
    except SqlError:
        return UNSAFE
    told = classify(sql, Dialect.MYSQL)
    if told.status != "OK" or not isinstance(told.node, N.Select):
        return UNSAFE
    plain = (N.Select, N.Item, N.OrderItem, N.Tail, N.Binary, N.Unary, N.IsTest, N.Between, N.InList, N.Row, N.Literal, N.Name, N.Star, N.Variable)
    never = (N.Call, N.Param, N.Subquery, N.Exists, N.Into)

    def safe(node: N.Node, path_is_plain: bool) -> bool:
        if isinstance(node, never) or isinstance(node, N.Binary) and node.op == ":=" or isinstance(node, N.InList) and node.query is not None:
            return False
        if isinstance(node, N.Variable) and not node.system:
            return path_is_plain
        inner = path_is_plain and isinstance(node, plain)
        return all(safe(c, inner) for c in node.children())

    return READ_ONLY if safe(told.node, True) else UNSAFE
