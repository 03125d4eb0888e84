"""A query of either dialect to Spark SQL that means the same.

Catalyst resolves names, plans and optimises; lowering only settles what the dialects mean otherwise than
Spark: division, truth of numbers, ``||``, LIKE, comparisons of text and numbers, functions, types, LIMIT
m, n, star modifiers, ANY/ALL. For these it follows the kinds of columns through a query's scopes. The
kinds of a subquery's columns are Spark's own, by analysing its text.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql.types import StructType

from tandemql.functions.registry import FunctionRegistry
from tandemql.sql import nodes as N
from tandemql.sql.dialect import Dialect, SqlError
from tandemql.types import NUMERIC, TEMPORAL, kind_of, spark_type

Text = tuple[str, str]  # Spark SQL and kind


@dataclass
class Relation:
    """A table as a query may name it: the Spark view, and its columns with their kinds."""

    view: str
    columns: list[tuple[str, str]]


@dataclass
class Scope:
    relations: list[tuple[str, list[tuple[str, str]]]] = field(default_factory=list)
    outer: Scope | None = None
    aliases: dict[str, str] = field(default_factory=dict)  # kinds of select items, for HAVING and ORDER BY

    def kind(self, parts: list[str]) -> str:
        name = parts[-1].lower()
        for alias, columns in self.relations:
            if len(parts) > 1 and alias.lower() != parts[-2].lower():
                continue
            for c, kind in columns:
                if c.lower() == name:
                    return kind
        if len(parts) == 1 and name in self.aliases:
            return self.aliases[name]
        return self.outer.kind(parts) if self.outer else "?"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        value = value.replace(plain, escaped)
    return f"'{value}'"


def mysql_number(text: str) -> str:
    """Text as MySQL reads a number: its longest numeric beginning; '' is 0, text without one is null."""
    start = rf"regexp_extract({text}, '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1)"
    return f"CASE WHEN {text} = '' THEN 0D ELSE try_cast(nullif({start}, '') AS DOUBLE) END"


class Lowering:
    def __init__(
        self,
        dialect: Dialect | str,
        find: Callable[[list[str]], Relation | None],
        analyse: Callable[[str], StructType],
        functions: FunctionRegistry | None = None,
        variables: dict[str, object] | None = None,
        system: dict[str, object] | None = None,
    ):
        self.dialect = Dialect.of(dialect)
        self.mysql = self.dialect is Dialect.MYSQL
        self.find, self.analyse = find, analyse
        self.functions = functions or FunctionRegistry(self.dialect)
        self.variables, self.system = variables or {}, system or {}
        self.ctes: list[tuple[str, str, list[tuple[str, str]]]] = []  # name, text, columns
        self.recursive = False
        self.first_kind = "?"  # of the first column of the select lowered last

    # Queries

    def query(self, node: N.Node, outer: Scope | None = None) -> str:
        return getattr(self, f"query_{type(node).__name__.lower()}")(node, outer)

    def columns_of(self, text: str) -> list[tuple[str, str]]:
        head = self.with_text()
        return [(f.name, kind_of(f.dataType)) for f in self.analyse(head + text).fields]

    def with_text(self) -> str:
        return f"WITH {'RECURSIVE ' * self.recursive}{', '.join(text for _, text, _ in self.ctes)} " if self.ctes else ""

    def query_with(self, node: N.With, outer: Scope | None) -> str:
        depth = len(self.ctes)
        self.recursive = self.recursive or node.recursive
        for cte in node.ctes:
            named = f"({', '.join(quote(c) for c in cte.columns)})" if cte.columns else ""
            if node.recursive and isinstance(cte.query, N.Compound):
                first = self.query(cte.query.left, outer)
                columns = self._named(self.columns_of(first), cte.columns)
                self.ctes.append((cte.name.lower(), "", columns))
                inner = self.ctes.pop()
                self.ctes.append((cte.name.lower(), f"{quote(cte.name)}{named} AS ({first})", columns))
                body = f"{first} {cte.query.op}{' ALL' * cte.query.all} {self.query(cte.query.right, outer)}"
                self.ctes[-1] = (inner[0], f"{quote(cte.name)}{named} AS ({body})", columns)
            else:
                body = self.query(cte.query, outer)
                columns = self._named(self.columns_of(body), cte.columns)
                self.ctes.append((cte.name.lower(), f"{quote(cte.name)}{named} AS ({body})", columns))
        body = self.query(node.body, outer)
        text = f"WITH {'RECURSIVE ' * node.recursive}{', '.join(text for _, text, _ in self.ctes[depth:])} {body}"
        del self.ctes[depth:]
        return text

    @staticmethod
    def _named(columns: list[tuple[str, str]], names: list[str]) -> list[tuple[str, str]]:
        return [(n, kind) for n, (_, kind) in zip(names, columns, strict=True)] if names else columns

    def query_parenthesized(self, node: N.Parenthesized, outer: Scope | None) -> str:
        return f"({self.query(node.query, outer)})"

    def query_compound(self, node: N.Compound, outer: Scope | None) -> str:
        sides = [self.query(x, outer) for x in (node.left, node.right)]
        op = f"{node.op}{' ALL' * node.all}"
        return f"{sides[0]} {op} {sides[1]}{self.tail(node.tail, Scope(outer=outer))}"

    def query_values(self, node: N.Values, outer: Scope | None) -> str:
        scope = Scope(outer=outer)
        rows = ", ".join(f"({', '.join(self.expr(v, scope)[0] for v in row)})" for row in node.rows)
        return f"SELECT * FROM VALUES {rows}{self.tail(node.tail, scope)}"

    def query_select(self, node: N.Select, outer: Scope | None) -> str:
        scope = Scope(outer=outer)
        for ignored in [*node.locks, *[o for o in node.options if o == "SQL_CALC_FOUND_ROWS"]]:
            warnings.warn(f"{ignored} has no effect", stacklevel=2)
        source = f" FROM {self.source(node.source, scope)}" if node.source else ""
        items = [t for item in node.items for t in self.item(item, scope)]
        first = self._kind_of_item(node.items[0], scope)
        text = f"SELECT {'DISTINCT ' * node.distinct}{', '.join(items)}{source}"
        if node.where:
            text += f" WHERE {self.truth(node.where, scope)}"
        if node.group:
            text += f" GROUP BY {', '.join(self.expr(g, scope)[0] for g in node.group)}{' WITH ROLLUP' * node.rollup}"
        if node.having:
            text += f" HAVING {self.truth(node.having, scope)}"
        if node.windows:
            text += " WINDOW " + ", ".join(f"{quote(n)} AS {self.window(w, scope)}" for n, w in node.windows)
        text += self.tail(node.tail, scope)
        self.first_kind = first
        return text

    def _kind_of_item(self, item: N.Node, scope: Scope) -> str:
        if isinstance(item, N.Star):
            return next((c[0][1] for a, c in scope.relations if c and (not item.table or a.lower() == item.table[-1].lower())), "?")
        return self.expr(item.expr, scope)[1]

    def tail(self, tail: N.Tail, scope: Scope) -> str:
        text = ""
        if tail.order:
            text += f" ORDER BY {', '.join(self.order(o, scope) for o in tail.order)}"
        if tail.limit:
            text += f" LIMIT {self.expr(tail.limit, scope)[0]}"
        if tail.offset:
            text += f" OFFSET {self.expr(tail.offset, scope)[0]}"
        return text

    def order(self, o: N.OrderItem, scope: Scope) -> str:
        return self.expr(o.expr, scope)[0] + " DESC" * o.desc + (f" NULLS {o.nulls}" if o.nulls else "")

    # Sources

    def source(self, node: N.Node, scope: Scope) -> str:
        if isinstance(node, N.Table):
            return self.table(node, scope)
        if isinstance(node, N.Derived):
            text = self.query(node.query, scope if node.lateral else scope.outer)
            alias = node.alias or f"_d{len(scope.relations)}"
            try:
                columns = self._named(self.columns_of(text), node.columns)
            except Exception:
                if not node.lateral:
                    raise
                columns = []  # it refers to columns outside; their kinds stay unknown
            scope.relations.append((alias, columns))
            named = f"({', '.join(quote(c) for c in node.columns)})" if node.columns else ""
            return f"{'LATERAL ' * node.lateral}({text}) AS {quote(alias)}{named}"
        left = self.source(node.left, scope)
        right = self.source(node.right, scope)
        if isinstance(node.right, N.Join):
            right = f"({right})"
        if node.kind in ("COMMA", "CROSS"):
            return f"{left} CROSS JOIN {right}"
        text = f"{left} {'NATURAL ' * node.natural}{node.kind} JOIN {right}"
        if node.on:
            text += f" ON {self.truth(node.on, scope)}"
        return text + (f" USING ({', '.join(quote(c) for c in node.using)})" if node.using else "")

    def table(self, node: N.Table, scope: Scope) -> str:
        alias = node.alias or node.parts[-1]
        if len(node.parts) == 1:
            for name, _, columns in reversed(self.ctes):
                if name == node.parts[0].lower():
                    scope.relations.append((alias, columns))
                    return f"{quote(node.parts[0])} AS {quote(alias)}"
        relation = self.find(node.parts)
        if relation is None:
            raise SqlError(f"no table {'.'.join(node.parts)}")
        columns = self._named(relation.columns, node.columns)
        scope.relations.append((alias, columns))
        named = f"({', '.join(quote(c) for c in node.columns)})" if node.columns else ""
        return f"{quote(relation.view)} AS {quote(alias)}{named}"

    # Select items

    def item(self, node: N.Node, scope: Scope) -> list[str]:
        if isinstance(node, N.Star):
            return self.star(node, scope)
        text, kind = self.expr(node.expr, scope)
        if node.alias:
            scope.aliases[node.alias.lower()] = kind
            return [f"{text} AS {quote(node.alias)}"]
        if isinstance(node.expr, N.Name):
            return [text]
        from tandemql.sql.printer import to_sql

        return [f"{text} AS {quote(to_sql(node.expr, self.dialect))}"]

    def star(self, node: N.Star, scope: Scope) -> list[str]:
        if not (node.except_ or node.replace):
            return [".".join([*map(quote, node.table[-1:]), "*"])]
        replaced = {name.lower(): e for e, name in node.replace}
        dropped = {c.lower() for c in node.except_}
        seen, out = set(), []
        for alias, columns in scope.relations:
            if node.table and alias.lower() != node.table[-1].lower():
                continue
            for c, _ in columns:
                seen.add(c.lower())
                if c.lower() in dropped:
                    continue
                text = self.expr(replaced[c.lower()], scope)[0] if c.lower() in replaced else f"{quote(alias)}.{quote(c)}"
                out.append(f"{text} AS {quote(c)}")
        if missing := (dropped | set(replaced)) - seen:
            raise SqlError(f"no such columns: {sorted(missing)}")
        return out

    # Expressions

    def expr(self, node: N.Node, scope: Scope) -> Text:
        return getattr(self, f"expr_{type(node).__name__.lower()}")(node, scope)

    def truth(self, node: N.Node, scope: Scope) -> str:
        return self.as_bool(self.expr(node, scope))

    def as_bool(self, text: Text) -> str:
        sql, kind = text
        if kind in NUMERIC:
            return f"({sql} <> 0)"
        if kind == "null":
            return "CAST(NULL AS BOOLEAN)"
        if kind == "str":
            return f"({sql} IS NOT NULL)"  # any text is true
        return sql

    def as_number(self, text: Text) -> Text:
        sql, kind = text
        if kind == "bool":
            return f"CAST({sql} AS BIGINT)", "int"
        if kind == "str":
            return (mysql_number(sql), "double") if self.mysql else (f"try_cast({sql} AS DOUBLE)", "double")
        return text

    def expr_literal(self, n: N.Literal, scope: Scope) -> Text:
        if n.kind == "int":
            return (str(n.value), "int") if n.value < 2**63 else (f"{n.value}BD", "decimal")
        if n.kind == "float":
            return f"{n.value!r}D", "double"
        if n.kind == "string":
            return text_literal(n.value), "str"
        if n.kind == "bool":
            return str(n.value).upper(), "bool"
        if n.kind == "hex":
            return (str(int(n.value or "0", 16)), "int") if n.raw[1:2] == "x" and n.raw[0] == "0" else (f"X'{n.value}'", "binary")
        if n.kind == "bit":
            return str(int(n.value or "0", 2)), "int"
        return "NULL", "null"

    def expr_fixed(self, n: N.Fixed, scope: Scope) -> Text:
        return n.sql, n.kind

    def expr_name(self, n: N.Name, scope: Scope) -> Text:
        return ".".join(quote(p) for p in n.parts[-2:]), scope.kind(n.parts)

    def expr_star(self, n: N.Star, scope: Scope) -> Text:
        return "*", "?"

    def expr_param(self, n: N.Param, scope: Scope) -> Text:
        return f":p{n.number}", "?"

    def expr_variable(self, n: N.Variable, scope: Scope) -> Text:
        values = self.system if n.system else self.variables
        name = n.name.split(".", 1)[-1] if n.system else n.name
        return value_literal(values.get(name.lower()))

    def expr_unary(self, n: N.Unary, scope: Scope) -> Text:
        if n.op == "NOT":
            return f"(NOT {self.truth(n.arg, scope)})", "bool"
        sql, kind = self.as_number(self.expr(n.arg, scope))
        return f"({n.op}{sql})" if n.op != "+" else sql, kind

    def expr_binary(self, n: N.Binary, scope: Scope) -> Text:
        op = n.op
        if op in ("AND", "OR") or op == "||" and self.mysql:
            word = "OR" if op == "||" else op
            return f"({self.truth(n.left, scope)} {word} {self.truth(n.right, scope)})", "bool"
        if op == "XOR":
            return f"({self.truth(n.left, scope)} <> {self.truth(n.right, scope)})", "bool"
        a, b = self.expr(n.left, scope), self.expr(n.right, scope)
        if op in ("=", "<>", "<", "<=", ">", ">=", "<=>"):
            return self.compare(op, a, b), "bool"
        if op == "||":
            if "array" in (a[1], b[1]):
                return f"concat({a[0]}, {b[0]})", "array"
            return " || ".join(x if k == "str" else f"CAST({x} AS STRING)" for x, k in (a, b)).join("()"), "str"
        return self.arithmetic(op, a, b)

    def arithmetic(self, op: str, a: Text, b: Text) -> Text:
        if op in ("+", "-") and (a[1] in TEMPORAL or b[1] in TEMPORAL or "interval" in (a[1], b[1])):
            if a[1] in TEMPORAL and b[1] in TEMPORAL:
                return f"CAST(datediff({a[0]}, {b[0]}) AS BIGINT)", "int"
            if a[1] == "date" and b[1] == "int":
                return f"{'date_add' if op == '+' else 'date_sub'}({a[0]}, CAST({b[0]} AS INT))", "date"
            return f"({a[0]} {op} {b[0]})", "timestamp" if "timestamp" in (a[1], b[1]) else "?"
        a, b = self.as_number(a), self.as_number(b)
        (x, ka), (y, kb) = a, b
        both = "double" if "double" in (ka, kb) else "decimal" if "decimal" in (ka, kb) else "int" if ka == kb == "int" else "null" if "null" in (ka, kb) else "?"
        if op == "/":
            return (f"({x} DIV nullif({y}, 0))", "int") if both == "int" else (f"({x} / nullif({y}, 0))", "double" if both != "decimal" else "decimal")
        if op in ("%", "MOD"):
            return f"try_mod({x}, {y})", both
        if op == "DIV":
            return (f"({x} DIV nullif({y}, 0))" if both == "int" else f"CAST({x} / nullif({y}, 0) AS BIGINT)"), "int"
        if op == "^":
            return (f"({x} ^ {y})", "int") if self.mysql else (f"power({x}, {y})", "double")
        if op == "#":
            return f"({x} ^ {y})", "int"
        if op in ("<<", ">>"):
            return f"shift{'left' if op == '<<' else 'right'}(CAST({x} AS BIGINT), CAST({y} AS INT))", "int"
        if op in ("&", "|"):
            return f"({x} {op} {y})", "int"
        if op in ("+", "-", "*"):
            return f"({x} {op} {y})", both
        raise SqlError(f"operator {op} isn't run")

    def compare(self, op: str, a: Text, b: Text) -> str:
        (x, ka), (y, kb) = a, b
        if {ka, kb} & NUMERIC and "str" in (ka, kb) or "bool" in (ka, kb) and ka != kb and {ka, kb} & (NUMERIC | {"str"}):
            literal = x.startswith("'") if ka == "str" else y.startswith("'")
            if not self.mysql and "str" in (ka, kb) and not literal:
                return "CAST(NULL AS BOOLEAN)"  # text and numbers don't compare
            if "bool" in (ka, kb) and "str" in (ka, kb) and not self.mysql:
                x, y = (f"try_cast({t} AS BOOLEAN)" if k == "str" else t for t, k in (a, b))
            else:
                (x, _), (y, _) = self.as_number(a), self.as_number(b)
        elif ka in TEMPORAL and kb == "str" or kb in TEMPORAL and ka == "str":
            to = "TIME" if "time" in (ka, kb) else "TIMESTAMP_NTZ"
            x, y = (f"try_cast({t} AS {to})" for t in (x, y))
        return f"({x} {op} {y})"

    def expr_istest(self, n: N.IsTest, scope: Scope) -> Text:
        text = self.expr(n.arg, scope)
        sql = text[0] if n.what == "NULL" else self.as_bool(text)
        return f"({sql} IS {'NOT ' * n.negated}{n.what})", "bool"

    def expr_between(self, n: N.Between, scope: Scope) -> Text:
        x, low, high = (self.expr(e, scope) for e in (n.arg, n.low, n.high))
        sql = f"({self.compare('>=', x, low)} AND {self.compare('<=', x, high)})"
        return f"(NOT {sql})" if n.negated else sql, "bool"

    def expr_inlist(self, n: N.InList, scope: Scope) -> Text:
        x = self.expr(n.arg, scope)
        word = "NOT IN" if n.negated else "IN"
        if n.query is not None:
            inner = self.query(n.query, scope)
            y = ("_q._v", self.first_kind)
            if not ("str" in (x[1], y[1]) and {x[1], y[1]} & NUMERIC):
                return f"({x[0]} {word} ({inner}))", "bool"
            if not self.mysql and not x[0].startswith("'"):
                return "CAST(NULL AS BOOLEAN)", "bool"  # text and numbers don't compare
            (left, _), (right, _) = self.as_number(x), self.as_number(y)
            return f"({left} {word} (SELECT {right} FROM ({inner}) AS _q(_v)))", "bool"
        items = [self.expr(i, scope) for i in n.items]
        if all(k in (x[1], "null", "?") or k in NUMERIC and x[1] in NUMERIC for _, k in items):
            return f"({x[0]} {word} ({', '.join(t for t, _ in items)}))", "bool"
        sql = "(" + " OR ".join(self.compare("=", x, i) for i in items) + ")"
        return f"(NOT {sql})" if n.negated else sql, "bool"

    def expr_like(self, n: N.Like, scope: Scope) -> Text:
        x, p = self.expr(n.arg, scope), self.expr(n.pattern, scope)
        a = x[0] if x[1] == "str" else f"CAST({x[0]} AS STRING)"
        if n.op == "MEMBER OF":
            sql = f"array_contains({p[0]}, {x[0]})"
        elif n.op == "SOUNDS LIKE":
            sql = f"(soundex({a}) = soundex({p[0]}))"
        elif n.op == "REGEXP":
            sql = f"({a} RLIKE {p[0]})" if not self.mysql else f"({a} RLIKE concat('(?i)', {p[0]}))"
        else:
            word = "ILIKE" if self.mysql or n.op == "ILIKE" else "LIKE"
            escape = f" ESCAPE {self.expr(n.escape, scope)[0]}" if n.escape else ""
            sql = f"({a} {word} {p[0]}{escape})"
        return f"(NOT {sql})" if n.negated else sql, "bool"

    def expr_quantified(self, n: N.Quantified, scope: Scope) -> Text:
        x, inner = self.expr(n.arg, scope), self.query(n.query, scope)
        if n.quantifier == "ANY" and n.op == "=":
            return f"({x[0]} IN ({inner}))", "bool"
        if n.quantifier == "ALL" and n.op == "<>":
            return f"({x[0]} NOT IN ({inner}))", "bool"
        test = f"{x[0]} {n.op} _q._v"
        if n.quantifier == "ANY":
            return f"EXISTS (SELECT 1 FROM ({inner}) AS _q(_v) WHERE {test})", "bool"
        return f"(NOT EXISTS (SELECT 1 FROM ({inner}) AS _q(_v) WHERE NOT coalesce({test}, FALSE)))", "bool"

    def expr_case(self, n: N.Case, scope: Scope) -> Text:
        results, text = [], "CASE"
        operand = self.expr(n.operand, scope) if n.operand else None
        for when, then in n.whens:
            test = self.compare("=", operand, self.expr(when, scope)) if operand else self.truth(when, scope)
            results.append(self.expr(then, scope))
            text += f" WHEN {test} THEN {results[-1][0]}"
        if n.otherwise:
            results.append(self.expr(n.otherwise, scope))
            text += f" ELSE {results[-1][0]}"
        return f"{text} END", next((k for _, k in results if k != "null"), "null")

    def expr_call(self, n: N.Call, scope: Scope) -> Text:
        name = n.name.upper()
        if name == "IF" and self.mysql and len(n.args) == 3:
            yes, no = self.expr(n.args[1], scope), self.expr(n.args[2], scope)
            return f"if({self.truth(n.args[0], scope)}, {yes[0]}, {no[0]})", yes[1] if yes[1] != "null" else no[1]
        function = self.functions.find(name)
        if function is None:
            raise SqlError(f"no function {n.name}")
        args = [self.expr(a, scope) for a in n.args]
        if name in ("ABS", "SIGN", "POWER", "POW", "SQRT", "MOD", "ROUND", "CEIL", "CEILING", "FLOOR", "TRUNCATE", "TRUNC"):
            args = [self.as_number(a) for a in args]
        texts, kinds = [t for t, _ in args], [k for _, k in args]
        if n.distinct and texts:
            texts[0] = f"DISTINCT {texts[0]}"
        over = f"OVER {quote(n.over.name) if n.over.name and not (n.over.partition or n.over.order or n.over.frame) else self.window(n.over, scope)}" if n.over else ""
        if isinstance(function.template, str) and "{over}" in function.template:
            if not over:
                raise SqlError(f"{n.name} needs OVER")
            return function.template.replace("{over}", over), function.result(kinds)
        sql = function.sql(texts, kinds)
        if n.distinct:
            sql = sql.replace("CAST(DISTINCT ", "DISTINCT CAST(", 1)
        if n.order:
            sql += f" WITHIN GROUP (ORDER BY {', '.join(self.order(o, scope) for o in n.order)})"
        if n.filter:
            sql += f" FILTER (WHERE {self.truth(n.filter, scope)})"
        return f"{sql} {over}" if over else sql, function.result(kinds)

    def window(self, w: N.Window, scope: Scope) -> str:
        parts = [quote(w.name)] if w.name else []
        if w.partition:
            parts.append(f"PARTITION BY {', '.join(self.expr(p, scope)[0] for p in w.partition)}")
        if w.order:
            parts.append(f"ORDER BY {', '.join(self.order(o, scope) for o in w.order)}")
        return f"({' '.join(parts + [w.frame] * bool(w.frame))})"

    def expr_cast(self, n: N.Cast, scope: Scope) -> Text:
        to, kind = spark_type(n.type)
        sql, have = self.expr(n.arg, scope)
        if have == "bool" and kind == "str" and self.mysql:
            return f"if({sql}, '1', '0')", "str"
        if self.mysql and have == "str" and kind in NUMERIC:
            number = mysql_number(sql)
            return f"try_cast({number} AS {to})", kind
        return f"try_cast({sql} AS {to})", kind

    def expr_extract(self, n: N.Extract, scope: Scope) -> Text:
        sql, kind = self.expr(n.arg, scope)
        x = f"try_cast({sql} AS TIMESTAMP_NTZ)" if kind in ("str", "?") else sql
        if n.unit == "EPOCH":
            return f"unix_timestamp(CAST({x} AS TIMESTAMP))", "int"
        return f"CAST(extract({n.unit} FROM {x}) AS BIGINT)", "int"

    def expr_interval(self, n: N.Interval, scope: Scope) -> Text:
        sql, kind = self.expr(n.value, scope)
        if not n.unit:
            return f"INTERVAL {sql}", "interval"
        return f"INTERVAL {sql if isinstance(n.value, N.Literal) else f'1 {n.unit} * {sql}'}{f' {n.unit}' if isinstance(n.value, N.Literal) else ''}", "interval"

    def expr_subquery(self, n: N.Subquery, scope: Scope) -> Text:
        text = self.query(n.query, scope)
        return f"({text})", self.first_kind  # of the select that was lowered last, which is the subquery's outermost

    def expr_exists(self, n: N.Exists, scope: Scope) -> Text:
        return f"EXISTS ({self.query(n.query, scope)})", "bool"

    def expr_groupingsets(self, n: N.GroupingSets, scope: Scope) -> Text:
        sets = [f"({', '.join(self.expr(e, scope)[0] for e in s)})" for s in n.sets]
        return f"{n.kind} ({', '.join(sets)})", "?"

    def expr_row(self, n: N.Row, scope: Scope) -> Text:
        if len(n.items) == 1 and not n.keyword:
            sql, kind = self.expr(n.items[0], scope)
            return f"({sql})", kind
        items = [self.expr(i, scope)[0] for i in n.items]
        return f"named_struct({', '.join(f'{text_literal(f"f{i + 1}")}, {x}' for i, x in enumerate(items))})", "struct"

    def expr_arrayof(self, n: N.ArrayOf, scope: Scope) -> Text:
        return f"array({', '.join(self.expr(i, scope)[0] for i in n.items)})", "array"

    def expr_index(self, n: N.Index, scope: Scope) -> Text:
        x, at = self.expr(n.arg, scope)[0], self.expr(n.at, scope)[0]
        return (f"get({x}, CAST({at} AS INT))" if self.mysql else f"try_element_at({x}, CAST({at} AS INT))"), "?"

    def expr_field(self, n: N.Field, scope: Scope) -> Text:
        return f"{self.expr(n.arg, scope)[0]}.{quote(n.name)}", "?"

    def expr_default(self, n: N.Default, scope: Scope) -> Text:
        return "NULL", "null"


def value_literal(value: object) -> Text:
    """A Python value in Spark SQL."""
    if value is None:
        return "NULL", "null"
    if isinstance(value, bool):
        return str(value).upper(), "bool"
    if isinstance(value, int):
        return str(value), "int"
    if isinstance(value, float):
        return (f"{value!r}D" if math.isfinite(value) else f"CAST('{value}' AS DOUBLE)"), "double"
    if isinstance(value, Decimal):
        return f"{value:f}BD", "decimal"
    if isinstance(value, datetime):
        return f"TIMESTAMP{'' if value.tzinfo else '_NTZ'} '{value.isoformat(sep=' ')}'", "timestamp"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'", "date"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'", "binary"
    return text_literal(str(value)), "str"
