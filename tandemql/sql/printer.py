"""The tree back to SQL text of its own dialect: parsing the text again gives an equal tree."""

from __future__ import annotations

from tandemql.sql import nodes as N
from tandemql.sql.dialect import Dialect


class Printer:
    def __init__(self, dialect: Dialect | str):
        self.dialect = Dialect.of(dialect)

    def print(self, node: N.Node) -> str:
        return getattr(self, f"on_{type(node).__name__.lower()}")(node)

    def listed(self, items: list, apart: str = ", ") -> str:
        return apart.join(self.print(i) for i in items)

    # Names

    def name(self, name: str) -> str:
        plain = name.replace("_", "a").replace("$", "a").isalnum() and not name[0].isdigit() if name else False
        if isinstance(name, N.Delimited) or not plain:
            mark = "`" if self.dialect is Dialect.MYSQL else '"'
            return mark + name.replace(mark, mark * 2) + mark
        return name

    def dotted(self, parts: list[str]) -> str:
        return ".".join(self.name(p) for p in parts)

    def columns(self, names: list[str]) -> str:
        return f"({', '.join(self.name(c) for c in names)})" if names else ""

    # Expressions

    def on_fixed(self, n: N.Fixed) -> str:
        return n.sql

    def on_literal(self, n: N.Literal) -> str:
        return n.raw.upper() if n.kind in ("null", "bool") else n.raw

    def on_name(self, n: N.Name) -> str:
        return self.dotted(n.parts)

    def on_param(self, n: N.Param) -> str:
        return n.raw

    def on_variable(self, n: N.Variable) -> str:
        return n.raw

    def on_unary(self, n: N.Unary) -> str:
        return f"NOT {self.print(n.arg)}" if n.op == "NOT" else f"{n.op}{' ' * (isinstance(n.arg, N.Unary) and n.arg.op == n.op)}{self.print(n.arg)}"

    def on_binary(self, n: N.Binary) -> str:
        if n.op == "<=>" and self.dialect is Dialect.POSTGRES:
            return f"{self.print(n.left)} IS NOT DISTINCT FROM {self.print(n.right)}"
        return f"{self.print(n.left)} {n.op} {self.print(n.right)}"

    def on_istest(self, n: N.IsTest) -> str:
        return f"{self.print(n.arg)} IS {'NOT ' * n.negated}{n.what}"

    def on_between(self, n: N.Between) -> str:
        return f"{self.print(n.arg)} {'NOT ' * n.negated}BETWEEN {self.print(n.low)} AND {self.print(n.high)}"

    def on_inlist(self, n: N.InList) -> str:
        inner = self.print(n.query) if n.query else self.listed(n.items)
        return f"{self.print(n.arg)} {'NOT ' * n.negated}IN ({inner})"

    def on_like(self, n: N.Like) -> str:
        if n.op == "MEMBER OF":
            return f"{self.print(n.arg)} MEMBER OF ({self.print(n.pattern)})"
        op = "~" if n.op == "REGEXP" and self.dialect is Dialect.POSTGRES else n.op
        escape = f" ESCAPE {self.print(n.escape)}" if n.escape else ""
        return f"{self.print(n.arg)} {'NOT ' * n.negated}{op} {self.print(n.pattern)}{escape}"

    def on_quantified(self, n: N.Quantified) -> str:
        return f"{self.print(n.arg)} {n.op} {n.quantifier} ({self.print(n.query)})"

    def on_case(self, n: N.Case) -> str:
        parts = ["CASE"] + ([self.print(n.operand)] if n.operand else [])
        parts += [f"WHEN {self.print(w)} THEN {self.print(t)}" for w, t in n.whens]
        return " ".join(parts + ([f"ELSE {self.print(n.otherwise)}"] if n.otherwise else []) + ["END"])

    def on_call(self, n: N.Call) -> str:
        if n.bare:
            return n.name.upper()
        args = self.listed(n.args)
        if n.name.upper() == "POSITION":
            args = self.listed(n.args, " IN ")
        order = f" ORDER BY {self.listed(n.order)}" if n.order else ""
        text = f"{n.name}({'DISTINCT ' * n.distinct}{args}{order})"
        text += f" FILTER (WHERE {self.print(n.filter)})" if n.filter else ""
        return text + (f" OVER {self.over(n.over)}" if n.over else "")

    def over(self, w: N.Window) -> str:
        alone = w.name and not (w.partition or w.order or w.frame)
        return self.name(w.name) if alone else self.on_window(w)

    def on_window(self, w: N.Window) -> str:
        parts = [self.name(w.name)] if w.name else []
        parts += [f"PARTITION BY {self.listed(w.partition)}"] if w.partition else []
        parts += [f"ORDER BY {self.listed(w.order)}"] if w.order else []
        return f"({' '.join(parts + ([w.frame] if w.frame else []))})"

    def on_cast(self, n: N.Cast) -> str:
        return f"{self.print(n.arg)}::{n.type}" if n.colons else f"CAST({self.print(n.arg)} AS {n.type})"

    def on_extract(self, n: N.Extract) -> str:
        return f"EXTRACT({n.unit} FROM {self.print(n.arg)})"

    def on_interval(self, n: N.Interval) -> str:
        return f"INTERVAL {self.print(n.value)}{' ' * bool(n.unit)}{n.unit}"

    def on_subquery(self, n: N.Subquery) -> str:
        return f"({self.print(n.query)})"

    def on_exists(self, n: N.Exists) -> str:
        return f"EXISTS ({self.print(n.query)})"

    def on_row(self, n: N.Row) -> str:
        return f"{'ROW' * n.keyword}({self.listed(n.items)})"

    def on_arrayof(self, n: N.ArrayOf) -> str:
        return f"ARRAY[{self.listed(n.items)}]"

    def on_index(self, n: N.Index) -> str:
        return f"{self.print(n.arg)}[{self.print(n.at)}]"

    def on_field(self, n: N.Field) -> str:
        return f"{self.print(n.arg)}.{self.name(n.name)}"

    def on_star(self, n: N.Star) -> str:
        text = ".".join([self.name(t) for t in n.table] + ["*"])
        text += f" EXCEPT ({', '.join(self.name(c) for c in n.except_)})" if n.except_ else ""
        return text + (f" REPLACE ({', '.join(f'{self.print(e)} AS {self.name(a)}' for e, a in n.replace)})" if n.replace else "")

    def on_default(self, n: N.Default) -> str:
        return "DEFAULT"

    # Queries

    def on_item(self, n: N.Item) -> str:
        return self.print(n.expr) + self.aliased(n.alias)

    def aliased(self, alias: str | None) -> str:
        return f" AS {self.name(alias)}" if alias else ""

    def on_orderitem(self, n: N.OrderItem) -> str:
        return self.print(n.expr) + " DESC" * n.desc + (f" NULLS {n.nulls}" if n.nulls else "")

    def on_table(self, n: N.Table) -> str:
        return self.dotted(n.parts) + self.aliased(n.alias) + self.columns(n.columns)

    def on_derived(self, n: N.Derived) -> str:
        return f"{'LATERAL ' * n.lateral}({self.print(n.query)}){self.aliased(n.alias)}{self.columns(n.columns)}"

    def on_join(self, n: N.Join) -> str:
        if n.kind == "COMMA":
            return f"{self.print(n.left)}, {self.print(n.right)}"
        right = f"({self.print(n.right)})" if isinstance(n.right, N.Join) else self.print(n.right)
        kind = "" if n.kind == "INNER" else f"{n.kind} "
        text = f"{self.print(n.left)} {'NATURAL ' * n.natural}{kind}JOIN {right}"
        return text + (f" ON {self.print(n.on)}" if n.on else "") + (f" USING {self.columns(n.using)}" if n.using else "")

    def on_tail(self, n: N.Tail) -> str:
        text = f" ORDER BY {self.listed(n.order)}" if n.order else ""
        text += f" LIMIT {self.print(n.limit)}" if n.limit else ""
        return text + (f" OFFSET {self.print(n.offset)}" if n.offset else "")

    def on_select(self, n: N.Select) -> str:
        text = "SELECT " + " ".join(["DISTINCT"] * n.distinct + n.options + [self.listed(n.items)])
        text += f" FROM {self.print(n.source)}" if n.source else ""
        text += f" WHERE {self.print(n.where)}" if n.where else ""
        text += f" GROUP BY {self.listed(n.group)}{' WITH ROLLUP' * n.rollup}" if n.group else ""
        text += f" HAVING {self.print(n.having)}" if n.having else ""
        if n.windows:
            text += " WINDOW " + ", ".join(f"{self.name(w)} AS {self.on_window(spec)}" for w, spec in n.windows)
        text += self.print(n.tail)
        text += f" {self.print(n.into)}" if n.into else ""
        return text + "".join(f" {lock}" for lock in n.locks)

    def on_groupingsets(self, n: N.GroupingSets) -> str:
        return f"{n.kind} ({', '.join(self.print(s[0]) if len(s) == 1 else f'({self.listed(s)})' for s in n.sets)})"

    def on_into(self, n: N.Into) -> str:
        if n.kind == "VARIABLES":
            return "INTO " + ", ".join(f"@{v}" for v in n.variables)
        return f"INTO {n.kind} {_quoted(n.path)}{_file_options(n.options)}"

    def on_values(self, n: N.Values) -> str:
        return "VALUES " + self.rows(n.rows) + self.print(n.tail)

    def rows(self, rows: list[list[N.Node]]) -> str:
        return ", ".join(f"({self.listed(r)})" for r in rows)

    def on_compound(self, n: N.Compound) -> str:
        return f"{self.print(n.left)} {n.op}{' ALL' * n.all} {self.print(n.right)}{self.print(n.tail)}"

    def on_parenthesized(self, n: N.Parenthesized) -> str:
        return f"({self.print(n.query)})"

    def on_cte(self, n: N.Cte) -> str:
        return f"{self.name(n.name)}{self.columns(n.columns)} AS ({self.print(n.query)})"

    def on_with(self, n: N.With) -> str:
        return f"WITH {'RECURSIVE ' * n.recursive}{self.listed(n.ctes)} {self.print(n.body)}"

    # Changes

    def on_assign(self, n: N.Assign) -> str:
        return f"{self.print(n.target)} = {self.print(n.value)}"

    def returning(self, items: list[N.Node]) -> str:
        return f" RETURNING {self.listed(items)}" if items else ""

    def on_insert(self, n: N.Insert) -> str:
        text = f"{'REPLACE' if n.replace else 'INSERT'}{' IGNORE' * n.ignore} INTO {self.dotted(n.table.parts)}"
        if n.assigned:
            text += " SET " + ", ".join(f"{self.name(c)} = {self.print(v)}" for c, v in zip(n.columns, n.source.rows[0], strict=True))
        else:
            text += f" {self.columns(n.columns)}" if n.columns else ""
            text += f" {self.print(n.source)}" if n.source else " DEFAULT VALUES"
        if n.conflict:
            text += self.print(n.conflict)
        return text + self.returning(n.returning)

    def on_conflict(self, n: N.Conflict) -> str:
        if n.duplicate_key:
            return f" ON DUPLICATE KEY UPDATE {self.listed(n.sets)}"
        what = f"UPDATE SET {self.listed(n.sets)}" + (f" WHERE {self.print(n.where)}" if n.where else "") if n.sets else "NOTHING"
        return f" ON CONFLICT{' ' * bool(n.columns)}{self.columns(n.columns)} DO {what}"

    def on_update(self, n: N.Update) -> str:
        text = f"UPDATE {self.print(n.tables)} SET {self.listed(n.sets)}"
        text += f" FROM {self.print(n.source)}" if n.source else ""
        return text + (f" WHERE {self.print(n.where)}" if n.where else "") + self.print(n.tail) + self.returning(n.returning)

    def on_delete(self, n: N.Delete) -> str:
        text = "DELETE " + ", ".join(self.name(t) for t in n.targets) + " " * bool(n.targets) + f"FROM {self.print(n.source)}"
        text += f" USING {self.print(n.using)}" if n.using else ""
        return text + (f" WHERE {self.print(n.where)}" if n.where else "") + self.print(n.tail) + self.returning(n.returning)

    # Others

    def on_setitem(self, n: N.SetItem) -> str:
        value = self.listed(n.value.items) if isinstance(n.value, N.Row) and self.dialect is Dialect.POSTGRES and len(n.value.items) > 1 else self.print(n.value)
        return f"{n.scope}{' ' * bool(n.scope)}{self.print(n.target)} = {value}"

    def on_setstatement(self, n: N.SetStatement) -> str:
        if n.form == "VARIABLES":
            return f"SET {self.listed(n.items)}"
        words = " ".join(w.upper() if n.form == "TRANSACTION" else w for w in n.words).replace(" ,", ",")
        return " ".join(x for x in ("SET", n.scope, n.form, words) if x)

    def on_explain(self, n: N.Explain) -> str:
        if self.dialect is Dialect.POSTGRES and n.options:
            return f"EXPLAIN ({', '.join(n.options)}) {self.print(n.statement)}"
        return " ".join(["EXPLAIN", *n.options, self.print(n.statement)])

    def on_describe(self, n: N.Describe) -> str:
        return f"DESCRIBE {self.dotted(n.table)}" + (f" {self.name(n.column)}" if n.column else "")

    def on_callstatement(self, n: N.CallStatement) -> str:
        return f"CALL {self.dotted(n.name)}({self.listed(n.args)})"

    def on_do(self, n: N.Do) -> str:
        return f"DO {self.listed(n.exprs)}"

    def on_loaddata(self, n: N.LoadData) -> str:
        text = f"LOAD DATA {'LOCAL ' * n.local}INFILE {_quoted(n.path)} {n.mode}{' ' * bool(n.mode)}INTO TABLE {self.dotted(n.table)}"
        text += f" CHARACTER SET {n.charset}" if n.charset else ""
        told = {"fields_terminated": n.fields, "fields_enclosed": n.enclosed, "fields_escaped": n.escaped, "lines_starting": n.starting, "lines_terminated": n.lines}
        text += _file_options({k: v for k, v in told.items() if v})
        text += f" IGNORE {n.skip} LINES" if n.skip else ""
        text += f" ({', '.join(n.columns)})" if n.columns else ""
        return text + (f" SET {self.listed(n.sets)}" if n.sets else "")

    def on_command(self, n: N.Command) -> str:
        out = ""
        for word in n.words:
            tight = word in (",", ".", ")", ";", "(") and not (word == "(" and out[-1:] not in (".", "(")) or out.endswith((".", "(")) or word.startswith("@")
            out += word if not out or tight else f" {word}"
        return out


def _quoted(text: str) -> str:
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = text.replace(plain, escaped)
    return f"'{text}'"


def _file_options(options: dict[str, str]) -> str:
    fields = [f"{k.split('_')[1].upper()} BY {_quoted(v)}" for k, v in options.items() if k.startswith("fields_")]
    lines = [f"{k.split('_')[1].upper()} BY {_quoted(v)}" for k, v in options.items() if k.startswith("lines_")]
    return "".join(f" {head} {' '.join(parts)}" for head, parts in (("FIELDS", fields), ("LINES", lines)) if parts)


def to_sql(node: N.Node, dialect: Dialect | str) -> str:
    return Printer(dialect).print(node)
