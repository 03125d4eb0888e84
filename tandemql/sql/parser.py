"""A recursive-descent parser with precedence climbing for expressions, for both dialects.

``parse`` reads one statement and wants all of it; what the grammar below doesn't know is an error, but
statements that the engine never runs (DDL, grants, ...) are kept as a Command of their kind.
"""

from __future__ import annotations

from tandemql.sql import nodes as N
from tandemql.sql.dialect import Dialect, SqlError
from tandemql.sql.lexer import Token, tokenize

# Binding powers; higher binds tighter.
OR, XOR, AND, NOT, COMPARE, BIT_OR, BIT_AND, SHIFT, OTHER, ADD, MULTIPLY, POWER, UNARY, POSTFIX = range(1, 15)
_COMPARISONS = {"=", "<>", "!=", "<", "<=", ">", ">=", "<=>"}
_INFIX = {"OR": OR, "XOR": XOR, "AND": AND, "&&": AND, "|": BIT_OR, "&": BIT_AND, "<<": SHIFT, ">>": SHIFT, "+": ADD, "-": ADD, "*": MULTIPLY, "/": MULTIPLY, "%": MULTIPLY, "DIV": MULTIPLY, "MOD": MULTIPLY, "^": POWER} | dict.fromkeys(_COMPARISONS, COMPARE)
#: Words that end an expression or an alias, and so can't be one without quotes.
_RESERVED = set(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL AS AND OR NOT XOR "
    "IN IS LIKE ILIKE BETWEEN REGEXP RLIKE CASE WHEN THEN ELSE END SET VALUES RETURNING WINDOW FOR LOCK INTO DIV MOD ASC DESC WITH OUTER STRAIGHT_JOIN LATERAL BY DISTINCT ALL SOUNDS MEMBER".split()
)
_BARE_CALLS = {"CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "LOCALTIME", "LOCALTIMESTAMP"}
_UNITS = set("MICROSECOND SECOND MINUTE HOUR DAY WEEK MONTH QUARTER YEAR SECONDS MINUTES HOURS DAYS WEEKS MONTHS YEARS EPOCH DOW DOY".split())
_TYPE_WORDS = {"DOUBLE": {"PRECISION"}, "CHARACTER": {"VARYING"}, "UNSIGNED": {"INTEGER", "INT"}, "SIGNED": {"INTEGER", "INT"}, "BIGINT": {"UNSIGNED"}, "INT": {"UNSIGNED"}, "INTEGER": {"UNSIGNED"}}


class Parser:
    def __init__(self, sql: str, dialect: Dialect | str = Dialect.MYSQL):
        self.dialect = Dialect.of(dialect)
        self.sql, self.at, self.params = sql, 0, 0
        self.tokens = tokenize(sql, self.dialect)

    # Tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.now
        self.at += token.kind != "end"
        return token

    def fail(self, wanted: str) -> SqlError:
        return SqlError(f"{wanted} expected at {self.now.start}, not {self.now.text or 'the end'!r}")

    def sees(self, *words: str) -> bool:
        """Whether the next tokens are these words or operators."""
        return all((t := self.ahead(i)).upper == w or t.kind == "op" and t.text == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.sees(*words):
            self.at += len(words)
            return True
        return False

    def take_any(self, *words: str) -> str:
        return next((w for w in words if self.take(w)), "")

    def want(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                raise self.fail(w)

    def identifier(self, what: str = "a name") -> str:
        if self.now.kind == "ident":
            return N.Delimited(self.next().value)
        if self.now.kind == "word":
            return self.next().value
        raise self.fail(what)

    def dotted(self) -> list[str]:
        parts = [self.identifier()]
        while self.take("."):
            parts.append(self.identifier())
        return parts

    def names(self) -> list[str]:
        """( name, ... )"""
        self.want("(")
        out = [self.identifier()]
        while self.take(","):
            out.append(self.identifier())
        self.want(")")
        return out

    def listed(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    # Statements

    def statement(self) -> N.Node:
        node = self._statement()
        self.take(";")
        if self.now.kind != "end":
            raise self.fail("the end of the statement")
        return node

    def _statement(self) -> N.Node:
        word = self.now.upper
        if self.sees("("):
            return self.query()
        if word in ("SELECT", "VALUES", "WITH", "TABLE"):
            return self.with_changes() if word == "WITH" else self.query()
        readers = {
            "INSERT": self.insert,
            "REPLACE": self.insert,
            "UPDATE": self.update,
            "DELETE": self.delete,
            "SET": self.set_statement,
            "EXPLAIN": self.explain,
            "DESCRIBE": self.explain,
            "DESC": self.explain,
            "CALL": self.call,
            "DO": self.do,
            "LOAD": self.load_data,
        }
        return readers.get(word, self.command)()

    def command(self) -> N.Command:
        from tandemql.sql.classify import command_kind, command_target

        start = self.at
        while self.now.kind != "end" and not self.sees(";"):
            self.next()
        tokens = self.tokens[start : self.at]
        if not tokens:
            raise self.fail("a statement")
        return N.Command(command_kind(tokens), [t.text for t in tokens], command_target(tokens))

    def with_changes(self) -> N.Node:
        self.want("WITH")
        recursive = self.take("RECURSIVE")
        ctes = self.listed(self.cte)
        word = self.now.upper
        body = {"INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete}.get(word, self.query)()
        return N.With(recursive, ctes, body)

    def cte(self) -> N.Cte:
        name = self.identifier()
        columns = self.names() if self.sees("(") else []
        self.want("AS")
        self.take("NOT")
        self.take("MATERIALIZED")
        self.want("(")
        query = self.query()
        self.want(")")
        return N.Cte(name, columns, query)

    # Queries

    def query(self) -> N.Node:
        if self.sees("WITH"):
            return self.with_changes()
        node = self.union_level()
        tail = self.tail()
        if tail.order or tail.limit or tail.offset:
            if isinstance(node, N.Parenthesized):
                node = N.Select([N.Star()], N.Derived(node.query, "_q"), tail=tail)
            else:
                node.tail = tail
        if isinstance(node, N.Select):
            node.locks = self.locks()
            node.into = node.into or self.into()
            node.locks += self.locks()
        return node

    def union_level(self) -> N.Node:
        left = self.intersect_level()
        while op := self.take_any("UNION", "EXCEPT", "MINUS"):
            every = self.take("ALL")
            self.take("DISTINCT")
            left = N.Compound("EXCEPT" if op == "MINUS" else op, every, left, self.intersect_level())
        return left

    def intersect_level(self) -> N.Node:
        left = self.query_term()
        while self.take("INTERSECT"):
            every = self.take("ALL")
            self.take("DISTINCT")
            left = N.Compound("INTERSECT", every, left, self.query_term())
        return left

    def query_term(self) -> N.Node:
        if self.take("("):
            inner = self.query()
            self.want(")")
            return N.Parenthesized(inner)
        if self.take("VALUES"):
            return N.Values(self.listed(self.values_row))
        if self.take("TABLE"):
            return N.Select([N.Star()], N.Table(self.dotted()))
        return self.select()

    def values_row(self) -> list[N.Node]:
        self.take("ROW")
        self.want("(")
        out = [] if self.sees(")") else self.listed(self.value_or_default)
        self.want(")")
        return out

    def value_or_default(self) -> N.Node:
        return N.Default() if self.take("DEFAULT") else self.expr()

    def select(self) -> N.Select:
        self.want("SELECT")
        node = N.Select([])
        while True:
            if self.take("DISTINCT") or self.take("DISTINCTROW"):
                node.distinct = True
            elif option := self.take_any("ALL", "SQL_CALC_FOUND_ROWS", "SQL_NO_CACHE", "STRAIGHT_JOIN", "HIGH_PRIORITY", "SQL_SMALL_RESULT", "SQL_BIG_RESULT", "SQL_BUFFER_RESULT"):
                if option != "ALL":
                    node.options.append(option)
            else:
                break
        node.items = self.listed(self.item)
        node.into = self.into()
        if self.take("FROM"):
            node.source = self.from_list()
        if self.take("WHERE"):
            node.where = self.expr()
        if self.take("GROUP", "BY"):
            node.group = self.listed(self.grouping)
            node.rollup = self.take("WITH", "ROLLUP")
        if self.take("HAVING"):
            node.having = self.expr()
        if self.take("WINDOW"):
            node.windows = self.listed(self.named_window)
        return node

    def grouping(self) -> N.Node:
        if self.sees("GROUPING") and self.ahead(1).upper == "SETS":
            self.next()
            self.next()
            return N.GroupingSets("GROUPING SETS", self.grouping_sets())
        if self.now.upper in ("ROLLUP", "CUBE") and self.ahead(1).text == "(":
            return N.GroupingSets(self.next().upper, self.grouping_sets())
        return self.expr()

    def grouping_sets(self) -> list[list[N.Node]]:
        self.want("(")
        sets = self.listed(self.grouping_set)
        self.want(")")
        return sets

    def grouping_set(self) -> list[N.Node]:
        if not self.take("("):
            return [self.expr()]
        columns = [] if self.sees(")") else self.listed(self.expr)
        self.want(")")
        return columns

    def named_window(self) -> tuple[str, N.Window]:
        name = self.identifier()
        self.want("AS")
        return name, self.window_spec()

    def item(self) -> N.Node:
        if self.take("*"):
            return self.star_modifiers(N.Star())
        if self.now.kind in ("word", "ident"):
            n = 0
            while self.ahead(n).kind in ("word", "ident") and self.ahead(n + 1).text == ".":
                n += 2
            if n and self.ahead(n).text == "*" and self.ahead(n).kind == "op":
                table = [N.Delimited(t.value) if t.kind == "ident" else t.value for t in self.tokens[self.at : self.at + n : 2]]
                self.at += n + 1
                return self.star_modifiers(N.Star(table))
        return N.Item(self.expr(), self.alias())

    def star_modifiers(self, star: N.Star) -> N.Star:
        if (self.sees("EXCEPT", "(") or self.sees("EXCLUDE", "(")) and self.ahead(2).upper not in ("SELECT", "VALUES", "WITH") and self.ahead(2).text != "(":
            self.next()
            star.except_ = self.names()
        if self.take("REPLACE", "("):
            star.replace = self.listed(lambda: (self.expr(), (self.want("AS"), self.identifier())[1]))
            self.want(")")
        return star

    def alias(self) -> str | None:
        if self.take("AS"):
            if self.now.kind == "string":
                return self.next().value
            return self.identifier("an alias")
        if self.now.kind == "ident" or self.now.kind == "word" and self.now.upper not in _RESERVED:
            return self.identifier()
        if self.now.kind == "string" and self.dialect is Dialect.MYSQL:
            return self.next().value
        return None

    def from_list(self) -> N.Node:
        left = self.joined()
        while self.take(","):
            left = N.Join(left, self.joined(), "COMMA")
        return left

    def joined(self) -> N.Node:
        left = self.table()
        while True:
            natural = self.take("NATURAL")
            if self.take("CROSS", "JOIN"):
                kind = "CROSS"
            elif self.take("INNER", "JOIN") or self.take("JOIN") or self.take("STRAIGHT_JOIN"):
                kind = "INNER"
            elif side := next((s for s in ("LEFT", "RIGHT", "FULL") if self.sees(s, "JOIN") or self.sees(s, "OUTER", "JOIN")), None):
                self.next()
                self.take("OUTER")
                self.want("JOIN")
                kind = side
            elif natural:
                raise self.fail("JOIN")
            else:
                return left
            join = N.Join(left, self.table(), kind, natural)
            if not natural and kind != "CROSS" or self.sees("ON") or self.sees("USING"):
                if self.take("ON"):
                    join.on = self.expr()
                elif self.take("USING"):
                    join.using = self.names()
                elif kind != "INNER":
                    raise self.fail("ON or USING")
                else:
                    join.kind = "CROSS"
            left = join

    def table(self) -> N.Node:
        lateral = self.take("LATERAL")
        if self.take("("):
            if self.sees("SELECT") or self.sees("WITH") or self.sees("VALUES") or self.sees("("):
                mark = self.at
                try:
                    query = self.query()
                    self.want(")")
                except SqlError:
                    self.at = mark
                else:
                    derived = N.Derived(query, None, [], lateral)
                    derived.alias, derived.columns = self.table_alias()
                    return derived
            inner = self.from_list()
            self.want(")")
            return inner
        node = N.Table(self.dotted())
        node.alias, node.columns = self.table_alias()
        return node

    def table_alias(self) -> tuple[str | None, list[str]]:
        name = self.alias()
        return name, self.names() if name and self.sees("(") and self.ahead().kind in ("word", "ident") else []

    def tail(self) -> N.Tail:
        tail = N.Tail()
        if self.take("ORDER", "BY"):
            tail.order = self.listed(self.order_item)
        while True:
            if self.take("LIMIT"):
                if not self.take("ALL"):
                    first = self.expr()
                    if self.take(","):
                        tail.offset, tail.limit = first, self.expr()
                    else:
                        tail.limit = first
            elif self.take("OFFSET"):
                tail.offset = self.expr()
                self.take_any("ROW", "ROWS")
            elif self.take("FETCH"):
                self.take_any("FIRST", "NEXT")
                tail.limit = N.Literal("int", 1, "1") if self.sees("ROW") or self.sees("ROWS") else self.expr()
                self.take_any("ROW", "ROWS")
                self.want("ONLY")
            else:
                return tail

    def order_item(self) -> N.OrderItem:
        item = N.OrderItem(self.expr(), self.take_any("ASC", "DESC") == "DESC")
        if self.take("NULLS"):
            item.nulls = self.take_any("FIRST", "LAST")
        return item

    def locks(self) -> list[str]:
        out = []
        while self.sees("FOR") or self.sees("LOCK", "IN"):
            words = [self.next().upper]
            while self.now.kind in ("word", "ident") and not self.sees("FOR") and not self.sees("INTO") or self.sees(",") or self.sees("."):
                words.append(self.next().text)
            out.append(" ".join(words))
        return out

    def into(self) -> N.Into | None:
        if not (self.dialect is Dialect.MYSQL and self.take("INTO")):
            return None
        kind = self.take_any("OUTFILE", "DUMPFILE")
        if not kind:
            return N.Into("VARIABLES", variables=self.listed(lambda: self.next().value))
        out = N.Into(kind, self.string())
        if self.take("CHARACTER", "SET"):
            self.identifier()
        out.options = self.file_options()
        return out

    def string(self) -> str:
        if self.now.kind != "string":
            raise self.fail("a string")
        return self.next().value

    def file_options(self) -> dict[str, str]:
        out: dict[str, str] = {}
        if self.take("FIELDS") or self.take("COLUMNS"):
            while word := self.take_any("TERMINATED", "OPTIONALLY", "ENCLOSED", "ESCAPED"):
                if word == "OPTIONALLY":
                    self.want("ENCLOSED")
                    word = "ENCLOSED"
                self.want("BY")
                out[f"fields_{word.lower()}"] = self.string()
        if self.take("LINES"):
            while word := self.take_any("STARTING", "TERMINATED"):
                self.want("BY")
                out[f"lines_{word.lower()}"] = self.string()
        return out

    # Changes

    def insert(self) -> N.Insert:
        replace = self.next().upper == "REPLACE"
        self.take_any("LOW_PRIORITY", "HIGH_PRIORITY", "DELAYED")
        ignore = self.take("IGNORE")
        self.take("INTO")
        table = N.Table(self.dotted())
        if self.take("AS"):
            table.alias = self.identifier()
        node = N.Insert(table, [], None, replace, ignore)
        if self.sees("(") and not (self.ahead().upper in ("SELECT", "WITH", "VALUES") or self.ahead().text == "("):
            node.columns = self.names() if self.ahead().text != ")" else (self.want("(", ")"), [])[1]
        if self.take("OVERRIDING"):
            self.take_any("SYSTEM", "USER")
            self.want("VALUE")
        if self.take("DEFAULT", "VALUES"):
            node.source = None
        elif self.take("SET"):
            sets = self.listed(self.assign)
            node.assigned, node.columns = True, [a.target.parts[-1] for a in sets]
            node.source = N.Values([[a.value for a in sets]])
        elif self.take("VALUES") or self.take("VALUE"):
            node.source = N.Values(self.listed(self.values_row))
        else:
            node.source = self.query()
        if self.dialect is Dialect.MYSQL and self.take("AS"):
            table.alias = self.identifier()
        if self.take("ON", "DUPLICATE", "KEY", "UPDATE"):
            node.conflict = N.Conflict(sets=self.listed(self.assign), duplicate_key=True)
        elif self.take("ON", "CONFLICT"):
            node.conflict = N.Conflict(self.names() if self.sees("(") else [])
            if self.take("ON", "CONSTRAINT"):
                self.identifier()
            self.want("DO")
            if not self.take("NOTHING"):
                self.want("UPDATE", "SET")
                node.conflict.sets = self.listed(self.assign)
                if self.take("WHERE"):
                    node.conflict.where = self.expr()
        node.returning = self.returning()
        return node

    def assign(self) -> N.Assign:
        target = N.Name(self.dotted())
        if not self.take(":="):
            self.want("=")
        return N.Assign(target, self.value_or_default())

    def returning(self) -> list[N.Node]:
        return self.listed(self.item) if self.take("RETURNING") else []

    def update(self) -> N.Update:
        self.want("UPDATE")
        self.take("LOW_PRIORITY")
        self.take("IGNORE")
        self.take("ONLY")
        tables = self.from_list()
        self.want("SET")
        node = N.Update(tables, self.listed(self.assign))
        if self.take("FROM"):
            node.source = self.from_list()
        if self.take("WHERE"):
            node.where = self.expr()
        node.tail = self.tail()
        node.returning = self.returning()
        return node

    def delete(self) -> N.Delete:
        self.want("DELETE")
        for word in ("LOW_PRIORITY", "QUICK", "IGNORE"):
            self.take(word)
        targets: list[str] = []
        if not self.sees("FROM"):  # DELETE t1, t2 FROM ...
            targets = self.listed(lambda: (self.dotted(), self.take(".", "*"))[0][-1])
        self.want("FROM")
        self.take("ONLY")
        node = N.Delete(targets, self.from_list())
        if self.take("USING"):
            node.using = self.from_list()
        if self.take("WHERE"):
            node.where = self.expr()
        node.tail = self.tail()
        node.returning = self.returning()
        return node

    # Other statements

    def set_statement(self) -> N.Node:
        self.want("SET")
        if self.take("NAMES"):
            return N.SetStatement("NAMES", words=self.rest())
        if self.take("CHARACTER", "SET") or self.take("CHARSET"):
            return N.SetStatement("CHARACTER SET", words=self.rest())
        mark = self.at
        scope = self.take_any("GLOBAL", "SESSION", "LOCAL")
        if self.take("TRANSACTION") or scope == "SESSION" and self.take("CHARACTERISTICS", "AS", "TRANSACTION"):
            return N.SetStatement("TRANSACTION", words=self.rest(), scope=scope)
        for form in ("ROLE", "SESSION AUTHORIZATION", "CONSTRAINTS", "TIME ZONE", "SCHEMA", "DEFAULT ROLE", "PASSWORD", "RESOURCE GROUP"):
            words = form.split()
            if scope and words[0] == scope and self.take(*words[1:]):
                return N.SetStatement(form, words=self.rest())
            after = self.ahead(len(words))
            if self.sees(*words) and after.text not in ("=", ":="):
                self.at += len(words)
                return N.SetStatement(form, words=self.rest(), scope=scope)
        self.at = mark
        return N.SetStatement("VARIABLES", self.listed(self.set_item))

    def rest(self) -> list[str]:
        out = []
        while self.now.kind != "end" and not self.sees(";"):
            out.append(self.next().text)
        return out

    def set_item(self) -> N.SetItem:
        scope = self.take_any("GLOBAL", "SESSION", "LOCAL", "PERSIST_ONLY", "PERSIST")
        token = self.now
        if token.kind in ("uservar", "sysvar"):
            self.next()
            target: N.Node = N.Variable(token.value, token.text, token.kind == "sysvar")
        else:
            target = N.Name(self.dotted())
        if not (self.take(":=") or self.take("=") or self.take("TO")):
            raise self.fail("=")
        if self.now.kind == "word" and self.now.upper in ("ON", "DEFAULT", "ALL", "OFF", "LOCAL"):
            value: N.Node = N.Name([self.next().text])
        else:
            value = self.expr()
            while self.dialect is Dialect.POSTGRES and self.sees(",") and not isinstance(target, N.Variable):
                self.next()  # a list, as of search_path
                value = N.Row([*(value.items if isinstance(value, N.Row) else [value]), self.expr()])
        return N.SetItem(scope, target, value)

    def explain(self) -> N.Node:
        word = self.next().upper
        readable = ("SELECT", "INSERT", "UPDATE", "DELETE", "REPLACE", "WITH", "VALUES", "TABLE")
        options: list[str] = []
        if self.sees("(") and self.ahead().upper in ("ANALYZE", "VERBOSE", "COSTS", "BUFFERS", "FORMAT", "TIMING", "SUMMARY", "SETTINGS", "WAL"):
            self.next()
            options = self.listed(lambda: " ".join(self.option_words()))
            self.want(")")
        while self.now.upper in ("ANALYZE", "VERBOSE", "EXTENDED", "PARTITIONS", "FORMAT") and (self.ahead().upper in readable or self.ahead().text in ("=", "(") or self.ahead().upper in ("VERBOSE", "FORMAT")):
            option = self.next().upper
            if self.take("="):
                option += f"={self.next().text}"
            options.append(option)
        if self.now.upper in readable or self.sees("("):
            return N.Explain(self._statement(), options)
        if word == "EXPLAIN" and self.dialect is Dialect.POSTGRES:
            raise self.fail("a statement")
        table = self.dotted()
        return N.Describe(table, self.next().value if self.now.kind in ("word", "ident", "string") else None)

    def option_words(self) -> list[str]:
        out = []
        while self.now.kind in ("word", "number", "string"):
            out.append(self.next().text)
        return out

    def call(self) -> N.CallStatement:
        self.want("CALL")
        name, args = self.dotted(), []
        if self.take("("):
            args = [] if self.sees(")") else self.listed(self.expr)
            self.want(")")
        return N.CallStatement(name, args)

    def do(self) -> N.Node:
        if self.dialect is Dialect.POSTGRES:
            return self.command()
        self.want("DO")
        return N.Do(self.listed(self.expr))

    def load_data(self) -> N.Node:
        if not (self.dialect is Dialect.MYSQL and self.sees("LOAD", "DATA")):
            return self.command()
        self.want("LOAD", "DATA")
        self.take_any("LOW_PRIORITY", "CONCURRENT")
        local = self.take("LOCAL")
        self.want("INFILE")
        path = self.string()
        mode = self.take_any("REPLACE", "IGNORE")
        self.want("INTO", "TABLE")
        node = N.LoadData(path, self.dotted(), local, mode)
        if self.take("CHARACTER", "SET"):
            node.charset = self.identifier()
        told = self.file_options()
        node.fields, node.enclosed = told.get("fields_terminated", node.fields), told.get("fields_enclosed", "")
        node.escaped, node.lines, node.starting = told.get("fields_escaped", "\\"), told.get("lines_terminated", "\n"), told.get("lines_starting", "")
        if self.take("IGNORE"):
            node.skip = int(self.next().text)
            self.take_any("LINES", "ROWS")
        if self.take("("):
            node.columns = self.listed(lambda: ("@" if self.now.kind == "uservar" else "") + self.next().value)
            self.want(")")
        if self.take("SET"):
            node.sets = self.listed(self.assign)
        return node

    # Expressions

    def expr(self, least: int = 0) -> N.Node:
        left = self.prefix()
        while True:
            after = self.infix(left, least)
            if after is None:
                return left
            left = after

    def infix(self, left: N.Node, least: int) -> N.Node | None:
        token = self.now
        word = token.upper or (token.text if token.kind == "op" else "")
        if word in ("::", "["):
            self.next()
            if word == "::":
                return N.Cast(left, self.type_name(), colons=True)
            at = self.expr()
            self.want("]")
            return N.Index(left, at)
        if word == "." and isinstance(left, (N.Row, N.Subquery, N.Field, N.Index)):
            self.next()
            return N.Field(left, self.identifier())
        if least < COMPARE or least == COMPARE - 1:
            negated = word == "NOT" and self.ahead().upper in ("IN", "BETWEEN", "LIKE", "ILIKE", "REGEXP", "RLIKE", "SIMILAR")
            word_at = self.ahead().upper if negated else word
            if word_at in ("IS", "IN", "BETWEEN", "LIKE", "ILIKE", "REGEXP", "RLIKE", "SOUNDS", "MEMBER") and COMPARE > least:
                self.at += negated
                return self.predicate(left, negated)
        if word in ("~", "~*", "!") and self.dialect is Dialect.POSTGRES and word == "~" and COMPARE > least:
            self.next()
            return N.Like("REGEXP", left, self.expr(COMPARE))
        power = _INFIX.get(word)
        if word == "||":
            power = OR if self.dialect is Dialect.MYSQL else OTHER
        if word == "#" and self.dialect is Dialect.POSTGRES:
            power = BIT_OR
        if power is None or power <= least:
            return None
        self.next()
        if power == COMPARE and (quantifier := self.take_any("ANY", "SOME", "ALL")):
            self.want("(")
            query = self.query()
            self.want(")")
            return N.Quantified(word, left, "ALL" if quantifier == "ALL" else "ANY", query)
        op = {"&&": "AND", "!=": "<>"}.get(word, word)
        return N.Binary(op, left, self.expr(power))

    def predicate(self, left: N.Node, negated: bool) -> N.Node:
        if self.take("IS"):
            negated = self.take("NOT")
            if self.take("DISTINCT", "FROM"):
                same = N.Binary("<=>", left, self.expr(COMPARE))
                return same if negated else N.Unary("NOT", same)
            what = self.take_any("NULL", "TRUE", "FALSE", "UNKNOWN")
            if not what:
                raise self.fail("NULL, TRUE or FALSE")
            return N.IsTest(left, "NULL" if what == "UNKNOWN" else what, negated)
        if self.take("IN"):
            self.want("(")
            if self.sees("SELECT") or self.sees("WITH") or self.sees("VALUES"):
                node = N.InList(left, None, self.query(), negated)
            else:
                node = N.InList(left, self.listed(self.expr), None, negated)
            self.want(")")
            return node
        if self.take("BETWEEN"):
            self.take_any("SYMMETRIC", "ASYMMETRIC")
            low = self.expr(COMPARE)
            self.want("AND")
            return N.Between(left, low, self.expr(COMPARE), negated)
        if self.take("SOUNDS", "LIKE"):
            return N.Like("SOUNDS LIKE", left, self.expr(COMPARE))
        if self.take("MEMBER"):
            self.take("OF")
            self.want("(")
            pattern = self.expr()
            self.want(")")
            return N.Like("MEMBER OF", left, pattern)
        op = self.take_any("LIKE", "ILIKE", "REGEXP", "RLIKE")
        if not op:
            raise self.fail("a predicate")
        pattern = self.expr(COMPARE)
        escape = self.expr(COMPARE) if self.take("ESCAPE") else None
        return N.Like("REGEXP" if op == "RLIKE" else op, left, pattern, escape, negated)

    def prefix(self) -> N.Node:
        token = self.now
        if token.kind == "number":
            self.next()
            whole = token.text.isdigit()
            return N.Literal("int" if whole else "float", int(token.text) if whole else float(token.text), token.text)
        if token.kind == "string":
            self.next()
            value, raw = token.value, token.text
            while self.now.kind == "string":
                more = self.next()
                value, raw = value + more.value, f"{raw} {more.text}"
            return N.Literal("string", value, raw)
        if token.kind in ("hex", "bit"):
            self.next()
            digits = token.text[2:].rstrip("'")
            return N.Literal(token.kind, digits, token.text)
        if token.kind == "param":
            self.next()
            self.params += 1
            return N.Param(token.text, int(token.text[1:]) if token.text[0] == "$" else self.params)
        if token.kind in ("uservar", "sysvar"):
            self.next()
            variable = N.Variable(token.value, token.text, token.kind == "sysvar")
            return N.Binary(":=", variable, self.expr()) if self.take(":=") else variable
        if token.kind == "op":
            return self.prefix_operator()
        if token.kind == "ident":
            return self.name_or_call()
        return self.word()

    def prefix_operator(self) -> N.Node:
        if self.take("("):
            if self.sees("SELECT") or self.sees("WITH") or self.sees("VALUES"):
                query = self.query()
                self.want(")")
                return N.Subquery(query)
            items = self.listed(self.expr)
            self.want(")")
            return N.Row(items)
        for op, power in (("-", UNARY), ("+", UNARY), ("~", UNARY), ("!", UNARY)):
            if self.take(op):
                arg = self.expr(power)
                return N.Unary("NOT" if op == "!" else op, arg)
        if self.take("*"):
            return N.Star()
        raise self.fail("an expression")

    def word(self) -> N.Node:
        word = self.now.upper
        if word in ("NULL", "TRUE", "FALSE"):
            text = self.next().text
            return N.Literal("null", None, text) if word == "NULL" else N.Literal("bool", word == "TRUE", text)
        if word == "NOT":
            self.next()
            return N.Unary("NOT", self.expr(NOT))
        if word == "CASE":
            return self.case()
        if word == "EXISTS" and self.ahead().text == "(":
            self.at += 2
            query = self.query()
            self.want(")")
            return N.Exists(query)
        if word in ("DATE", "TIME", "TIMESTAMP", "DATETIME") and self.ahead().kind == "string":
            self.next()
            raw = self.next()
            return N.Cast(N.Literal("string", raw.value, raw.text), word)
        if word == "INTERVAL" and (self.ahead().kind in ("number", "string", "param") or self.ahead().text in ("(", "-")):
            self.next()
            value = self.expr(ADD)
            return N.Interval(value, self.next().upper if self.now.upper in _UNITS else "")
        if word == "ARRAY" and self.ahead().text == "[":
            self.at += 2
            items = [] if self.sees("]") else self.listed(self.expr)
            self.want("]")
            return N.ArrayOf(items)
        if word == "ROW" and self.ahead().text == "(":
            self.at += 2
            items = self.listed(self.expr)
            self.want(")")
            return N.Row(items, keyword=True)
        if word in ("CAST", "TRY_CAST", "CONVERT") and self.ahead().text == "(":
            self.at += 2
            arg = self.expr()
            if not (self.take("AS") or word == "CONVERT" and self.take(",")):
                if word == "CONVERT" and self.take("USING"):
                    self.identifier()
                    self.want(")")
                    return arg
                raise self.fail("AS")
            node = N.Cast(arg, self.type_name())
            self.want(")")
            return node
        if word == "EXTRACT" and self.ahead().text == "(":
            self.at += 2
            unit = self.next().upper
            self.want("FROM")
            node = N.Extract(unit, self.expr())
            self.want(")")
            return node
        if word in _BARE_CALLS and self.ahead().text != "(":
            self.next()
            return N.Call(word, [], bare=True)
        if word in _RESERVED and not (word in ("LEFT", "RIGHT", "MOD", "VALUES", "REPLACE") and self.ahead().text == "(") and self.ahead().text != ".":
            raise self.fail("an expression")
        return self.name_or_call()

    def case(self) -> N.Case:
        self.want("CASE")
        operand = None if self.sees("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            when = self.expr()
            self.want("THEN")
            whens.append((when, self.expr()))
        otherwise = self.expr() if self.take("ELSE") else None
        self.want("END")
        return N.Case(operand, whens, otherwise)

    def name_or_call(self) -> N.Node:
        parts = []
        while True:
            parts.append(self.identifier("an expression"))
            if not (self.sees(".") and (self.ahead().kind in ("word", "ident"))):
                break
            self.next()
        if self.sees("(") and not isinstance(parts[-1], N.Delimited):
            return self.arguments(".".join(parts))
        return N.Name(parts)

    def arguments(self, name: str) -> N.Call:
        self.want("(")
        call = N.Call(name, [])
        upper = name.upper()
        if not self.sees(")"):
            call.distinct = self.take("DISTINCT")
            self.take("ALL")
            if upper == "TRIM" and (side := self.take_any("BOTH", "LEADING", "TRAILING")):
                what = N.Literal("string", " ", "' '") if self.sees("FROM") else self.expr()
                self.want("FROM")
                call.name, call.args = {"BOTH": "TRIM", "LEADING": "LTRIM", "TRAILING": "RTRIM"}[side], [self.expr(), what]
            elif upper == "POSITION":
                what = self.expr(COMPARE)
                self.want("IN")
                call.args = [what, self.expr()]
            else:
                call.args = self.listed(self.expr)
                if upper in ("SUBSTRING", "SUBSTR", "OVERLAY") and self.take("FROM"):
                    call.args.append(self.expr())
                    if self.take("FOR"):
                        call.args.append(self.expr())
                elif upper == "TRIM" and self.take("FROM"):
                    call.args = [self.expr(), call.args[0]]
                if self.take("ORDER", "BY"):
                    call.order = self.listed(self.order_item)
                if self.take("SEPARATOR"):
                    call.args.append(self.expr())
        self.want(")")
        if self.take("FILTER", "("):
            self.want("WHERE")
            call.filter = self.expr()
            self.want(")")
        if self.take("OVER"):
            call.over = N.Window(self.identifier()) if self.now.kind in ("word", "ident") else self.window_spec()
        return call

    def window_spec(self) -> N.Window:
        self.want("(")
        window = N.Window()
        if self.now.kind in ("word", "ident") and self.now.upper not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
            window.name = self.identifier()
        if self.take("PARTITION", "BY"):
            window.partition = self.listed(self.expr)
        if self.take("ORDER", "BY"):
            window.order = self.listed(self.order_item)
        words = []
        while self.now.kind != "end" and not self.sees(")"):
            words.append(self.next().text.upper())
        window.frame = " ".join(words)
        self.want(")")
        return window

    def type_name(self) -> str:
        words = [self.identifier("a type").upper()]
        while self.now.kind == "word" and self.now.upper in _TYPE_WORDS.get(words[-1], ()):
            words.append(self.next().upper)
        if self.take("("):
            words[-1] += "(" + ",".join(self.listed(lambda: self.next().text)) + ")"
            self.want(")")
        if words[0].startswith(("TIMESTAMP", "TIME")) and (self.sees("WITH", "TIME", "ZONE") or self.sees("WITHOUT", "TIME", "ZONE")):
            words += [self.next().upper for _ in range(3)]
        while self.take("[", "]"):
            words[-1] += "[]"
        return " ".join(words)


def parse(sql: str, dialect: Dialect | str = Dialect.MYSQL) -> N.Node:
    return Parser(sql, dialect).statement()


def parse_script(sql: str, dialect: Dialect | str = Dialect.MYSQL) -> list[N.Node]:
    """Statements separated by semicolons."""
    parser, out = Parser(sql, dialect), []
    while parser.now.kind != "end":
        if parser.take(";"):
            continue
        parser.params = 0
        out.append(parser._statement())
        if parser.now.kind != "end":
            parser.want(";")
    return out
