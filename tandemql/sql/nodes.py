"""The syntax tree. Nodes are plain dataclasses; ``walk`` visits all of a tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields


class Delimited(str):
    """A name that was written in quotes, and is printed so."""


class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(value) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from _nodes(v)


# Expressions


@dataclass
class Literal(Node):
    kind: str  # int, float, string, null, bool, hex, bit
    value: object
    raw: str


@dataclass
class Fixed(Node):
    """A value that is settled for a statement, as Spark SQL and its kind; the parser makes none."""

    sql: str
    kind: str


@dataclass
class Name(Node):
    """A column, perhaps qualified; the last part may be ``*``."""

    parts: list[str]


@dataclass
class Param(Node):
    raw: str
    number: int  # from 1


@dataclass
class Variable(Node):
    name: str
    raw: str
    system: bool = False


@dataclass
class Unary(Node):
    op: str
    arg: Node


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass
class IsTest(Node):
    arg: Node
    what: str  # NULL, TRUE, FALSE, UNKNOWN
    negated: bool = False


@dataclass
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass
class InList(Node):
    arg: Node
    items: list[Node] | None
    query: Node | None = None
    negated: bool = False


@dataclass
class Like(Node):
    op: str  # LIKE, ILIKE, REGEXP, SOUNDS LIKE, MEMBER OF
    arg: Node
    pattern: Node
    escape: Node | None = None
    negated: bool = False


@dataclass
class Quantified(Node):
    op: str
    arg: Node
    quantifier: str  # ANY, ALL
    query: Node


@dataclass
class Case(Node):
    operand: Node | None
    whens: list[tuple[Node, Node]]
    otherwise: Node | None


@dataclass
class Window(Node):
    name: str | None = None
    partition: list[Node] = field(default_factory=list)
    order: list[OrderItem] = field(default_factory=list)
    frame: str = ""


@dataclass
class Call(Node):
    name: str
    args: list[Node]
    distinct: bool = False
    over: Window | None = None
    filter: Node | None = None
    bare: bool = False  # written without parentheses
    order: list[OrderItem] = field(default_factory=list)


@dataclass
class Cast(Node):
    arg: Node
    type: str
    colons: bool = False


@dataclass
class Extract(Node):
    unit: str
    arg: Node


@dataclass
class Interval(Node):
    value: Node
    unit: str


@dataclass
class Subquery(Node):
    query: Node


@dataclass
class Exists(Node):
    query: Node


@dataclass
class Row(Node):
    items: list[Node]
    keyword: bool = False


@dataclass
class ArrayOf(Node):
    items: list[Node]


@dataclass
class Index(Node):
    arg: Node
    at: Node


@dataclass
class Field(Node):
    arg: Node
    name: str


@dataclass
class Star(Node):
    table: list[str] = field(default_factory=list)
    except_: list[str] = field(default_factory=list)
    replace: list[tuple[Node, str]] = field(default_factory=list)


# Queries


@dataclass
class Item(Node):
    expr: Node
    alias: str | None = None


@dataclass
class OrderItem(Node):
    expr: Node
    desc: bool = False
    nulls: str = ""


@dataclass
class Table(Node):
    parts: list[str]
    alias: str | None = None
    columns: list[str] = field(default_factory=list)


@dataclass
class Derived(Node):
    query: Node
    alias: str | None = None
    columns: list[str] = field(default_factory=list)
    lateral: bool = False


@dataclass
class Join(Node):
    left: Node
    right: Node
    kind: str  # INNER, LEFT, RIGHT, FULL, CROSS, COMMA
    natural: bool = False
    on: Node | None = None
    using: list[str] = field(default_factory=list)


@dataclass
class Tail(Node):
    """ORDER BY, LIMIT and OFFSET of a query."""

    order: list[OrderItem] = field(default_factory=list)
    limit: Node | None = None
    offset: Node | None = None


@dataclass
class GroupingSets(Node):
    """ROLLUP, CUBE or GROUPING SETS; each set is a list of expressions."""

    kind: str
    sets: list[list[Node]]


@dataclass
class Select(Node):
    items: list[Node]
    source: Node | None = None
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    rollup: bool = False
    having: Node | None = None
    windows: list[tuple[str, Window]] = field(default_factory=list)
    distinct: bool = False
    options: list[str] = field(default_factory=list)
    tail: Tail = field(default_factory=Tail)
    locks: list[str] = field(default_factory=list)
    into: Into | None = None


@dataclass
class Into(Node):
    kind: str  # OUTFILE, DUMPFILE, VARIABLES
    path: str = ""
    variables: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)


@dataclass
class Values(Node):
    rows: list[list[Node]]
    tail: Tail = field(default_factory=Tail)


@dataclass
class Compound(Node):
    op: str
    all: bool
    left: Node
    right: Node
    tail: Tail = field(default_factory=Tail)


@dataclass
class Parenthesized(Node):
    query: Node


@dataclass
class Cte(Node):
    name: str
    columns: list[str]
    query: Node


@dataclass
class With(Node):
    recursive: bool
    ctes: list[Cte]
    body: Node


# Changes


@dataclass
class Assign(Node):
    target: Name
    value: Node


@dataclass
class Default(Node):
    pass


@dataclass
class Conflict(Node):
    columns: list[str] = field(default_factory=list)
    sets: list[Assign] = field(default_factory=list)  # none: do nothing
    where: Node | None = None
    duplicate_key: bool = False  # the MySQL form


@dataclass
class Insert(Node):
    table: Table
    columns: list[str]
    source: Node | None  # None: DEFAULT VALUES
    replace: bool = False
    ignore: bool = False
    assigned: bool = False  # INSERT ... SET
    conflict: Conflict | None = None
    returning: list[Node] = field(default_factory=list)


@dataclass
class Update(Node):
    tables: Node
    sets: list[Assign]
    source: Node | None = None
    where: Node | None = None
    tail: Tail = field(default_factory=Tail)
    returning: list[Node] = field(default_factory=list)


@dataclass
class Delete(Node):
    targets: list[str]  # of the multi-table forms
    source: Node
    using: Node | None = None
    where: Node | None = None
    tail: Tail = field(default_factory=Tail)
    returning: list[Node] = field(default_factory=list)


# Others


@dataclass
class SetItem(Node):
    scope: str
    target: Node
    value: Node


@dataclass
class SetStatement(Node):
    form: str  # VARIABLES, NAMES, CHARACTER SET, TRANSACTION, ROLE, SESSION AUTHORIZATION, CONSTRAINTS, TIME ZONE, SCHEMA
    items: list[SetItem] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    scope: str = ""


@dataclass
class Explain(Node):
    statement: Node
    options: list[str] = field(default_factory=list)


@dataclass
class Describe(Node):
    table: list[str]
    column: str | None = None


@dataclass
class CallStatement(Node):
    name: list[str]
    args: list[Node]


@dataclass
class Do(Node):
    exprs: list[Node]


@dataclass
class LoadData(Node):
    path: str
    table: list[str]
    local: bool = False
    mode: str = ""  # REPLACE, IGNORE
    fields: str = "\t"
    enclosed: str = ""
    escaped: str = "\\"
    lines: str = "\n"
    starting: str = ""
    skip: int = 0
    columns: list[str] = field(default_factory=list)
    sets: list[Assign] = field(default_factory=list)
    charset: str = ""


@dataclass
class Command(Node):
    """A statement of which only the kind and the object are told; ``words`` are its tokens."""

    kind: str
    words: list[str]
    target: list[str] = field(default_factory=list)
