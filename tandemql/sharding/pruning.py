"""Which shards a statement can need: from ``key = literal`` and ``key IN (literals)`` in its conditions.

A literal counts as the key's values that it equals by the dialect's comparison. Where those can't be told
exactly (a number beside a text key, a text that is no number below 2**53 beside an integer key, an integer beyond
64 bits, a key that is neither), nothing is pruned.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql.types import DataType, IntegralType, StringType

from tandemql.sharding.shard_map import ShardedTable
from tandemql.sql import nodes as N
from tandemql.sql.dialect import Dialect


def _conjuncts(node: N.Node | None) -> list[N.Node]:
    if node is None:
        return []
    if isinstance(node, N.Binary) and node.op == "AND":
        return _conjuncts(node.left) + _conjuncts(node.right)
    if isinstance(node, N.Row) and len(node.items) == 1 and not node.keyword:
        return _conjuncts(node.items[0])
    return [node]


def _is_key(node: N.Node, alias: str, key: str, alone: bool) -> bool:
    if not isinstance(node, N.Name) or node.parts[-1].lower() != key.lower():
        return False
    return node.parts[-2].lower() == alias.lower() if len(node.parts) > 1 else alone


def _values(node: N.Node, alias: str, key: str, alone: bool) -> list | None:
    """The literals that a condition restricts the key to, or None."""
    plain = lambda n: isinstance(n, N.Literal) and n.kind in ("int", "string")
    if isinstance(node, N.Binary) and node.op == "=":
        for a, b in ((node.left, node.right), (node.right, node.left)):
            if _is_key(a, alias, key, alone) and plain(b):
                return [b.value]
    if isinstance(node, N.InList) and node.items and not node.negated and _is_key(node.arg, alias, key, alone) and all(map(plain, node.items)):
        return [i.value for i in node.items]
    return None


_NUMBER = r"\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,3})?)"


def key_values(value: int | str, key: DataType | None, dialect: Dialect) -> list[int | str] | None:
    """The values of a key that equal a literal, or None where that isn't known."""
    if key is None:  # a table without a schema yet: a literal is of the key's type
        return [value]
    if isinstance(key, StringType):
        return [value] if isinstance(value, str) else None
    if not isinstance(key, IntegralType):
        return None
    if isinstance(value, int):
        return [value] if -(1 << 63) <= value < 1 << 63 else None
    mysql = dialect is Dialect.MYSQL
    found = (re.match if mysql else re.fullmatch)(_NUMBER + ("" if mysql else r"\s*"), value)
    if mysql and value == "":
        return [0]
    if not found:
        return None
    number = Fraction(found[1])
    if abs(number) >= 1 << 53:
        return None  # compared as doubles, several keys may equal it
    return [int(number)] if number.denominator == 1 else []


def shards_for(query: N.Node, tables: dict[str, ShardedTable], dialect: Dialect | str = Dialect.MYSQL) -> dict[str, set[int]]:
    """By table the shards that are needed; a table that is read twice, or without such a condition, isn't there."""
    reads = [n.parts[-1].lower() for n in query.walk() if isinstance(n, N.Table)]
    out: dict[str, set[int]] = {}
    for node in query.walk():
        if isinstance(node, N.Select) and node.source is not None:
            direct = _tables(node.source)
        elif isinstance(node, N.Update):
            direct = _tables(node.tables) + (_tables(node.source) if node.source is not None else [])
        elif isinstance(node, N.Delete):
            direct = _tables(node.source) + (_tables(node.using) if node.using is not None else [])
        else:
            continue
        for table in direct:
            name = table.parts[-1].lower()
            if name not in tables or reads.count(name) > 1:
                continue
            sharded = tables[name]
            found: set[int] | None = None
            for condition in _conjuncts(node.where):
                literals = _values(condition, table.alias or table.parts[-1], sharded.map.key, len(direct) == 1)
                values = literals and [key_values(v, sharded.key_type, Dialect.of(dialect)) for v in literals]
                if values and None not in values:
                    shards = {sharded.map.route(v) for vs in values for v in vs}
                    found = shards if found is None else found & shards
            if found is not None:
                out[name] = found
    return out


def _tables(source: N.Node) -> list[N.Table]:
    if isinstance(source, N.Table):
        return [source]
    return _tables(source.left) + _tables(source.right) if isinstance(source, N.Join) else []
