"""Digests: a statement's text without its values, and a 64-bit hash of that.

Values become ``?``, lists of values in IN one ``?``, rows of VALUES one row, keywords upper case; aliases
are left out. A statement that the parser doesn't read whole is normalised by its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from tandemql.sql import nodes as N
from tandemql.sql.classify import FIRST_WORDS
from tandemql.sql.dialect import Dialect, SqlError
from tandemql.sql.lexer import Token, tokenize
from tandemql.sql.parser import _RESERVED, parse
from tandemql.sql.printer import Printer

# Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

_KEYWORDS = _RESERVED | {w for w in FIRST_WORDS if w.isalpha()} | set("TABLE INTO IF EXISTS INDEX VIEW DATABASE DEFAULT NULL TRUE FALSE PRIMARY KEY TO UNIQUE TRANSACTION ISOLATION LEVEL ADD COLUMN".split())


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass(frozen=True)
class Digest:
    text: str
    hash: int


class _Normaliser(Printer):
    def on_literal(self, n: N.Literal) -> str:
        return n.raw.upper() if n.kind in ("null", "bool") else "?"

    def on_variable(self, n: N.Variable) -> str:
        return "@?" if not n.system and n.raw[1:2] in "'\"`" else n.raw

    def on_inlist(self, n: N.InList) -> str:
        if n.items and all(isinstance(i, (N.Literal, N.Param)) for i in n.items):
            return f"{self.print(n.arg)} {'NOT ' * n.negated}IN (?)"
        return super().on_inlist(n)

    def rows(self, rows: list[list[N.Node]]) -> str:
        return super().rows(rows[:1])

    def aliased(self, alias: str | None) -> str:
        return ""


def digest(sql: str, dialect: Dialect | str = Dialect.MYSQL) -> Digest:
    dialect = Dialect.of(dialect)
    try:
        node = parse(sql, dialect)
    except SqlError:
        node = None
    text = token_text(sql, dialect) if node is None or isinstance(node, N.Command) else _Normaliser(dialect).print(node)
    return Digest(text, fnv1a(text.encode()))


def token_text(sql: str, dialect: Dialect | str = Dialect.MYSQL) -> str:
    """Normalised by tokens alone."""
    tokens = [t for t in tokenize(sql, Dialect.of(dialect)) if t.kind != "end" and t.text != ";"]
    words = [_token(t) for t in tokens]
    words = _collapsed(words)
    out = ""
    for i, word in enumerate(words):
        before = words[i - 1] if i else ""
        call = word == "(" and i and tokens and before not in ("IN", "VALUES", ")") and before.upper() not in _KEYWORDS and before.isidentifier() and before.isupper()
        tight = not out or word in (",", ".", ")") or before in (".", "(", "@") or word.startswith("@") and before == "?" or call
        out += word if tight else f" {word}"
    return out


def _token(t: Token) -> str:
    if t.kind in ("string", "number", "hex", "bit"):
        return "?"
    if t.kind == "uservar":
        return "@?" if t.text[1] in "'\"`" else t.text
    return t.upper if t.upper in _KEYWORDS else t.text


def _collapsed(words: list[str]) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(words):
        if words[i : i + 2] == ["IN", "("]:
            end = i + 2
            while end < len(words) and words[end] in ("?", ","):
                end += 1
            if end > i + 2 and words[end : end + 1] == [")"]:
                out += ["IN", "(", "?", ")"]
                i = end + 1
                continue
        out.append(words[i])
        if words[i] == "VALUES":
            depth, j, ends = 0, i + 1, []
            while j < len(words):
                depth += (words[j] == "(") - (words[j] == ")")
                if not depth:
                    ends.append(j)
                    if words[j + 1 : j + 2] != [","] or words[j + 2 : j + 3] != ["("]:
                        break
                    j += 1
                j += 1
            if ends:
                out += words[i + 1 : ends[0] + 1]
                i = ends[-1] + 1
                continue
        i += 1
    return out
