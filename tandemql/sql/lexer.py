"""Tokens of both dialects.

A dialect differs in its comments, quotes and escapes; one master pattern per dialect is built from these
and scanned from left to right. Nested comments and dollar quotes, which no pattern can tell, are read by hand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tandemql.sql.dialect import Dialect, SqlError


@dataclass(frozen=True)
class Token:
    kind: str  # word, ident, string, number, hex, bit, param, uservar, sysvar, op, end
    text: str  # as in the source
    value: str  # decoded
    start: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_OPERATORS = ["<=>", "->>", "<<", ">>", "<=", ">=", "<>", "!=", ":=", "||", "&&", "::", "->", *"+-*/%=<>(),.;:[]&|^~!#{}@"]
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def _master(dialect: Dialect) -> re.Pattern:
    mysql = dialect is Dialect.MYSQL
    body = r"(?:[^'\\]|\\.|'')*" if mysql else r"(?:[^']|'')*"
    parts = [
        ("space", r"\s+"),
        ("comment", r"--(?=\s|$)[^\n]*|\#[^\n]*" if mysql else r"--[^\n]*"),
        ("hex", r"[xX]'[0-9a-fA-F]*'" + (r"|0x[0-9a-fA-F]+" if mysql else "")),
        ("bit", r"[bB]'[01]*'" + (r"|0b[01]+" if mysql else "")),
        ("escaped", r"[eE]'(?:[^'\\]|\\.|'')*'"),
        ("string", rf"[nN]?'{body}'" + (r'|"(?:[^"\\]|\\.|"")*"' if mysql else "")),
        ("ident", r"`(?:[^`]|``)*`" if mysql else r'"(?:[^"]|"")*"'),
        ("number", r"(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?"),
        ("sysvar", r"@@(?:[A-Za-z_]+\.)?[A-Za-z_$][\w$]*"),
        ("uservar", r"@(?:'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|[\w$.]+)"),
        ("param", r"\?" if mysql else r"\$\d+"),
        ("word", r"[^\W\d][\w$]*"),
        ("op", "|".join(re.escape(o) for o in _OPERATORS)),
    ]
    if mysql:
        parts = [p for p in parts if p[0] != "escaped"]
    else:
        parts = [p for p in parts if p[0] not in ("sysvar", "uservar")]
    return re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in parts), re.DOTALL)


_MASTERS = {d: _master(d) for d in Dialect}


def unescape(raw: str, quote: str) -> str:
    """The characters that a quoted body with backslash escapes stands for."""
    return re.sub(rf"\\(.)|{quote}{quote}", lambda m: _ESCAPES.get(m[1], m[1]) if m[1] else quote, raw, flags=re.DOTALL)


def _decoded(kind: str, text: str, dialect: Dialect) -> str:
    if kind in ("ident",):
        return text[1:-1].replace(text[0] * 2, text[0])
    if kind in ("string", "escaped"):
        at = text.index("'") if "'" in text[:2] else 0
        quote, body = text[at], text[at + 1 : -1]
        if kind == "escaped" or dialect is Dialect.MYSQL:
            return unescape(body, quote)
        return body.replace(quote * 2, quote)
    if kind == "uservar":
        name = text[1:]
        return name[1:-1].replace(name[0] * 2, name[0]) if name[0] in "'\"`" else name
    if kind == "sysvar":
        return text[2:]
    return text


def _block_comment(sql: str, at: int, nested: bool) -> int:
    depth, i = 1, at + 2
    while i < len(sql):
        if sql.startswith("*/", i):
            depth, i = depth - 1, i + 2
            if not depth:
                return i
        elif nested and sql.startswith("/*", i):
            depth, i = depth + 1, i + 2
        else:
            i += 1
    raise SqlError(f"comment at {at} has no end")


def tokenize(sql: str, dialect: Dialect) -> list[Token]:
    master, out, at = _MASTERS[dialect], [], 0
    open_version = False  # inside /*! ... */, whose text counts
    while at < len(sql):
        if sql.startswith("/*", at):
            version = re.compile(r"/\*!\d*").match(sql, at) if dialect is Dialect.MYSQL else None
            if version:
                open_version, at = True, version.end()
            else:
                at = _block_comment(sql, at, dialect is Dialect.POSTGRES)
            continue
        if open_version and sql.startswith("*/", at):
            open_version, at = False, at + 2
            continue
        if dialect is Dialect.POSTGRES and (tag := re.compile(r"\$(?:[^\W\d]\w*)?\$").match(sql, at)):
            end = sql.find(tag[0], tag.end())
            if end < 0:
                raise SqlError(f"string at {at} has no end")
            out.append(Token("string", sql[at : end + len(tag[0])], sql[tag.end() : end], at))
            at = end + len(tag[0])
            continue
        m = master.match(sql, at)
        if not m:
            raise SqlError(f"can't read {sql[at : at + 20]!r} at {at}")
        kind, text = m.lastgroup, m[0]
        if kind not in ("space", "comment"):
            out.append(Token("string" if kind == "escaped" else kind, text, _decoded(kind, text, dialect), at))
        at = m.end()
    out.append(Token("end", "", "", len(sql)))
    return out
