"""One table of functions: name, arity, Spark SQL and kind of the result.

A template names its arguments ``{0}``, ``{1}``, ...; ``{*}`` is all of them. The kind is a fixed one, or
``=n`` for that of argument n, or ``num`` for integer in, integer out, and double else. The kinds are those of
``tandemql.types``. Users may register functions of their own, which Spark must know under that name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from tandemql.sql.dialect import Dialect, SqlError

MANY = 64


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int
    template: str | Callable[[list[str], list[str]], str]
    kind: str
    dialects: tuple[Dialect, ...] = tuple(Dialect)

    def sql(self, args: list[str], kinds: list[str]) -> str:
        if not self.least <= len(args) <= self.most:
            raise SqlError(f"{self.name} takes {self.least} to {self.most} arguments, not {len(args)}")
        if callable(self.template):
            return self.template(args, kinds)
        return re.sub(r"\{(\*|\d+)\}", lambda m: ", ".join(args) if m[1] == "*" else args[int(m[1])], self.template)

    def result(self, kinds: list[str]) -> str:
        if self.kind.startswith("="):
            at = int(self.kind[1:])
            return next((k for k in kinds[at:] if k != "null"), "null")
        if self.kind == "num":
            return "int" if kinds and kinds[0] in ("int", "bool") else "double"
        return self.kind


def _whole_or_double(spark: str) -> Callable[[list[str], list[str]], str]:
    """Integers stay as they are; others become double."""
    return lambda a, k: a[0] if k[0] == "int" else f"CAST({spark}(CAST({a[0]} AS DOUBLE)) AS DOUBLE)"


def _round(a: list[str], k: list[str]) -> str:
    return f"round(CAST({a[0]} AS DOUBLE), {a[1] if len(a) > 1 else 0})"


def _substring(a: list[str], k: list[str]) -> str:
    """1-based; 0 counts as 1, a start before the text is its start, a negative length gives ''."""
    n = f"char_length({a[0]})"
    start = f"CASE WHEN {a[1]} > 0 THEN {a[1]} WHEN {a[1]} = 0 THEN 1 ELSE greatest(1, {n} + {a[1]} + 1) END"
    return f"substring({a[0]}, {start}{f', greatest(0, {a[2]})' if len(a) > 2 else ''})"


def _pad(spark: str) -> Callable[[list[str], list[str]], str]:
    def text(a: list[str], k: list[str]) -> str:
        pad = a[2] if len(a) > 2 else "' '"
        return f"CASE WHEN {pad} = '' AND {a[1]} > char_length({a[0]}) THEN '' ELSE {spark}({a[0]}, CAST(greatest({a[1]}, 0) AS INT), {pad}) END"

    return text


def _concat(a: list[str], k: list[str]) -> str:
    return f"concat({', '.join(x if kind == 'str' else f'CAST({x} AS STRING)' for x, kind in zip(a, k, strict=True))})"


def _part(spark: str) -> Callable[[list[str], list[str]], str]:
    def text(a: list[str], k: list[str]) -> str:
        x = f"try_cast({a[0]} AS TIMESTAMP_NTZ)" if k[0] in ("str", "?") else a[0]
        return f"CAST({spark}({x}) AS BIGINT)"

    return text


def _day(x: str, kind: str) -> str:
    return f"try_cast({x} AS DATE)" if kind in ("str", "?") else x


def _unix(a: list[str], k: list[str]) -> str:
    return f"unix_timestamp(CAST({a[0]} AS TIMESTAMP))" if a else "unix_timestamp()"


def _date_add(sign: str) -> Callable[[list[str], list[str]], str]:
    return lambda a, k: f"({_day(a[0], k[0])} {sign} {a[1] if k[1] == 'interval' else f'INTERVAL 1 DAY * {a[1]}'})"


MYSQL, PG = (Dialect.MYSQL,), (Dialect.POSTGRES,)

_TABLE = [
    # arithmetic
    ("ABS", 1, 1, "abs({0})", "=0"),
    ("CEIL", 1, 1, _whole_or_double("ceil"), "num"),
    ("CEILING", 1, 1, _whole_or_double("ceil"), "num"),
    ("FLOOR", 1, 1, _whole_or_double("floor"), "num"),
    ("ROUND", 1, 2, _round, "double"),
    ("TRUNCATE", 2, 2, "(sign({0}) * floor(abs(CAST({0} AS DOUBLE)) * power(10, {1})) / power(10, {1}))", "double"),
    ("TRUNC", 1, 2, lambda a, k: f"(sign({a[0]}) * floor(abs(CAST({a[0]} AS DOUBLE)) * power(10, {a[1] if len(a) > 1 else 0})) / power(10, {a[1] if len(a) > 1 else 0}))", "double"),
    ("MOD", 2, 2, "try_mod({0}, {1})", "=0"),
    ("POWER", 2, 2, "power({0}, {1})", "double"),
    ("POW", 2, 2, "power({0}, {1})", "double"),
    ("SQRT", 1, 1, "CASE WHEN {0} >= 0 THEN sqrt({0}) END", "double"),
    ("SIGN", 1, 1, "CAST(sign({0}) AS BIGINT)", "int"),
    ("EXP", 1, 1, "exp({0})", "double"),
    ("LN", 1, 1, "ln({0})", "double"),
    ("LOG", 1, 2, "log({*})", "double"),
    ("RAND", 0, 1, "rand({*})", "double"),
    ("RANDOM", 0, 0, "rand()", "double"),
    # comparison
    ("COALESCE", 1, MANY, "coalesce({*})", "=0"),
    ("NULLIF", 2, 2, "nullif({0}, {1})", "=0"),
    ("LEAST", 2, MANY, "least({*})", "=0"),
    ("GREATEST", 2, MANY, "greatest({*})", "=0"),
    ("IFNULL", 2, 2, "coalesce({0}, {1})", "=0", MYSQL),
    # dates and times
    ("NOW", 0, 1, "CAST(current_timestamp() AS TIMESTAMP_NTZ)", "timestamp"),
    ("CURRENT_TIMESTAMP", 0, 1, "CAST(current_timestamp() AS TIMESTAMP_NTZ)", "timestamp"),
    ("LOCALTIMESTAMP", 0, 1, "CAST(current_timestamp() AS TIMESTAMP_NTZ)", "timestamp"),
    ("CURRENT_DATE", 0, 0, "current_date()", "date"),
    ("CURDATE", 0, 0, "current_date()", "date"),
    ("CURRENT_TIME", 0, 0, "current_time()", "time"),
    ("CURTIME", 0, 0, "current_time()", "time"),
    ("YEAR", 1, 1, _part("year"), "int"),
    ("QUARTER", 1, 1, _part("quarter"), "int"),
    ("MONTH", 1, 1, _part("month"), "int"),
    ("DAY", 1, 1, _part("day"), "int"),
    ("DAYOFMONTH", 1, 1, _part("day"), "int"),
    ("HOUR", 1, 1, _part("hour"), "int"),
    ("MINUTE", 1, 1, _part("minute"), "int"),
    ("SECOND", 1, 1, _part("second"), "int"),
    ("DATE", 1, 1, "try_cast({0} AS DATE)", "date"),
    ("UNIX_TIMESTAMP", 0, 1, _unix, "int"),
    ("FROM_UNIXTIME", 1, 1, "CAST(timestamp_seconds({0}) AS TIMESTAMP_NTZ)", "timestamp"),
    ("DATEDIFF", 2, 2, lambda a, k: f"CAST(datediff({_day(a[0], k[0])}, {_day(a[1], k[1])}) AS BIGINT)", "int"),
    ("DATE_ADD", 2, 2, _date_add("+"), "=0"),
    ("DATE_SUB", 2, 2, _date_add("-"), "=0"),
    ("DATE_TRUNC", 2, 2, "CAST(date_trunc({0}, {1}) AS TIMESTAMP_NTZ)", "timestamp"),
    # strings
    ("CONCAT", 1, MANY, _concat, "str"),
    ("CONCAT_WS", 1, MANY, lambda a, k: f"concat_ws({', '.join([a[0]] + [f'CAST({x} AS STRING)' for x in a[1:]])})", "str"),
    ("LENGTH", 1, 1, "CAST(octet_length(CAST({0} AS STRING)) AS BIGINT)", "int"),
    ("OCTET_LENGTH", 1, 1, "CAST(octet_length(CAST({0} AS STRING)) AS BIGINT)", "int"),
    ("CHAR_LENGTH", 1, 1, "CAST(char_length(CAST({0} AS STRING)) AS BIGINT)", "int"),
    ("CHARACTER_LENGTH", 1, 1, "CAST(char_length(CAST({0} AS STRING)) AS BIGINT)", "int"),
    ("UPPER", 1, 1, "upper({0})", "str"),
    ("UCASE", 1, 1, "upper({0})", "str"),
    ("LOWER", 1, 1, "lower({0})", "str"),
    ("LCASE", 1, 1, "lower({0})", "str"),
    ("SUBSTRING", 2, 3, _substring, "str"),
    ("SUBSTR", 2, 3, _substring, "str"),
    ("TRIM", 1, 2, lambda a, k: f"trim({a[0]})" if len(a) == 1 else f"trim(BOTH {a[1]} FROM {a[0]})", "str"),
    ("LTRIM", 1, 2, lambda a, k: f"ltrim({a[0]})" if len(a) == 1 else f"trim(LEADING {a[1]} FROM {a[0]})", "str"),
    ("RTRIM", 1, 2, lambda a, k: f"rtrim({a[0]})" if len(a) == 1 else f"trim(TRAILING {a[1]} FROM {a[0]})", "str"),
    ("REPLACE", 3, 3, "replace({0}, {1}, {2})", "str"),
    ("REVERSE", 1, 1, "reverse({0})", "str"),
    ("LEFT", 2, 2, "left({0}, greatest({1}, 0))", "str"),
    ("RIGHT", 2, 2, "right({0}, greatest({1}, 0))", "str"),
    ("LPAD", 2, 3, _pad("lpad"), "str"),
    ("RPAD", 2, 3, _pad("rpad"), "str"),
    ("REPEAT", 2, 2, "repeat({0}, CAST(greatest({1}, 0) AS INT))", "str"),
    ("SPACE", 1, 1, "space(CAST(greatest({0}, 0) AS INT))", "str"),
    ("POSITION", 2, 2, "CAST(position({0} IN {1}) AS BIGINT)", "int"),
    ("SOUNDEX", 1, 1, "soundex({0})", "str"),
    # arrays
    ("ARRAY_LENGTH", 1, 2, "CAST(size({0}) AS BIGINT)", "int"),
    ("CARDINALITY", 1, 1, "CAST(size({0}) AS BIGINT)", "int"),
    # aggregates
    ("COUNT", 0, MANY, "count({*})", "int"),
    ("SUM", 1, 1, "sum(CAST({0} AS DOUBLE))", "double"),
    ("AVG", 1, 1, "avg(CAST({0} AS DOUBLE))", "double"),
    ("MIN", 1, 1, "min({0})", "=0"),
    ("MAX", 1, 1, "max({0})", "=0"),
    ("STDDEV", 1, 1, "stddev_samp({0})", "double"),
    ("VARIANCE", 1, 1, "var_samp({0})", "double"),
    ("STDDEV_SAMP", 1, 1, "stddev_samp({0})", "double"),
    ("STDDEV_POP", 1, 1, "stddev_pop({0})", "double"),
    ("VAR_SAMP", 1, 1, "var_samp({0})", "double"),
    ("VAR_POP", 1, 1, "var_pop({0})", "double"),
    ("GROUP_CONCAT", 1, 2, lambda a, k: f"listagg(CAST({a[0]} AS STRING), {a[1] if len(a) > 1 else repr(',')})", "str", MYSQL),
    ("STRING_AGG", 2, 2, "listagg(CAST({0} AS STRING), {1})", "str", PG),
    ("ARRAY_AGG", 1, 1, "collect_list({0})", "array", PG),
    # window functions
    ("ROW_NUMBER", 0, 0, "CAST(row_number() {over} AS BIGINT)", "int"),
    ("RANK", 0, 0, "CAST(rank() {over} AS BIGINT)", "int"),
    ("DENSE_RANK", 0, 0, "CAST(dense_rank() {over} AS BIGINT)", "int"),
    ("NTILE", 1, 1, "ntile({0})", "int"),
    ("PERCENT_RANK", 0, 0, "percent_rank()", "double"),
    ("CUME_DIST", 0, 0, "cume_dist()", "double"),
    ("LAG", 1, 3, "lag({*})", "=0"),
    ("LEAD", 1, 3, "lead({*})", "=0"),
    ("FIRST_VALUE", 1, 1, "first_value({0})", "=0"),
    ("LAST_VALUE", 1, 1, "last_value({0})", "=0"),
    ("NTH_VALUE", 2, 2, "nth_value({0}, {1})", "=0"),
]

AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "STDDEV", "VARIANCE", "GROUP_CONCAT", "STRING_AGG", "ARRAY_AGG"}


class FunctionRegistry:
    """Names to functions of a dialect, ignoring case."""

    def __init__(self, dialect: Dialect | str):
        self.dialect = Dialect.of(dialect)
        self.changes = 0
        self._own: set[str] = set()
        self._known = {f.name: f for f in (Function(*row) for row in _TABLE) if self.dialect in f.dialects}

    def register(self, name: str, least: int, most: int, template: str | None = None, kind: str = "?") -> None:
        """A function of the user's own; without a template, Spark's function of that name."""
        self.changes += 1
        self._own.add(name.upper())
        self._known[name.upper()] = Function(name.upper(), least, most, template or f"{name}({{*}})", kind)

    def is_own(self, name: str) -> bool:
        """Whether a user registered it."""
        return name.upper() in self._own

    def find(self, name: str) -> Function | None:
        return self._known.get(name.upper())

    def names(self) -> list[str]:
        return sorted(self._known)
