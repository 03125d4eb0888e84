"""The relational queries once more, as SQL through the engine's own parser and lowering.

A query of another module whose DuckDB SQL is also SQL of the engine is registered as ``<name>_sql``, in the PostgreSQL
dialect; tests run them in MySQL's as well. Left out is what only DuckDB says that way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tandemql.plans import aggregates, joins, scans, sorting, windows
from tandemql.plans.registry import Registry, Tables, through_session

registry = Registry()

#: GROUP BY ALL, ASOF, xor(), regexp_matches() and a window's name with a frame beside it are DuckDB's own.
OTHER_SQL = {"agg_sum_avg", "agg_group_multi", "agg_group_expr", "join_asof", "filter_bitops", "filter_regexp", "win_distribution"}
#: These have another meaning in MySQL, whose LIKE ignores case and where || is OR.
NOT_MYSQL = {"filter_like_cs"}


def _speak(name: str, text: str) -> None:
    def build(t: Tables) -> DataFrame:
        return through_session(t, "postgres", text)

    build.__name__ = f"{name}_sql"
    registry.query(text)(build)


for _module in (scans, joins, aggregates, windows, sorting):
    for _name, _text in _module.registry.oracles.items():
        if _name not in OTHER_SQL:
            _speak(_name, _text)
