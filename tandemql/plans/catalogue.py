"""All registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from tandemql.plans import aggregates, changes, dialects, extras, flagship, functions, joins, scans, shards, sorting, spoken, subqueries, windows

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (flagship, scans, joins, aggregates, windows, sorting, subqueries, functions, dialects, spoken, shards, changes, extras):
    for _name in _module.registry.queries:
        if _name in QUERIES:
            raise ValueError(f"{_name} is registered twice")
    QUERIES.update(_module.registry.queries)
    ORACLES.update(_module.registry.oracles)
