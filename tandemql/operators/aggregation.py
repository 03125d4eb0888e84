"""Aggregates that are taken in two phases by hand: partials of each part of a table, and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates that can be merged, as name -> (function, column or None for rows).
Spec = dict[str, tuple[str, str | None]]

_PARTIAL = {
    "count": lambda c: {"": F.count(F.lit(1) if c is None else c)},
    "sum": lambda c: {"": sum_double(c)},
    "min": lambda c: {"": F.min(c)},
    "max": lambda c: {"": F.max(c)},
    "avg": lambda c: {"_sum": sum_double(c), "_count": F.count(c)},
}


def sum_double(c: str | Column) -> Column:
    """SUM as the engine has it: always a double, null without a value."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("double"))


def partial(part: DataFrame, keys: list[str], spec: Spec) -> DataFrame:
    """One part's partial aggregates; an average becomes a sum and a count."""
    return part.groupBy(*keys).agg(*[e.alias(f"{name}{end}") for name, (fn, c) in spec.items() for end, e in _PARTIAL[fn](c).items()])


def merge_partials(parts: list[DataFrame], keys: list[str], spec: Spec) -> DataFrame:
    """Partials put together: counts and sums are summed, extremes taken again, averages divided last."""
    both = reduce(DataFrame.unionByName, parts)
    final = []
    for name, (fn, _) in spec.items():
        if fn == "avg":
            merged = F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_count"))
        elif fn == "count":
            merged = F.coalesce(F.sum(name), F.lit(0))
        else:
            merged = {"sum": F.sum, "min": F.min, "max": F.max}[fn](name)
        final.append(merged.alias(name))
    return both.groupBy(*keys).agg(*final)
