"""Set operations, by position. ``bags=False`` gives the filter reading of the ALL forms: left rows (not) present on the right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    if len(left.columns) != len(right.columns):
        raise ValueError(f"sides of {len(left.columns)} and {len(right.columns)} columns")
    return right.toDF(*left.columns)


def union(left: DataFrame, right: DataFrame, all_rows: bool = False) -> DataFrame:
    both = left.union(_aligned(left, right))
    return both if all_rows else both.distinct()


def intersect(left: DataFrame, right: DataFrame, all_rows: bool = False, bags: bool = True) -> DataFrame:
    right = _aligned(left, right)
    if not all_rows:
        return left.intersect(right)
    return left.intersectAll(right) if bags else _filtered(left, right, "left_semi")


def except_(left: DataFrame, right: DataFrame, all_rows: bool = False, bags: bool = True) -> DataFrame:
    right = _aligned(left, right)
    if not all_rows:
        return left.subtract(right)
    return left.exceptAll(right) if bags else _filtered(left, right, "left_anti")


def _filtered(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    marked = right.distinct().toDF(*[f"_{c}" for c in right.columns])
    on = None
    for c in left.columns:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = one if on is None else on & one
    return left.join(marked, on, how)
