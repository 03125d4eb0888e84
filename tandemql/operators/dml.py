"""INSERT, REPLACE, upserts, UPDATE and DELETE as DataFrames: from a table's version to its next.

A predicate that is null leaves a row as it is. A statement's items are applied from left to right, so a
later one sees what an earlier one has set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def aligned(df: DataFrame, rows: DataFrame, columns: list[str], defaults: dict[str, object]) -> DataFrame:
    """``rows``, whose columns are ``columns`` by position, as rows of ``df``; others get their default or null."""
    at = {c.lower(): i for i, c in enumerate(columns)}
    plain = rows.toDF(*[f"_v{i}" for i in range(len(rows.columns))])
    if len(rows.columns) != len(columns):
        raise ValueError(f"{len(columns)} columns but {len(rows.columns)} values")

    def value(f) -> Column:
        c = F.col(f"_v{at[f.name.lower()]}") if f.name.lower() in at else F.lit(defaults.get(f.name))
        return c.cast(f.dataType).alias(f.name)

    return plain.select(*[value(f) for f in df.schema.fields])


def _on(key: list[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for c in key:
        on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return on


def insert(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new)


def last_of_key(new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of the new rows of one key the last by the column ``order``, which is dropped."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", order)


def replace(df: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a key that ``new`` has are gone; ``new`` is there."""
    kept = df.alias("o").join(new.alias("n"), _on(key, "o", "n"), "left_anti")
    return kept.unionByName(new)


def upsert(df: DataFrame, new: DataFrame, key: list[str], sets: list[tuple[str, Column]], only_if: Column | None = None) -> DataFrame:
    """New keys are inserted; rows of known keys get ``sets``, whose expressions may name ``o.c`` and ``n.c``."""
    marked = new.withColumn("_new", F.lit(True)).alias("n")
    joined = df.alias("o").join(marked, _on(key, "o", "n"), "left")
    hit = F.col("n._new").isNotNull() & (F.lit(True) if only_if is None else F.coalesce(only_if, F.lit(False)))
    given = {c.lower(): e for c, e in sets}
    old = joined.select(*[F.when(hit, given[f.name.lower()].cast(f.dataType)).otherwise(F.col(f"o.{f.name}")).alias(f.name) if f.name.lower() in given else F.col(f"o.{f.name}") for f in df.schema.fields])
    fresh = new.alias("n").join(df.alias("o"), _on(key, "n", "o"), "left_anti")
    return old.unionByName(fresh)


def update(df: DataFrame, hit: Column, sets: list[tuple[str, Column]], mark: str | None = None) -> DataFrame:
    """One pass of ``when`` per item; ``hit`` is settled before the first, and kept as a column ``mark``."""
    names, marked = df.columns, df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    types = {f.name: f.dataType for f in df.schema.fields}
    for c, e in sets:
        marked = marked.withColumn(c, F.when(F.col("_hit"), e.cast(types[c])).otherwise(F.col(f"`{c}`")))
    return marked.select(*names, *([F.col("_hit").alias(mark)] if mark else []))


def delete(df: DataFrame, hit: Column) -> DataFrame:
    return df.where(~F.coalesce(hit, F.lit(False)))
