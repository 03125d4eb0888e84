"""How a category module registers its queries: a callable beside the DuckDB SQL for the same rows."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


NAMES = "region nation customer supplier part orders lineitem events".split()


class Tables:
    """The tables of a data folder as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL with tables as ``{orders}``."""
        names = {name for _, name, _, _ in string.Formatter().parse(text) if name}
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def through_session(t: Tables, dialect: str, sql: str, params: tuple = ()) -> DataFrame:
    """A query by the engine's own parser and lowering, over the tables that it names."""
    from tandemql.session import Session

    session = Session(t.spark, dialect)
    for table in NAMES:
        if re.search(rf"\b{table}\b", sql, re.IGNORECASE):
            session.register(table, getattr(t, table))
    return session.execute_query(sql, params)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None):
        """Register a function of Tables under its own name. ``oracle`` is None where SQL can't tell the rows."""

        def register(build: Callable[[Tables], DataFrame]):
            name = build.__name__.rstrip("_")
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if oracle is not None:
                self.oracles[name] = oracle
            return build

        return register
