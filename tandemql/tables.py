"""Tables that statements change: immutable versions of a DataFrame, each under a view of its own."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemql.sql.dialect import SqlError
from tandemql.storage import materialise
from tandemql.types import kind_of

#: After so many versions on top of each other the table is written and read again.
CUT_AFTER = 8
_numbers = itertools.count()


def next_number() -> int:
    return next(_numbers)


@dataclass(frozen=True)
class Version:
    df: DataFrame
    number: int
    depth: int = 0  # versions since the last written one
    folders: dict[int, tuple[str, ...]] = field(default_factory=dict)  # of a sharded table, by shard


@dataclass
class VersionedTable:
    name: str
    version: Version
    key: list[str] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)
    _views: dict[int, str] = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, df: DataFrame, key: list[str] | str = (), defaults: dict[str, object] | None = None) -> VersionedTable:
        return cls(name, Version(df, next(_numbers)), [key] if isinstance(key, str) else list(key), defaults or {})

    @property
    def df(self) -> DataFrame:
        return self.version.df

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [(f.name, kind_of(f.dataType)) for f in self.df.schema.fields]

    def shaped(self, df: DataFrame) -> DataFrame:
        """``df`` with the table's columns and types."""
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.df.schema.fields])

    def put(self, df: DataFrame) -> None:
        """A next version; its lineage is cut by writing it when there are many."""
        df = self.shaped(df)
        depth = self.version.depth + 1
        if depth >= CUT_AFTER:
            df, depth = materialise(df, f"table-{self.name}"), 0
        self.version = Version(df, next(_numbers), depth)

    def append(self, new: DataFrame) -> None:
        """A next version with more rows."""
        self.put(self.df.unionByName(new))

    def only(self, shards: set[int] | None) -> VersionedTable:
        """The table as a statement changes it that can touch these shards alone."""
        return self

    def view(self) -> str:
        number = self.version.number
        if number not in self._views:
            self._views[number] = f"_tandemql_{self.name}_{next(_numbers)}"
            self.df.createOrReplaceTempView(self._views[number])
        return self._views[number]

    def with_row_ids(self) -> DataFrame:
        """The rows with ``_rid``, a number that stays: it is written, as Spark may deal rows anew each time."""
        return materialise(self.df.withColumn("_rid", F.monotonically_increasing_id()), f"rows-{self.name}")

    def column(self, name: str) -> str:
        found = next((f.name for f in self.df.schema.fields if f.name.lower() == name.lower()), None)
        if found is None:
            raise SqlError(f"table {self.name} has no column {name}")
        return found
