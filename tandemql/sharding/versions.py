"""Sharded tables that statements change: per shard a list of Parquet folders, in versions like any table's.

A statement writes the shards it can touch to a new folder, in one job; a row whose key moves it elsewhere is added
to its new shard. Other shards keep their folders. What a version holds counts for other sessions once a
two-phase commit has published its folders.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tandemql.sharding.shard_map import SHARD_COLUMN, ShardedTable, ShardMap
from tandemql.tables import Version, VersionedTable, next_number
from tandemql.transactions.two_phase import ShardStore

Folders = dict[int, tuple[str, ...]]


class ShardedVersions(VersionedTable):
    def __init__(self, shard_map: ShardMap, store: ShardStore, schema: StructType, folders: Folders, key: list[str], defaults: dict[str, object]):
        self.map, self.store, self.schema = shard_map, store, schema
        super().__init__(shard_map.table, self._version(folders), key, defaults)
        self.published: Folders = dict(folders)

    @classmethod
    def of(cls, table: ShardedTable, store: ShardStore, key: list[str] | str = (), defaults: dict[str, object] | None = None) -> ShardedVersions:
        """The rows of a dealt table, written by shard."""
        schema = StructType([f for f in table.df.schema.fields if f.name != SHARD_COLUMN])
        out = cls(table.map, store, schema, {}, [key] if isinstance(key, str) else list(key), defaults or {})
        out.version = out._version(out._written(table.df, out.version.folders, set(range(len(table.map.shards)))))
        return out

    @classmethod
    def open(cls, shard_map: ShardMap, store: ShardStore, key: list[str] | str = (), defaults: dict[str, object] | None = None) -> ShardedVersions:
        """A table that a store holds."""
        folders = {s: tuple(store.current(f"{shard_map.table}.{s}") or ()) for s in range(len(shard_map.shards))}
        paths = [store.files.url(f) for fs in folders.values() for f in fs]
        if not paths:
            raise ValueError(f"the store holds no table {shard_map.table}")
        return cls(shard_map, store, store.spark.read.parquet(paths[0]).schema, folders, [key] if isinstance(key, str) else list(key), defaults or {})

    def read(self, folders: Folders, shards: set[int] | None = None) -> DataFrame:
        paths = [self.store.files.url(f) for s, fs in sorted(folders.items()) if shards is None or s in shards for f in fs]
        spark = self.store.spark
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def _version(self, folders: Folders) -> Version:
        return Version(self.read(folders), next_number(), 0, folders)

    def _written(self, df: DataFrame, folders: Folders, replaced: set[int]) -> Folders:
        """``folders`` with ``df`` written: in place of the replaced shards, and beside what others have."""
        folder = f"data/{self.name}-{uuid.uuid4().hex}"
        rows = df if SHARD_COLUMN in df.columns else self.map.with_shard(df)
        rows.write.partitionBy(SHARD_COLUMN).parquet(self.store.files.url(folder))
        made = {int(n.partition("=")[2]) for n in self.store.files.names(folder) if n.startswith(f"{SHARD_COLUMN}=")}
        new = {s: () if s in replaced else folders.get(s, ()) for s in range(len(self.map.shards))}
        return {s: (*fs, f"{folder}/{SHARD_COLUMN}={s}") if s in made else fs for s, fs in new.items()}

    def put(self, df: DataFrame, shards: set[int] | None = None) -> None:
        """A next version, in which ``df`` is all that the shards held (None: all shards) and hold."""
        replaced = set(range(len(self.map.shards))) if shards is None else shards
        self.version = self._version(self._written(self.shaped(df), self.version.folders, replaced))

    def append(self, new: DataFrame) -> None:
        self.version = self._version(self._written(self.shaped(new), self.version.folders, set()))

    def only(self, shards: set[int] | None) -> VersionedTable:
        return self if shards is None else _Part(self, shards)

    def as_sharded(self) -> ShardedTable:
        """For routing and pruning."""
        return ShardedTable(self.map, self.df)


class _Part(VersionedTable):
    """Some shards of a table, for a statement that can touch no others."""

    def __init__(self, whole: ShardedVersions, shards: set[int]):
        self.whole, self.shards = whole, shards
        super().__init__(whole.name, Version(whole.read(whole.version.folders, shards), next_number()), whole.key, whole.defaults)

    def put(self, df: DataFrame) -> None:
        self.whole.put(df, self.shards)
