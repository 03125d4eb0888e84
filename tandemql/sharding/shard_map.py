"""Where rows of a sharded table live.

One function routes, for values on the driver (to prune) and for columns (to write), so that what is written
is found again. The hash is the 64-bit FNV-1a of an integer's 8 little-endian bytes or of a text's bytes,
taken modulo the number of shards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from tandemql.sql.digest import FNV_OFFSET, FNV_PRIME, fnv1a

SHARD_COLUMN = "_shard"
_LOW = 0xFFFFFFFF


def _hash_integers(df: DataFrame, value: Column) -> DataFrame:
    """``df`` with ``_high`` and ``_low``, the halves of the hash of ``value``'s 8 bytes.

    A step is a projection of its own, which binds both halves once; the halves are longs below 2**32, so that
    nothing overflows where the session raises on that.
    """
    out = df.withColumns({"_key": value.cast("long"), "_high": F.lit(FNV_OFFSET >> 32), "_low": F.lit(FNV_OFFSET & _LOW)})
    small, shift = FNV_PRIME & 0xFFFF, 40 - 32  # the prime is 2**40 + small
    for i in range(8):
        byte = F.shiftrightunsigned("_key", 8 * i).bitwiseAND(F.lit(255))
        out = out.withColumn("_low", F.col("_low").bitwiseXOR(byte))
        out = out.withColumns(
            {
                "_high": (F.col("_high") * small + F.shiftrightunsigned(F.col("_low") * small, 32) + F.shiftleft("_low", shift)).bitwiseAND(F.lit(_LOW)),
                "_low": (F.col("_low") * small).bitwiseAND(F.lit(_LOW)),
            }
        )
    return out.drop("_key")


def _hash_texts(texts: pd.Series) -> pd.Series:
    """The hash of each text's UTF-8 bytes as a signed long, byte by byte over all texts of a batch at once."""
    raw = [b"" if t is None else t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    order = np.argsort(-sizes, kind="stable")  # the texts that still have a byte are the first ones
    flat, starts = np.frombuffer(b"".join(raw), dtype=np.uint8), (np.cumsum(sizes) - sizes)[order]
    hashes, ordered = np.full(len(raw), FNV_OFFSET, dtype=np.uint64), sizes[order]
    n = len(raw)
    for i in range(int(ordered[0]) if n else 0):
        n = int(np.searchsorted(-ordered[:n], -i, side="left"))  # those longer than i
        hashes[:n] = (hashes[:n] ^ flat[starts[:n] + i]) * np.uint64(FNV_PRIME)
    out = np.empty(len(raw), dtype=np.int64)
    out[order] = hashes.view(np.int64)
    return pd.Series(out)


@dataclass
class ShardMap:
    table: str
    key: str
    shards: list[str]
    strategy: str = "hash"  # hash, range, list
    ranges: list[tuple[int, int]] = field(default_factory=list)  # (greatest value, shard)
    values: dict[int | str, int] = field(default_factory=dict)

    def route(self, value: int | str | None) -> int:
        """The shard's number. A null key is in the first."""
        if value is None:
            return 0
        if self.strategy == "hash":
            data = value.to_bytes(8, "little", signed=True) if isinstance(value, int) else str(value).encode()
            return fnv1a(data) % len(self.shards)
        if self.strategy == "range":
            return next((s for upper, s in self.ranges if int(value) <= upper), self.ranges[-1][1])
        return self.values.get(value, 0) if isinstance(value, int) else {str(k): s for k, s in self.values.items()}.get(value, 0)

    def with_shard(self, df: DataFrame) -> DataFrame:
        """``df`` with the shard of each row. Integers are hashed by built-in functions, texts in Arrow batches."""
        c, kind = F.col(f"`{self.key}`"), df.schema[self.key].dataType
        integral = isinstance(kind, IntegralType)
        n = len(self.shards)
        if self.strategy == "hash":
            if integral:
                shard = (F.col("_high") % n * ((1 << 32) % n) + F.col("_low")) % n
                return _hash_integers(df, c).withColumn(SHARD_COLUMN, self._or_first(c, shard)).drop("_high", "_low")
            h = F.pandas_udf(_hash_texts, "long")(c.cast("string"))
            hashed = df.withColumn("_hash", h)
            shard = (F.shiftrightunsigned("_hash", 32) % n * ((1 << 32) % n) + F.col("_hash").bitwiseAND(F.lit(_LOW))) % n
            return hashed.withColumn(SHARD_COLUMN, self._or_first(c, shard)).drop("_hash")
        if self.strategy == "range":
            shard = F.lit(self.ranges[-1][1])
            for upper, s in reversed(self.ranges):
                shard = F.when(c <= upper, F.lit(s)).otherwise(shard)
        else:
            shard = F.lit(0)
            for value, s in self.values.items():
                if isinstance(value, int) or not integral:
                    shard = F.when(c == F.lit(value if integral else str(value)), F.lit(s)).otherwise(shard)
        return df.withColumn(SHARD_COLUMN, self._or_first(c, shard))

    @staticmethod
    def _or_first(key: Column, shard: Column) -> Column:
        return F.coalesce(F.when(key.isNotNull(), shard), F.lit(0)).cast("int")


def parse_shard_spec(spec: str) -> ShardMap:
    """``table:key:[hash|range|list:]body``; the body is shards, or value=shard entries."""
    parts = spec.split(":", 2)
    if len(parts) < 3:
        raise ValueError(f"table:key:shards expected, not {spec!r}")
    table, key, rest = parts
    strategy, _, body = rest.partition(":")
    if strategy not in ("hash", "range", "list") or not _:
        strategy, body = "hash", rest
    entries = [e.strip() for e in body.split(",") if e.strip()]
    if not entries:
        raise ValueError(f"no shards in {spec!r}")
    if strategy == "hash":
        return ShardMap(table, key, entries)
    shards: list[str] = []
    ranges: list[tuple[int, int]] = []
    values: dict[int | str, int] = {}
    for entry in entries:
        value, equals, shard = entry.partition("=")
        if not (equals and value and shard):
            raise ValueError(f"value=shard expected, not {entry!r}")
        if shard not in shards:
            shards.append(shard)
        at = shards.index(shard)
        whole = value.lstrip("+-").isdigit()
        if strategy == "range":
            if not whole:
                raise ValueError(f"a range ends at an integer, not {value!r}")
            ranges.append((int(value), at))
        else:
            values[int(value) if whole else value] = at
    if len({upper for upper, _ in ranges}) < len(ranges):
        raise ValueError(f"two ranges end at one value in {spec!r}")
    return ShardMap(table, key, shards, strategy, sorted(ranges), values)


@dataclass
class ShardedTable:
    """A table dealt to shards: files partitioned by shard, or a DataFrame that has the shard as a column."""

    map: ShardMap
    df: DataFrame
    stored: bool = False

    @property
    def name(self) -> str:
        return self.map.table

    @classmethod
    def deal(cls, df: DataFrame, shard_map: ShardMap) -> ShardedTable:
        return cls(shard_map, shard_map.with_shard(df))

    @classmethod
    def write(cls, df: DataFrame, shard_map: ShardMap, path: str) -> ShardedTable:
        """Written by shard, so that a scan of some shards reads only their files."""
        shard_map.with_shard(df).write.partitionBy(SHARD_COLUMN).parquet(path)
        return cls.read(df.sparkSession, shard_map, path)

    @classmethod
    def read(cls, spark: SparkSession, shard_map: ShardMap, path: str) -> ShardedTable:
        return cls(shard_map, spark.read.parquet(path), stored=True)

    @property
    def key_type(self) -> DataType | None:
        return None if self.df is None else self.df.schema[self.map.key].dataType

    def scan(self, shards: set[int] | None = None) -> DataFrame:
        return self.df if shards is None else self.df.where(F.col(SHARD_COLUMN).isin(sorted(shards)))

    def read_shards(self, shards: set[int] | None = None) -> DataFrame:
        """The table's rows for a query that needs ``shards``. Where a row's shard would be computed just to skip it, none is skipped."""
        return self.scan(shards if self.stored else None).drop(SHARD_COLUMN)
