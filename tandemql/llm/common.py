"""Helpers shared by the corpus operators: column picking, shared storage, global ranks."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tandemql.storage import materialise

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table of groups (sources, partitions) is broadcast; beyond it a salted join is used.
BROADCAST_ROWS = 100_000

SALTS = 32

#: Rows of one key beyond which a join deals them to several tasks.
HOT_ROWS = 1 << 16

#: Rows of a batch that Python works on.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns alone, as ``new=old``.

    Columns are found by position (exact name first, then ignoring case), so other
    columns may carry any name, also one that an operator uses itself.
    """
    names, lower = df.columns, [c.lower() for c in df.columns]
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    out = []
    for new, old in wanted.items():
        if old not in names and old.lower() not in lower:
            raise ValueError(f"no column {old!r} among {names}")
        i = names.index(old) if old in names else lower.index(old.lower())
        out.append(F.col(f"_c{i}").alias(new))
    return plain.select(*out)


def with_row(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns, and ``row``: a struct of all columns by position (``_c0``, ...)."""
    names = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    row = F.struct(*[F.col(f"_c{i}") for i in range(len(names))]).alias("row")
    lower = [c.lower() for c in names]
    at = {new: names.index(old) if old in names else lower.index(old.lower()) for new, old in wanted.items()}
    return plain.select(*[F.col(f"_c{i}").alias(new) for new, i in at.items()], row)


def unpack_row(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """Back from ``row`` to columns called ``names``; ``replaced`` gives new values by name."""
    return df.select(*[replaced.get(c, F.col(f"row._c{i}")).alias(c) for i, c in enumerate(names)])


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of BATCH_ROWS rows at most; Spark bounds the bytes of those that it sends.

    Python workers outlive their tasks, so a task gives back the memory that it has freed.
    """

    def small(parts):
        yield from run(part.slice(i, BATCH_ROWS) for part in parts for i in range(0, max(1, part.num_rows), BATCH_ROWS))
        give_back()

    return df.mapInArrow(small, schema)


def give_back() -> None:
    """Return freed memory of Arrow and of the C library, where that can, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: its row's rank from 0 in ``order``, without sorting in one task.

    Rows are dealt by range, numbered in each partition, and moved by the number of rows in the
    partitions before. Only that table of counts, with one row per partition, meets in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), name)
    return _ranked(dealt, order, name)


def _ranked(dealt: DataFrame, order: list[Column], name: str) -> DataFrame:
    before = running_before(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_part", "_n", "_before")
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        dealt.withColumn("_within", F.row_number().over(within) - 1)
        .join(F.broadcast(before), "_part")  # a row per partition
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_part", "_n", "_before", "_within")
    )


def running_before(totals: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the smaller keys. ``totals`` has one row per partition, so one task may hold it."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(value).over(w), F.lit(0)).alias(name))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, salt_of: Column) -> DataFrame:
    """``rows`` with the columns of ``groups``, by a null-safe ``key`` that may be very skewed.

    ``groups`` has a row per key. Up to BROADCAST_ROWS of them are broadcast; beyond, both sides are
    salted, so that the rows of a hot key spread over SALTS tasks.
    """
    right = groups.withColumnRenamed(key, "_key")
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_salt_r"))
    return left.join(right, on).drop("_key", "_salt", "_salt_r")


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows.join(table, key)``, where ``table`` has a row per key and keys of ``rows``, a written table, may be hot.

    The rows of a key that has more than HOT_ROWS of them are dealt by a hash of their columns to as many salts as that
    takes, and only those keys' rows of ``table`` are repeated. Keys are counted with partial sums, so that no task gets
    a hot one whole.
    """
    if rows.count() <= HOT_ROWS:
        return rows.join(table, key, how)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > HOT_ROWS)
    hot = hot.select(key, F.ceil(F.col("_c") / HOT_ROWS).cast("int").alias("_salts"))
    if hot.isEmpty():
        return rows.join(table, key, how)
    hot = materialise(hot, "hot")
    few = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = F.broadcast(hot) if few else hot
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("_salts"))
    dealt = rows.join(known, key, "left").withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int")).drop("_salts")
    spread = table.join(known, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(spread, [key, "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession) -> None:
    """For an application over tables of long texts: Spark sends Python no more than BATCH_ROWS rows at a time. The operators
    leave the session's settings alone and work with any."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(name, str(BATCH_ROWS))
