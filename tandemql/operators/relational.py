"""Relational operators over DataFrames: star projection, joins with checked broadcast, range and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType
from pyspark.sql.window import Window

#: A side is broadcast by request only up to so many rows; beyond, the join shuffles.
BROADCAST_ROWS = 50_000


def values_row(spark: SparkSession, **columns: Column) -> DataFrame:
    """A SELECT without FROM: exactly one row."""
    return spark.range(1).select(*[c.alias(name) for name, c in columns.items()])


def star(df: DataFrame, except_: list[str] = (), replace: dict[str, Column] | None = None) -> DataFrame:
    """``*`` without the columns ``except_``, and with others replaced in their place."""
    unknown = {c.lower() for c in [*except_, *(replace or {})]} - {c.lower() for c in df.columns}
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.withColumns(replace or {}).drop(*except_)


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "inner", broadcast_rows: int = 0) -> DataFrame:
    """Equi-join on pairs of columns; null keys never match.

    With ``broadcast_rows`` the right side is broadcast if it has no more rows than that. Without, the
    choice is Spark's, by the sizes that it sees at run time.
    """
    condition = None
    for a, b in on:
        one = left[a] == right[b]
        condition = one if condition is None else condition & one
    if broadcast_rows and right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        right = F.broadcast(right)
    return left.join(right, condition, how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """On all columns of the same name; without any, a cross join, as the standard has it."""
    lower = {c.lower() for c in right.columns}
    shared = [c for c in left.columns if c.lower() in lower]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def range_join(left: DataFrame, right: DataFrame, low: Column, high: Column, point: Column, width: float) -> DataFrame:
    """Pairs with ``low <= point <= high``, as an equi-join on buckets of ``width``.

    A left row goes to every bucket that its range touches, so ``width`` should be about the ranges' length.
    """
    a = left.withColumn("_bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    b = right.withColumn("_bucket", F.floor(point / width))
    return a.join(b, "_bucket").where(point.between(low, high)).drop("_bucket")


#: Slices of time that a key's rows are dealt to in an as-of join, so that a hot key is in many tasks.
ASOF_SLICES = 64


def asof_join(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """Each left row with the columns ``take`` of the latest right row of its key that is not after it.

    Both sides are put together, dealt by key and slice of time, and sorted; the last right row seen is carried on.
    Where a slice has none yet, it is the last one of the key's earlier slices, of which there are ASOF_SLICES at
    most per key. That is one shuffle of each side and a small one of the slices' last rows, and no pairs are made.
    A right row of the same time counts. A null key or time meets nothing.
    """
    own = [F.col(c) for c in left.columns]
    told = F.struct(*[F.col(c) for c in take])
    a = left.select(F.col(left_key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_row"))
    b = right.select(F.col(right_key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), told.alias("_found")).where("_k IS NOT NULL AND _t IS NOT NULL")
    timed = isinstance(right.schema[right_time].dataType, (DateType, TimestampType, TimestampNTZType))
    number = (F.col("_t").cast("timestamp") if timed else F.col("_t")).cast("double")
    ends = b.agg(F.min(number).alias("low"), F.max(number).alias("high")).first()  # two numbers
    low, high = ends["low"] or 0.0, ends["high"] or 0.0
    width = (high - low) / ASOF_SLICES or 1.0
    place = F.least(F.greatest(F.floor((number - low) / width), F.lit(0)), F.lit(ASOF_SLICES - 1))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_slice", F.coalesce(place, F.lit(0)).cast("int"))
    within = Window.partitionBy("_k", "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_found", ignorenulls=True).over(within)).where("_side = 1")
    ordered = Window.partitionBy("_k").orderBy("_slice")
    sliced = b.withColumn("_slice", place.cast("int")).groupBy("_k", "_slice").agg(F.max_by("_found", "_t").alias("_end"))
    spans = sliced.withColumn("_next", F.coalesce(F.lead("_slice").over(ordered), F.lit(ASOF_SLICES)))
    # A slice's last row holds for the key's later slices, up to and with the next that has one.
    last = ASOF_SLICES - 1
    later = F.explode(F.expr(f"sequence(_slice + 1, least(_next, {last}))")).alias("_slice")
    carried = spans.where(F.col("_slice") < last).select("_k", later, F.col("_end").alias("_before"))
    seen = seen.join(carried, ["_k", "_slice"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    return seen.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in take])
