"""DataFrame operators, streaming, files and the shell."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tandemql.operators import aggregation, relational, setops
from tandemql.sources.files import read_files
from tandemql.streaming.windows import event_stream, sessions, windowed


def test_star(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b, 3 AS c")
    assert relational.star(df, except_=["b"], replace={"c": F.col("a") + F.col("c")}).collect() == [(1, 4)]
    with pytest.raises(ValueError):
        relational.star(df, except_=["nope"])


def test_range_join_equals_plain_join(spark):
    left = spark.range(50).select((F.col("id") * 3 - 40).cast("double").alias("lo"))
    right = spark.range(200).select((F.col("id") * 0.7 - 60).alias("x"))
    bucketed = relational.range_join(left, right, F.col("lo"), F.col("lo") + 4, F.col("x"), 4.0)
    plain = left.join(right, F.col("x").between(F.col("lo"), F.col("lo") + 4))
    assert sorted(bucketed.collect()) == sorted(plain.collect())
    assert "BroadcastNestedLoop" not in bucketed._jdf.queryExecution().executedPlan().toString()


def test_asof_join_without_matches(spark):
    left = spark.sql("SELECT * FROM VALUES (1, 5, 'a'), (1, 1, 'b'), (2, 9, 'c') AS t(k, ts, v)")
    right = spark.sql("SELECT * FROM VALUES (1, 2, 'x'), (1, 5, 'y') AS t(k2, at, w)")
    got = relational.asof_join(left, right, left_key="k", right_key="k2", left_time="ts", right_time="at", take=["w"])
    assert {(r.v, r.w) for r in got.collect()} == {("a", "y"), ("b", None), ("c", None)}


def test_asof_join_of_a_hot_key(spark):
    """Random rows, two thirds of them of one key, with ties, nulls and gaps, against looking back one by one."""
    rnd = random.Random(3)
    key = lambda: rnd.choice([1, 1, 1, 1, 2, 3, None])
    lefts = [(i, key(), rnd.choice([None, *range(-20, 400)])) for i in range(600)]
    lefts = [(i, k, None if t is None else float(t)) for i, k, t in lefts]
    taken = {(key(), rnd.choice([None, *range(0, 300, 7)])) for _ in range(150)}
    rights = [(k, None if t is None else float(t), n) for n, (k, t) in enumerate(sorted(taken, key=repr))]
    left = spark.createDataFrame(lefts, "i long, k long, t double")
    right = spark.createDataFrame(rights, "rk long, rt double, n long")
    got = relational.asof_join(left, right, left_key="k", right_key="rk", left_time="t", right_time="rt", take=["n"])
    want = set()
    for i, k, t in lefts:
        past = [(rt, n) for rk, rt, n in rights if None not in (rk, rt, k, t) and rk == k and rt <= t]
        want.add((i, max(past)[1] if past else None))
    assert {(r.i, r.n) for r in got.collect()} == want and got.count() == 600
    empty = relational.asof_join(left, right.limit(0), left_key="k", right_key="rk", left_time="t", right_time="rt", take=["n"])
    assert empty.where("n IS NOT NULL").count() == 0 and empty.count() == 600


def test_set_operations(spark):
    a, b = spark.sql("SELECT * FROM VALUES (1), (1), (2), (NULL) AS t(x)"), spark.sql("SELECT * FROM VALUES (1), (NULL), (3) AS t(y)")
    values = lambda df: sorted((r[0] for r in df.collect()), key=str)
    assert values(setops.intersect(a, b, all_rows=True)) == [1, None]
    assert values(setops.intersect(a, b, all_rows=True, bags=False)) == [1, 1, None]
    assert values(setops.except_(a, b, all_rows=True)) == [1, 2]
    assert values(setops.except_(a, b, all_rows=True, bags=False)) == [2]
    assert values(setops.union(a, b)) == [1, 2, 3, None]
    with pytest.raises(ValueError):
        setops.union(a, b.withColumn("z", F.lit(1)))


def test_two_phase_aggregate_of_nothing(spark):
    spec = {"n": ("count", None), "a": ("avg", "id"), "m": ("max", "id")}
    empty = spark.range(0)
    assert aggregation.merge_partials([aggregation.partial(empty, [], spec)], [], spec).collect() == [(0, None, None)]


def test_top_k_and_pushdown_plans(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = orders.where("o_orderkey = 5").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    plan = orders.orderBy("o_totalprice").limit(3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = tmp_path / "events"
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(str(source))
    batch = windowed(spark.read.parquet(str(source)), every="1 day")
    stream = windowed(event_stream(spark, str(source)), every="1 day", late="4000 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("counted").collect())) == sorted(map(key, batch.collect()))
    assert sessions(spark.read.parquet(str(source))).agg(F.sum("n")).first()[0] == spark.read.parquet(str(source)).count()


def test_read_files(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "x.json"))
    assert read_files(spark, str(tmp_path / "x.json")).count() == 3


def test_shell(spark, capsys, sf_dir):
    from tandemql.__main__ import main

    assert main(["--data", sf_dir, "-e", "SELECT r_name FROM region ORDER BY r_name LIMIT 1", "-e", "DELETE FROM region WHERE r_regionkey = 0", "-e", "SELECT nope()"]) == 1
    out = capsys.readouterr()
    assert "r_name" in out.out and "OK, 1 rows" in out.out and "no function nope" in out.err
