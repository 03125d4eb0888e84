"""Shard routing and pruning, specs and urls, the decision log, two-phase commit and recovery."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tandemql.sharding.pruning import shards_for
from tandemql.sharding.shard_map import SHARD_COLUMN, ShardedTable, parse_shard_spec
from tandemql.sources.backends import parse_backend
from tandemql.sql.parser import parse
from tandemql.transactions.two_phase import ShardStore, TwoPhaseTransaction, recover
from tandemql.transactions.wal import DecisionLog


def test_columns_are_routed_like_values(spark):
    ints = [0, 1, -1, 7, 255, 256, 10**12, -(10**15), 2**63 - 1, -(2**63), None]
    texts = ["", "a", "abc", "Ünïcödé", "日本", "x" * 300, None]
    for n in (2, 3, 7):
        spec = ",".join(f"s{i}" for i in range(n))
        by_int, by_text = parse_shard_spec(f"t:k:{spec}"), parse_shard_spec(f"t:k:hash:{spec}")
        for shard_map, values, kind in ((by_int, ints, "long"), (by_text, texts, "string")):
            df = ShardedTable.deal(spark.createDataFrame([(v,) for v in values], f"k {kind}"), shard_map).df
            assert {(r.k, r[SHARD_COLUMN]) for r in df.collect()} == {(v, shard_map.route(v)) for v in values}


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.integers(1, 9))
def test_pruning_finds_the_shard_of_every_key(value, n):
    shard_map = parse_shard_spec("t:k:" + ",".join(f"s{i}" for i in range(n)))
    table = ShardedTable(shard_map, None)
    if value >= 0:
        assert shards_for(parse(f"SELECT * FROM t WHERE k = {value}"), {"t": table}) == {"t": {shard_map.route(value)}}


def test_range_and_list():
    ranged = parse_shard_spec("t:k:range:5=a,10=b,20=a")
    assert [ranged.route(v) for v in (-1, 5, 6, 10, 11, 99)] == [0, 0, 1, 1, 0, 0] and ranged.shards == ["a", "b"]
    listed = parse_shard_spec("t:k:list:1=a,x=b")
    assert [listed.route(v) for v in (1, "x", "nope")] == [0, 1, 0]


@pytest.mark.parametrize("spec", ["t", "t:k", "t:k:", "t:k:range:x=a", "t:k:range:5", "t:k:list:", "t:k:list:=a"])
def test_bad_specs(spec):
    with pytest.raises(ValueError):
        parse_shard_spec(spec)


def test_pruning_conditions():
    table = {"t": ShardedTable(parse_shard_spec("t:k:hash:a,b,c,d"), None)}
    route = table["t"].map.route
    shards = lambda sql: shards_for(parse(sql), table).get("t")
    assert shards("SELECT * FROM t WHERE k IN (1, 2) AND x > 3") == {route(1), route(2)}
    assert shards("SELECT * FROM t WHERE k = 1 OR k = 2") is None
    assert shards("SELECT * FROM t WHERE NOT k = 1") is None
    assert shards("SELECT * FROM t WHERE k NOT IN (1)") is None
    assert shards("SELECT * FROM t a JOIN t b ON a.x = b.x WHERE a.k = 1") is None
    assert shards("SELECT * FROM t a JOIN u b ON a.x = b.x WHERE a.k = 1") == {route(1)}
    assert shards("SELECT * FROM t a JOIN u b ON a.x = b.x WHERE b.k = 1") is None


def test_pruned_scan_reads_only_its_shards(spark, tmp_path):
    shard_map = parse_shard_spec("t:k:hash:a,b,c")
    table = ShardedTable.write(spark.range(100).withColumnRenamed("id", "k"), shard_map, str(tmp_path / "t"))
    df = table.scan({shard_map.route(5)}).where("k = 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"{SHARD_COLUMN}" in plan
    assert df.count() == 1


def test_backend_urls():
    b = parse_backend("mysql://u:p%40ss@h:3307/db?name=one&ssl_mode=REQUIRED&ssl_ca=/x")
    assert (b.name, b.host, b.port, b.user, b.password, b.database, b.tls) == ("one", "h", 3307, "u", "p@ss", "db", {"ssl_mode": "REQUIRED", "ssl_ca": "/x"})
    assert b.jdbc_options()["url"] == "jdbc:mysql://h:3307/db"
    assert parse_backend("postgresql://h/db").port == 5432
    for bad in ("oracle://h/db", "mysql://", "mysql://h:x/db", "mysql://h/db?nope=1"):
        with pytest.raises(ValueError):
            parse_backend(bad)


def test_decision_log(tmp_path):
    log = DecisionLog(tmp_path / "log")
    log.decide("COMMIT", "t1", ["a", "b"])
    log.decide("ROLLBACK", "t2", ["a"])
    log.decide("COMMIT", "t3", ["b"])
    log.complete("t1")
    assert [(d.kind, d.txn, d.participants) for d in log.in_doubt()] == [("ROLLBACK", "t2", ("a",)), ("COMMIT", "t3", ("b",))]
    log.compact()
    assert log.path.read_text() == "ROLLBACK\tt2\ta\nCOMMIT\tt3\tb\n"
    with log.path.open("a") as f:
        f.write("COMMIT\tt4\ta")  # cut off in the middle
    assert [d.txn for d in log.in_doubt()] == ["t2", "t3"]
    with pytest.raises(ValueError):
        log.decide("COMMIT", "a\tb", [])


def numbers(store, shard):
    df = store.read(shard)
    return None if df is None else sorted(r.id for r in df.collect())


def test_two_phase_commit_and_rollback(spark, tmp_path):
    store, log = ShardStore(spark, tmp_path / "shards"), DecisionLog(tmp_path / "log")
    txn = TwoPhaseTransaction(store, log)
    txn.write("a", spark.range(3))
    txn.write("b", spark.range(3, 5))
    txn.commit()
    assert (numbers(store, "a"), numbers(store, "b")) == ([0, 1, 2], [3, 4]) and not log.in_doubt()
    txn = TwoPhaseTransaction(store, log)
    txn.write("a", spark.range(1))
    txn.prepare()
    txn.rollback()
    assert numbers(store, "a") == [0, 1, 2] and store.staged("a") == []


@pytest.mark.parametrize("crash", ["prepared", "decided", "one published", "all published"])
def test_recovery(spark, tmp_path, crash):
    store, log = ShardStore(spark, tmp_path / "shards"), DecisionLog(tmp_path / "log")
    first = TwoPhaseTransaction(store, log)
    for s in "ab":
        first.write(s, spark.range(2))
    first.commit()
    txn = TwoPhaseTransaction(store, log)
    for s in "ab":
        txn.write(s, spark.range(7, 9))
    txn.prepare()
    if crash != "prepared":
        log.decide("COMMIT", txn.txn, ["a", "b"])
    if crash in ("one published", "all published"):
        store.publish("a", txn.txn)
    if crash == "all published":
        store.publish("b", txn.txn)
    for _ in range(2):  # done twice, nothing more happens
        recover(store, log)
    new = [0, 1] if crash == "prepared" else [7, 8]
    assert (numbers(store, "a"), numbers(store, "b")) == (new, new)
    assert not log.in_doubt() and store.staged("a") == [] == store.staged("b")
