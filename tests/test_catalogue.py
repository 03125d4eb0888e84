"""Every registered query of the engine against its DuckDB SQL."""

from __future__ import annotations

import pytest
from compare import assert_same

from tandemql.plans import catalogue, spoken
from tandemql.plans.registry import Tables, through_session


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name in catalogue.ORACLES:
        assert_same(df, catalogue.ORACLES[name], sf_dir)
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(set(spoken.registry.oracles) - {f"{n}_sql" for n in spoken.NOT_MYSQL}))
def test_query_in_mysql(spark, sf_dir, name):
    text = spoken.registry.oracles[name]
    assert_same(through_session(Tables(spark, sf_dir), "mysql", text), text, sf_dir)


def test_stored_shards_are_read_by_partition(spark, sf_dir):
    plan = catalogue.QUERIES["shard_pruned_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_shard" in plan or "PartitionFilters: [_shard" in plan, plan
    assert "PushedFilters: [In(o_custkey" in plan or "o_custkey, [7,8,9]" in plan, plan


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
