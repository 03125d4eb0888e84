"""Queries over whole tables: every row of the tables takes part, at more than one scale."""

from __future__ import annotations

import duckdb
import pytest
from compare import assert_same

from tandemql.plans import catalogue

SCALES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
SETOPS = "union_all union_distinct intersect intersect_all except except_all intersect_all_filter_mode except_all_filter_mode setop_precedence".split()


def _rows(spark, sf: str, table: str) -> int:
    return spark.read.parquet(f"{sf}/{table}.parquet").count()


@pytest.mark.parametrize("sf", SCALES)
@pytest.mark.parametrize("name", SETOPS)
def test_setop_over_whole_tables(spark, sf, name):
    df = catalogue.QUERIES[f"{name}"](spark, sf)
    assert_same(df, catalogue.ORACLES[f"{name}"], sf)
    assert df.count() > 0


@pytest.mark.parametrize("sf", SCALES)
def test_union_all_has_every_customer_and_supplier(spark, sf):
    assert catalogue.QUERIES["union_all"](spark, sf).count() == _rows(spark, sf, "customer") + _rows(spark, sf, "supplier")


@pytest.mark.parametrize("sf", SCALES)
def test_full_join_has_every_supplier_and_customer_and_unmatched_rows(spark, sf):
    df = catalogue.QUERIES["join_full"](spark, sf)
    assert_same(df, catalogue.ORACLES["join_full"], sf)
    rows = df.collect()
    assert len({r.s_suppkey for r in rows} - {None}) == _rows(spark, sf, "supplier")
    assert len({r.c_custkey for r in rows} - {None}) == _rows(spark, sf, "customer")
    assert any(r.s_suppkey is None for r in rows) and any(r.c_custkey is None for r in rows)


@pytest.mark.parametrize("sf", SCALES)
@pytest.mark.parametrize("name", ["sub_not_in_null", "sql_postgres_filter_window", "sql_count_distinct", "shard_setop"])
def test_orders_and_customers_whole(spark, sf, name):
    assert_same(catalogue.QUERIES[f"{name}"](spark, sf), catalogue.ORACLES[f"{name}"], sf)


@pytest.mark.parametrize("sf", SCALES)
def test_every_customer_with_orders_is_counted(spark, sf):
    customers = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().count()
    assert catalogue.QUERIES["sql_count_distinct"](spark, sf).first().n == customers
    assert catalogue.QUERIES["sql_postgres_filter_window"](spark, sf).count() == customers
    assert catalogue.QUERIES["shard_setop"](spark, sf).count() == _rows(spark, sf, "customer") + customers


@pytest.mark.parametrize("sf", SCALES)
@pytest.mark.parametrize("name, table", [("sort_multi", "customer"), ("sort_nulls", "orders"), ("sort_not_projected", "customer"), ("sort_alias", "part")])
def test_sort_returns_all_rows_in_order(spark, sf, name, table):
    got = [tuple(r) for r in catalogue.QUERIES[f"{name}"](spark, sf).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    assert len(got) == _rows(spark, sf, table)
    assert got == con.execute(catalogue.ORACLES[f"{name}"]).fetchall()
