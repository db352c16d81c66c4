"""Every registered query against its SQL in DuckDB, and the shape of the plans that must scale."""

import hashlib

import duckdb
import pandas as pd
import pytest

from quillwork.operators import ordered as od
from quillwork.plans import applicability, registry
from quillwork.plans.base import TABLES

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def cells(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    names = sorted(df.columns)
    return sorted((tuple(one(v) for v in r) for r in df[names].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, con, name):
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [applicability.applicability_range_join, applicability.rule_baseline_or_join, applicability.branch_pairs])
def test_joins_keep_their_equality_keys(spark, sf, query):
    text = plan(query(spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark, sf):
    text = plan(QUERIES["kleene_combine"](spark, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_returnflag:string>" in text


def test_entry_and_registry_without_the_optional_package():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_components_of_whole_tables_by_union_find(spark, sf):
    lines = pd.read_parquet(f"{sf}/lineitem.parquet")
    root = {n: n for n in lines.l_partkey}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, parts in lines.groupby("l_orderkey").l_partkey:
        for a, b in zip(parts, parts[1:]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.root for r in QUERIES["product_components"](spark, sf).collect()}
    assert got == {n: find(n) for n in root}
    pools = {r.node: r.pool for r in QUERIES["pool_assignment"](spark, sf).collect()}
    number = lambda text, of: int(hashlib.sha256(text.encode()).hexdigest(), 16) % of
    for node, pool in pools.items():
        share = number(f"i{node}", 100)
        own = next(name for end, name in ((10, "pilot_development"), (20, "pilot_validation"), (60, "optimization"), (75, "validation"), (100, "test")) if share < end)
        assert pool == ("product_heldout" if number(f"g{find(node)}", 10) == 0 else "temporal" if node % 10 == 3 else own)
    assert set(pools) == set(root)


def test_places_do_not_need_one_task(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("v"), (F.col("id") % 3).alias("g"))
    assert all(r.v == r.place for r in od.placed(rows, [F.col("v")]).collect())
    got = od.placed_within(rows, ["g"], [F.col("v")]).toPandas().sort_values(["g", "v"])
    assert (got.turn == got.groupby("g").cumcount()).all()
    assert "SinglePartition" not in plan(od.placed(rows, [F.col("v")]).where("place < 0")).split("Window")[0]


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)
