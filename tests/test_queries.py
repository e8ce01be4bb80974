"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tramline.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, engine, name):
    df = registry.queries()[name](spark, DATA)
    want = engine.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    ours = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline_of_the_synthetic_feed(spark):
    rows = registry.queries()["transit_pipeline"](spark, DATA).toPandas()
    assert len(rows) and not rows.duplicated(["shape_id", "shape_pt_sequence"]).any()
    for _, g in rows.groupby("shape_id"):
        assert sorted(g["shape_pt_sequence"]) == list(range(1, len(g) + 1))
