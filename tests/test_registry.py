"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    try:
        return round(float(v), 6)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"/root/testdata/sf0.001/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLE:
        assert len(got)
        return
    want = duck.execute(registry.ORACLE[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [sorted(map(repr, (tuple(map(plain, r)) for r in df[cols].itertuples(index=False)))) for df in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(registry.ORACLE) <= set(e.queries())


def test_argmax_where_the_line_outweighs_the_quantity(spark, tmp_path):
    """Beyond a million orders an earlier line of smaller quantity has the higher score; lines without score count not."""
    rows = [(1, 5_000_000, 1, 50.0), (1, 10, 2, 49.0), (2, 5_000_000, 1, 50.0), (2, 4_500_000, 1, 49.0), (3, 7, 1, None), (4, 8, 1, None), (4, 9, 3, 1.0), (4, 9, 4, 1.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(map(tuple, registry.QUERIES["argmax_tie"](spark, str(tmp_path)).collect()))
    assert got == sorted(c.execute(registry.ORACLE["argmax_tie"]).fetchall()) == [(1, 102), (2, 50_000_001), (3, None), (4, 93)]
    # Equal scores: the least line.
    spark.createDataFrame([(1, 1_000_000, 5, 50.0), (1, 0, 5, 49.0)], "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/tie/lineitem.parquet")
    assert [tuple(r) for r in registry.QUERIES["argmax_tie"](spark, f"{tmp_path}/tie").collect()] == [(1, 5)]
