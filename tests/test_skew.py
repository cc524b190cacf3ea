"""Components, joins with hot keys and running sums against plain Python."""

import random
import re

from pyspark.sql import functions as F

from quern.operators.graph import components
from quern.operators.skew import hot_join, sums_before


def test_components_with_a_hub_and_a_chain(spark):
    r = random.Random(1)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(200)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = top(a), top(b)
            up[max(ra, rb)] = min(ra, rb)
    assert got == {x: top(x) for x in up}


def test_hot_and_null_keys_join_as_a_plain_join_does(spark):
    left = spark.createDataFrame([(i % 7 if i % 3 else None, i) for i in range(500)] + [(99, i) for i in range(4000)], "k long, i long")
    right = spark.createDataFrame([(k, k * 10) for k in (0, 1, 2, 3, 99, 50)], "k long, v long").join(left.groupBy("k").count(), "k", "left")
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right.drop("count"), "k", how).select("k", "i", "v").collect()), key=str)
        for least in (10, 10_000):
            got = hot_join(left, right, ["k"], "count", how, least=least)
            assert got.columns == ["k", "i", "v"]
            assert sorted(map(tuple, got.collect()), key=str) == want


def test_hot_rows_are_dealt_by_their_share_too(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    for how in ("inner", "left"):
        plan = hot_join(left, right, ["k"], "n", how, least=100, merge=True)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(k#\d+L, _s#\d+L", plan), plan


def test_running_sums_are_those_of_a_loop(spark):
    total = 0
    for r in sums_before(spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("x")), "k", "x", "b").orderBy("k").collect():
        assert r.b == total
        total += r.x


def test_facts_of_hot_and_null_groups(spark):
    """A key that half of all rows hold, null keys and single rows: the facts are those of a window."""
    from quern.operators.skew import with_group

    df = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.col("id").cast("string")).alias("k")).repartition(5)
    got = with_group(df, ["k"], F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    assert got.columns == ["id", "k", "least", "n"]
    for r in got.collect():
        want = (0, 3000) if r.k == "hot" else (None, None) if r.k is None else (r.id, 1)
        assert (r.least, r.n) == want


def test_windows_by_content_are_gone():
    import ast
    from pathlib import Path

    for f in Path(__file__).resolve().parents[1].joinpath("quern").rglob("*.py"):
        for n in ast.walk(ast.parse(f.read_text())):
            if isinstance(n, ast.Call) and ast.unparse(n.func) == "Window.partitionBy":
                assert not any(isinstance(a, ast.Constant) and a.value in ("sha256", "sha") for a in n.args), (f, ast.unparse(n))
