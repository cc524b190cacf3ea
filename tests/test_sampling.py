import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quern.functions.text import tie_break
from quern.operators import sampling

RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


def h(seed, x):
    return hashlib.sha256(f"{seed}:{x}".encode()).hexdigest()


def units_of(spark, n=6000, classes=5, sizes=(1, 1, 2, 3, 9, 40)):
    """Units of mixed sizes whose labels are all connected, one label with half of all rows."""
    r, rows, u = random.Random(4), [], 0
    while len(rows) < n:
        for _ in range(r.choice(sizes)):
            rows.append((f"s{len(rows):05d}", f"w{max(0, r.randrange(-classes, classes))}", f"u{u}"))
        u += 1
    return spark.createDataFrame(rows, "sample_id string, word string, split_group string"), rows


def test_rounds_of_proposals_meet_the_targets(spark, monkeypatch):
    s, rows = units_of(spark)
    rounds = []
    real = sampling.staged
    monkeypatch.setattr(sampling, "staged", lambda df, name: (rounds.append(name), real(df, name))[1])
    got = sampling.assign_splits(s, RATIOS, 42).collect()
    assert rounds.count("offers") > 1  # proposals did collide
    assert Counter(r.sample_id for r in got) == Counter(x[0] for x in rows)
    by_unit = defaultdict(set)
    for r in got:
        by_unit[r.split_group].add(r.split)
    assert all(len(v) == 1 for v in by_unit.values())
    n = Counter((r.word, r.split) for r in got)
    for w, size in Counter(x[1] for x in rows).items():
        for k, share in RATIOS.items():
            assert abs(n[w, k] / size - share) < 0.03, (w, k, n[w, k], size)
    multi = Counter(next(iter(v)) for u, v in by_unit.items() if sum(x[2] == u for x in rows) > 1)
    assert min(multi.values()) > 0.05 * sum(multi.values())  # units of several files are in every split
    again = sampling.assign_splits(s.orderBy(F.rand(1)).repartition(7), RATIOS, 42).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_only_single_files_and_an_empty_table(spark):
    s = spark.createDataFrame([(f"s{i}", f"w{i % 2}", f"s{i}") for i in range(40)], "sample_id string, word string, split_group string")
    n = Counter((r.word, r.split) for r in sampling.assign_splits(s, RATIOS, 1).collect())
    assert all(n[w, "train"] == 14 and n[w, "val"] == 3 and n[w, "test"] == 3 for w in ("w0", "w1"))
    assert sampling.assign_splits(s.limit(0), RATIOS, 1).count() == 0


def test_hash_rank_is_the_row_number(spark):
    df = spark.range(9000).select(F.concat(F.lit("g"), F.least(F.col("id") % 9, F.lit(1))).alias("g"), F.col("id").cast("string").alias("k"))
    got = {(r.g, r.k): r["_rank"] for r in sampling.hash_rank(df, "g", tie_break(F.col("k"), 7), "k").collect()}
    for g in ("g0", "g1"):
        want = sorted((k for x, k in got if x == g), key=lambda k: h(7, k))
        assert [got[g, k] for k in want] == list(range(1, len(want) + 1))


def brute_coverage(rows, steps, total, seed):
    """Quotas in order by hash, then the five quintiles, distinct words first."""
    taken, out = set(), []
    for reason, test, quota in steps:
        for i in sorted((r for r in rows if test(r) and r[0] not in taken), key=lambda r: h(seed, r[0]))[:quota]:
            taken.add(i[0])
            out.append((i[0], reason))
    rest = max(0, total - len(out))
    left = sorted((r for r in rows if r[0] not in taken), key=lambda r: (r[2], r[0]))
    bins = defaultdict(list)
    for k, r in enumerate(left, 1):
        bins[max(0, -(-(k - 1) * 5 // (len(left) - 1)) - 1)].append(r)
    for b, mine in bins.items():
        seen, order = set(), []
        for r in sorted(mine, key=lambda r: h(seed, r[0])):
            order.append((r[1] in seen, h(seed, r[0]), r[0]))
            seen.add(r[1])
        out += [(x[2], f"quintile_{b + 1}") for x in sorted(order)[: rest // 5 + (b < rest % 5)]]
    return sorted(out)


def test_coverage_sample_with_few_and_with_many_words(spark):
    for words in (3, 40, 900):
        r = random.Random(words)
        rows = [(f"s{i:04d}", f"w{r.randrange(words)}", r.random()) for i in range(1000)]
        df = spark.createDataFrame(rows, "sample_id string, word string, v double")
        steps = [("low", F.col("v") < 0.05, 7), ("w1", F.col("word") == "w1", 4)]
        got = sorted((x.sample_id, x.reason) for x in sampling.coverage_sample(df, steps, 100, "v", "word", 42).collect())
        assert got == brute_coverage(rows, [("low", lambda x: x[2] < 0.05, 7), ("w1", lambda x: x[1] == "w1", 4)], 100, 42)


def test_groups_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("word"), F.col("id").alias("sample_id"))
    for out in (sampling.top_per_group(df, ["word"], [F.col("sample_id")], 3), sampling.class_sample(df, 2, 5, 1)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
