"""Reproducible samples: hash order in place of random draws, quotas, quintiles, shards, split targets."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import tie_break
from quern.operators.skew import hot_join, sums_before
from quern.sources.shared import staged


def rank_bins(n: Column, rank: Column, bins: int = 5) -> Column:
    """Bin (from 0) of the rank-th of n values cut at rank quantiles."""
    return F.greatest(F.lit(0), F.ceil((rank - 1) * F.lit(bins) / (n - 1)) - 1).cast("int")


def quantile_bins(df: DataFrame, value: str, key: str, bins: int = 5) -> DataFrame:
    """df with bin: equal-count bins by (value, key). Ranks come from range-sorted partitions, not from one task."""
    ranked = global_rank(df, [F.col(value), F.col(key)])
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(F.broadcast(n)).withColumn("bin", F.when(F.col("_n") == 1, 0).otherwise(rank_bins(F.col("_n"), F.col("_rank"), bins))).drop("_n", "_rank")


def global_rank(df: DataFrame, order: list[Column], name: str = "_rank") -> DataFrame:
    """df with name: each row's place (from 1) in a total order.

    Rows are range-partitioned and numbered inside partitions; each partition's offset is the sum of the counts of
    those before it, a table of one row per partition. The columns are staged first so that both reads agree.
    """
    from quern.operators.graph import cut

    p = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(p, *order).sortWithinPartitions(*order).withColumns({"_pid": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    # One row per partition.
    counts = sums_before(dealt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_seq").alias("_first")), "_pid", "_c", "_before")
    out = dealt.join(F.broadcast(counts.select("_pid", "_first", "_before")), "_pid")
    return out.withColumn(name, F.col("_before") + F.col("_seq") - F.col("_first") + 1).drop("_pid", "_seq", "_first", "_before")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str | None = None) -> DataFrame:
    """The first n rows of each group, with their place in name if given. n is a number, so each task keeps its first n
    rows of a group before the shuffle, and no task gets more than that from each other one."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(name or "_rn", F.row_number().over(w)).filter(F.col(name or "_rn") <= n)
    return out if name else out.drop("_rn")


#: Slices of a group that is ranked by a hash.
SLICES = 4096


def hash_rank(df: DataFrame, group: str, h: Column, key: str, name: str = "_rank") -> DataFrame:
    """df with name: each row's place (from 1) in its group by (hash text h, key), without a task for a whole group.

    h is a hex hash; its first three digits cut a group into SLICES, counted with partial sums: a slice's rows start
    after those of the slices before it, and are numbered among themselves.
    """
    d = df.withColumns({"_h": h, "_slice": F.conv(F.substring(h, 1, 3), 16, 10).cast("int")})
    counts = d.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(group, "_slice").orderBy("_h", key))
    out = d.withColumn("_inside", inside).join(counts, [group, "_slice"])
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_h", "_slice", "_before", "_inside")


def round_robin(df: DataFrame, key: str, n: int, name: str = "shard") -> DataFrame:
    """df with shard 0..n-1 by place in key order: disjoint, sizes differ by one at most."""
    return global_rank(df, [F.col(key)]).withColumn(name, ((F.col("_rank") - 1) % n).cast("int")).drop("_rank")


def class_quotas(pool: DataFrame, per_class: int, target: int, seed: int, word: str = "word") -> DataFrame:
    """word, class_size, quota, selection: per_class each, and one more for the smallest and the largest classes.

    The slots up to target go half to the smallest, half to the largest classes; ties follow the seeded hash. The
    table has one row per class.
    """
    c = pool.groupBy(word).agg(F.count(F.lit(1)).alias("class_size"))
    c = c.withColumn("_base", F.least(F.lit(per_class), F.col("class_size"))).withColumn("_h", tie_break(F.col(word), seed))
    c = global_rank(c, [F.col("class_size"), F.col("_h"), F.col(word)], "_up")
    facts = c.agg(F.greatest(F.lit(0), F.lit(target) - F.sum("_base")).alias("_extra"), F.count(F.lit(1)).alias("_classes"))  # one row
    c = c.crossJoin(F.broadcast(facts)).withColumn("_down", F.col("_classes") + 1 - F.col("_up"))
    small = F.col("_up") <= F.floor(F.col("_extra") / 2)
    large = ~small & (F.col("_down") <= F.col("_extra") - F.floor(F.col("_extra") / 2))
    quota = F.least(F.col("class_size"), F.col("_base") + F.when(small | large, 1).otherwise(0))
    reason = F.when(small, "extra_smallest_class").when(large, "extra_largest_class").otherwise("base")
    return c.select(word, "class_size", quota.alias("quota"), reason.alias("selection"))


def class_sample(pool: DataFrame, per_class: int, target: int, seed: int, word: str = "word", key: str = "sample_id") -> DataFrame:
    """Rows of pool up to each class's quota, in seeded hash order, with selection."""
    quotas = class_quotas(pool, per_class, target, seed, word)
    # No quota is above per_class + 1, a limit that works before the shuffle: a class sends that many rows a task.
    few = top_per_group(pool, [word], [tie_break(F.col(key), seed), F.col(key)], per_class + 1, "_rn")
    return few.join(quotas, word).filter("_rn <= quota").drop("_rn", "quota")


def coverage_sample(pool: DataFrame, steps: list[tuple[str, Column, int]], total: int, value: str, word: str, seed: int, key: str = "sample_id") -> DataFrame:
    """Rows chosen by quotas in order, each skipping what is taken, then spread over quintiles of value.

    steps: (reason, condition, quota). The rest of total goes to the five bins, distinct words first. All draws
    follow the seeded hash of the key; every step is a top-n that works before the shuffle.
    """
    rows = pool.withColumn("_h", tie_break(F.col(key), seed))
    chosen = None
    for reason, test, quota in steps:
        left = rows if chosen is None else rows.join(chosen.select(key), key, "left_anti")
        got = left.filter(F.coalesce(test, F.lit(False))).orderBy("_h", key).limit(quota).withColumn("reason", F.lit(reason))
        chosen = got if chosen is None else chosen.unionByName(got)
    taken = chosen.count()
    rest = max(0, total - taken)
    left = staged(quantile_bins(rows.join(chosen.select(key), key, "left_anti"), value, key), "quintiles")
    # Distinct words first: at most most rows of a bin are wanted. Each (bin, word) folds to its first row before the
    # shuffle; where a bin has fewer words than that, its first 2 * most rows hold enough others.
    most = rest // 5 + 1
    cols = F.struct("_h", key, *[c for c in left.columns if c not in ("_h", key)])
    firsts = left.groupBy("bin", word).agg(F.min(F.struct("_h", key)).alias("_k"), F.min_by(cols, F.struct("_h", key)).alias("_row")).select("_row.*")
    order = [F.col("_h"), F.col(key)]
    firsts = top_per_group(firsts.select(*left.columns), ["bin"], order, most).withColumn("_again", F.lit(False))
    others = top_per_group(left, ["bin"], order, 2 * most).join(firsts.select(key), key, "left_anti").withColumn("_again", F.lit(True))
    left = top_per_group(firsts.unionByName(others), ["bin"], [F.col("_again"), *order], most, "_n")
    room = F.lit(rest // 5) + F.when(F.col("bin") < rest % 5, 1).otherwise(0)
    left = left.filter(F.col("_n") <= room).withColumn("reason", F.concat(F.lit("quintile_"), (F.col("bin") + 1).cast("string")))
    return chosen.unionByName(left.select(*chosen.columns)).drop("_h")


def class_targets(sizes: DataFrame, ratios: dict[str, float], seed: int, word: str = "word", size: str = "n") -> DataFrame:
    """word, split, target: whole samples of each class for each split by largest remainders.

    Ties of remainders follow the seeded hash. With enough samples every split after the first gets one at least,
    taken from the first.
    """
    names = list(ratios)
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.lit(i).alias("i"), F.lit(float(r)).alias("r")) for i, (s, r) in enumerate(ratios.items())])
    t = sizes.select(word, F.col(size).alias("n"), F.explode(parts).alias("p")).select(word, "n", "p.*")
    raw = F.round(F.col("n") * F.col("r"), 9)
    t = t.withColumns({"base": F.floor(raw), "frac": raw - F.floor(raw), "_h": tie_break(F.concat_ws(":", F.col(word).cast("string"), F.col("split")), seed)})
    by = Window.partitionBy(word)
    left = F.col("n") - F.sum("base").over(by)
    rank = F.row_number().over(by.orderBy(F.desc("frac"), "_h"))
    t = t.withColumns({"_left": left, "_rank": rank})
    t = t.withColumn("t", F.col("base") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0))
    lift = F.when((F.col("n") >= len(names)) & (F.col("i") > 0) & (F.col("t") == 0), 1).otherwise(0)
    t = t.withColumn("_lift", lift)
    take = F.when(F.col("i") == 0, F.sum("_lift").over(by)).otherwise(0)
    return t.withColumn("target", (F.col("t") + F.col("_lift") - take).cast("long")).select(word, "split", "target")


#: Rounds of proposals; after the last, what is left is placed as it proposes.
ROUNDS = 8


def assign_splits(samples: DataFrame, ratios: dict[str, float], seed: int, word: str = "word", unit: str = "split_group", key: str = "sample_id") -> DataFrame:
    """samples with split; units are never divided, every class comes close to its targets.

    Units of several files are placed in rounds. Each proposes a split by its seeded hash, in proportion to the room
    that its labels have left there, or where none has room the split whose labels are least over target. Proposals for a (label, split) pair are accepted in order, larger units first (by powers of two),
    then by seeded hash, as long as what comes before them leaves room; a unit is placed if all its labels accept it,
    and labels without room do not hold it up. The order is known by the sums of slices of it, so no task sees a
    label's units, and the first unit left is placed in every round. Single files then fill each class in seeded hash
    order up to what its targets leave.
    """
    names = list(ratios)
    sized = samples.groupBy(unit, word).agg(F.count(F.lit(1)).alias("c"))
    files = samples.groupBy(unit).agg(F.count(F.lit(1)).alias("_files")).filter("_files > 1")
    targets = class_targets(samples.groupBy(word).agg(F.count(F.lit(1)).alias("n")), ratios, seed, word).groupBy(word).pivot("split", names).agg(F.first("target")).na.fill(0)
    targets = staged(targets, "targets")
    h = tie_break(F.col(unit).cast("string"), seed)
    part = lambda start, n: F.conv(F.substring(h, start, n), 16, 10).cast("int")
    multi = sized.join(files, unit).withColumns({"_place": (F.lit(63) - F.floor(F.log2("_files")).cast("int")) * SLICES + part(1, 3), "_draw": part(4, 6) / (1 << 24)})
    left = staged(multi.select(unit, word, "c", "_place", "_draw"), "units")
    room, done = targets, []
    for turn in range(ROUNDS):
        if left.isEmpty():
            break
        under = [F.col("c") * F.col(f"_r_{s}") / F.greatest(F.col(s), F.lit(1)) for s in names]
        goal = room.select(word, *names, *[(F.col(s) if not done else F.col(s) - F.col(f"_u_{s}")).alias(f"_r_{s}") for s in names])
        space = [F.col("c") * F.greatest(F.col(f"_r_{s}"), F.lit(0)) for s in names]
        score = left.join(goal, word).groupBy(unit).agg(*[F.sum(u).alias(s) for u, s in zip(under, names)], F.array(*[F.sum(x) for x in space]).alias("_room"), F.first("_draw").alias("_draw"))
        total = F.aggregate("_room", F.lit(0).cast("long"), lambda a, x: a + x)
        upto, pick, best = F.lit(0), None, F.greatest(*names)
        for k in range(len(names)):
            upto = upto + F.col("_room")[k]
            test = (total > 0) & (F.col("_draw") * total < upto)
            pick = F.when(test, k) if pick is None else pick.when(test, k)
        for k, s in enumerate(names):
            pick = pick.when(F.col(s) == best, k)
        offers = left.join(score.select(unit, pick.alias("_k")), unit)
        if turn < ROUNDS - 1:
            sums = offers.groupBy(word, "_k", "_place").agg(F.sum("c").alias("_c"))
            upto = Window.partitionBy(word, "_k").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
            free = goal.select(word, F.posexplode(F.array(*[f"_r_{s}" for s in names])).alias("_k", "_free"))
            sums = sums.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0))).join(free, [word, "_k"])
            sums = sums.select(word, "_k", "_place", ((F.col("_free") <= 0) | (F.col("_before") < F.col("_free"))).alias("_ok"))
            offers = offers.join(sums, [word, "_k", "_place"])
            fits = offers.groupBy(unit).agg(F.bool_and("_ok").alias("_placed"))
            offers = staged(offers.drop("_ok").join(fits, unit), "offers")
        else:
            offers = staged(offers.withColumn("_placed", F.lit(True)), "offers")
        done.append(offers.filter("_placed"))
        left = offers.filter("not _placed").select(unit, word, "c", "_place", "_draw")
        placed = reduce(DataFrame.unionByName, done)
        used = placed.groupBy(word).agg(*[F.sum(F.when(F.col("_k") == k, F.col("c")).otherwise(0)).alias(f"_u_{s}") for k, s in enumerate(names)])
        room = staged(targets.join(used, word, "left").na.fill(0), "room")
    split = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("_k") + 1)
    if done:
        placed = staged(reduce(DataFrame.unionByName, done).groupBy(unit).agg(F.first("_k").alias("_k"), F.sum("c").alias("_n")).select(unit, split.alias("split"), "_n"), "placed")
    else:
        placed = staged(files.select(unit, F.lit(names[0]).alias("split"), F.col("_files").alias("_n")), "placed")
    if not done:
        room = targets.select("*", *[F.lit(0).alias(f"_u_{s}") for s in names])
    whole = hot_join(samples, placed, [unit], "_n", "left")
    ones = hash_rank(whole.filter(F.col("split").isNull()).drop("split"), word, tie_break(F.col(key).cast("string"), seed), key)
    ones = hot_join(ones, room.withColumn("_w", reduce(lambda a, b: a + b, [F.col(s) for s in names])), [word], "_w")
    free = [F.greatest(F.lit(0), F.col(s) - F.col(f"_u_{s}")) for s in names]
    split, upto = None, F.lit(0)
    for s, f in zip(names[1:] + names[:1], free[1:] + free[:1]):
        upto = upto + f
        test = F.col("_rank") <= upto
        split = F.when(test, s) if split is None else split.when(test, s)
    ones = ones.withColumn("split", split.otherwise(names[0])).select(*samples.columns, "split")
    return whole.filter(F.col("split").isNotNull()).select(*samples.columns, "split").unionByName(ones)


def select_samples(frozen: DataFrame, words: list[str], per_split: dict[str, int] | None = None, n_classes: int | None = None, seed: int = 42, word: str = "word", key: str = "sample_id") -> DataFrame:
    """Rows of the given words; optionally the first n_classes words and the first rows per word and split, in hash order."""
    got = {r[0] for r in frozen.filter(F.col(word).isin(words)).select(word).distinct().collect()}
    if got != set(words):
        raise ValueError(f"words missing from the split: {sorted(set(words) - got)[:5]}")
    rows = frozen.filter(F.col(word).isin(words))
    if n_classes is not None:
        keep = rows.select(word).distinct().orderBy(tie_break(F.col(word), seed)).limit(n_classes)
        rows = rows.join(keep, word, "left_semi")
    if per_split is not None:
        most = F.lit(0)
        for s, n in per_split.items():
            most = F.when(F.col("split") == s, n).otherwise(most)
        few = top_per_group(rows, [word, "split"], [tie_break(F.col(key), seed), F.col(key)], max(per_split.values()), "_rn")
        rows = few.filter(F.col("_rn") <= most).drop("_rn")
    return rows


def shares(n: int, ratios: list[float]) -> list[int]:
    """Largest-remainder shares of n (driver side, for small plans)."""
    raw = [n * r for r in ratios]
    out = [math.floor(x) for x in raw]
    for i in sorted(range(len(raw)), key=lambda k: out[k] - raw[k])[: n - sum(out)]:
        out[i] += 1
    return out
