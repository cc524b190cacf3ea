"""Classification metrics from (y_true, y_pred) rows: one aggregation to confusion counts, all else from those."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.profile import percentiles


def confusion(df: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """y_true, y_pred, n: the sparse confusion matrix."""
    return df.groupBy(F.col(t).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(cm: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support for labels of either side; 0 where undefined."""
    both = cm.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("c")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("c")),
    )).alias("x")).select("x.*")
    s = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("c").alias("correct"))
    zero = F.lit(0.0)
    pr = F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")).otherwise(zero)
    rc = F.when(F.col("support") > 0, F.col("correct") / F.col("support")).otherwise(zero)
    f1 = F.when(F.col("correct") > 0, 2 * F.col("correct") / (F.col("predicted") + F.col("support"))).otherwise(zero)
    return s.select("label", pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), "support")


def metrics(cm: DataFrame, vocabulary_size: int) -> DataFrame:
    """One row: samples, correct, incorrect, accuracy (NaN on nothing), macro and weighted averages, class counts.

    Averages are over the labels of either side, not over the vocabulary.
    """
    n = cm.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))), F.lit(0)).alias("correct"))
    c, w = per_class(cm), F.col("support")
    names = ("precision", "recall", "f1")
    a = c.agg(F.count_if(w > 0).alias("classes_in_y_true"), F.count(F.lit(1)).alias("classes_evaluated"), *[F.avg(m).alias(f"macro_{m}") for m in names], *[F.try_divide(F.sum(F.col(m) * w), F.sum(w)).alias(f"weighted_{m}") for m in names])
    out = n.crossJoin(a)
    acc = F.when(F.col("samples") > 0, F.col("correct") / F.col("samples")).otherwise(F.lit(float("nan")))
    return out.select("samples", "correct", (F.col("samples") - F.col("correct")).alias("incorrect"), acc.alias("accuracy"), F.lit(vocabulary_size).alias("vocabulary_size"), "classes_in_y_true", "classes_evaluated", *[f"{k}_{m}" for k in ("macro", "weighted") for m in names])


def summary(m: DataFrame) -> DataFrame:
    return m.select("samples", "accuracy", "macro_f1", "weighted_f1", "classes_in_y_true")


def top_confusions(cm: DataFrame, n: int = 50) -> DataFrame:
    """The most frequent errors; ties by true, then predicted label."""
    return cm.filter("y_true <> y_pred").orderBy(F.desc("n"), "y_true", "y_pred").limit(n)


def best_so_far(df: DataFrame, epoch: str = "epoch", metric: str = "metric", patience: int = 10, by: list[str] | None = None) -> DataFrame:
    """df with improved (strictly above all before), best, best_epoch, bad_epochs, stop."""
    w = Window.partitionBy(*(by or [])).orderBy(epoch)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_b", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("improved", F.col("_b").isNull() | (F.col(metric) > F.col("_b"))).drop("_b")
    df = df.withColumns({"best": F.max(metric).over(upto), "best_epoch": F.last(F.when(F.col("improved"), F.col(epoch)), True).over(upto), "_n": F.row_number().over(w)})
    last = F.last(F.when(F.col("improved"), F.col("_n")), True).over(upto)
    df = df.withColumn("bad_epochs", F.col("_n") - last)
    return df.withColumn("stop", F.col("bad_epochs") >= patience).drop("_n")


def latency(df: DataFrame, seconds: str, batch: int = 1) -> DataFrame:
    """mean_ms, median_ms, p95_ms, samples_per_s."""
    q = percentiles(df, F.col(seconds), {"median": 0.5, "p95": 0.95})
    got = df.agg(F.avg(seconds).alias("mean")).join(F.broadcast(q), how="left")  # one row each
    return got.select((F.col("mean") * 1000).alias("mean_ms"), (F.col("median") * 1000).alias("median_ms"), (F.col("p95") * 1000).alias("p95_ms"), (F.lit(batch) / F.col("mean")).alias("samples_per_s"))
