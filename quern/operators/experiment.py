"""One experiment over labelled feature rows: preflight, train, select on validation, evaluate once, record."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import finite
from quern.operators import evalmetrics
from quern.operators.quality import all_of, check


def matrix(models: list[str], configurations: list[str], windows: list[int]) -> list[str]:
    """Ids of every combination."""
    return [f"{c}_w{w:02d}_{m}" for c in configurations for w in windows for m in models]


def preflight(rows: DataFrame, n_classes: int, n_features: int, mapping: DataFrame | None = None) -> DataFrame:
    """Checks before training: labels in range, every split there, shapes right, values finite; with mapping (word,
    label), that rows' words have its labels."""
    empty = [check(rows.filter(F.col("split") == s).limit(1), f"{s} is not empty", F.when(F.count(F.lit(1)) == 0, 1), "empty") for s in ("train", "val", "test")]
    if mapping is not None:
        m = rows.select("word", "label").join(mapping.select("word", F.col("label").alias("_m")), "word", "left")
        empty.append(check(m, "labels agree with the mapping", F.count_if(~F.col("label").eqNullSafe(F.col("_m"))), "of another label"))
    bad = ~F.coalesce(F.col("label").between(0, n_classes - 1), F.lit(False))
    return all_of([
        check(rows, "labels in range", F.count_if(bad), "out of range"),
        check(rows, "feature shape", F.count_if(F.size("features") != n_features), "of another length"),
        check(rows, "features finite", F.count_if(~F.forall("features", lambda v: finite(v.cast("double")))), "not finite"),
        *empty,
    ])


def run(rows: DataFrame, candidates: dict[str, dict], n_classes: int, seed: int = 42, allow_no_validation: bool = False, mapping: DataFrame | None = None) -> tuple[object, DataFrame]:
    """Train each candidate forest on train, keep the best macro-F1 on val (ties: the earlier), evaluate it.

    rows: sample_id, split, label, features. Returns the model and one row per split with the metrics. Without
    validation rows it refuses unless told otherwise; the test rows are read once, at the end.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    checks = preflight(rows, n_classes, rows.select(F.size("features")).first()[0], mapping).filter("not passed").collect()
    failed = [c["check"] for c in checks if c["check"] != "val is not empty" or not allow_no_validation]
    if failed:
        raise ValueError(f"preflight failed: {failed}")
    v = rows.select("sample_id", "split", F.col("label").cast("double").alias("label"), array_to_vector(F.col("features").cast("array<double>")).alias("x"))
    train, best = v.filter("split = 'train'").cache(), None
    for name, params in candidates.items():
        began = time.perf_counter()
        model = RandomForestClassifier(featuresCol="x", labelCol="label", seed=seed, **params).fit(train)
        seconds = time.perf_counter() - began
        said = predictions(model, v.filter("split = 'val'" if not allow_no_validation else "split = 'train'"))
        score = evalmetrics.metrics(evalmetrics.confusion(said), n_classes).first().macro_f1
        if best is None or score > best[1]:
            best = (name, score, model, seconds)
    name, _, model, seconds = best
    parts = []
    for s in ("train", "val", "test"):
        m = evalmetrics.metrics(evalmetrics.confusion(predictions(model, v.filter(F.col("split") == s))), n_classes)
        parts.append(m.select(F.lit(name).alias("experiment"), F.lit(s).alias("split"), *m.columns, F.lit(seconds).alias("train_seconds")))
    out = parts[0].union(parts[1]).union(parts[2])
    return model, out


def predictions(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("sample_id", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
