"""Resumable micro-batches: a file stream whose checkpoint is the done set, written as atomic parts, read latest-wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.reconcile import latest


def ingest(spark: SparkSession, source: str, schema, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 8, format: str = "parquet") -> int:
    """Process files that no earlier run with this checkpoint has, as parts under out; returns the number of batches.

    Each micro-batch replaces its own part, so a batch that is run again after a failure leaves no second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = step(batch) if step else batch
        rows.withColumn("part", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    return each_batch(spark, source, schema, checkpoint, write, files_per_batch, format)


def each_batch(spark: SparkSession, source: str, schema, checkpoint: str, write: Callable[[DataFrame, int], None], files_per_batch: int = 8, format: str = "parquet") -> int:
    """Call write(rows, number) for each batch of files that no earlier run with this checkpoint has finished; returns
    the number of batches. write must replace what an unfinished call with the same number left."""
    stream = spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_batch).load(source)
    done = []

    def one(batch: DataFrame, number: int) -> None:
        write(batch, number)
        done.append(number)

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def results(spark: SparkSession, out: str, key: list[str], success: str | None = None) -> DataFrame:
    """All parts, one row per key: a success beats failures, then the latest part wins."""
    rows = spark.read.option("mergeSchema", "true").parquet(out).drop("batch")
    ok = F.col(success) if success else F.lit(True)
    return latest(rows, key, ok, [F.col("part")])
