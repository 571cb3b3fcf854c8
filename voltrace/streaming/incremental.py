"""Resumable feature builds: what is new is taken from a file stream, checked against what is done, and appended.

The batch form is an anti join; this form remembers which input files it has seen in the stream's own checkpoint, so that a
rerun after a failure takes up where the last one stopped. It isn't an event-time stream: there are no windows or late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_pending(spark: SparkSession, source: str, schema: str, target: str, key: str, build: Callable[[DataFrame], DataFrame], checkpoint: str) -> int:
    """Append build(rows) for all rows of new files whose key the target lacks; returns the number of batches run."""
    batches = 0

    def step(rows: DataFrame, number: int) -> None:
        nonlocal batches
        fresh = rows.dropDuplicates([key])
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        build(fresh).withColumn("batch", F.lit(number)).write.mode("append").parquet(target)
        batches += 1

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return batches
