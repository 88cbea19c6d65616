"""Resumable ingestion: each run takes the files that are new and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def available_now(spark: SparkSession, folder: str, schema: StructType, checkpoint: str, process: Callable[[DataFrame], DataFrame], output: str, pattern: str = "*.parquet") -> None:
    """Process the files that no earlier run with this checkpoint has seen, and append the result.

    A batch that is run again after a failure overwrites its own folder, so its rows are written once.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def state_stream(spark: SparkSession, folder: str, schema: StructType, when: str = "processed_at", late: str = "30 days") -> DataFrame:
    """Counts of states by day from a growing log, rows later than the watermark left out."""
    from pyspark.sql import functions as F

    stream = spark.readStream.schema(schema).parquet(folder).withWatermark(when, late)
    return stream.groupBy(F.window(when, "1 day").alias("day"), "status").agg(F.count("*").alias("n"))
