"""State of ingestion: latest state per file, pending files, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_LENGTH = 500
#: Statuses of a finished file.
DONE = ("done", "completed")


def latest(log: DataFrame, key: str = "filepath", when: str = "processed_at") -> DataFrame:
    """The last state of each key, by one aggregation with partial results instead of a sorted window.

    Ties in time go to the row that is largest in the remaining columns, so that repeated runs agree. Null times are first.
    """
    rest = [c for c in log.columns if c not in (key, when)]
    best = F.max(F.struct(F.col(when), *[F.col(c) for c in rest])).alias("s")
    return log.groupBy(key).agg(best).select(key, *[F.col(f"s.{c}").alias(c) for c in rest], F.col(f"s.{when}").alias(when))


def upsert(state: DataFrame, changes: DataFrame, key: str = "filepath", when: str = "processed_at") -> DataFrame:
    return latest(state.unionByName(changes, allowMissingColumns=True), key, when)


def done_row(status: str = "status", chunks: str = "chunks_count", error: str = "error_text") -> dict:
    """Values of a finished or failed row: a failed one has no chunks, a finished one no error; errors are cut."""
    failed = F.col(status) == "failed"
    return {chunks: F.when(failed, 0).otherwise(F.col(chunks)), error: F.when(failed, F.substring(error, 1, ERROR_LENGTH))}


def unprocessed(files: DataFrame, state: DataFrame, key: str = "filepath", resume: bool = True) -> DataFrame:
    """Files that are not done; all of them without resuming."""
    return files.join(state.where(F.col("status").isin(*DONE)).select(key).distinct(), key, "left_anti") if resume else files


def pending(state: DataFrame) -> DataFrame:
    return state.where(F.col("status").isin("pending", "failed"))


def summary(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def summary_map(state: DataFrame) -> DataFrame:
    """One row: statuses and their counts as a map, and the chunks of finished files."""
    done = state.where(F.col("status").isin(*DONE)).agg(F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("chunks"))
    counts = summary(state).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    return counts.join(F.broadcast(done))  # one row each


def rollup(results: DataFrame, skipped: int = 0) -> DataFrame:
    """Totals of a run: files tried, succeeded, failed, chunks."""
    return results.agg(
        (F.count("*") - skipped).alias("total_files"), F.count_if(F.col("status").isin(*DONE)).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("status").isin(*DONE), F.col("chunks_count"))), F.lit(0)).alias("total_chunks"),
    )


def retry_failed(state: DataFrame) -> DataFrame:
    return state.withColumn("status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")))


def errors(results: DataFrame, error: str = "error_text") -> DataFrame:
    return results.where(F.col(error).isNotNull())
