"""Counters, limits and job states over event streams.

Each plan is one function from a stream or a table to a DataFrame, so batch and stream
results can be held against each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Legal moves of an action, and states that end it.
MOVES = {"PROPOSED": ["APPROVED", "REJECTED", "EXPIRED"], "APPROVED": ["RUNNING", "CANCELLED"], "RUNNING": ["DONE", "FAILED"], "FAILED": ["RUNNING"]}


def read_events(spark, folder: str, schema, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def window_counts(events: DataFrame, key: str, limit: int, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Hits of each key and minute, and whether they exceed the limit; late rows count up to the watermark."""
    return (
        events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", "1 minute").alias("w"), key)
        .agg(F.count("*").alias("hits")).select(F.col("w.start").alias("minute"), key, "hits", (F.col("hits") > limit).alias("rejected"))
    )


def distinct_jobs(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """One active job a key: repeats within the watermark are dropped."""
    marked = events.withColumn("at", F.col(at).cast("timestamp"))
    return marked.withWatermark("at", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)


def replace_partitions(batch: DataFrame, path: str, key: str) -> None:
    """Idempotent sink for ``foreachBatch``: the partitions of a batch's keys are replaced, others stay."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


# --------------------------------------------------------------------- states of jobs, in batch


def claim(jobs: DataFrame, now, workers: int) -> DataFrame:
    """The next jobs: ready ones by priority, time and id, and running ones whose lease is over."""
    ready = ((F.col("status") == "QUEUED") & (F.col("run_after") <= F.lit(now))) | ((F.col("status") == "RUNNING") & (F.col("lease_until") < F.lit(now)))
    return jobs.where(ready).orderBy(F.desc("priority"), "run_after", "job_id").limit(workers)


def after_failure(jobs: DataFrame, now, most: int = 3, base: int = 10) -> DataFrame:
    """FAILED after so many attempts, else queued again after a growing wait: ``status, run_after``."""
    wait = F.least(F.lit(3600), F.lit(base) * F.pow(F.lit(2), F.greatest(F.lit(0), F.col("attempts") - 1))).cast("int")
    over = F.col("attempts") >= most
    return jobs.withColumn("status", F.when(over, "FAILED").otherwise("QUEUED")).withColumn("run_after", F.when(~over, F.lit(now) + F.make_dt_interval(secs=wait)))


def illegal_moves(log: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Rows of an append-only log whose move from the row before is not legal."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    legal = F.coalesce(*[F.when(before == a, F.col(status).isin(b)) for a, b in MOVES.items()], F.when(before.isNull(), F.lit(True)), F.lit(False))
    return log.withColumn("before", before).withColumn("legal", legal).where("NOT legal")


def token_families(events: DataFrame) -> DataFrame:
    """Families of rotated tokens (``family, token, at``) that a replayed token revokes.

    A use of a token after a later one of its family was used is a replay; a repeat of the
    newest token (a lost answer) is not.
    """
    order = Window.partitionBy("family").orderBy("at", "use_id").rowsBetween(Window.unboundedPreceding, -1)
    replay = F.col("token") < F.max("token").over(order)
    return events.withColumn("replay", F.coalesce(replay, F.lit(False))).groupBy("family").agg(F.bool_or("replay").alias("revoked"), F.min(F.when(F.col("replay"), F.col("at"))).alias("revoked_at"))
