"""Application status history and the job queue, as functions of snapshots and a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The statuses that may follow each status.
TRANSITIONS = {
    "draft": "pending_documents ready_to_fill cancelled",
    "pending_documents": "draft ready_to_fill cancelled",
    "ready_to_fill": "pending_documents filled cancelled",
    "filled": "ready_to_fill submitted cancelled",
    "submitted": "pending_followup approved rejected cancelled",
    "pending_followup": "submitted approved rejected cancelled",
    "approved": "pending_followup",
    "rejected": "draft pending_documents pending_followup cancelled",
    "cancelled": "draft",
}


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, own in TRANSITIONS.items() for b in own.split()], "old_status string, new_status string")


def history(events: DataFrame, order: list[str], edges: DataFrame) -> DataFrame:
    """events: (application_id, status and the columns of order). Adds old_status, changed and valid; the first status and an unchanged one are valid."""
    before = F.lag("status").over(Window.partitionBy("application_id").orderBy(*order))
    rows = events.withColumn("old_status", before)
    known = edges.select(F.col("old_status").alias("_o"), F.col("new_status").alias("_n")).withColumn("_known", F.lit(True))
    rows = rows.join(F.broadcast(known), (F.col("old_status") == F.col("_o")) & (F.col("status") == F.col("_n")), "left")
    same = F.col("old_status").isNull() | (F.col("old_status") == F.col("status"))
    return rows.withColumn("changed", ~F.col("old_status").eqNullSafe(F.col("status"))).withColumn("valid", same | F.coalesce("_known", F.lit(False))).drop("_o", "_n", "_known")


def claim(jobs: DataFrame, worker: str, as_of: Column, *, batch: int = 5, lease_seconds: int = 120, reclaim_expired: bool = False) -> DataFrame:
    """The queue after a worker has claimed the `batch` jobs that have been due longest (ties by id)."""
    waiting = F.col("status").isin("pending", "retry")
    if reclaim_expired:
        waiting |= (F.col("status") == "running") & (F.col("locked_until") < as_of)
    due = jobs.where(waiting & (F.col("run_after") <= as_of) & (F.col("locked_until").isNull() | (F.col("locked_until") < as_of)))
    chosen = due.orderBy("run_after", "id").limit(batch).select(F.col("id").alias("_id"))
    hit = F.col("_id").isNotNull()
    changed = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_by": F.lit(worker), "locked_until": as_of + F.make_dt_interval(secs=F.lit(lease_seconds))}
    # a batch of jobs is as small as the batch
    return jobs.join(F.broadcast(chosen), F.col("id") == F.col("_id"), "left").withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changed.items()}).drop("_id")


def complete(jobs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """results: (id, ok, error). Done jobs are completed; failed ones are retried after 30 * 2 ** attempts seconds until their attempts are used up."""
    rows = jobs.join(results.select(F.col("id").alias("_id"), "ok", "error"), F.col("id") == F.col("_id"), "left")
    hit, spent = F.col("_id").isNotNull(), F.col("attempts") >= F.col("max_attempts")
    status = F.when(F.col("ok"), "completed").when(spent, "failed").otherwise("retry")
    later = as_of + F.make_dt_interval(secs=30 * F.pow(F.lit(2), F.col("attempts")))
    changed = {"status": status, "locked_by": F.lit(None).cast("string"), "locked_until": F.lit(None).cast("timestamp"), "last_error": F.when(~F.col("ok"), F.col("error")), "run_after": F.when(status == "retry", later).otherwise(F.col("run_after"))}
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in changed.items()}).drop("_id", "ok", "error")
