"""Task state, results and what is kept of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_FIRST = ("task_type", "created_at", "video_key", "link_name", "submit_date")
RESULT_LAST = ("status", "updated_at", "completed_at", "image_count", "llm_content", "ocr_text_count", "custom_data")
RESULT_COLUMNS = ("task_id", "task_type", "status", "created_at", "updated_at", "completed_at", "video_key", "link_name", "submit_date", "image_count", "llm_content", "ocr_text_count", "custom_data")


def upsert_results(writes: DataFrame, seq: str = "seq", key: str = "task_id") -> DataFrame:
    """One row per task: first values of RESULT_FIRST and last ones of RESULT_LAST in the order of ``seq``.

    min_by and max_by take a struct, so nulls count as values; the aggregate is
    partial before its shuffle.
    """
    first, last = F.min_by(F.struct(*RESULT_FIRST), seq), F.max_by(F.struct(*RESULT_LAST), seq)
    df = writes.groupBy(key).agg(first.alias("_f"), last.alias("_l"))
    return df.select(key, *(F.col(f"_f.{c}").alias(c) for c in RESULT_FIRST), *(F.col(f"_l.{c}").alias(c) for c in RESULT_LAST))


def merge_results(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows and new writes (with ``seq``) as one table again: stored rows come first."""
    return upsert_results(stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.select(*stored.columns, "seq")))


def build_result_row(tasks: DataFrame) -> DataFrame:
    """The 13 result columns of a task with image_paths, ocr_text_by_image and custom map; a null collection has a null count."""
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return tasks.withColumns({"image_count": n("image_paths"), "ocr_text_count": n("ocr_text_by_image"), "custom_data": F.to_json("custom")}).select(*RESULT_COLUMNS)


def latest_by_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def state_snapshot(states: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The newest state of each task, if it is younger than its life."""
    return latest_by_key(states, ["task_id"], "updated_at").where(F.col("updated_at") > now - F.expr(f"INTERVAL {days} DAYS"))


def fold_task_events(events: DataFrame) -> DataFrame:
    """States from task events (task_id, event, step_name, error_message, ts, seq): the batch form of the stream.

    The last status wins whatever came before it; steps are listed in the order
    in which they were first executed; completed_at and error_message follow the
    last event that sets them.
    """
    status = F.when(F.col("event") == "START", "RUNNING").when(F.col("event") == "COMPLETE", "COMPLETED").when(F.col("event") == "FAIL", "FAILED").when(F.col("event") == "CANCEL", "CANCELLED")
    order = F.struct("ts", "seq")
    steps = F.array_sort(F.collect_list(F.when(F.col("event") == "STEP", F.struct("ts", "seq", "step_name"))))
    when = lambda cond, value: F.max_by(F.when(cond, value), F.when(cond, order))
    return events.groupBy("task_id").agg(
        F.coalesce(when(status.isNotNull(), status), F.lit("PENDING")).alias("status"), F.array_distinct(F.transform(steps, lambda s: s["step_name"])).alias("executed_steps"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max(F.when(F.col("event") == "COMPLETE", F.col("ts"))).alias("completed_at"), when(F.col("event") == "FAIL", F.col("error_message")).alias("error_message"),
    )


def mark_processed(processed: DataFrame, emitted: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """The processed set with what was emitted, each key once with its last time, and none older than its life."""
    added = emitted.select("bucket", "object_key", now.alias("processed_at"))
    both = processed.select("bucket", "object_key", "processed_at").unionByName(added)
    return both.groupBy("bucket", "object_key").agg(F.max("processed_at").alias("processed_at")).where(F.col("processed_at") > now - F.expr(f"INTERVAL {days} DAYS"))


def step_pending(states: DataFrame, steps: list[str]) -> DataFrame:
    """task_id, step, order of the steps that a task hasn't executed."""
    every = F.posexplode(F.array(*map(F.lit, steps))).alias("step_order", "step")
    return states.select("task_id", "executed_steps", every).where(~F.coalesce(F.array_contains("executed_steps", F.col("step")), F.lit(False))).select("task_id", "step", "step_order")


def step_executions(tasks: DataFrame) -> DataFrame:
    """One row per step run, from task_id and runs array<struct<step_name,status,error_message,started_at,ended_at>>."""
    rows = tasks.select("task_id", F.posexplode("runs").alias("run", "r")).select("task_id", "run", "r.*")
    return rows.withColumn("duration_ms", F.unix_millis("ended_at") - F.unix_millis("started_at"))


def quality_checks(checked: DataFrame) -> DataFrame:
    """One row per check of dual_check(): task_id, check_type, check_result, details."""
    rows = checked.select("task_id", F.explode("results").alias("r"))
    return rows.select("task_id", F.col("r.name").alias("check_type"), F.when(F.col("r.valid"), "PASS").otherwise("FAIL").alias("check_result"), F.col("r.message").alias("details"))


def task_status(states: DataFrame, steps: int = 2) -> DataFrame:
    done = F.coalesce(F.when(F.col("executed_steps").isNotNull(), F.size("executed_steps")), F.lit(0))
    return states.select("task_id", "status", (done * 100 / steps).cast("int").alias("progress"), "created_at", "updated_at", "completed_at", "error_message")


def task_list(tasks: DataFrame, status: str | None = None, task_type: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page, newest first, with the total of the filter beside it."""
    df = tasks
    for column, wanted in (("status", status), ("task_type", task_type)):
        df = df.where(F.col(column) == wanted) if wanted else df
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(F.desc("created_at"), "task_id").offset((page - 1) * page_size).limit(page_size)
    return rows.withColumn("total", total.scalar())
