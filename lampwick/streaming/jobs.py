"""Structured Streaming forms of the operators. What is windowed works on batches too."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.text import is_media
from ..operators.metrics import MONITOR_PRICES, cost, counted_quantiles, ratio
from ..operators.state import merge_results
from .versions import VersionedTable

OUT_STATE = "status string, steps string, created_at timestamp, updated_at timestamp, completed_at timestamp, error_message string"
#: Times are nanoseconds, so that no time zone comes into the state.
STATE = "status string, steps string, created long, updated long, completed long, error string"
STATUS_OF = {"START": "RUNNING", "COMPLETE": "COMPLETED", "FAIL": "FAILED", "CANCEL": "CANCELLED"}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _seconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds())


def stream_new_objects(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    """Listings as they are dropped into a folder, media only; the checkpoint is the set of what was seen."""
    return spark.readStream.schema(schema).format(fmt).load(path).where(is_media(F.col("object_key")))


def stream_dedup_tasks(events: DataFrame, at: str = "ts", keys: tuple[str, ...] = ("task_id",), life: str = "30 days") -> DataFrame:
    """Each key once within the watermark's life."""
    return events.withWatermark(at, life).dropDuplicatesWithinWatermark(list(keys))


def fold(events: pd.DataFrame, state: tuple | None) -> tuple:
    """The fields of STATE after more events, in order of (ts, seq).

    An event older than the last one of the state is late: its step counts and it
    may be the first of the task, but it doesn't set status, error or time back.
    """
    status, steps, created, updated, completed, error = state or ("PENDING", "", None, None, None, None)
    names = [s for s in steps.split("\x1f") if s]
    for e in events.sort_values(["ts", "seq"], kind="stable").to_dict("records"):
        at, late = e["ts"].value, updated is not None and e["ts"].value < updated
        if e["event"] == "STEP" and e["step_name"] not in names:
            names.append(e["step_name"])
        created, updated = at if created is None else min(created, at), at if updated is None else max(updated, at)
        if not late:
            status = STATUS_OF.get(e["event"], status)
            completed = at if e["event"] == "COMPLETE" else completed
            error = e["error_message"] if e["event"] == "FAIL" else error
    return status, "\x1f".join(names), created, updated, completed, error


class TaskState(StatefulProcessor):
    """Folds the events of a task into a state that lives for ``life_ms`` after its last change."""

    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("task", STATE, self.life_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = fold(pd.concat(list(rows)), tuple(self.state.get()) if self.state.exists() else None)
        self.state.update(new)
        status, steps, *times, error = new
        yield pd.DataFrame([(*key, status, steps, *map(pd.Timestamp, times), error)], columns=["task_id", *(c.split()[0] for c in OUT_STATE.split(", "))])

    def close(self) -> None:
        pass


def stream_task_state(events: DataFrame, life: str = "7 days") -> DataFrame:
    """The state of each task after each batch that touches it; a state goes when its task was quiet for its life.

    events: task_id, event, step_name, error_message, ts, seq. The life is the
    state store's own and runs by the clock, as does that of a cache. Such
    state needs the RocksDB store, which the session is set to. A run that is to
    end takes the trigger ``once``: by the clock there is always a next batch. For late events see fold().
    """
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    processor = TaskState(_seconds(life) * 1000)
    return events.groupBy("task_id").transformWithStateInPandas(processor, f"task_id string, {OUT_STATE}", "Update", "ProcessingTime")


def stream_task_results(writes: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Result rows upserted batch by batch into a VersionedTable: a batch writes the buckets of its keys, and is one commit."""
    schema = writes.drop("seq").schema

    def merge(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, path, "task_id", buckets).commit(number, batch, schema, merge_results)

    return writes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def cost_trend(usage: DataFrame, hours: int = 24, at: str = "ts", late: str = "1 hour", prices: tuple[float, float] = MONITOR_PRICES) -> DataFrame:
    """window_start, requests and cost of tumbling windows."""
    df = usage.withWatermark(at, late) if usage.isStreaming else usage
    tokens = lambda c: F.coalesce(F.sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0))
    out = df.groupBy(F.window(at, f"{hours} hours").alias("w")).agg(F.count("*").alias("requests"), cost(tokens("input_tokens"), tokens("output_tokens"), prices).alias("cost"))
    return out.select(F.col("w.start").alias("window_start"), "requests", "cost")


def pane(length: str, slide: str) -> str:
    """The longest span that both a window's length and its slide are made of."""
    return f"{gcd(_seconds(length), _seconds(slide))} seconds"


def windows_of(panes: DataFrame, length: str, slide: str, by: tuple[str, ...], *sums: Column) -> DataFrame:
    """Sliding windows from a table of panes (w: window, by...): a row for each pane, not for each event, goes to the windows that hold it."""
    return panes.groupBy(F.window("w", length, slide).alias("w"), *by).agg(*sums)


def eval_panes(log: DataFrame, hours: int = 24, slide: str = "1 hour", at: str = "created_at", late: str = "1 hour") -> DataFrame:
    """w, biz_type, prompt_stage, total and success: the counts that windows are summed from."""
    df = log.withWatermark(at, late) if log.isStreaming else log
    ok = F.count_if(F.col("validation_status") == "SUCCESS")
    return df.groupBy(F.window(at, pane(f"{hours} hours", slide)).alias("w"), "biz_type", "prompt_stage").agg(F.count("*").alias("total"), ok.alias("success"))


def rolling_eval(log: DataFrame, hours: int = 24, slide: str = "1 hour", at: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Counts and success rate of each biz and stage in sliding windows, summed from panes. A stream of it appends."""
    sums = (F.sum("total").alias("total"), F.sum("success").alias("success"))
    out = windows_of(eval_panes(log, hours, slide, at, late), f"{hours} hours", slide, ("biz_type", "prompt_stage"), *sums)
    return out.select(F.col("w.start").alias("window_start"), "biz_type", "prompt_stage", "total", "success", ratio(F.col("success"), F.col("total")).alias("success_rate"))


ALERT, EVERY = "5 minutes", "30 seconds"


def error_panes(events: DataFrame, failed: Column) -> DataFrame:
    """w, errors and requests of every 30 seconds."""
    df = events.withWatermark("ts", "10 minutes") if events.isStreaming else events
    return df.groupBy(F.window("ts", EVERY).alias("w")).agg(F.count_if(failed).alias("errors"), F.count("*").alias("requests"))


def error_windows(panes: DataFrame, limit: float = 0.1) -> DataFrame:
    """at, errors, requests, errors_per_second, error_share, over: each window of 5 minutes, every 30 seconds, from error_panes()."""
    out = windows_of(panes, ALERT, EVERY, (), F.sum("errors").alias("errors"), F.sum("requests").alias("requests"))
    out = out.select(F.col("w.end").alias("at"), "errors", "requests", (F.col("errors") / 300.0).alias("errors_per_second"), ratio(F.col("errors"), F.col("requests")).alias("error_share"))
    return out.withColumn("over", F.col("errors_per_second") > limit)


def alert_error_rate(events: DataFrame, failed: Column, limit: float = 0.1) -> DataFrame:
    """error_windows() of the events. A stream of it appends."""
    return error_windows(error_panes(events, failed), limit)


def alert_latency_p95(events: DataFrame, value: str, limit: float = 1000.0, exact: bool = True) -> DataFrame:
    """at, p95, over for the same windows; streams take the sketch.

    Exact ones count each value in each pane and the panes' counts in each window.
    A sketch holds a pane, and a window merges its panes' sketches.
    """
    df = events.withWatermark("ts", "10 minutes") if events.isStreaming else events
    w = F.window("ts", EVERY).alias("w")
    if exact and not events.isStreaming:
        panes = df.groupBy(w, F.col(value).alias("value")).agg(F.count("*").alias("n"))
        counts = windows_of(panes, ALERT, EVERY, ("value",), F.sum("n").alias("n")).select(F.col("w.end").alias("at"), "value", "n")
        out = counted_quantiles(counts, ["at"], {"p95": 0.95})
    else:
        panes = df.groupBy(w).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("s"))
        merged = windows_of(panes, ALERT, EVERY, (), F.kll_merge_agg_double("s").alias("s"))
        out = merged.select(F.col("w.end").alias("at"), F.kll_sketch_get_quantile_double("s", F.lit(0.95)).alias("p95"))
    return out.select("at", "p95", (F.col("p95") > limit).alias("over"))


def held_for(windows: DataFrame, seconds: int = 300, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds firing: every window of the last ``seconds`` was over. One series per ``by``; its rows are windows, not events."""
    s = F.unix_timestamp("at")
    near = Window.partitionBy(*(by or [F.to_date("at")])).orderBy(s).rangeBetween(-seconds, 0)
    return windows.withColumn("firing", F.min("over").over(near))


def alert_service_down(beats: DataFrame, by: tuple[str, ...] = ("service",), gap: int = 60) -> DataFrame:
    """by, down_from, up_at: gaps of over ``gap`` seconds between heartbeats."""
    nxt = F.lead("ts").over(Window.partitionBy(*by).orderBy("ts"))
    df = beats.select(*by, "ts").withColumn("up_at", nxt)
    return df.where(F.unix_timestamp("up_at") - F.unix_timestamp("ts") > gap).select(*by, F.col("ts").alias("down_from"), "up_at")


def upload_alerts(uploads: DataFrame, size: str = "1 hour") -> DataFrame:
    """uploads: ts, ok, seconds, store_ok, queue_ok. Shares by window and whether each limit is passed."""
    df = uploads.withWatermark("ts", "10 minutes") if uploads.isStreaming else uploads
    n = F.count("*")
    bad = lambda c: ratio(F.count_if(~F.col(c)), n)
    out = df.groupBy(F.window("ts", size).alias("w")).agg(n.alias("uploads"), bad("ok").alias("failure"), F.avg("seconds").alias("mean_seconds"), bad("store_ok").alias("store_failure"), bad("queue_ok").alias("queue_failure"))
    limits = (F.col("failure") > 0.05) | (F.col("mean_seconds") > 30) | (F.col("store_failure") > 0.01) | (F.col("queue_failure") > 0.01)
    return out.select(F.col("w.start").alias("window_start"), "uploads", "failure", "mean_seconds", "store_failure", "queue_failure", limits.alias("alert"))
