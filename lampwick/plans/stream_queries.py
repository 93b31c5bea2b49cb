"""Streams over the given tables, run to the end of what is there; each is written as files and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..streaming import jobs
from ..streaming.versions import VersionedTable
from ..workdir import new_path
from . import table_queries as tq

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


class _Streamed(fx.Tables):
    """Tables as streams of files."""

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        schema = self.spark.read.parquet(f"{self.dir}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.dir}/{name}.parquet*")


def _streamed(t: fx.Tables) -> _Streamed:
    return _Streamed(t.spark, t.dir)


def drained(stream: DataFrame, mode: str = "append", **trigger: bool) -> DataFrame:
    """Everything that the stream gives until its input ends. Complete results are written anew by each batch."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, "stream"), new_path(spark, "offsets")

    def write(batch: DataFrame, number: int) -> None:
        path = out if mode == "complete" else f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*([out] if mode == "complete" else [f"{out}/batch=*"]))


@query(f"WITH {fx.OBJECTS} SELECT bucket, object_key, length FROM objects WHERE doc_id % 4 < 2")
def stream_new_objects(t):
    from ..functions.text import is_media

    listing = fx.objects(_streamed(t)).where(is_media(F.col("object_key")))
    return drained(listing.select("bucket", "object_key", "length"))


@query("SELECT DISTINCT 'task_' || (user_id % 500) AS task_id FROM events")
def stream_dedup_tasks(t):
    events = fx.task_events(_streamed(t)).withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(jobs.stream_dedup_tasks(events, life="60 days").select("task_id"))


@query(tq._FOLD)
def stream_task_state(t):
    events = fx.task_events(_streamed(t)).withColumn("ts", F.col("ts").cast("timestamp"))
    states = drained(jobs.stream_task_state(events), "update", once=True)  # state with a life asks for a next batch always, so there is no end to wait for
    last = states.groupBy("task_id").agg(F.max_by(F.struct("status", "steps", "created_at", "updated_at", "completed_at", "error_message"), "updated_at").alias("s")).select("task_id", "s.*")
    return last.withColumn("executed", F.replace("steps", F.lit("\x1f"), F.lit(","))).drop("steps")


@query(tq.SQL["upsert_results"])
def stream_task_results(t):
    spark = t.spark
    path, checkpoint = new_path(spark, "results"), new_path(spark, "offsets")
    writes = tq._writes(_streamed(t)).select(*_RESULT, "seq")
    run = jobs.stream_task_results(writes, path, checkpoint).start()
    run.awaitTermination()
    return VersionedTable(spark, path, "task_id").read(writes.drop("seq").schema).select("task_id", "link_name", "task_type", "status", "llm_content", "updated_at")


_RESULT = ["task_id", "task_type", "status", "created_at", "updated_at", "completed_at", "video_key", "link_name", "submit_date", "image_count", "llm_content", "ocr_text_count", "custom_data"]


@query(tq.SQL["metrics_rollup"])
def stream_metrics(t):
    from ..operators.metrics import metrics_rollup

    return drained(metrics_rollup(fx.metric_points(_streamed(t))), "complete")


@query(tq.SQL["cost_trend"])
def stream_cost_trend(t):
    return drained(jobs.cost_trend(fx.token_usage(_streamed(t)), late="1 hour"), "complete")


@query(tq.SQL["alert_error_rate"])
def stream_alert_error_rate(t):
    events = _streamed(t).events.withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.error_windows(drained(jobs.error_panes(events, F.col("event_type") == "error"), "complete"), 0.003)


@query(tq.SQL["read_task_messages"])
def stream_task_messages(t):
    """The decoding of messages is the same on a stream; broken ones go to a table of their own."""
    k = F.col("doc_id")
    body = F.concat(F.lit('{"videoKey":"'), "source", F.lit('/v.mp4","taskId":"t'), k.cast("string"), F.lit('","customData":{"a":"'), "lang", F.lit('"}}'))
    from ..sources.messages import decode

    raw = _streamed(t).documents.select("doc_id", F.when(k % 4 == 1, F.concat(F.lit("key"), k.cast("string"))).otherwise("").alias("msg_key"), F.when(k % 8 == 0, "no json").when(k % 4 == 0, '{"bucket":"b"}').otherwise(body).alias("body"))
    df = decode(raw)
    good = lambda c: F.when(~F.col("broken"), c)
    return drained(df.select("doc_id", F.when(F.col("broken"), "dead").otherwise("task").alias("kind"), *(good(F.col(c)).alias(c) for c in ("task_id", "video_key", "bucket")), good(F.col("custom_data.a")).alias("a")))
