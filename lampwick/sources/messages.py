"""Task messages: decoding, dead letters, and events to send."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import overlay
from ..schemas import TASK_MESSAGE


def decode(messages: DataFrame, body: str = "body", key: str = "msg_key") -> DataFrame:
    """Adds the message's fields and ``broken``: not JSON, or without a videoKey. The id is the key, else taskId, else a hash of the body."""
    m = F.from_json(body, TASK_MESSAGE, {"mode": "PERMISSIVE"})
    df = messages.withColumn("_m", m)
    task_id = F.coalesce(F.nullif(F.col(key), F.lit("")), F.col("_m.taskId"), F.sha2(F.coalesce(F.col(body), F.lit("")), 256))
    slash = F.instr("_m.videoKey", "/")
    fields = {
        "task_id": task_id, "video_key": F.col("_m.videoKey"), "bucket": F.coalesce("_m.bucket", F.when(slash > 0, F.substring_index("_m.videoKey", "/", 1))),
        "sent_at": F.timestamp_millis("_m.timestamp"), "link_name": F.col("_m.linkName"), "submit_date": F.col("_m.submitDate"),
        "custom_data": overlay(F.col("_m.customData")), "broken": F.col("_m.videoKey").isNull(),
    }
    return df.withColumns(fields).drop("_m")


def read_task_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded tasks, and the messages that aren't any, as they came."""
    df = decode(messages)
    return df.where("NOT broken").drop("broken"), df.where("broken").select(*messages.columns)


def stream_task_messages(spark: SparkSession, fmt: str = "kafka", schema: str | None = None, path: str | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """A stream of msg_key and body: a broker's topic from its last offset, or files of such rows."""
    reader = spark.readStream.format(fmt).options(**{"startingOffsets": "latest", "maxOffsetsPerTrigger": "50000"} if fmt == "kafka" else {}).options(**(options or {}))
    df = (reader.schema(schema) if schema else reader).load(*([path] if path else []))
    return df.select(F.col("key").cast("string").alias("msg_key"), F.col("value").cast("string").alias("body")) if fmt == "kafka" else df


def task_event(bucket: Column, object_key: Column, at: Column) -> Column:
    return F.to_json(F.struct(object_key.alias("videoKey"), bucket.alias("bucket"), F.unix_millis(at).alias("timestamp")))


def upload_event(video_key: Column, task_id: Column, at: Column, link_name: Column, submit_date: Column, custom: Column) -> Column:
    """Optional fields that are null or empty are left out."""
    held = F.when(F.size(custom) > 0, custom)
    return F.to_json(F.struct(video_key.alias("videoKey"), task_id.alias("taskId"), F.unix_millis(at).alias("timestamp"), F.nullif(link_name, F.lit("")).alias("linkName"), F.nullif(submit_date, F.lit("")).alias("submitDate"), held.alias("customData")))


def emit(events: DataFrame, path: str | None = None, fmt: str = "kafka", options: Mapping[str, str] | None = None) -> None:
    """Sends rows of key and value to a broker, or appends them as files."""
    writer = events.select("key", "value").write.format(fmt).options(**(options or {})).mode("append")
    writer.save(path) if path else writer.save()
