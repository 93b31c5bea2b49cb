"""Survey records, supplier rates, points of metrics and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SURVEY_RECORD


def read_survey_records(records: DataFrame, activity: str, start: Column, end: Column) -> DataFrame:
    """objId, created_at, data (a variant) and raw of one activity's records in [start, end).

    records: activity, record (JSON whose ``data`` is JSON in a text). Where the
    inner text doesn't parse, data is null and raw keeps it.
    """
    df = records.where(F.col("activity") == activity).select(F.from_json("record", SURVEY_RECORD).alias("r"))
    df = df.select(F.col("r.bizId").alias("objId"), F.try_to_timestamp("r.createdAt", F.lit("yyyy-MM-dd HH:mm:ss")).alias("created_at"), F.try_parse_json("r.data").alias("data"), F.col("r.data").alias("raw"))
    return df.where((F.col("created_at") >= start) & (F.col("created_at") < end))


def supplier_rates_scan(spark: SparkSession, path: str | None = None, fmt: str = "parquet", options: Mapping[str, str] | None = None) -> DataFrame:
    """Live rows of the rate table, from files or a database; the filter reaches the source."""
    reader = spark.read.format(fmt).options(**(options or {}))
    return (reader.load(path) if path else reader.load()).where("deleted = 0")


def append_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """step_executions, quality_checks, metric points and the like are append-only."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


COUNTER, TIMER, GAUGE = "counter", "timer", "gauge"


def metric_points(df: DataFrame, kind: str, metric: str | Column, value: Column, tags: Column, ts: Column) -> DataFrame:
    """One typed point per row: metric, kind, value (a long; milliseconds of a timer), tags (map of texts, none is empty), ts."""
    if kind not in (COUNTER, TIMER, GAUGE):
        raise ValueError(f"no such kind of metric: {kind}")
    name = F.lit(metric) if isinstance(metric, str) else metric
    none = F.create_map().cast("map<string,string>")
    return df.select(name.alias("metric"), F.lit(kind).alias("kind"), value.cast("long").alias("value"), F.coalesce(tags.cast("map<string,string>"), none).alias("tags"), ts.cast("timestamp").alias("ts"))


def rpc_points(df: DataFrame, method: Column, source: Column, business: Column, ms: Column, code: Column, ts: Column) -> DataFrame:
    """A timer ``<method>_duration_ms`` and a counter ``<method>_total`` per call, tagged by method, source, business and status."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    tags = F.create_map(F.lit("method"), known(method), F.lit("source"), known(source), F.lit("business"), known(business), F.lit("status"), F.when(code == 0, "success").otherwise("fail"))
    timer = metric_points(df, TIMER, F.concat(known(method), F.lit("_duration_ms")), ms, tags, ts)
    return timer.unionByName(metric_points(df, COUNTER, F.concat(known(method), F.lit("_total")), F.lit(1), tags, ts))


def metric_sink(points: DataFrame, path: str) -> None:
    """Appends points, by kind and day, so that roll-ups read what they ask for."""
    append_table(points.withColumn("day", F.to_date("ts")), path, by=("kind", "day"))
