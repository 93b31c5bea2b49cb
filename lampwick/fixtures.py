"""The operators' records, derived from the given tables; SQL holds the same derivations for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def evaluation_samples(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    return d.join(t.labels, "doc_id").selectExpr(
        "lang AS biz_type", "source AS stage", "quality = 1 AS success", "CAST(quality AS string) AS expected_label", "CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN toxic = 1 THEN '0' ELSE '1' END END AS predicted_label",
        "CASE WHEN doc_id % 13 <> 0 THEN n_chars END AS latency", "CASE WHEN doc_id % 7 <> 0 THEN n_chars div 4 END AS input_tokens", "doc_id % 200 AS output_tokens", "CASE WHEN doc_id % 5 <> 0 THEN toxic * 0.5D + 0.25D END AS toxicity", "toxic = 1 AS safety_violation",
    )


SAMPLES = """samples AS (
  SELECT d.lang AS biz_type, d.source AS stage, l.quality = 1 AS success, l.quality::VARCHAR AS expected_label,
         CASE WHEN d.doc_id % 9 <> 0 THEN CASE WHEN l.toxic = 1 THEN '0' ELSE '1' END END AS predicted_label,
         CASE WHEN d.doc_id % 13 <> 0 THEN d.n_chars END AS latency, CASE WHEN d.doc_id % 7 <> 0 THEN d.n_chars // 4 END AS input_tokens,
         d.doc_id % 200 AS output_tokens, CASE WHEN d.doc_id % 5 <> 0 THEN l.toxic * 0.5::DOUBLE + 0.25::DOUBLE END AS toxicity, l.toxic = 1 AS safety_violation
  FROM documents d JOIN labels l USING (doc_id))"""


def token_usage(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity * 10 AS bigint) END AS input_tokens", "CAST(l_linenumber * 25 AS bigint) AS output_tokens", "CAST(l_shipdate AS timestamp) AS ts", "l_returnflag AS biz_type", "l_linestatus AS stage")


USAGE = """usage AS (
  SELECT CASE WHEN l_linenumber <> 7 THEN (l_quantity * 10)::BIGINT END AS input_tokens, (l_linenumber * 25)::BIGINT AS output_tokens, l_shipdate::TIMESTAMP AS ts,
         l_returnflag AS biz_type, l_linestatus AS stage FROM lineitem)"""


def execution_log(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS log_id", "o_orderpriority AS biz_type", "CASE WHEN o_custkey % 3 = 0 THEN 'system' ELSE 'extraction' END AS prompt_stage", "concat('v', o_orderkey % 2) AS prompt_version", "CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS validation_status",
        "CAST(floor(o_totalprice) AS bigint) AS response_time_ms", "concat('in', o_custkey) AS input_data", "concat('out', o_orderkey) AS llm_output", "CASE WHEN o_orderstatus = 'F' THEN concat('bad ', o_orderpriority) END AS validation_error", "CAST(o_orderdate AS timestamp) AS created_at",
    )


LOG = """log AS (
  SELECT o_orderkey AS log_id, o_orderpriority AS biz_type, CASE WHEN o_custkey % 3 = 0 THEN 'system' ELSE 'extraction' END AS prompt_stage, 'v' || (o_orderkey % 2) AS prompt_version,
         CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS validation_status, floor(o_totalprice)::BIGINT AS response_time_ms, 'in' || o_custkey AS input_data, 'out' || o_orderkey AS llm_output,
         CASE WHEN o_orderstatus = 'F' THEN 'bad ' || o_orderpriority END AS validation_error, o_orderdate::TIMESTAMP AS created_at FROM orders)"""


def metric_points(t: Tables) -> DataFrame:
    return t.events.selectExpr("event_type AS metric", "CASE event_id % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'timer' ELSE 'gauge' END AS kind", "CAST(round(value * 100) AS bigint) AS value", "map('user', CAST(user_id % 5 AS string), 'app', concat('a', event_id % 2)) AS tags", "ts")


POINTS = """points AS (
  SELECT event_type AS metric, CASE event_id % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'timer' ELSE 'gauge' END AS kind, round(value * 100)::BIGINT AS value,
         'app=a' || (event_id % 2) || ',user=' || (user_id % 5) AS tag_key, ts FROM events)"""


def task_events(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "concat('task_', user_id % 500) AS task_id", "CASE event_id % 7 WHEN 0 THEN 'START' WHEN 4 THEN 'COMPLETE' WHEN 5 THEN 'FAIL' ELSE 'STEP' END AS event", "CASE WHEN event_id % 7 IN (1, 2, 3, 6) THEN CASE WHEN event_id % 2 = 0 THEN 'FrameExtract' ELSE 'Inference' END END AS step_name",
        "CASE WHEN event_id % 7 = 5 THEN concat('failed at ', event_id) END AS error_message", "ts", "event_id AS seq",
    )


TASK_EVENTS = """task_events AS (
  SELECT 'task_' || (user_id % 500) AS task_id, CASE event_id % 7 WHEN 0 THEN 'START' WHEN 4 THEN 'COMPLETE' WHEN 5 THEN 'FAIL' ELSE 'STEP' END AS event,
         CASE WHEN event_id % 7 IN (1, 2, 3, 6) THEN CASE WHEN event_id % 2 = 0 THEN 'FrameExtract' ELSE 'Inference' END END AS step_name,
         CASE WHEN event_id % 7 = 5 THEN 'failed at ' || event_id END AS error_message, ts, event_id AS seq FROM events)"""


def task_states(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "concat('task_', o_orderkey) AS task_id", "o_orderpriority AS task_type", "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'COMPLETED' END AS status", "CASE o_orderkey % 3 WHEN 0 THEN array() WHEN 1 THEN array('FrameExtract') ELSE array('FrameExtract', 'Inference') END AS executed_steps",
        "CAST(o_orderdate AS timestamp) AS created_at", "CAST(o_orderdate AS timestamp) AS updated_at", "CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS timestamp) END AS completed_at", "CASE WHEN o_orderstatus = 'F' THEN 'failed' END AS error_message",
    ).withColumn("executed_steps", F.col("executed_steps").cast("array<string>"))


STATES = """states AS (
  SELECT 'task_' || o_orderkey AS task_id, o_orderpriority AS task_type, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'COMPLETED' END AS status, o_orderkey % 3 AS n_steps,
         o_orderdate::TIMESTAMP AS created_at, o_orderdate::TIMESTAMP AS updated_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate::TIMESTAMP END AS completed_at, CASE WHEN o_orderstatus = 'F' THEN 'failed' END AS error_message FROM orders)"""


def objects(t: Tables) -> DataFrame:
    return t.documents.selectExpr("lang AS bucket", "concat(source, '/', doc_id, CASE doc_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV?sig=1' WHEN 2 THEN '.txt' ELSE '' END) AS object_key", "n_chars * 9000 AS length", "timestamp_seconds(1700000000 + doc_id) AS modified", "doc_id")


OBJECTS = """objects AS (
  SELECT lang AS bucket, source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV?sig=1' WHEN 2 THEN '.txt' ELSE '' END AS object_key, n_chars * 9000 AS length, doc_id FROM documents)"""


def pages(t: Tables) -> DataFrame:
    return t.documents.selectExpr("source AS video_key", "concat('link', doc_id % 3) AS link_name", "concat(source, '/frame_', lpad(doc_id, 9, '0'), '.jpg') AS image_path", "doc_id AS pos", "CAST(doc_id AS int) AS frame_index", "text AS ocr_text")


def page_rules(t: Tables) -> DataFrame:
    """Rules over the words of the texts; configuration, so a fixed table."""
    rows = [
        ("english", ["the", "and"], ["und"], 2, [], None, "Global_dedup", None),
        ("german", ["der", "die", "und"], [], 2, ["[äöü]"], "SlidingWindow_dedup", None, "40"),
        ("licensed", ["license"], [], 1, ["(?i)released|licensed"], None, "CoverageMinSet_dedup", None),
        ("contact", ["@", "555"], ["|"], 1, [r"[0-9]{3}", " "], None, None, None),
        ("unknown", ["the"], [], 1, [], None, None, None),
    ]
    return t.spark.createDataFrame(rows, "page_type string, keywords array<string>, exclude array<string>, min_matches int, verify_regexes array<string>, dedup_strategy string, dedup_rule string, window_size string")


def dedup_input(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    df = t.events.withColumn("frame_index", F.row_number().over(order))
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    ids = F.when(F.col("event_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("k"), (k.try_cast("int") % 5).cast("string")), F.concat(F.lit("e"), (F.col("event_id") % 4).cast("string"))))
    return df.select(F.concat(F.lit("v"), F.col("user_id") % 40).alias("video_key"), F.col("event_type").alias("page_type"), F.concat(F.lit("f_"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".jpg")).alias("image_path"), F.col("event_id").alias("pos"), F.col("frame_index").cast("int").alias("frame_index"), ids.alias("unique_ids"))


DEDUP = """dedup_input AS (
  SELECT 'v' || (user_id % 40) AS video_key, event_type AS page_type, 'f_' || lpad(event_id::VARCHAR, 9, '0') || '.jpg' AS image_path, event_id AS pos, frame_index::INT AS frame_index,
         CASE WHEN event_id % 11 = 0 THEN []::VARCHAR[] ELSE ['k' || ((props->>'k')::INT % 5), 'e' || (event_id % 4)] END AS unique_ids
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS frame_index FROM events))"""


def supplier_rates(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name")
    return t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("n_name AS city_name", "s_name AS partner_name", "CAST(abs(s_acctbal) / 10000 AS decimal(10,6)) AS response_rate", "CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS deleted", "s_suppkey")


RATES = """rates AS (
  SELECT n_name AS city_name, s_name AS partner_name, (abs(s_acctbal) / 10000)::DECIMAL(10,6) AS response_rate, CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS deleted, s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def media_info(t: Tables) -> DataFrame:
    return t.part.selectExpr("concat('bucket/', p_brand, '/', p_partkey, '.mp4') AS path", "p_size * 80 AS width", "p_size * 45 AS height", "CASE WHEN p_partkey % 3 = 0 THEN p_size * 300L END AS nb_frames", "p_size * 10.0D AS duration", "CASE p_partkey % 4 WHEN 0 THEN '25/1' WHEN 1 THEN '30000/1001' WHEN 2 THEN '0/0' ELSE 'x' END AS r_frame_rate", "p_partkey")


MEDIA = """media AS (
  SELECT 'bucket/' || p_brand || '/' || p_partkey || '.mp4' AS path, p_size * 80 AS width, p_size * 45 AS height, CASE WHEN p_partkey % 3 = 0 THEN p_size * 300 END AS nb_frames, p_size * 10.0::DOUBLE AS duration,
         CASE p_partkey % 4 WHEN 0 THEN '25/1' WHEN 1 THEN '30000/1001' WHEN 2 THEN '0/0' ELSE 'x' END AS r_frame_rate, p_partkey FROM part)"""


def examples(t: Tables) -> DataFrame:
    return t.benchmark.selectExpr("item_id AS example_pos", "text AS input", "text AS output", "CASE WHEN item_id % 2 = 0 THEN 'even' END AS label")


def queries_of(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").selectExpr("conv_id * 1000 + turn AS query_id", "text AS query")


def reasoning_steps(t: Tables) -> DataFrame:
    return t.conversations.selectExpr("concat('task_', conv_id) AS task_id", "CAST(turn AS int) AS step_number", "CASE role WHEN 'user' THEN 'observation' WHEN 'assistant' THEN 'thought' ELSE 'action' END AS type", "text AS content", "turn * 1000 AS ts")
