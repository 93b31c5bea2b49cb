"""Queries over tables of numbers, events, tasks and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as X
from ..functions import values as V
from ..operators import classify, dedup, ids, inference, joins, metrics, rollout, similarity, state
from ..sources import messages, objects
from ..sources import tables as src
from ..sources import config
from ..streaming import jobs
from ..workdir import materialise

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- aggregates -------------------------------------------------------------

_ACC = """count(*) AS samples, count_if(success) AS successes, count_if(NOT success) AS failures, count_if(success) / count(*)::DOUBLE AS accuracy,
  coalesce(count_if(success AND expected_label = predicted_label), 0) AS tp, count_if(NOT success AND predicted_label IS NOT NULL) AS fp, count_if(NOT success AND expected_label IS NOT NULL) AS fn"""
_PRF = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall"""
_F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"


@query(f"WITH {fx.SAMPLES}, a AS (SELECT biz_type, {_ACC} FROM samples GROUP BY biz_type), b AS (SELECT *, {_PRF} FROM a) SELECT *, {_F1} FROM b")
def accuracy_metrics(t):
    return metrics.accuracy_metrics(fx.evaluation_samples(t), ["biz_type"])


@query("""SELECT event_type, min(v) AS min, max(v) AS max, sum(v)::BIGINT // count(v) AS avg, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, quantile_disc(v, 0.999) AS p999, count(v) AS n
  FROM (SELECT event_type, round(value * 100)::BIGINT AS v FROM events) GROUP BY event_type""")
def latency_metrics(t):
    return metrics.latency_metrics(t.events.selectExpr("event_type", "CAST(round(value * 100) AS bigint) AS latency"), ["event_type"])


_LAT = """coalesce(sum(latency) FILTER (latency > 0) // count(latency) FILTER (latency > 0), 0)::BIGINT AS avg_latency, coalesce(quantile_disc(latency, 0.95) FILTER (latency > 0), 0) AS p95_latency, coalesce(quantile_disc(latency, 0.99) FILTER (latency > 0), 0) AS p99_latency"""


@query(f"WITH {fx.SAMPLES} SELECT biz_type, {_LAT} FROM samples GROUP BY biz_type")
def latency_eval(t):
    return metrics.latency_eval(fx.evaluation_samples(t), ["biz_type"])


@query("SELECT event_type, count_if(v < 100) AS lt_100, count_if(v >= 100 AND v < 500) AS lt_500, count_if(v >= 500 AND v < 1000) AS lt_1000, count_if(v >= 1000 AND v < 3000) AS lt_3000, count_if(v >= 3000) AS ge_3000 FROM (SELECT event_type, value * 100 AS v FROM events) GROUP BY event_type")
def latency_histogram(t):
    return metrics.latency_histogram(t.events.selectExpr("event_type", "value * 100 AS latency"), ["event_type"])


def cost_sql(by: str, i: float, o: float) -> str:
    return f"""SELECT {by}, si AS input_tokens, so AS output_tokens, si + so AS total_tokens, si // ni AS avg_input, so // no AS avg_output, (si + so) // n AS avg_total, n AS requests, si * {i} / 1000 + so * {o} / 1000 AS cost, (si * {i} / 1000 + so * {o} / 1000) / n AS cost_per_request
  FROM (SELECT {by}, coalesce(sum(input_tokens) FILTER (input_tokens > 0), 0)::BIGINT AS si, coalesce(sum(output_tokens) FILTER (output_tokens > 0), 0)::BIGINT AS so, count(*) FILTER (input_tokens > 0) AS ni, count(*) FILTER (output_tokens > 0) AS no, count(*) AS n FROM usage GROUP BY {by})"""


_COST = cost_sql("biz_type, stage", 0.005, 0.015)


@query(f"WITH {fx.USAGE} {_COST}")
def cost_metrics(t):
    return metrics.cost_metrics(fx.token_usage(t), ["biz_type", "stage"])


@query(f"WITH {fx.USAGE} SELECT biz_type, stage, requests, total_tokens, cost FROM ({_COST})")
def cost_by_biz_stage(t):
    return metrics.cost_by_biz_stage(fx.token_usage(t))


_TOK = """coalesce(sum(input_tokens) FILTER (input_tokens > 0) // count(*) FILTER (input_tokens > 0), 0)::BIGINT AS avg_input_tokens, coalesce(sum(output_tokens) FILTER (output_tokens > 0) // count(*) FILTER (output_tokens > 0), 0)::BIGINT AS avg_output_tokens"""
_TOK_COST = "avg_input_tokens * 0.001 / 1000 + avg_output_tokens * 0.002 / 1000 AS cost_per_request"


@query(f"WITH {fx.SAMPLES} SELECT *, {_TOK_COST} FROM (SELECT biz_type, {_TOK} FROM samples GROUP BY biz_type)")
def cost_eval(t):
    return metrics.cost_eval(fx.evaluation_samples(t), ["biz_type"])


_SAFE = "coalesce(avg(toxicity), 0) AS avg_toxicity, count_if(safety_violation) AS violations"


@query(f"WITH {fx.SAMPLES} SELECT biz_type, {_SAFE} FROM samples GROUP BY biz_type")
def safety_eval(t):
    return metrics.safety_eval(fx.evaluation_samples(t), ["biz_type"])


@query(f"""WITH {fx.SAMPLES}, a AS (SELECT biz_type, stage, {_ACC}, {_LAT}, {_TOK}, {_SAFE} FROM samples GROUP BY biz_type, stage), b AS (SELECT *, {_PRF} FROM a) SELECT *, {_F1}, {_TOK_COST} FROM b""")
def comprehensive_eval(t):
    return metrics.comprehensive_eval(fx.evaluation_samples(t))


_NOW = "TIMESTAMP '1997-03-02 00:00:00'"


def now():
    return F.lit("1997-03-02 00:00:00").cast("timestamp")


_WINDOW = f"""w AS (SELECT biz_type, prompt_stage, count(*) AS total, count_if(validation_status = 'SUCCESS') AS success, count_if(validation_status <> 'SUCCESS') AS failure, count_if(validation_status = 'SUCCESS') / count(*)::DOUBLE AS success_rate,
  avg(response_time_ms) AS avg_response_ms, count(*) >= 100 AS enough_samples FROM log WHERE created_at > {_NOW} - INTERVAL 2400 HOURS AND created_at <= {_NOW} AND VERSION GROUP BY ALL)"""


@query(f"WITH {fx.LOG}, {_WINDOW.replace('VERSION', 'prompt_version = ' + chr(39) + 'v1' + chr(39))} SELECT * FROM w")
def evaluate_window(t):
    return metrics.evaluate_window(fx.execution_log(t), now(), 2400, "v1")


@query(f"""WITH {fx.POINTS} SELECT metric, kind, tag_key, (sum(value) FILTER (kind = 'counter'))::BIGINT AS total, count(*) FILTER (kind = 'timer') AS count, (sum(value) FILTER (kind = 'timer'))::BIGINT AS sum, max(value) FILTER (kind = 'timer') AS max,
  arg_max(value, (ts, value)) FILTER (kind = 'gauge') AS last FROM points GROUP BY metric, kind, tag_key""")
def metrics_rollup(t):
    return metrics.metrics_rollup(fx.metric_points(t))


@query("""SELECT event_type AS method, CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE 's' || (user_id % 4) END AS source, 'b' || (event_id % 2) AS business, CASE WHEN event_type = 'error' THEN 'fail' ELSE 'success' END AS status,
  count(*) AS calls, sum(round(value)::BIGINT)::BIGINT AS duration_ms, max(round(value)::BIGINT) AS max_ms FROM events GROUP BY ALL""")
def rpc_rollup(t):
    calls = t.events.selectExpr("event_type AS method", "CASE WHEN user_id % 4 <> 0 THEN concat('s', user_id % 4) END AS source", "concat('b', event_id % 2) AS business", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS code", "CAST(round(value) AS bigint) AS duration_ms")
    return metrics.rpc_rollup(calls)


@query(f"""WITH {fx.USAGE} SELECT biz_type, 'input_tokens' AS counter, coalesce(sum(input_tokens), 0)::BIGINT AS tokens FROM usage GROUP BY biz_type UNION ALL SELECT biz_type, 'output_tokens', sum(output_tokens)::BIGINT FROM usage GROUP BY biz_type
  UNION ALL SELECT biz_type, 'total_tokens', sum(coalesce(input_tokens, 0) + output_tokens)::BIGINT FROM usage GROUP BY biz_type""")
def token_usage_rollup(t):
    return metrics.token_usage_rollup(fx.token_usage(t))


@query(f"WITH {fx.STATES} SELECT status, count(*) AS tasks FROM states GROUP BY status")
def task_status_counts(t):
    return metrics.task_status_counts(fx.task_states(t))


@query("SELECT event_type AS step_name, CASE WHEN event_id % 3 = 0 THEN 'FAILED' ELSE 'OK' END AS status, count(*) AS steps FROM events GROUP BY ROLLUP (1, 2)")
def step_status_counts(t):
    return metrics.step_status_counts(t.events.selectExpr("event_type AS step_name", "CASE WHEN event_id % 3 = 0 THEN 'FAILED' ELSE 'OK' END AS status"))


@query("SELECT source AS video_key, count_if(doc_id % 6 <> 0 AND trim(text) <> '') AS with_text, count_if(NOT (doc_id % 6 <> 0 AND trim(text) <> '')) AS blank FROM documents GROUP BY source")
def ocr_outcome_counts(t):
    df = fx.pages(t).withColumn("ocr_text", F.when(F.col("pos") % 6 != 0, F.col("ocr_text")))
    return metrics.ocr_outcome_counts(df, ["video_key"])


@query(f"WITH {fx.DEDUP} SELECT DISTINCT video_key, page_type, unnest(unique_ids) AS id FROM dedup_input")
def distinct_ids(t):
    return metrics.distinct_ids(fx.dedup_input(t))


@query("SELECT 'img' || conv_id AS image_path, string_agg(text, ',' ORDER BY turn) AS merged_text FROM conversations WHERE text <> '' GROUP BY conv_id")
def merge_text_lines(t):
    return metrics.merge_text_lines(t.conversations.selectExpr("concat('img', conv_id) AS image_path", "turn AS pos", "text"))


# -- joins and sets ---------------------------------------------------------


@query(f"WITH {fx.OBJECTS} SELECT bucket, object_key, length, lower(regexp_replace(regexp_extract(object_key, '\\.([^.]+)$', 1), '\\?.*$', '')) AS ext FROM objects WHERE doc_id % 4 < 2")
def filter_media_ext(t):
    return objects.filter_media_ext(fx.objects(t)).select("bucket", "object_key", "length", X.media_extension(F.col("object_key")).alias("ext"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND n_chars * 9000 <= 10485760")
def filter_media_type_size(t):
    df = t.documents.selectExpr("doc_id", "concat('a/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.PNG' ELSE '.pdf' END) AS object_key", "n_chars * 9000 AS length")
    return objects.filter_media_type_size(df).select("doc_id")


@query("SELECT DISTINCT source AS prefix FROM documents")
def list_prefixes(t):
    return objects.list_prefixes(fx.objects(t))


def _processed(t):
    return fx.objects(t).where("doc_id % 5 = 0").select("bucket", "object_key", F.lit("2024-01-01").cast("timestamp").alias("processed_at"))


@query(f"WITH {fx.OBJECTS} SELECT bucket, object_key, length FROM objects WHERE doc_id % 5 <> 0")
def new_objects(t):
    return joins.new_objects(fx.objects(t), _processed(t)).select("bucket", "object_key", "length")


@query(f"""WITH {fx.OBJECTS} SELECT bucket, object_key, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 <> 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-15' END AS processed_at FROM objects WHERE doc_id % 5 = 0 OR doc_id % 2 = 0""")
def mark_processed(t):
    at = F.lit("2024-01-15").cast("timestamp")
    return state.mark_processed(_processed(t), fx.objects(t).where("doc_id % 2 = 0"), at)


@query(f"""WITH {fx.OBJECTS} SELECT 'ok' AS kind, '{{"videoKey":"' || object_key || '","bucket":"' || bucket || '","timestamp":' || (1700000000 + doc_id) * 1000 || '}}' AS event FROM objects WHERE doc_id % 4 < 2 AND doc_id % 5 <> 0""")
def scan_job(t):
    fresh = joins.new_objects(objects.filter_media_ext(fx.objects(t)), _processed(t))
    return fresh.select(F.lit("ok").alias("kind"), messages.task_event(F.col("bucket"), F.col("object_key"), F.col("modified")).alias("event"))


@query("""SELECT doc_id, '{"videoKey":"' || source || '","taskId":"t' || doc_id || '","timestamp":1700000000000' || CASE WHEN doc_id % 2 = 0 THEN ',"linkName":"' || lang || '"' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ',"customData":{"k":"' || lang || '"}' ELSE '' END || '}' AS event FROM documents""")
def emit_upload_events(t):
    custom = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("k"), F.col("lang")))
    e = messages.upload_event(F.col("source"), F.concat(F.lit("t"), F.col("doc_id").cast("string")), F.timestamp_seconds(F.lit(1700000000)), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""), F.lit(None).cast("string"), custom)
    return t.documents.select("doc_id", e.alias("event"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'dead' ELSE 'task' END AS kind, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'key' || doc_id ELSE 't' || doc_id END AS task_id, CASE WHEN doc_id % 4 <> 0 THEN source || '/v.mp4' END AS video_key, CASE WHEN doc_id % 4 <> 0 THEN source END AS bucket, CASE WHEN doc_id % 4 <> 0 THEN lang END AS a FROM documents""")
def read_task_messages(t):
    k = F.col("doc_id")
    body = F.concat(F.lit('{"videoKey":"'), "source", F.lit('/v.mp4","taskId":"t'), k.cast("string"), F.lit('","customData":{"a":"'), "lang", F.lit('"}}'))
    df = t.documents.select("doc_id", F.when(k % 4 == 1, F.concat(F.lit("key"), k.cast("string"))).otherwise("").alias("msg_key"), F.when(k % 8 == 0, "no json").when(k % 4 == 0, '{"bucket":"b"}').otherwise(body).alias("body"))
    good, dead = messages.read_task_messages(df)
    none = F.lit(None).cast("string")
    return good.select("doc_id", F.lit("task").alias("kind"), "task_id", "video_key", "bucket", F.col("custom_data.a").alias("a")).unionByName(dead.select("doc_id", F.lit("dead").alias("kind"), none.alias("task_id"), none.alias("video_key"), none.alias("bucket"), none.alias("a")))


@query("""SELECT page_id AS obj_id, 'v' || (page_id % 3) AS value, (TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * page_id)::TIMESTAMP AS created_at FROM pages WHERE page_id % 2 = 0 AND page_id < 48""")
def read_survey_records(t):
    k = F.col("page_id")
    inner = F.concat(F.lit('{"x":"v'), (k % 3).cast("string"), F.lit('"}'))
    at = F.date_format(F.timestamp_seconds(k * 3600 + 1704067200), "yyyy-MM-dd HH:mm:ss")
    record = F.to_json(F.struct(k.cast("string").alias("bizId"), at.alias("createdAt"), inner.alias("data")))
    df = t.pages.select(F.when(k % 2 == 0, "a").otherwise("b").alias("activity"), record.alias("record"))
    got = src.read_survey_records(df, "a", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03").cast("timestamp"))
    return got.select(F.col("objId").cast("long").alias("obj_id"), F.try_variant_get("data", "$.x", "string").alias("value"), "created_at")


@query("""SELECT 'n' || page_id AS namespace, unnest(['a', 'b']) AS key, unnest([CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'x y' ELSE '1' END, CASE page_id % 3 WHEN 0 THEN '{"c":1}' WHEN 1 THEN 'p:q' ELSE url END]) AS value FROM pages""")
def read_config_table(t):
    k = F.col("page_id")
    body = F.when(k % 3 == 0, F.concat(F.lit(' {"a":"'), "url", F.lit('","b":{"c": 1}}'))).when(k % 3 == 1, "# note\na='x y'\n\nb=p:q").otherwise(F.concat(F.lit("a: 1\r\n# x\nb: "), "url"))
    df = t.pages.select(F.concat(F.lit("n"), k.cast("string")).alias("namespace"), body.alias("content"))
    return config.read_config_table(df)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS ocr_text FROM documents")
def page_text_join(t):
    texts = t.documents.where("doc_id % 3 <> 0").selectExpr("concat('i', doc_id) AS image_path", "text AS ocr_text")
    return joins.page_text_join(t.documents.selectExpr("doc_id", "concat('i', doc_id) AS image_path"), texts).select("doc_id", "ocr_text")


@query(f"WITH {fx.RATES} SELECT city_name, partner_name, response_rate::VARCHAR AS rate FROM rates WHERE deleted = 0")
def supplier_rates_scan(t):
    return fx.supplier_rates(t).where("deleted = 0").select("city_name", "partner_name", F.col("response_rate").cast("string").alias("rate"))


@query(f"""WITH {fx.RATES} SELECT c_custkey, n_name AS city_name, coalesce(CASE WHEN deleted = 0 THEN response_rate::VARCHAR END, '') AS o_supplier_rate
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN rates ON city_name = n_name AND s_suppkey = c_custkey % 100""")
def supplier_rate_lookup(t):
    probes = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("city_name"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 100).cast("string"), 9, "0")).alias("partner_name"))
    return joins.supplier_rate_lookup(probes, fx.supplier_rates(t)).select("c_custkey", "city_name", "o_supplier_rate")


def _cities(t):
    return t.nation.selectExpr("concat(n_name, CASE WHEN n_nationkey % 2 = 0 THEN '市' ELSE '' END) AS name", "n_nationkey AS city_id")


@query("SELECT c_custkey, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '市' ELSE '' END AS std_city, n_nationkey AS city_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def city_id_lookup(t):
    df = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("city_name"))
    return joins.city_id_lookup(df, _cities(t)).select("c_custkey", "std_city", "city_id")


@query("""WITH c AS (SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '市' ELSE '' END AS name FROM nation), p AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'NATION_' || (c_custkey % 30) || '市x' END AS part FROM customer)
  SELECT c_custkey, coalesce((SELECT name FROM c WHERE contains(part, name) ORDER BY length(name) DESC, name LIMIT 1), part) AS city FROM p""")
def city_contains_lookup(t):
    k = F.col("c_custkey")
    df = t.customer.select("c_custkey", F.concat(F.lit("prov-x-"), F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("NATION_"), (k % 30).cast("string"), F.lit("市x")))).alias("province_city"))
    return joins.city_contains_lookup(df, _cities(t)).select("c_custkey", "city")


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS biz, 'p' || (o_orderkey % 50) AS prompt, CASE WHEN o_orderkey % 7 <> 0 THEN 'i' || (o_orderkey % 3) END AS image FROM orders),
  c AS (SELECT 'llm_cache:' || o_orderpriority || ':' || sha256('p' || (o_orderkey % 50)) || ':' || sha256('i' || (o_orderkey % 3)) AS cache_key, 'c' || o_orderkey AS content, o_orderkey * 1000 AS ts FROM orders WHERE o_orderkey % 4 = 0),
  n AS (SELECT cache_key, arg_max(content, ts) AS content, max(ts) AS ts FROM c GROUP BY cache_key)
  SELECT k, 'llm_cache:' || biz || ':' || sha256(prompt) || ':' || sha256(image) AS cache_key, coalesce(1000000000 - ts < 1000::BIGINT * CASE WHEN biz = '1-URGENT' THEN 999900 WHEN biz = '2-HIGH' THEN 2592000 ELSE 604800 END, false) AS hit,
    CASE WHEN 1000000000 - ts < 1000::BIGINT * CASE WHEN biz = '1-URGENT' THEN 999900 WHEN biz = '2-HIGH' THEN 2592000 ELSE 604800 END THEN content END AS cached_content
  FROM r LEFT JOIN n ON n.cache_key = 'llm_cache:' || biz || ':' || sha256(prompt) || ':' || sha256(image)""")
def cached_inference_join(t):
    k = F.col("o_orderkey")
    prompt, image = F.concat(F.lit("p"), (k % 50).cast("string")), F.concat(F.lit("i"), (k % 3).cast("string"))
    req = t.orders.select(k.alias("k"), F.col("o_orderpriority").alias("biz_type"), prompt.alias("prompt"), F.when(k % 7 != 0, image).alias("image_url"))
    cache = t.orders.where("o_orderkey % 4 = 0").select(joins.cache_key(F.col("o_orderpriority"), prompt, image).alias("cache_key"), F.concat(F.lit("c"), k.cast("string")).alias("content"), (k * 1000).alias("ts"), F.col("o_orderpriority").alias("business_name"))
    cache = joins.cache_put(cache.limit(0), cache)
    ttls = t.spark.createDataFrame([("1-URGENT", "999900"), ("2-HIGH", "9999999"), ("3-MEDIUM", "x")], "biz_type string, ttl string")
    return joins.cached_inference_join(req, cache, ttls, F.lit(1000000 * 1000)).select("k", "cache_key", "hit", "cached_content")


@query("""WITH a AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'GAODE' WHEN 1 THEN 'XIAOLA' ELSE 'B' || (o_orderkey % 3) END AS biz, CASE WHEN o_orderkey % 2 = 0 THEN 'extraction' ELSE 'system' END AS stage, CASE o_orderkey % 5 WHEN 0 THEN 'v1' WHEN 1 THEN 'v9' END AS version FROM orders)
  SELECT k, CASE WHEN version = 'v1' AND biz IN ('B0', 'B1') AND stage = 'extraction' THEN 'exact' WHEN version IS NULL AND biz = 'B0' AND stage = 'extraction' THEN 'exact' WHEN version IS NULL AND biz = 'B2' THEN 'latest' ELSE 'default' END AS resolved FROM a""")
def template_resolve(t):
    from ..functions.prompts import DEFAULT_TEMPLATES

    asked = t.orders.selectExpr("o_orderkey AS k", "CASE o_orderkey % 4 WHEN 0 THEN 'GAODE' WHEN 1 THEN 'XIAOLA' ELSE concat('B', o_orderkey % 3) END AS biz_type", "CASE WHEN o_orderkey % 2 = 0 THEN 'extraction' ELSE 'system' END AS stage", "CASE o_orderkey % 5 WHEN 0 THEN 'v1' WHEN 1 THEN 'v9' END AS version")
    kept = t.spark.createDataFrame([("B0", "extraction", "v1", "b0v1"), ("B1", "extraction", "v1", "b1v1"), ("B0", "extraction", None, "b0"), ("B2", "extraction", "latest", "b2"), ("B2", "system", "latest", "b2s")], "biz_type string, stage string, version string, template string")
    defaults = t.spark.createDataFrame(DEFAULT_TEMPLATES, "biz_type string, stage string, template string")
    return joins.template_resolve(asked, kept, defaults).select("k", "resolved")


# -- tasks and results ------------------------------------------------------

_WRITES = """writes AS (SELECT 'task_' || (event_id % 700) AS task_id, event_type AS task_type, CASE event_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, ts, 'link' || event_id AS link_name, CASE WHEN event_id % 2 = 0 THEN 'c' || event_id END AS llm_content, event_id AS seq FROM events)"""


def _writes(t):
    none = F.lit(None)
    return t.events.selectExpr("concat('task_', event_id % 700) AS task_id", "event_type AS task_type", "CASE event_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS status", "ts", "concat('link', event_id) AS link_name", "CASE WHEN event_id % 2 = 0 THEN concat('c', event_id) END AS llm_content", "event_id AS seq").withColumns(
        {"created_at": F.col("ts"), "updated_at": F.col("ts"), "completed_at": none.cast("timestamp"), "video_key": F.col("task_type"), "submit_date": none.cast("string"), "image_count": none.cast("int"), "ocr_text_count": none.cast("int"), "custom_data": none.cast("string")}
    )


@query(f"WITH {_WRITES}, f AS (SELECT task_id, arg_min(link_name, seq) AS link_name, arg_min(task_type, seq) AS task_type, max(seq) AS last FROM writes GROUP BY task_id) SELECT f.task_id, f.link_name, f.task_type, w.status, w.llm_content, w.ts AS updated_at FROM f JOIN writes w ON w.seq = f.last")
def upsert_results(t):
    return state.upsert_results(_writes(t)).select("task_id", "link_name", "task_type", "status", "llm_content", "updated_at")


@query("""SELECT conv_id, count(*)::INT AS image_count, NULL::INT AS ocr_text_count, '{"k":"' || conv_id || '"}' AS custom_data FROM conversations GROUP BY conv_id""")
def build_result_row(t):
    df = t.conversations.groupBy("conv_id").agg(F.collect_list("text").alias("image_paths")).withColumns({"ocr_text_by_image": F.lit(None).cast("map<string,string>"), "custom": F.create_map(F.lit("k"), F.col("conv_id").cast("string")), "task_id": F.col("conv_id").cast("string")})
    rest = {c: F.lit(None).cast("string") for c in state.RESULT_COLUMNS if c not in df.columns and c not in ("image_count", "ocr_text_count", "custom_data")}
    return state.build_result_row(df.withColumns(rest)).select(F.col("task_id").cast("long").alias("conv_id"), "image_count", "ocr_text_count", "custom_data")


@query(f"WITH {_WRITES} SELECT task_id, arg_max(status, ts) AS status, max(ts) AS updated_at FROM writes GROUP BY task_id HAVING max(ts) > TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS")
def state_snapshot(t):
    df = _writes(t).select("task_id", "status", "updated_at")
    return state.state_snapshot(df, F.lit("2024-01-31").cast("timestamp")).select("task_id", "status", "updated_at")


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def latest_by_key(t):
    return state.latest_by_key(t.events.select("event_type", "event_id", F.struct("ts", "event_id").alias("o")), ["event_type"], "o").select("event_type", "event_id")


_FOLD = f"""WITH {fx.TASK_EVENTS}, s AS (SELECT *, CASE event WHEN 'START' THEN 'RUNNING' WHEN 'COMPLETE' THEN 'COMPLETED' WHEN 'FAIL' THEN 'FAILED' END AS st FROM task_events),
  steps AS (SELECT task_id, string_agg(step_name, ',' ORDER BY first_at) AS executed FROM (SELECT task_id, step_name, min((ts, seq)) AS first_at FROM s WHERE event = 'STEP' GROUP BY task_id, step_name) GROUP BY task_id)
  SELECT s.task_id, coalesce(arg_max(st, (ts, seq)) FILTER (st IS NOT NULL), 'PENDING') AS status, coalesce(any_value(executed), '') AS executed, min(ts) AS created_at, max(ts) AS updated_at, max(ts) FILTER (event = 'COMPLETE') AS completed_at,
    arg_max(error_message, (ts, seq)) FILTER (event = 'FAIL') AS error_message FROM s LEFT JOIN steps USING (task_id) GROUP BY s.task_id"""


@query(_FOLD)
def task_state_fold(t):
    return state.fold_task_events(fx.task_events(t)).withColumn("executed", F.array_join("executed_steps", ",")).drop("executed_steps")


@query(f"WITH {fx.STATES} SELECT task_id, step, step_order::INT AS step_order FROM states, (VALUES ('FrameExtract', 0), ('Inference', 1)) v(step, step_order) WHERE step_order >= n_steps")
def step_pending(t):
    return state.step_pending(fx.task_states(t), ["FrameExtract", "Inference"])


@query(f"WITH {fx.STATES} SELECT task_id, status, (n_steps * 50)::INT AS progress, created_at, completed_at, error_message FROM states")
def task_status(t):
    return state.task_status(fx.task_states(t)).drop("updated_at")


@query(f"WITH {fx.STATES} SELECT task_id, created_at, (SELECT count(*) FROM states WHERE status = 'FAILED') AS total FROM states WHERE status = 'FAILED' ORDER BY created_at DESC, task_id LIMIT 20 OFFSET 20")
def task_list(t):
    return state.task_list(fx.task_states(t), "FAILED", None, 2).select("task_id", "created_at", "total")


@query("SELECT 'task_' || conv_id AS task_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS run, role AS step_name, 1500::BIGINT * turn AS duration_ms FROM conversations")
def write_step_executions(t):
    at = F.lit("2024-01-01").cast("timestamp")
    run = F.struct("turn", F.col("role").alias("step_name"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("error_message"), at.alias("started_at"), F.timestamp_millis(F.unix_millis(at) + F.col("turn") * 1500).alias("ended_at"))
    df = t.conversations.groupBy(F.concat(F.lit("task_"), "conv_id").alias("task_id")).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    return state.step_executions(df).select("task_id", "run", "step_name", "duration_ms")


def rules() -> inference.Rules:
    r = inference.Rules()
    r.register("short", lambda: F.length("content") < 3000, "too long")
    r.register("plain", lambda: ~F.col("content").contains("|"), "has bars")
    r.register("typed", lambda: F.col("content").cast("string").isNotNull(), "empty")
    return r


@query("""SELECT doc_id, length(text) < 3000 AS short, NOT contains(text, '|') AS plain FROM documents""")
def run_rules(t):
    df = inference.run_rules(t.documents.select("doc_id", F.col("text").alias("content")), rules())
    return df.select("doc_id", F.get("results", F.lit(0))["valid"].alias("short"), F.get("results", F.lit(1))["valid"].alias("plain"))


_DUAL = """d AS (SELECT doc_id, text, concat_ws('; ', CASE WHEN length(text) >= 3000 THEN 'short: too long' END, CASE WHEN contains(text, '|') THEN 'plain: has bars' END, CASE WHEN doc_id % 10 = 0 THEN '发现矛盾' END) AS errors FROM documents)"""


def _dual(t):
    verdict = F.when(F.col("doc_id") % 10 == 0, "发现矛盾").otherwise("验证通过")
    return inference.dual_check(t.documents.select("doc_id", F.concat(F.lit("task_"), "doc_id").alias("task_id"), F.col("text").alias("content"), verdict.alias("verdict")), rules())


@query(f"WITH {_DUAL} SELECT doc_id, errors = '' AS valid, errors FROM d")
def dual_check(t):
    return _dual(t).select("doc_id", "valid", F.array_join("errors", "; ").alias("errors"))


@query("""SELECT 'task_' || doc_id AS task_id, unnest(['short', 'plain', 'typed']) AS check_type, unnest([CASE WHEN length(text) < 3000 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN contains(text, '|') THEN 'FAIL' ELSE 'PASS' END, 'PASS']) AS check_result FROM documents""")
def write_quality_checks(t):
    return state.quality_checks(_dual(t)).select("task_id", "check_type", "check_result")


# -- rollout ----------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND h % 10000 < CASE o_orderpriority WHEN '1-URGENT' THEN 5000 ELSE 1000 END THEN 'new' END AS canary_version
  FROM (SELECT *, abs(CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END) AS h FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split('task_' || o_orderkey, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS c FROM orders))""")
def canary_assign(t):
    tasks = t.orders.select("o_orderkey", F.concat(F.lit("task_"), "o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("biz_type"), F.lit("extraction").alias("stage"))
    rows = [("1-URGENT", "extraction", "new", 0.5, True, 2), ("1-URGENT", "extraction", "old", 0.9, True, 1), ("2-HIGH", "extraction", "new", 0.1, True, 1), ("5-LOW", "extraction", "new", 1.0, False, 1)]
    canaries = t.spark.createDataFrame(rows, "biz_type string, stage string, version string, ratio double, enabled boolean, published_at int")
    return rollout.canary_assign(tasks, canaries).select("o_orderkey", "canary_version")


@query("""SELECT o_orderkey, (abs(CASE WHEN c >= 2147483648 THEN c - 4294967296 ELSE c END) % 10000) / 10000.0::DOUBLE AS share FROM (SELECT o_orderkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split('task_' || o_orderkey, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296) AS c FROM orders)""")
def canary_bucket(t):
    return t.orders.select("o_orderkey", V.canary_share(F.concat(F.lit("task_"), "o_orderkey")).alias("share"))


_COMPARE = """cmp AS (SELECT biz_type, prompt_stage, prompt_version, n, good / n::DOUBLE AS version_rate, sum(good) OVER w / sum(n) OVER w::DOUBLE AS baseline_rate FROM (SELECT biz_type, prompt_stage, prompt_version, count(*) AS n, count_if(validation_status = 'SUCCESS') AS good FROM log GROUP BY ALL) WINDOW w AS (PARTITION BY biz_type, prompt_stage))"""


@query(f"WITH {fx.LOG}, {_COMPARE} SELECT *, baseline_rate - version_rate AS drop, baseline_rate - version_rate > 0.05 AS rollback FROM cmp")
def canary_compare(t):
    return rollout.canary_compare(fx.execution_log(t))


@query(f"WITH {fx.LOG}, {_COMPARE} SELECT biz_type, prompt_stage, prompt_version, baseline_rate - version_rate AS drop FROM cmp WHERE baseline_rate - version_rate > 0.002")
def rollback_plan(t):
    return rollout.rollback_plan(fx.execution_log(t), 0.002)


@query(f"WITH {fx.LOG}, {_WINDOW.replace('VERSION', 'true')} SELECT biz_type, prompt_stage, total, failure, success_rate FROM w WHERE success_rate < 0.9 AND failure > 0")
def rollout_plan(t):
    return rollout.rollout_plan(fx.execution_log(t), now(), 2400)


@query(f"WITH {fx.LOG} SELECT log_id, biz_type, prompt_stage, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY biz_type, prompt_stage ORDER BY created_at DESC, log_id DESC) AS rank FROM log WHERE validation_status <> 'SUCCESS') WHERE rank <= 50")
def recent_failures_top_n(t):
    return rollout.recent_failures(fx.execution_log(t)).select("log_id", "biz_type", "prompt_stage", "rank")


@query(f"WITH {fx.LOG} SELECT log_id, biz_type, prompt_stage, input_data, validation_error FROM (SELECT *, row_number() OVER (PARTITION BY biz_type, prompt_stage ORDER BY created_at DESC, log_id DESC) AS rank FROM log WHERE validation_status <> 'SUCCESS' AND created_at > {_NOW} - INTERVAL 2400 HOURS AND created_at <= {_NOW}) WHERE rank <= 20")
def filter_failure_cases(t):
    return rollout.filter_failure_cases(fx.execution_log(t), now(), 2400, 20).select("log_id", "biz_type", "prompt_stage", "input_data", "validation_error")


_CAND = "cand AS (SELECT p_brand AS biz, p_partkey AS pos, (p_partkey % 100) / 100.0::DOUBLE AS accuracy, p_size / 1000.0::DOUBLE AS cost, ((p_partkey * 37) % 4000)::DOUBLE AS latency FROM part)"


def _candidates(t):
    return t.part.selectExpr("p_brand AS biz", "p_partkey AS pos", "(p_partkey % 100) / 100.0D AS accuracy", "p_size / 1000.0D AS cost", "CAST((p_partkey * 37) % 4000 AS double) AS latency")


@query(f"WITH {_CAND}, s AS (SELECT *, 0.5::DOUBLE * accuracy + 0.3::DOUBLE * (1 - least(1.0::DOUBLE, cost / 0.05::DOUBLE)) + 0.2::DOUBLE * (1 - least(1.0::DOUBLE, latency / 3000.0::DOUBLE)) AS score FROM cand) SELECT biz, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY biz ORDER BY score DESC, pos) AS k FROM s) WHERE k = 1")
def candidate_top1(t):
    return rollout.candidate_top1(_candidates(t), ["biz"]).select("biz", "pos", "score")


@query(f"WITH {_CAND} SELECT biz, pos FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE a.biz = b.biz AND b.accuracy >= a.accuracy AND b.cost <= a.cost AND b.latency <= a.latency AND (b.accuracy > a.accuracy OR b.cost < a.cost OR b.latency < a.latency))")
def pareto_front(t):
    return rollout.pareto_front(_candidates(t), ["biz"]).select("biz", "pos")


# -- values -----------------------------------------------------------------


@query(f"""WITH {fx.MEDIA} SELECT p_partkey, CASE WHEN s >= 2160 THEN '4K (2160p)' WHEN s >= 1440 THEN '2K (1440p)' WHEN s >= 1080 THEN '1080p' WHEN s >= 720 THEN '720p' WHEN s >= 480 THEN '480p' WHEN s >= 360 THEN '360p' WHEN s >= 240 THEN '240p' ELSE width || 'x' || height || ' (低清)' END AS tier FROM (SELECT *, least(width, height) AS s FROM media)""")
def quality_tier(t):
    return fx.media_info(t).select("p_partkey", V.quality_tier(F.col("width"), F.col("height")).alias("tier"))


@query("SELECT doc_id, CASE WHEN b < 1048576 THEN '<1MB' WHEN b < 10485760 THEN '1-10MB' WHEN b < 104857600 THEN '10-100MB' WHEN b < 524288000 THEN '100-500MB' ELSE '500MB+' END AS bucket FROM (SELECT doc_id, n_chars * 9000 AS b FROM documents)")
def file_size_bucket(t):
    return t.documents.select("doc_id", V.size_bucket(F.col("n_chars") * 9000).alias("bucket"))


_FPS = """fps AS (SELECT *, CASE WHEN nb_frames / duration > 1 AND nb_frames / duration < 120 THEN nb_frames / duration WHEN p_partkey % 4 = 0 THEN 25 WHEN p_partkey % 4 = 1 THEN 30000 / 1001.0::DOUBLE ELSE 30 END AS fps FROM (SELECT * FROM media))""".replace("WHEN p_partkey % 4 = 1 THEN 30000 / 1001.0::DOUBLE ", "")


@query(f"WITH {fx.MEDIA}, {_FPS} SELECT p_partkey, fps::DOUBLE AS fps FROM fps")
def derive_fps(t):
    return fx.media_info(t).select("p_partkey", V.derive_fps(F.col("nb_frames"), F.col("duration"), F.col("r_frame_rate")).alias("fps"))


@query(f"""WITH {fx.MEDIA}, {_FPS}, p AS (SELECT p_partkey, greatest(1, (fps * 5)::INT) AS step, (fps * duration)::INT AS n FROM fps)
  SELECT p_partkey, frame::INT AS frame, p_partkey || '_' || lpad((frame // step + 1)::VARCHAR, 4, '0') || '.jpg' AS image FROM (SELECT *, unnest(range(0, n, step)) AS frame FROM p)""")
def frame_plan(t):
    df = fx.media_info(t)
    fps = V.derive_fps(F.col("nb_frames"), F.col("duration"), F.col("r_frame_rate"))
    df = df.select("p_partkey", X.file_stem(F.col("path")).alias("stem"), V.frame_step(fps, F.lit(5)).alias("step"), (fps * F.col("duration")).cast("int").alias("n"))
    df = df.where("n > 0").select("p_partkey", "stem", "step", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.col("step"))).alias("frame"))
    return df.select("p_partkey", "frame", F.format_string("%s_%04d.jpg", "stem", (F.col("frame") / F.col("step")).cast("int") + 1).alias("image"))


@query("""SELECT l_orderkey, l_linenumber, (least(a, b) + least(greatest(a, b), c)) / 2 AS x, 5.0::DOUBLE AS y, greatest(a, b, c, d) AS w, l_tax * 100 + 5 AS h FROM (SELECT l_orderkey, l_linenumber, l_tax, l_quantity AS a, l_quantity AS b, l_quantity + 100 AS c, l_quantity + 100 AS d FROM lineitem)""")
def polygon_to_box(t):
    q, h = F.col("l_quantity"), F.col("l_tax") * 100 + 5
    region = F.array(F.array(q, F.lit(5.0)), F.array(q + 100, F.lit(5.0)), F.array(q + 100, h), F.array(q, h))
    return t.lineitem.select("l_orderkey", "l_linenumber", V.corner_box(region).alias("b")).select("l_orderkey", "l_linenumber", "b.x", "b.y", "b.w", "b.h")


@query("SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0 ELSE greatest(value - 10, 0) END, 3) AS confidence FROM events")
def clamp_round_conf(t):
    return t.events.select("event_id", V.clamp_confidence(F.when(F.col("event_id") % 5 != 0, F.col("value") - 10)).alias("confidence"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN 0 ELSE 0 END AS prefix, CASE WHEN event_id % 2 = 0 THEN value ELSE user_id END::DOUBLE AS merged FROM events")
def float_prefix(t):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.concat(F.col("value").cast("string"), F.lit("km"))).when(k % 3 == 1, "1.2.3x").otherwise("x1")
    merged = V.merge_float(F.when(k % 2 == 0, F.col("value")).otherwise(0.0), F.col("user_id").cast("double"))
    return t.events.select("event_id", V.float_prefix(text).alias("prefix"), merged.alias("merged"))


SQL["float_prefix"] = SQL["float_prefix"].replace("CASE WHEN event_id % 2 = 0 THEN value ELSE user_id END", "CASE WHEN event_id % 2 = 0 AND value <> 0 THEN value ELSE user_id END")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id * 60 + 30 WHEN 1 THEN user_id * 60 WHEN 2 THEN user_id + 0.5 WHEN 3 THEN 7.5 ELSE 0 END::DOUBLE AS minutes FROM events")
def parse_minutes(t):
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    text = F.when(k % 5 == 0, F.concat(u, F.lit("小时 30分钟"))).when(k % 5 == 1, F.concat(u, F.lit("小时"))).when(k % 5 == 2, F.concat(F.lit("约"), u, F.lit(".5分钟"))).when(k % 5 == 3, "7.5").otherwise("x")
    return t.events.select("event_id", V.parse_minutes(text).alias("minutes"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS shown, floor(epoch(ts))::BIGINT AS seconds FROM events")
def ms_to_datetime(t):
    shown = V.ms_to_datetime(F.unix_millis(F.col("ts").cast("timestamp")))
    return t.events.select("event_id", shown.alias("shown"), V.datetime_to_seconds(shown).alias("seconds"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 604800 WHEN 1 THEN CASE WHEN user_id < 60 THEN 604800 ELSE user_id END WHEN 2 THEN 2592000 ELSE 604800 END::BIGINT AS ttl FROM events")
def ttl_clamp(t):
    k = F.col("event_id")
    return t.events.select("event_id", V.ttl_seconds(F.when(k % 4 == 0, "abc").when(k % 4 == 1, F.col("user_id").cast("string")).when(k % 4 == 2, "9999999")).alias("ttl"))


@query("SELECT event_id, '1,x' AS items, event_type AS one, 'p,q' AS texts FROM events")
def json_path_list(t):
    j = F.concat(F.lit('{"a":[{"b":1},{"b":"x"},{"c":2},{"b":[1]}],"e":"'), "event_type", F.lit('","t":["p",1,"q"]}'))
    return t.events.select("event_id", *(F.array_join(V.json_path_list(j, p), ",").alias(n) for n, p in (("items", "a.#.b"), ("one", "e"), ("texts", "t"))))


@query("SELECT event_id, event_type AS a, 'base' AS b, 'w' || (user_id % 3) AS window_size FROM events")
def spread_custom_data(t):
    merged = V.overlay(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("base")), F.create_map(F.lit("a"), F.col("event_type")), F.create_map(F.lit("window_size"), F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string"))))
    return t.events.select("event_id", merged.alias("m")).select("event_id", "m.a", "m.b", "m.window_size")


# -- pages ------------------------------------------------------------------

_MATCH = """m AS (
  SELECT doc_id, source, 'english' AS page_type, contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT AS n FROM documents WHERE NOT contains(lower(text), 'und')
  UNION ALL SELECT doc_id, source, 'german', contains(lower(text), 'der')::INT + contains(lower(text), 'die')::INT + contains(lower(text), 'und')::INT FROM documents WHERE regexp_matches(text, '[äöü]')
  UNION ALL SELECT doc_id, source, 'licensed', contains(lower(text), 'license')::INT FROM documents WHERE regexp_matches(text, '(?i)released|licensed')
  UNION ALL SELECT doc_id, source, 'contact', contains(text, '@')::INT + contains(text, '555')::INT FROM documents WHERE NOT contains(text, '|') AND regexp_matches(text, '[0-9]{3}')),
  hit AS (SELECT * FROM m WHERE n >= CASE WHEN page_type IN ('english', 'german') THEN 2 ELSE 1 END),
  classified AS (SELECT doc_id, source, page_type, n::INT AS match_count FROM hit UNION ALL SELECT doc_id, source, 'unknown', 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit))"""


@query(f"WITH {_MATCH} SELECT doc_id, page_type, match_count FROM classified")
def classify_pages(t):
    return classify.classify_pages(fx.pages(t), fx.page_rules(t)).select(F.col("pos").alias("doc_id"), "page_type", "match_count")


@query(f"WITH {_MATCH} SELECT doc_id, page_type, CASE WHEN page_type = 'unknown' THEN 0 ELSE 0.8 END::DOUBLE AS confidence FROM classified WHERE doc_id % 6 <> 0 UNION ALL SELECT doc_id, 'unknown', 0 FROM documents WHERE doc_id % 6 = 0")
def classify_summary_rows(t):
    blank = fx.pages(t).withColumn("ocr_text", F.when(F.col("pos") % 6 == 0, "  ").otherwise(F.col("ocr_text")))
    return classify.classification_rows(blank, fx.page_rules(t)).select(F.col("pos").alias("doc_id"), "page_type", "confidence")


@query(f"WITH {_MATCH} SELECT page_type, count(*) AS pages FROM classified GROUP BY page_type")
def classification_counts(t):
    return classify.classification_counts(classify.classify_pages(fx.pages(t), fx.page_rules(t)))


@query(f"WITH {_MATCH} SELECT doc_id, page_type, page_type <> 'unknown' AS has_rule FROM classified")
def page_rule_join(t):
    rules_ = fx.page_rules(t).where("page_type <> 'unknown'").select("page_type", "dedup_rule")
    return joins.page_rule_join(classify.classify_pages(fx.pages(t), fx.page_rules(t)), rules_).select(F.col("pos").alias("doc_id"), "page_type", "has_rule")


_GLOBAL = """g AS (SELECT *, unique_ids[1] AS id FROM dedup_input WHERE len(unique_ids) > 0),
  ranked AS (SELECT *, count(*) OVER (PARTITION BY video_key, page_type, id) AS n, row_number() OVER (PARTITION BY video_key, page_type, id ORDER BY image_path, pos) - 1 AS place FROM g),
  global_out AS (SELECT video_key, page_type, image_path, pos, CASE WHEN place = n // 2 THEN 'kept' ELSE 'removed' END AS action, CASE WHEN n = 1 THEN '唯一页面' WHEN place = n // 2 THEN '中间页面(' || n || '选1)' ELSE '重复ID，保留中间页面' END AS reason FROM ranked)"""


@query(f"WITH {fx.DEDUP}, {_GLOBAL} SELECT * FROM global_out")
def global_id_dedup(t):
    return dedup.global_id_dedup(fx.dedup_input(t))


_SLIDE = """WITH RECURSIVE {dedup}, s AS (SELECT video_key, page_type, image_path, pos, frame_index, unique_ids[1] AS id, row_number() OVER (PARTITION BY video_key, page_type, unique_ids[1] ORDER BY frame_index, pos, image_path) AS k FROM dedup_input WHERE len(unique_ids) > 0),
  r AS (SELECT *, frame_index AS last, true AS kept FROM s WHERE k = 1
    UNION ALL SELECT s.*, CASE WHEN s.frame_index - r.last > 3 OR s.frame_index = r.last THEN s.frame_index ELSE r.last END, s.frame_index - r.last > 3 OR s.frame_index = r.last FROM r JOIN s ON s.video_key = r.video_key AND s.page_type = r.page_type AND s.id = r.id AND s.k = r.k + 1)
  SELECT video_key, page_type, image_path, pos, CASE WHEN kept THEN 'kept' ELSE 'removed' END AS action, CASE WHEN kept THEN '滑动窗口去重保留' ELSE '滑动窗口去重移除' END AS reason FROM r"""


@query(_SLIDE.format(dedup=fx.DEDUP))
def sliding_window_dedup(t):
    return dedup.sliding_window_dedup(fx.dedup_input(t), 3)


_ISLANDS = "i AS (SELECT *, sum(new) OVER (PARTITION BY video_key, page_type ORDER BY frame_index, pos) AS island FROM (SELECT *, CASE WHEN lag(frame_index) OVER (PARTITION BY video_key, page_type ORDER BY frame_index, pos) = frame_index - 1 THEN 0 ELSE 1 END AS new FROM dedup_input))"


@query(f"WITH {fx.DEDUP}, {_ISLANDS} SELECT video_key, page_type, image_path, island::BIGINT AS island FROM i")
def coverage_islands(t):
    return dedup.coverage_islands(fx.dedup_input(t)).select("video_key", "page_type", "image_path", "island")


#: The greedy cover of each island, page by page: the one that adds most, the earliest of equals.
_COVER = """p AS (SELECT *, list_distinct(unique_ids) AS ids, row_number() OVER (PARTITION BY video_key, page_type, island ORDER BY frame_index, pos) AS place FROM i),
  c AS (SELECT video_key, page_type, island, []::VARCHAR[] AS covered, []::BIGINT[] AS chosen FROM p GROUP BY ALL
    UNION ALL SELECT c.video_key, c.page_type, c.island, list_distinct(list_concat(any_value(covered), arg_max(ids, (len(list_filter(ids, lambda x: NOT list_contains(covered, x))), -place)))), list_append(any_value(chosen), arg_max(pos, (len(list_filter(ids, lambda x: NOT list_contains(covered, x))), -place)))
      FROM c JOIN p USING (video_key, page_type, island) WHERE len(list_filter(ids, lambda x: NOT list_contains(covered, x))) > 0 GROUP BY c.video_key, c.page_type, c.island, len(chosen)),
  best AS (SELECT video_key, page_type, island, arg_max(chosen, len(chosen)) AS chosen FROM c GROUP BY ALL),
  cover_out AS (SELECT video_key, page_type, image_path, pos, CASE WHEN list_contains(chosen, pos) THEN 'kept' ELSE 'removed' END AS action,
    CASE WHEN max(len(ids)) OVER (PARTITION BY video_key, page_type) = 0 THEN '无目标ID需要覆盖' WHEN list_contains(chosen, pos) THEN '覆盖率最小集合保留' ELSE '覆盖率最小集合移除' END AS reason FROM p JOIN best USING (video_key, page_type, island))"""


@query(f"WITH RECURSIVE {fx.DEDUP}, {_ISLANDS}, {_COVER} SELECT * FROM cover_out")
def coverage_min_set_dedup(t):
    return dedup.coverage_min_set_dedup(fx.dedup_input(t))


def _dispatch_rules(t):
    rows = [("click", "SlidingWindow_dedup", None, "3"), ("view", "", "CoverageMinSet_dedup", None), ("signup", None, "no such", None), ("purchase", None, None, None)]
    return t.spark.createDataFrame(rows, "page_type string, dedup_strategy string, dedup_rule string, window_size string")


@query(f"""{_SLIDE.format(dedup=fx.DEDUP + ", " + _ISLANDS + ", " + _COVER + ", " + _GLOBAL)} WHERE page_type = 'click'
  UNION ALL SELECT * FROM cover_out WHERE page_type = 'view'
  UNION ALL SELECT * FROM global_out WHERE page_type IN ('signup', 'purchase')
  UNION ALL SELECT video_key, page_type, image_path, pos, 'removed', 'no rule' FROM dedup_input WHERE page_type NOT IN ('click', 'view', 'signup', 'purchase')""")
def dedup_dispatch(t):
    return dedup.dedup_dispatch(fx.dedup_input(t), _dispatch_rules(t))


_SUMMARY = f"""{fx.DEDUP}, {_GLOBAL}, total AS (SELECT video_key, page_type, count(*) AS total FROM dedup_input GROUP BY ALL), done AS (SELECT video_key, page_type, count_if(action = 'kept') AS kept, count_if(action = 'removed') AS removed FROM global_out GROUP BY ALL),
  summary AS (SELECT video_key, page_type, total, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(removed, 0) / total::DOUBLE * 100 AS removal_rate FROM total LEFT JOIN done USING (video_key, page_type))"""


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def dedup_summary(t):
    pages_ = fx.dedup_input(t)
    return dedup.dedup_summary(pages_, dedup.global_id_dedup(pages_))


@query(f"WITH {_SUMMARY} SELECT video_key, sum(total)::BIGINT AS before, sum(removed)::BIGINT AS removed, greatest(0, sum(total) - sum(removed))::BIGINT AS kept, sum(removed) * 100.0::DOUBLE / sum(total) AS removal_rate FROM summary GROUP BY video_key")
def dedup_overall(t):
    pages_ = fx.dedup_input(t)
    return dedup.dedup_overall(dedup.dedup_summary(pages_, dedup.global_id_dedup(pages_)))


@query(f"WITH {fx.DEDUP}, {_GLOBAL} SELECT DISTINCT video_key, image_path FROM global_out WHERE action = 'kept'")
def union_kept(t):
    r = dedup.global_id_dedup(fx.dedup_input(t))
    return dedup.union_kept(r.where("page_type < 'm'"), r.where("page_type >= 'm'"))


@query(f"WITH {fx.DEDUP}, {_GLOBAL} SELECT d.video_key, d.image_path, d.pos FROM dedup_input d WHERE (video_key, image_path) IN (SELECT video_key, image_path FROM global_out WHERE action = 'kept')")
def kept_semi(t):
    pages_ = fx.dedup_input(t)
    return dedup.kept_semi(pages_, dedup.global_id_dedup(pages_)).select("video_key", "image_path", "pos")


@query()
def page_pipeline(t):
    """Classify, derive ids, de-duplicate by each type's rule: what is kept."""
    rules_ = fx.page_rules(t)
    found = classify.classify_pages(fx.pages(t), rules_)
    found = found.withColumn("unique_ids", ids.page_ids(F.col("ocr_text"), "RegStrategy", [r"([A-Z][a-z]+)\b"]))
    rows = found.select("video_key", "page_type", "image_path", "pos", "frame_index", "unique_ids")
    rows = materialise(rows, "pages")  # each strategy reads them; texts are read and classified once
    done = dedup.dedup_dispatch(rows, rules_.where("page_type <> 'unknown'"))
    return done.where("action = 'kept'")


# -- similarity -------------------------------------------------------------


@query("""WITH chars AS (SELECT conv_id * 1000 + turn AS query_id, list_distinct(string_split(text, '')) AS q FROM conversations WHERE role = 'user' AND text <> ''),
  scored AS (SELECT query_id, item_id AS example_pos, len(list_intersect(q, e)) / len(list_distinct(list_concat(q, e)))::DOUBLE AS score FROM chars, (SELECT item_id, list_distinct(string_split(text, '')) AS e FROM benchmark))
  SELECT query_id, example_pos, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_pos) AS rank FROM scored WHERE score >= 0.5) WHERE rank <= 5""")
def similarity_top_k(t):
    return similarity.similarity_top_k(fx.queries_of(t), fx.examples(t), 5, 0.5)


@query("""WITH pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS example_pos, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
  SELECT query_id, example_pos, rank::INT AS rank, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_pos) AS rank FROM pairs) WHERE rank <= 5""")
def cosine_top_k(t):
    e = t.embeddings
    top = similarity.cosine_top_k(e.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vector"), e.selectExpr("vec_id AS example_pos", "embedding AS vector"))
    return top.withColumn("score", F.round("score", 9))


@query()
def mmr_top_k(t):
    return similarity.mmr_top_k(fx.queries_of(t), fx.examples(t), 5, 0.5)


@query("""SELECT c.conv_id * 1000 + c.turn AS query_id, b.item_id AS example_pos FROM conversations c, benchmark b WHERE role = 'user' AND len(list_intersect(string_split(c.text, ''), string_split(b.text, ''))) > 0""")
def example_match(t):
    return similarity.example_candidates(fx.queries_of(t).where("query <> ''"), fx.examples(t))


# -- models -----------------------------------------------------------------


@query("SELECT doc_id, length(source || chr(10) || lang)::BIGINT AS tokens_in, length(source || chr(10) || lang) || ':' || lang AS content FROM documents")
def infer_rows(t):
    df = t.documents.select("doc_id", F.concat("source", F.lit("\n"), "lang").alias("prompt"))
    return inference.infer_rows(df, partitions=None).select("doc_id", "tokens_in", "content")


@query("SELECT doc_id, 1::BIGINT AS n_tokens, 'w' || doc_id AS text, 0.5::DOUBLE AS confidence FROM documents")
def ocr_rows(t):
    def recogniser():
        return lambda data: [{"text": data.decode(), "confidence": 0.5, "text_region": [[0.0, 0.0]]}]

    df = t.documents.select(F.col("doc_id").cast("string").alias("image_path"), F.concat(F.lit("w"), "doc_id").cast("binary").alias("content"))
    out = inference.ocr_rows(df, recogniser)
    return out.select(F.col("image_path").cast("long").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), F.col("tokens")[0]["text"].alias("text"), F.col("tokens")[0]["confidence"].alias("confidence"))


@query("SELECT doc_id, 'w' || doc_id AS texts, CASE WHEN doc_id % 2 = 0 THEN 'w' || doc_id ELSE '' END AS sure FROM documents")
def ocr_normalize(t):
    w = F.concat(F.lit("w"), F.col("doc_id").cast("string"))
    low = F.when(F.col("doc_id") % 2 == 0, "0.9").otherwise("0.2")
    as_dict = F.concat(F.lit('{"texts":["'), w, F.lit('"],"scores":['), low, F.lit('],"boxes":[[[1,2],[3,4]]]}'))
    as_list = F.concat(F.lit('[[[[1,2],[3,4]],["'), w, F.lit('",'), low, F.lit("]]]"))
    tokens = inference.ocr_normalize(F.when(F.col("doc_id") % 3 == 0, as_dict).otherwise(as_list))
    return t.documents.select("doc_id", F.array_join(F.transform(tokens, lambda x: x["text"]), ",").alias("texts"), F.array_join(F.transform(inference.filter_ocr_tokens(tokens, 0.5), lambda x: x["text"]), ",").alias("sure"))


@query("SELECT doc_id, n_chars * 2 + 1 AS n FROM documents")
def register_step(t):
    steps = {"double": lambda df: df.withColumn("n", F.col("n") * 2), "next": lambda df: df.withColumn("n", F.col("n") + 1)}
    return inference.run_steps(t.documents.select("doc_id", F.col("n_chars").alias("n")), ["double", "next"], steps)


def _failed(t):
    return _dual(t).where("NOT valid").select("task_id", F.concat(F.lit("check "), "task_id").alias("prompt"), "content", "errors")


@query()
def self_correct(t):
    return inference.self_correct(_failed(t), partitions=None).select("task_id", "final_content", "corrected", "attempts")


@query()
def govern_results(t):
    answers = t.documents.select(F.concat(F.lit("task_"), "doc_id").alias("task_id"), F.concat(F.lit("check "), "doc_id").alias("prompt"), F.col("text").alias("content"))
    return inference.govern_results(answers, rules(), partitions=None)


# -- windows in time --------------------------------------------------------


@query(f"WITH {fx.USAGE} SELECT time_bucket(INTERVAL 24 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS requests, coalesce(sum(input_tokens) FILTER (input_tokens > 0), 0) * 0.005 / 1000 + coalesce(sum(output_tokens) FILTER (output_tokens > 0), 0) * 0.015 / 1000 AS cost FROM usage GROUP BY 1")
def cost_trend(t):
    return jobs.cost_trend(fx.token_usage(t))


@query(f"""WITH {fx.LOG}, w AS (SELECT *, unnest(range(date_trunc('hour', created_at) - INTERVAL 18 HOURS, created_at + INTERVAL 1 SECOND, INTERVAL 6 HOURS)) AS s FROM log)
  SELECT s AS window_start, biz_type, prompt_stage, count(*) AS total, count_if(validation_status = 'SUCCESS') AS success, count_if(validation_status = 'SUCCESS') / count(*)::DOUBLE AS success_rate FROM w GROUP BY ALL""")
def rolling_eval(t):
    return jobs.rolling_eval(fx.execution_log(t), 24, "6 hours")


_SPREAD = """spread AS (SELECT *, unnest(range(time_bucket(INTERVAL 30 SECONDS, ts, TIMESTAMP '1970-01-01') + INTERVAL 30 SECONDS, time_bucket(INTERVAL 30 SECONDS, ts, TIMESTAMP '1970-01-01') + INTERVAL 301 SECONDS, INTERVAL 30 SECONDS)) AS "at" FROM events)"""


@query(f"""WITH {_SPREAD}, a AS (SELECT "at", count_if(event_type = 'error') AS errors, count(*) AS requests FROM spread GROUP BY "at") SELECT "at", errors, requests, errors / 300.0::DOUBLE AS errors_per_second, errors / requests::DOUBLE AS error_share, errors / 300.0 > 0.003 AS over FROM a""")
def alert_error_rate(t):
    return jobs.alert_error_rate(t.events.withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_type") == "error", 0.003)


_P95 = f"""WITH {_SPREAD}, a AS (SELECT "at", quantile_disc(value * 100, 0.95) AS p95 FROM spread GROUP BY "at"), o AS (SELECT "at", p95, p95 > 1000 AS over FROM a)"""


@query(f"""{_P95} SELECT "at", p95, over, min(over) OVER (PARTITION BY "at"::DATE ORDER BY "at" RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW) AS firing FROM o""")
def alert_latency_p95(t):
    events = t.events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 100).alias("v"))
    return jobs.held_for(jobs.alert_latency_p95(events, "v"))


@query("SELECT service, ts AS down_from, up_at FROM (SELECT event_type AS service, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS up_at FROM events) WHERE floor(epoch(up_at)) - floor(epoch(ts)) > 3600")
def alert_service_down(t):
    return jobs.alert_service_down(t.events.select(F.col("event_type").alias("service"), F.col("ts").cast("timestamp").alias("ts")), gap=3600)


@query("""SELECT date_trunc('hour', ts) AS window_start, count(*) AS uploads, count_if(event_type = 'error') / count(*)::DOUBLE AS failure, avg(value) AS mean_seconds, count_if(event_id % 50 = 0) / count(*)::DOUBLE AS store_failure, 0.0::DOUBLE AS queue_failure,
  count_if(event_type = 'error') / count(*)::DOUBLE > 0.05 OR avg(value) > 30 OR count_if(event_id % 50 = 0) / count(*)::DOUBLE > 0.01 AS alert FROM events GROUP BY 1""")
def upload_alerts(t):
    df = t.events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"), (F.col("event_id") % 50 != 0).alias("store_ok"), F.lit(True).alias("queue_ok"))
    return jobs.upload_alerts(df)
