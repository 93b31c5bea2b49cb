"""State with a life, late events, commits of changed buckets, panes."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lampwick.operators.state import merge_results
from lampwick.streaming import jobs
from lampwick.streaming.versions import VersionedTable

EVENTS = "task_id string, event string, step_name string, error_message string, ts timestamp, seq long"
T0 = datetime(2024, 5, 1, 12)


def after(minutes):
    return T0 + timedelta(minutes=minutes)


def run_states(spark, folder, life):
    """One batch of the files of a folder that are new; the states that it gives by task."""
    got = []
    stream = jobs.stream_task_state(spark.readStream.schema(EVENTS).parquet(f"{folder}/in"), life)
    stream.writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", f"{folder}/c").trigger(once=True).start().awaitTermination()
    return {r.task_id: r for r in got}


def test_state_lives_and_dies(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([("a", "START", None, None, after(0), 1), ("a", "STEP", "x", None, after(1), 2), ("b", "FAIL", None, "bad", after(5), 1)])
    first = run_states(spark, str(tmp_path), "1 hour")
    assert (first["a"].status, first["a"].steps, first["a"].created_at, first["b"].error_message) == ("RUNNING", "x", after(0), "bad")
    put([("a", "COMPLETE", None, None, after(9), 3), ("b", "START", None, None, after(2), 2), ("b", "STEP", "late", None, after(3), 3)])
    second = run_states(spark, str(tmp_path), "1 hour")
    assert (second["a"].status, second["a"].steps, second["a"].completed_at) == ("COMPLETED", "x", after(9))
    late = second["b"]  # older than what was seen: the step counts, the status stays
    assert (late.status, late.steps, late.error_message, late.created_at, late.updated_at) == ("FAILED", "late", "bad", after(2), after(5))


def test_state_is_gone_after_its_life(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put([("a", "START", None, None, after(0), 1), ("a", "STEP", "x", None, after(1), 2)])
    assert run_states(spark, str(tmp_path), "1 second")["a"].steps == "x"
    time.sleep(1.5)
    put([("a", "STEP", "y", None, after(2), 3)])
    again = run_states(spark, str(tmp_path), "1 second")["a"]
    assert (again.status, again.steps, again.created_at) == ("PENDING", "y", after(2))


RESULT = "task_id string, task_type string, status string, created_at string, updated_at string, completed_at string, video_key string, link_name string, submit_date string, image_count int, llm_content string, ocr_text_count int, custom_data string"


def writes_of(spark, rows):
    cols = RESULT.replace(" string", "").replace(" int", "").split(", ")
    held = [(tuple({"task_id": k, "status": s, "llm_content": c}.get(n) for n in cols) + (q,)) for k, s, c, q in rows]
    return spark.createDataFrame(held, RESULT + ", seq long")


def folders(path):
    return {f"{v.name}/{b.name}" for v in path.glob("v=*") for b in v.glob("bucket=*")}


def test_a_commit_writes_what_it_changes(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "task_id", buckets=8)
    schema = writes_of(spark, []).drop("seq").schema
    table.commit(0, writes_of(spark, [(f"k{i}", "RUNNING", "c0", i) for i in range(40)]), schema, merge_results)
    before = folders(tmp_path / "t")
    one = writes_of(spark, [("k3", "DONE", "c1", 50)])
    table.commit(1, one, schema, merge_results)
    new = folders(tmp_path / "t") - before
    assert len(new) == 1 and next(iter(new)).startswith("v=1/")
    rows = {r.task_id: (r.status, r.llm_content) for r in table.read(schema).collect()}
    assert len(rows) == 40 and rows["k3"] == ("DONE", "c1") and rows["k4"] == ("RUNNING", "c0")
    table.commit(1, one, schema, merge_results)  # repeated after a failure
    assert {r.task_id: (r.status, r.llm_content) for r in table.read(schema).collect()} == rows
    for n in (2, 3, 4):
        table.commit(n, writes_of(spark, [("k3", f"S{n}", None, n)]), schema, merge_results)
    assert table.commits() == [3, 4] and len(folders(tmp_path / "t")) == 8 + 1  # what only older commits name is gone
    assert {r.task_id: r.status for r in table.read(schema).collect()}["k3"] == "S4" and table.read(schema).count() == 40


def test_an_empty_table_reads_as_none(spark, tmp_path):
    schema = writes_of(spark, []).drop("seq").schema
    assert VersionedTable(spark, f"file://{tmp_path}/none", "task_id").read(schema).count() == 0


def test_results_of_a_stream_survive_a_replay(spark, tmp_path):
    writes_of(spark, [("a", "RUNNING", None, 1), ("b", "RUNNING", None, 2), ("a", "DONE", "x", 3)]).write.parquet(str(tmp_path / "in"))
    schema = writes_of(spark, []).schema

    def run(checkpoint):
        jobs.stream_task_results(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), f"file://{tmp_path}/t", str(tmp_path / checkpoint), 4).start().awaitTermination()
        return sorted((r.task_id, r.status) for r in VersionedTable(spark, f"file://{tmp_path}/t", "task_id", 4).read(writes_of(spark, []).drop("seq").schema).collect())

    assert run("c1") == run("c2") == [("a", "DONE"), ("b", "RUNNING")]


def test_panes_sum_to_windows(spark):
    log = spark.createDataFrame([("b", "s", after(m), "SUCCESS" if m % 3 else "FAILED") for m in range(0, 3000, 7)], "biz_type string, prompt_stage string, created_at timestamp, validation_status string")
    direct = log.groupBy(F.window("created_at", "24 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("validation_status") == "SUCCESS").alias("ok"))
    assert sorted((r.window_start, r.total, r.success) for r in jobs.rolling_eval(log, 24, "6 hours").collect()) == sorted((r.w.start, r.n, r.ok) for r in direct.collect())
    assert jobs.pane("24 hours", "6 hours") == "21600 seconds" and jobs.pane("24 hours", "5 hours") == "3600 seconds"


@pytest.mark.parametrize("exact", [True, False])
def test_percentiles_of_panes(spark, exact):
    events = spark.createDataFrame([(T0 + timedelta(seconds=13 * i), (i * 37) % 101) for i in range(200)], "ts timestamp, v long")
    direct = {r.w.end: r.p for r in events.groupBy(F.window("ts", "5 minutes", "30 seconds").alias("w")).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p")).collect()}
    found = {r.at: r.p95 for r in jobs.alert_latency_p95(events, "v", exact=exact).collect()}
    assert found.keys() == direct.keys()
    assert found == direct if exact else all(abs(found[k] - direct[k]) <= 25 for k in direct)
