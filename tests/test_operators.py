"""Operators on small tables: hand-derived results and plain restatements of the greedy ones."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lampwick.operators import classify, dedup, inference, joins, metrics, rollout, similarity, state
from lampwick.sources import config, messages, objects

PAGES = "video_key string, page_type string, image_path string, pos long, frame_index int, unique_ids array<string>"


def pages(spark, rows):
    return spark.createDataFrame([("v", "t", f"f_{i}.jpg", k, i, list(x)) for k, (i, x) in enumerate(rows)], PAGES)


def actions(df):
    return {r.image_path: (r.action, r.reason) for r in df.collect()}


def test_global_dedup(spark):
    p = pages(spark, [(1, "X"), (2, "X"), (3, "X"), (4, "Y"), (5, "")])
    got = actions(dedup.global_id_dedup(p))
    assert got == {"f_1.jpg": ("removed", dedup.REPEATED), "f_2.jpg": ("kept", "中间页面(3选1)"), "f_3.jpg": ("removed", dedup.REPEATED), "f_4.jpg": ("kept", dedup.ONLY)}
    s = dedup.dedup_summary(p, dedup.global_id_dedup(p)).first()
    assert (s.total, s.kept, s.removed, s.removal_rate) == (5, 2, 2, 40.0)
    assert actions(dedup.global_id_dedup(p, middle=False))["f_1.jpg"][0] == "kept"


def test_sliding_window(spark):
    got = actions(dedup.sliding_window_dedup(pages(spark, [(1, "X"), (2, "X"), (4, "X"), (5, "X")]), 2))
    assert {k for k, (a, _) in got.items() if a == "kept"} == {"f_1.jpg", "f_4.jpg"}


def plain_sliding(rows, window):
    kept = []
    for i, x in sorted(rows):
        if x and (i < 0 or not any(y == x and j >= 0 and i - window <= j < i for j, y in kept)):
            kept.append((i, x))
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_sliding_window_at_random(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("XYZ") if rng.random() < 0.9 else "") for i in rng.sample(range(60), 40)] + [(-1, "X")]
    got = dedup.sliding_window_dedup(pages(spark, rows), 5).where("action = 'kept'").collect()
    at = {f"f_{i}.jpg": (i, x) for i, x in rows}
    assert sorted(at[r.image_path] for r in got) == plain_sliding(rows, 5)


def test_coverage(spark):
    got = actions(dedup.coverage_min_set_dedup(pages(spark, [(1, "A"), (2, "AB"), (3, "BC"), (5, "C")])))
    assert {k for k, (a, _) in got.items() if a == "kept"} == {"f_2.jpg", "f_3.jpg", "f_5.jpg"}
    got = actions(dedup.coverage_min_set_dedup(pages(spark, [(1, ""), (2, "")])))
    assert set(got.values()) == {("removed", dedup.UNCOVERED)}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_cover_covers_greedily(seed):
    rng = random.Random(seed)
    sets = [set(rng.sample("abcdefgh", rng.randint(0, 4))) for _ in range(9)]
    kept, left = [False] * 9, set().union(*sets)
    while left:
        best = max(range(9), key=lambda i: (len(sets[i] & left), -i))
        kept[best], left = True, left - sets[best]
    assert dedup.greedy_cover(sets) == kept and dedup.greedy_cover([]) == []


def test_dispatch(spark):
    p = pages(spark, [(1, "X"), (2, "X"), (4, "X")])
    rules = lambda how, rule, w: spark.createDataFrame([("t", how, rule, w)], "page_type string, dedup_strategy string, dedup_rule string, window_size string")
    kept = lambda r: {x.image_path for x in dedup.dedup_dispatch(p, r).where("action = 'kept'").collect()}
    assert kept(rules("SlidingWindow_dedup", None, "2")) == {"f_1.jpg", "f_4.jpg"} and kept(rules("SlidingWindow_dedup", None, "many")) == {"f_1.jpg"}
    assert kept(rules(" ", "CoverageMinSet_dedup", None)) == {"f_1.jpg", "f_4.jpg"} and kept(rules("what", None, None)) == {"f_2.jpg"}
    other = spark.createDataFrame([("u", None, None, None)], "page_type string, dedup_strategy string, dedup_rule string, window_size string")
    assert kept(other) == set()
    dedup.register_dedup("Keep_all", lambda df, w: df.withColumns({"action": F.lit("kept"), "reason": F.lit("")}).select(*dedup.OUT))
    assert len(kept(rules("Keep_all", None, None))) == 3
    del dedup.STRATEGIES["Keep_all"]


RULES = "page_type string, keywords array<string>, exclude array<string>, min_matches int, verify_regexes array<string>"


def test_classify(spark):
    p = spark.createDataFrame([(1, "Alpha beta"), (2, "alpha gamma"), (3, "none"), (4, None), (5, "alpha beta 12")], "pos int, ocr_text string")
    r = spark.createDataFrame([("a", ["ALPHA"], ["gamma"], None, None), ("b", ["alpha", "beta"], None, 2, [" ", r"(?-i)[a]\D*\d+"]), ("unknown", ["none"], None, 1, None)], RULES)
    got = sorted((x.pos, x.page_type, x.match_count) for x in classify.classify_pages(p, r).collect())
    assert got == [(1, "a", 1), (2, "unknown", 0), (3, "unknown", 0), (4, "unknown", 0), (5, "a", 1), (5, "b", 2)]
    strict = classify.classify_pages(p, r, case_sensitive=True)
    assert strict.where("page_type = 'a'").count() == 0
    assert classify.classify_pages(p, r.limit(0)).where("page_type = 'unknown'").count() == 5


def test_metrics(spark):
    lat = metrics.latency_metrics(spark.range(1, 21).select(F.col("id").alias("latency"))).first()
    assert (lat["min"], lat["max"], lat.avg, lat.p50, lat.p95, lat.p99, lat.p999, lat.n) == (1, 20, 10, 10, 19, 20, 20, 20)
    usage = spark.createDataFrame([(1000, 200), (None, 0), (500, 300)], "input_tokens long, output_tokens long")
    c = metrics.cost_metrics(usage).first()
    assert (c.input_tokens, c.output_tokens, c.total_tokens, c.avg_input, c.avg_output, c.avg_total) == (1500, 500, 2000, 750, 250, 666)
    assert c.cost == pytest.approx(0.015) and c.cost_per_request == pytest.approx(0.005)
    rows = [(True, "a", "a"), (True, "a", "b"), (False, "a", "a"), (False, None, "b")]
    a = metrics.accuracy_metrics(spark.createDataFrame(rows, "success boolean, expected_label string, predicted_label string")).first()
    assert (a.tp, a.fp, a.fn, a.accuracy) == (1, 2, 1, 0.5) and a.precision == pytest.approx(1 / 3) and a.recall == 0.5 and a.f1 == pytest.approx(0.4)


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "biz_type string, stage string, success boolean, expected_label string, predicted_label string, latency long, input_tokens long, output_tokens long, toxicity double, safety_violation boolean")
    row = metrics.comprehensive_eval(none, ()).first()
    assert row.samples == 0 and row.f1 == 0 and row.p95_latency == 0 and row.avg_toxicity == 0


def test_upsert(spark):
    cols = "task_id string, task_type string, created_at int, video_key string, link_name string, submit_date string, status string, updated_at int, completed_at int, image_count int, llm_content string, ocr_text_count int, custom_data string"
    first = spark.createDataFrame([("t", "x", 1, "v", "L1", None, "PENDING", 1, None, 1, "c", 1, None)], cols)
    second = spark.createDataFrame([("t", "y", 2, "w", "L2", "d", "COMPLETED", 2, 2, None, None, 2, "{}")], cols).withColumn("seq", F.lit(5).cast("long"))
    row = state.merge_results(first, second).first()
    assert (row.status, row.link_name, row.task_type, row.llm_content, row.image_count, row.submit_date) == ("COMPLETED", "L1", "x", None, None, None)


def test_similarity_paths_agree(spark):
    q = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "query_id int, query string")
    e = spark.createDataFrame([(0, "abd"), (1, "abc"), (2, "xyz"), (3, "cba"), (4, "")], "example_pos int, input string")
    want = [(1, 1, 1), (1, 3, 2), (1, 0, 3)]
    for small in (similarity.SMALL, 2):
        got = sorted((r.query_id, r.example_pos, r["rank"]) for r in similarity.similarity_top_k(q, e, 3, 0.1, small).collect())
        assert got == sorted(want)
    assert sorted(similarity.example_candidates(q.where("query <> ''"), e).toPandas().example_pos) == [0, 1, 3]


def test_mmr(spark):
    import numpy as np

    alike = {(0, 1): 0.9, (0, 2): 0.1}
    assert similarity.mmr(np.array([0.9, 0.8, 0.5]), lambda i, j: alike.get((min(i, j), max(i, j)), 0.0), 2, 0.5) == [0, 2]
    q = spark.createDataFrame([(1, "abcdef")], "query_id int, query string")
    e = spark.createDataFrame([(0, "abcd"), (1, "abce"), (2, "ef")], "example_pos int, input string")
    rows = similarity.mmr_top_k(q, e, 2).collect()
    assert sorted((r["rank"], r.example_pos) for r in rows) == [(1, 0), (2, 2)]


def test_mmr_looks_at_every_example(spark):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.sample("abcdefghijklmnop", rng.randint(1, 9))) for _ in range(120)] + ["", None]
    asks = [(i, "".join(rng.sample("abcdefghijklmnop", 8))) for i in range(12)]

    def alike(a, b):
        a, b = set(a or ""), set(b or "")
        return len(a & b) / len(a | b) if a and b else 0.0

    def plain(query, k):
        chosen = []
        while len(chosen) < k:
            gain = {i: 0.5 * alike(query, x) - 0.5 * max((alike(x, texts[j]) for j in chosen), default=0.0) for i, x in enumerate(texts) if i not in chosen}
            chosen.append(max(gain, key=lambda i: (gain[i], -i)))
        return chosen

    q = spark.createDataFrame([*asks, (99, "")], "query_id int, query string")
    e = spark.createDataFrame(list(enumerate(texts)), "example_pos int, input string")
    want = {(i, r, x) for i, text in asks for r, x in enumerate(plain(text, 5), 1)}
    for small in (similarity.SMALL, 50):
        assert {(r.query_id, r["rank"], r.example_pos) for r in similarity.mmr_top_k(q, e, 5, 0.5, small=small).collect()} == want
    assert similarity.mmr_top_k(q, e.where("example_pos < 3")).where("query_id = 0").count() == 3


def test_rollout(spark):
    c = spark.createDataFrame([("g", i, a, b, d) for i, (a, b, d) in enumerate([(0.9, 0.01, 100.0), (0.8, 0.02, 200.0), (0.95, 0.04, 50.0), (0.9, 0.01, 100.0)])], "g string, pos int, accuracy double, cost double, latency double")
    assert sorted(r.pos for r in rollout.pareto_front(c, ["g"]).collect()) == [0, 2, 3]
    assert rollout.candidate_top1(c, ["g"]).first().pos == 0


def test_template_resolution(spark):
    asked = spark.createDataFrame([(1, "A", "extraction", None), (2, "B", "extraction", None), (3, "GAODE", "extraction", "v7"), (4, "C", "system", None), (5, "C", "other", None)], "k int, biz_type string, stage string, version string")
    kept = spark.createDataFrame([("A", "extraction", None, "own"), ("B", "extraction", "latest", "late"), ("GAODE", "extraction", "latest", "no")], "biz_type string, stage string, version string, template string")
    from lampwick.functions.prompts import DEFAULT_TEMPLATES

    rows = {r.k: r for r in joins.template_resolve(asked, kept, spark.createDataFrame(DEFAULT_TEMPLATES, "biz_type string, stage string, template string")).collect()}
    assert [rows[i].resolved for i in range(1, 6)] == ["exact", "latest", "default", "default", "none"] and "targetField" in rows[3].template


def test_correction_and_governance(spark):
    rules = inference.Rules()
    rules.register("digits", lambda: F.col("content").rlike("^[0-9]"), "no digit in front")
    rules.register("gone", lambda: F.lit(False), "x")
    rules.unregister("gone")
    assert rules.names() == ["digits"] and rules.get("none") is None
    rows = spark.createDataFrame([("a", "p", "1 ok"), ("b", "p", "bad"), ("c", "p", None)], "task_id string, prompt string, content string")
    got = {r.task_id: r for r in inference.govern_results(rows, rules, partitions=2).collect()}
    assert got["a"].valid and got["a"].attempts == 0 and got["b"].corrected and got["b"].attempts == 1 and got["c"].corrected

    def stubborn():
        return lambda prompt, image, text: ("bad", 0, 0)

    failed = inference.dual_check(rows, rules, None).where("task_id = 'b'").select("task_id", "prompt", "content", "errors")
    row = inference.self_correct(failed, stubborn, partitions=1).first()
    assert not row.corrected and row.attempts == 3 and row.final_content == "bad" and row.prompt.count("重要提示") == 3

    def broken():
        def fail(*_):
            raise ValueError("down")

        return fail

    row = inference.infer_rows(failed, broken, 1).first()
    assert row.content is None and row.infer_error == "ValueError: down"


def test_messages_and_sources(spark, tmp_path):
    rows = [("k", '{"videoKey":"b/v.mp4","extra":1}'), ("", '{"videoKey":"b/v.mp4","taskId":"t"}'), (None, "no"), (None, None)]
    good, dead = messages.read_task_messages(spark.createDataFrame(rows, "msg_key string, body string"))
    assert sorted(r.task_id for r in good.collect()) == ["k", "t"] and dead.count() == 2 and good.first().bucket == "b"
    (tmp_path / "a").mkdir()
    for name in ("a/x.mp4", "a/y.txt", "z.MOV"):
        (tmp_path / name).write_bytes(b"123")
    found = objects.as_objects(objects.scan_objects(spark, str(tmp_path)), f"file:{tmp_path}")
    assert {r.object_key for r in objects.filter_media_ext(found.withColumn("object_key", F.concat_ws("/", "bucket", "object_key"))).collect()} == {"a/x.mp4", "default-bucket/z.MOV"}
    assert objects.scan_objects(spark, str(tmp_path), "*.txt").count() == 1


def test_configuration(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"link_name": "l", "other": 1, "pages": [{"page_type": "a", "classify": {"keywords": ["k"]}, "dedup": {"rule": "Global_dedup", "param": {"window_size": "7"}}}, {"page_type": "b"}]}')
    rules = {r.page_type: r for r in config.read_rules(spark, str(tmp_path)).collect()}
    assert rules["a"].min_matches == 1 and rules["a"].threshold == 0.8 and rules["a"].window_size == "7" and rules["b"].keywords == []
    texts = spark.createDataFrame([("n", "# c\na = 'x'\n\nb=1=2"), ("j", '{"a": {"b": [1]}, "c": "d"}'), ("y", 'a: "q"\nb: c:d')], "namespace string, content string")
    got = {(r.namespace, r.key): r.value for r in config.read_config_table(texts).collect()}
    assert got == {("n", "a"): "x", ("n", "b"): "1=2", ("j", "a"): '{"b":[1]}', ("j", "c"): "d", ("y", "a"): "q", ("y", "b"): "c:d"}


def test_message_stream_from_files(spark, tmp_path):
    spark.createDataFrame([("k", '{"videoKey":"b/v"}')], "msg_key string, body string").write.json(str(tmp_path / "in"))
    stream = messages.decode(messages.stream_task_messages(spark, "json", "msg_key string, body string", str(tmp_path / "in")))
    stream.select("task_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().task_id == "k"
    messages.emit(spark.createDataFrame([("k", "v")], "key string, value string"), str(tmp_path / "sent"), "json")
    assert spark.read.json(str(tmp_path / "sent")).count() == 1


def test_inference_holds_few_rows_and_leaves_other_columns_alone(spark):
    asked = []
    batch = pa.RecordBatch.from_pydict({"prompt": [f"p{i}" for i in range(5000)]})
    first = next(inference._answers(iter([batch]), lambda *a: asked.append(a) or ("x", 1, 1), "image_url", "ocr_text"))
    assert first.num_rows == len(asked) <= 256
    rows = [("a", 2**53 + 1), ("b", None), (None, 7)]
    got = inference.infer_rows(spark.createDataFrame(rows, "prompt string, n long"), partitions=1).collect()
    assert sorted(((r.prompt, r.n) for r in got), key=str) == sorted(rows, key=str)
    assert {r.prompt: r.content for r in got} == {"a": "1:a", "b": "1:b", None: "0:"}
