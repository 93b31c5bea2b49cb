import math
import re
import unicodedata
import json

import pytest
from pyspark.sql import functions as F

from lampwick.llm import license_scan as L
from lampwick.llm import rule_ensemble as R
from lampwick.llm import tool_calls as C
from lampwick.llm.common import crc_mod


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(docs, labels):
    got = R.held_out_scores(docs, labels, crc_mod("doc_id", 5) == 0)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count() and len(rows) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_rules_are_conjunctions_and_compile(spark, docs, labels):
    text = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=13
  Tree 0 (weight 1.0):
    If (feature 0 <= 5.5)
     If (feature 6 <= 0.1)
      Predict: 0.0
     Else (feature 6 > 0.1)
      Predict: 1.0
    Else (feature 0 > 5.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 2 <= 0.5)
     Predict: 0.0
    Else (feature 2 > 0.5)
     Predict: 1.0
"""
    rules = R.tree_rules(text)
    assert [r.parts for r in rules] == [
        (("n_words", True, 5.5),), (("n_words", True, 5.5), ("symbols", True, 0.1)), (("n_words", True, 5.5), ("symbols", False, 0.1)), (("n_words", False, 5.5),), (("distinct_words", True, 0.5),), (("distinct_words", False, 0.5),),
    ]
    model = R.Ensemble(0.5, tuple((r, 1.0) for r in rules[:2]))
    rows = R.with_score(spark.createDataFrame([(1, "a b", 9.0)], "doc_id int, text string, score double"), model).collect()
    assert rows[0].score == pytest.approx(1 / (1 + 2.718281828459045**-2.5)) and len(rows[0]) == 4


def plain_statistics(text):
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    part = lambda a, b: a / b if b else 0.0
    count = lambda p: len(re.findall(p, text))
    n, chars = len(words), len(text)
    return {
        "n_words": n, "word_length": part(chars, n), "distinct_words": part(len(set(words)), n), "repeated_next": part(sum(a == b for a, b in zip(words, words[1:])), n), "distinct_lines": part(len(set(lines)), len(lines)), "line_words": part(n, len(lines)),
        "symbols": part(count(r"[#*$%&<>=_~^{}\[\]\\]"), n), "bars": part(count(r"\|"), n), "marks": part(count(r"[!?]"), n), "stops": part(count(r"[.,;:]"), n),
        "capitals": part(sum(unicodedata.category(c) == "Lu" for c in text), chars), "digits": part(count(r"[0-9]"), chars), "letters": part(sum(unicodedata.category(c)[0] == "L" for c in text), chars),
    }


def test_scores_against_plain_python(spark, sample, edge_docs):
    """Statistics, rules and weights evaluated by hand give the query's scores, of odd texts too."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = R.train(sample, labels)
    assert model.weights and all(set(dict.fromkeys(n for n, _, _ in rule.parts)) <= set(R.NAMES) for rule, _ in model.weights)
    for docs in (sample, edge_docs.select("doc_id", "text")):
        for r in R.with_score(docs, model).collect():
            have = plain_statistics(r.text or "")
            total = model.intercept + sum(w for rule, w in model.weights if all((have[n] <= b) == low for n, low, b in rule.parts))
            assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), r.doc_id


def test_rule_edges(spark, edge_docs, no_docs, edge_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = R.held_out_scores(edge_docs, none, crc_mod("doc_id", 5) == 0).collect()
    assert len(rows) == len(edge_rows) and all(r.score == 0.5 for r in rows)
    assert R.held_out_scores(no_docs, none, F.lit(False)).collect() == []
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    rows = R.held_out_scores(edge_docs, one, F.lit(False)).collect()
    assert all(r.score > 0.99 for r in rows)  # one label only: a constant
    model = R.train(edge_docs, spark.createDataFrame([(1, 1), (9, 0), (4, 0)], "doc_id long, quality int"))
    scored = R.with_score(edge_docs, model)
    assert sorted(scored.columns) == sorted(edge_docs.columns) and scored.where("score IS NULL").count() == 0


def test_whole_licences(spark):
    """Every licence of the catalogue, written otherwise, is known as an entire text; a word more or less is not it."""
    stems = {p.stem: p.read_text(encoding="utf-8") for p in L.TEXTS.glob("*.txt")}
    assert len(stems) >= 17
    rows = []
    for stem, text in stems.items():
        for written in (text, text.upper(), "Copyright (c) 1999-2020 A. Nother\nCopyright Jane Doe\nAll rights reserved.\n\n" + text.replace("\n", "\r\n"), text.replace("license", "licence").replace(" ", "  "), text.replace(",", " ,").replace('"', "''")):
            rows.append((len(rows), written, stem))
        rows += [(len(rows), text + " more", None), (len(rows) + 1, text.replace(" software ", " thing ", 1).replace(" the ", " a ", 1), None)]
    rows.append((len(rows), stems["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Some Firm"), "Apache-2.0"))
    rows.append((len(rows), stems["Apache-2.0"].split("APPENDIX")[0], "Apache-2.0"))
    rows += [(len(rows) + k, f"{t}\n\nCopyright 2020 x\n{stems['MIT']}", "MIT") for k, t in enumerate(L.TITLES["MIT"])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in L.license_scan(docs, L.known_digests(spark)).collect()}
    assert got == {i: want for i, _, want in rows}


def test_canonical_texts(spark):
    mit = "MIT License\n\n" + (L.TEXTS / "MIT.txt").read_text()
    rows = [
        (1, mit), (2, mit.upper().replace("software", "  software\n")), (3, "Copyright (c) 2020 Someone\n© 2019 x\nAll rights reserved.\n" + mit.replace("\n", " ")),
        (4, mit + " And more."), (5, "Released under the MIT Licence"), (6, "Copyright 2020 x"), (7, None), (8, ""), (9, "some text\n\nLicensed under CC-BY-NC 4.0!\r\nmore"), (9, "some text\n\nLicensed under CC-BY-NC 4.0!\r\nmore"), (None, "ISC"),
    ]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), L.known_digests(spark)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert [of[i].license_id for i in range(1, 7)] == ["MIT", "MIT", "MIT", None, "MIT-notice", None]
    assert of[5].notices == "MIT-notice" and of[9].notices == "CC-BY-NC-4.0-notice"
    assert all(of[i].digest is None and of[i].notices == "" for i in (6, 7, 8)) and of[None].digest


def test_license_edges(spark, edge_docs, no_docs, edge_rows):
    known = L.known_digests(spark)
    assert L.license_scan(edge_docs, known).count() == len(edge_rows)
    assert L.license_scan(no_docs, known).collect() == []
    assert L.license_scan(edge_docs, known.limit(0)).where("license_id IS NOT NULL").count() == 0


EVENTS = "conv_id long, pos long, kind string, call_id string, name string, arguments string, parent_id string, content string, status string, errors string, depth int, value string"


def events(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], EVENTS)


@pytest.fixture(scope="module")
def tools(spark):
    return spark.createDataFrame(C.TOOLS, "tool string, arg string, type string, required boolean")


def test_links_and_order(spark, tools):
    good = '{"limit": 2, "query": "q"}'
    rows = [
        (1, 0, "result", "a", None, None, None, "r"), (1, 1, "call", "a", "lookup", good, None, None), (1, 2, "call", "c", "lookup", good, "b", None), (1, 3, "call", "b", "lookup", good, "a", None),
        (1, 4, "result", "b", None, None, None, "rb"), (1, 5, "result", "c", None, None, None, "rc"), (1, 6, "result", "c", None, None, None, "again"), (1, 7, "result", "z", None, None, None, "lost"),
        (2, 0, "call", "x", "lookup", good, "y", None), (2, 1, "call", "y", "lookup", good, "x", None), (2, 2, "call", "s", "lookup", good, "s", None),
        (3, 0, "call", "d", "lookup", good, "gone", None), (3, 1, "call", "d", "lookup", good, None, None), (3, 2, "result", "d", None, None, None, None),
        (None, 0, "call", "n", "lookup", good, None, None), (3, 3, "call", None, "lookup", good, None, None), (3, 4, "talk", "d", None, None, None, "hi"),
    ]
    got = C.link_tool_calls(events(spark, rows), tools).collect()
    assert len(got) == len(rows)
    status = {(r.conv_id, r.pos): r.status for r in got}
    assert [status[1, i] for i in range(8)] == ["ok", "ok", "ok", "ok", "ok", "ok", "late", "orphan"]
    assert [status[2, i] for i in range(3)] == ["cycle"] * 3
    assert [status[3, i] for i in range(5)] == ["ok", "duplicate_id", "ok", "no_id", "ignored"] and status[None, 0] == "no_id"
    order = [(r.kind, r.call_id) for r in sorted((r for r in got if r.conv_id == 1 and r.call_id != "z"), key=lambda r: (r.order_pos, r.depth, r.pos))]
    assert order[:6] == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("call", "c"), ("result", "c")]
    assert next(r for r in got if r.conv_id == 3 and r.pos == 0).missing_parent


def test_long_chains_take_few_rounds(spark):
    n = 300
    calls = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.concat(F.lit("c"), "id").alias("call_id"), (n - F.col("id")).alias("pos"), (n - F.col("id")).alias("last"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("parent"))
    rows = {r.call_id: r for r in C.call_order(calls).collect()}
    assert all(rows[f"c{i}"].hops == i and rows[f"c{i}"].order_pos == n for i in range(n))


@pytest.mark.parametrize(
    ("arguments", "status", "errors"),
    [
        ('{"query": "q", "limit": 1}', "unanswered", ""), ('{"query": "q", "limit": "1"}', "invalid", "type:limit"), ('{"limit": 1.5}', "invalid", "missing:query,type:limit"), ('{"query": "q", "limit": 1, "x": {"b": [1, {"z": 1, "a": 2}]}}', "invalid", "unlisted:x"),
        ('{"query": null, "limit": 1}', "invalid", "type:query"), ('{"query": "q", "limit": 1', "bad_json", ""), ('{"query": "q", "limit": 1} x', "bad_json", ""), ('{"query": "q"},{"limit": 1}', "bad_json", ""), ('1],[2', "bad_json", ""), ("[1]", "not_object", ""), ("", "bad_json", ""), (None, "bad_json", ""), ('{"query": "q", "query": "r", "limit": 1}', "bad_json", ""),
    ],
)
def test_arguments(spark, tools, arguments, status, errors):
    got = C.link_tool_calls(events(spark, [(1, 0, "call", "a", "lookup", arguments, None, None)]), tools).first()
    assert (got.status, got.errors) == (status, errors)
    told = json.loads(got.json)
    assert list(told) == sorted(told)
    if status not in ("bad_json",):
        assert json.dumps(json.loads(arguments), sort_keys=True, separators=(",", ":"), ensure_ascii=False) in got.json


def test_tool_edges(spark, tools):
    none = events(spark, [])
    assert C.link_tool_calls(none, tools).collect() == []
    rows = events(spark, [(1, 0, "call", "a", "lookup", "{}", None, None)] * 3)
    assert [r.status for r in C.link_tool_calls(rows, tools).collect()] == ["invalid"] * 3
    assert C.link_tool_calls(rows, tools.limit(0)).first().status == "unknown_tool"
