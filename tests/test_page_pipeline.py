"""The page pipeline and the dispatch against plain Python, row by row."""

import re
from collections import defaultdict

from lampwick import fixtures as fx
from lampwick.operators import dedup
from lampwick.plans import table_queries as tq

SF = "/root/testdata/sf0.001"


def plain_classes(text, rules):
    low, out = text.lower(), []
    for r in rules:
        if r.page_type == "unknown" or any(x.lower() in low for x in r.exclude):
            continue
        if all(re.search(p, text, 0 if p.startswith("(?") else re.I | re.A) for p in r.verify_regexes if p.strip()) and sum(k.lower() in low for k in r.keywords) >= r.min_matches:
            out.append(r.page_type)
    return out or ["unknown"]


def plain_global(rows):
    groups = defaultdict(list)
    for r in rows:
        if r["ids"]:
            groups[r["ids"][0]].append(r)
    return {sorted(g, key=lambda r: (r["path"].rpartition("/")[2], r["pos"]))[len(g) // 2]["path"] for g in groups.values()}


def plain_sliding(rows, window):
    kept = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["frame"], r["pos"])):
        if r["ids"] and not any(r["frame"] - window <= k["frame"] < r["frame"] for k in kept[r["ids"][0]]):
            kept[r["ids"][0]].append(r)
    return {r["path"] for g in kept.values() for r in g}


def plain_cover(rows):
    rows, islands = sorted(rows, key=lambda r: (r["frame"], r["pos"])), []
    for r in rows:
        if islands and r["frame"] == islands[-1][-1]["frame"] + 1:
            islands[-1].append(r)
        else:
            islands.append([r])
    return {r["path"] for island in islands for r, k in zip(island, dedup.greedy_cover([set(r["ids"]) for r in island])) if k}


def plain_dedup(rows, rule):
    how = rule and (rule.dedup_strategy or rule.dedup_rule or "")
    if rule is None:
        return set()
    if how == "SlidingWindow_dedup":
        return plain_sliding(rows, int(rule.window_size))
    return plain_cover(rows) if how == "CoverageMinSet_dedup" else plain_global(rows)


def kept_by(rows, rules):
    parts, out = defaultdict(list), set()
    for r in rows:
        parts[r["video"], r["type"]].append(r)
    for (video, kind), own in parts.items():
        out |= {(video, kind, p) for p in plain_dedup(own, rules.get(kind))}
    return out


def test_page_pipeline(spark):
    t = fx.Tables(spark, SF)
    rules = fx.page_rules(t).collect()
    rows = []
    for p in fx.pages(t).collect():
        found = re.findall(r"([A-Z][a-z]+)\b", re.sub(r"\b(?:[01]?\d|2[0-3]):[0-5]\d\b", "", p.ocr_text, flags=re.A), re.A)
        ids = ["-".join(found)] if found else []
        rows += [{"video": p.video_key, "type": c, "path": p.image_path, "pos": p.pos, "frame": p.frame_index, "ids": ids} for c in plain_classes(p.ocr_text, rules)]
    want = kept_by(rows, {r.page_type: r for r in rules if r.page_type != "unknown"})
    got = {(r.video_key, r.page_type, r.image_path) for r in tq.page_pipeline(t).collect()}
    assert got == want and len(got) > 50


def test_dispatch(spark):
    t = fx.Tables(spark, SF)
    pages = fx.dedup_input(t)
    rules = tq._dispatch_rules(t)
    rows = [{"video": p.video_key, "type": p.page_type, "path": p.image_path, "pos": p.pos, "frame": p.frame_index, "ids": p.unique_ids} for p in pages.collect()]
    done = tq.dedup_dispatch(t).collect()
    got = {(r.video_key, r.page_type, r.image_path) for r in done if r.action == "kept"}
    assert got == kept_by(rows, {r.page_type: r for r in rules.collect()})
    cover = {(r.video_key, r.page_type, r.image_path) for r in tq.coverage_min_set_dedup(t).where("action = 'kept'").collect()}
    parts = defaultdict(list)
    for r in rows:
        parts[r["video"], r["type"]].append(r)
    assert cover == {(v, k, p) for (v, k), own in parts.items() for p in plain_cover(own)}


def test_dispatch_takes_any_window_size(spark):
    rows = [("v", kind, f"{kind}{i}", i, i, ["x"]) for kind in ("a", "b", "c") for i in range(0, 400, 5)]
    pages = spark.createDataFrame(rows, "video_key string, page_type string, image_path string, pos long, frame_index int, unique_ids array<string>")
    rules = spark.createDataFrame([("a", "SlidingWindow_dedup", None, "17"), ("b", "SlidingWindow_dedup", None, "42"), ("c", "SlidingWindow_dedup", None, "no")], "page_type string, dedup_strategy string, dedup_rule string, window_size string")
    done = dedup.dedup_dispatch(pages, rules).collect()
    assert len(done) == len(rows)
    for kind, window in (("a", 17), ("b", 42), ("c", 100)):
        own = [{"path": p, "pos": i, "frame": f, "ids": ids} for _, k, p, i, f, ids in rows if k == kind]
        assert {r.image_path for r in done if r.page_type == kind and r.action == "kept"} == plain_sliding(own, window)
