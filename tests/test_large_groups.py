"""De-duplication where one group has all rows and so lies in many ranges and blocks, against plain Python."""

import random

import numpy as np
import pytest

from lampwick.operators import dedup, metrics, ranges

SCHEMA = "video_key string, page_type string, image_path string, pos long, frame_index int, unique_ids array<string>"


@pytest.fixture(autouse=True, params=[50, 10**6], ids=["ranges", "one range"])
def large(request, monkeypatch):
    monkeypatch.setattr(ranges, "LARGE", request.param)
    return request.param


def pages_of(spark, rows):
    return spark.createDataFrame([(v, "t", f"/p/{i:06d}.png", i, f, ids) for i, (v, f, ids) in enumerate(rows)], SCHEMA)


def plain_islands(rows):
    out, before, island = {}, None, 0
    for f, i in sorted((f if f is not None else -(1 << 40), i) for i, (_, f, _) in enumerate(rows)):
        island += before is None or f == -(1 << 40) or before != f - 1
        before, out[i] = (None if f == -(1 << 40) else f), island
    return out


def test_islands_of_one_video(spark):
    rng = random.Random(1)
    frames = sorted(rng.sample(range(4000), 3000)) + [7, 7, -1, -1, None, None]
    rows = [("v", f, None) for f in frames]
    rng.shuffle(rows)
    got = {r.pos: r.island for r in dedup.coverage_islands(pages_of(spark, rows)).collect()}
    assert got == plain_islands(rows)


def test_islands_keep_groups_apart(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(60), None) for _ in range(90)] + [("z", f, None) for f in range(500)]
    got = {r.pos: r.island for r in dedup.coverage_islands(pages_of(spark, rows)).collect()}
    for v in ("a", "b", None, "z"):
        own = [(i, r) for i, r in enumerate(rows) if r[0] == v]
        assert {i: got[i] for i, _ in own} == {own[k][0]: n for k, n in plain_islands([r for _, r in own]).items()}


def plain_window(rows, window):
    kept, last = {}, {}
    for v, f, i in sorted(((v, f if f is not None else -1, i) for i, (v, f, _) in enumerate(rows)), key=lambda x: (str(x[0]), x[1], x[2])):
        before = last.get(v)
        kept[i] = f < 0 or before is None or f - before > window or f == before
        if kept[i] and f >= 0:
            last[v] = f
    return kept


@pytest.mark.parametrize("window", [1, 3, 100, 1500, 10**6])
def test_sliding_window_of_one_id(spark, window):
    rng = random.Random(window)
    rows = [("v", rng.randrange(6000), ["x"]) for _ in range(3000)] + [("v", None, ["x"]), ("v", -1, ["x"]), ("v", -1, ["x"])]
    rows += [(v, rng.randrange(300), ["x", "y"]) for v in ("w", None) for _ in range(40)] + [("w", 5, []), ("w", 5, None)]
    found = dedup.sliding_window_dedup(pages_of(spark, rows), window).collect()
    with_id = [i for i, r in enumerate(rows) if r[2]]
    expected = plain_window([rows[i] for i in with_id], window)
    assert {r.pos: r.action == "kept" for r in found} == {with_id[i]: k for i, k in expected.items()} and len(found) == len(with_id)


def test_chain_maps():
    rng = np.random.default_rng(3)
    for window in (1, 4, 50):
        frames = np.unique(rng.integers(0, 400, 150))
        after, last = dedup._followed(frames, window)
        for i in range(len(frames)):
            at = i
            while after[at] < len(frames):
                at = after[at]
            assert last[i] == at
        entries = set(dedup._entries(frames, window).tolist())
        for kept in range(frames[0] - 3 * window, frames[0]):
            beyond = np.flatnonzero(frames > kept + window)
            assert not len(beyond) or beyond[0] in entries


def plain_cover(rows):
    islands = plain_islands(rows)
    out = {}
    for island in set(islands.values()):
        own = sorted((rows[i][1] if rows[i][1] is not None else -(1 << 40), i) for i, n in islands.items() if n == island)
        for (_, i), kept in zip(own, dedup.greedy_cover([set(rows[i][2] or []) for _, i in own])):
            out[i] = kept
    return out


@pytest.mark.parametrize("kind", ["random", "chain", "shared"])
def test_cover_of_a_large_island(spark, kind):
    rng = random.Random(4)
    if kind == "random":
        ids = [[f"i{rng.randrange(400)}" for _ in range(rng.randrange(6))] for _ in range(1200)]
    elif kind == "chain":  # each page waits for the one before
        ids = [[f"i{n}", f"i{n + 1}"] for n in range(1200)]
    else:
        ids = [["all", f"i{n % 90}", None] if n % 7 else None for n in range(1200)]
    rows = [("v", n, x) for n, x in enumerate(ids)] + [("v", 5000 + n, [f"i{n % 3}"]) for n in range(30)] + [("w", 1, None)]
    found = dedup.coverage_min_set_dedup(pages_of(spark, rows), large=200, block=100).collect()
    expected = plain_cover([r for r in rows if r[0] == "v"])
    assert {r.pos: r.action == "kept" for r in found if r.video_key == "v"} == expected and len(found) == len(rows)
    assert [r.reason for r in found if r.video_key == "w"] == [dedup.UNCOVERED]


def test_cover_of_a_hundred_thousand_pages(spark, large):
    if large > 50:
        pytest.skip("once is enough")
    rng = np.random.default_rng(5)
    n = 100_000
    ids = [[f"i{k}" for k in row] for row in rng.integers(0, 60_000, (n, 2))]
    rows = [("v", f, x) for f, x in enumerate(ids)]
    found = dedup.coverage_min_set_dedup(pages_of(spark, rows), block=20_000).where("action = 'kept'").select("pos").collect()
    assert {r.pos for r in found} == {i for i, kept in enumerate(dedup.greedy_cover([set(x) for x in ids])) if kept}


@pytest.mark.parametrize("middle", [True, False])
def test_global_dedup_of_one_id(spark, middle):
    rows = [("v", n, ["x"]) for n in range(2001)] + [("w", n, [f"y{n % 5}"]) for n in range(40)] + [(None, 1, ["x"]), ("w", 1, [])]
    found = dedup.global_id_dedup(pages_of(spark, rows), middle).collect()
    kept = {(r.video_key, r.pos): r.reason for r in found if r.action == "kept"}
    assert len(found) == len(rows) - 1 and len(kept) == 7
    at = 1000 if middle else 0
    assert kept["v", at] == (dedup.MIDDLE if middle else dedup.FIRST) % 2001 and kept[None, 2041] == dedup.ONLY


def test_quantiles_of_one_group(spark):
    rng = random.Random(9)
    values = [("a", rng.randrange(5000)) for _ in range(4000)] + [("b", rng.choice([1, 2, None])) for _ in range(50)] + [("c", None), (None, 7)]
    found = {r.g: r for r in metrics.latency_metrics(spark.createDataFrame(values, "g string, latency long"), ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted(v for k, v in values if k == g and v is not None)
        rank = lambda p: own[max(1, -(-int(p * 1000) * len(own) // 1000)) - 1]  # noqa: E731, B023
        assert (found[g].p50, found[g].p95, found[g].p99, found[g].p999, found[g].n) == (rank(0.5), rank(0.95), rank(0.99), rank(0.999), len(own))
    assert (found["c"].p50, found["c"].n) == (None, 0)
