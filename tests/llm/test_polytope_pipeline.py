from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lampwick.llm import cross_polytope as X
from lampwick.llm import mixing, packing, pii_crf, rule_ensemble
from test_simhash import groups, similar_pairs

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score double, query_id long, gid long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, None, None, None, None, None) for i, v in rows], SCHEMA)


def exact(rows, asks, k=5):
    """For each row that asks, by its place: the k nearest other rows as (place, id, score)."""
    fine = []
    for place, (i, v) in enumerate(rows):
        if i is not None and v is not None and any(v) and all(x is not None and np.isfinite(x) for x in v):
            fine.append((place, i, np.array(v, dtype=np.float32).astype(np.float64)))
    out = {}
    for place, i, q in fine:
        if asks(i):
            scored = [(-float((q * v).sum() / (np.sqrt((q**2).sum()) * np.sqrt((v**2).sum()))), j, p) for p, j, v in fine if p != place and len(v) == len(q)]
            out[place] = i, [(j, -s) for s, j, _ in sorted(scored)[:k]]
    return out


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = X.hadamard(x)
    assert np.allclose((y**2).sum(axis=1), (x**2).sum(axis=1)) and np.allclose(X.hadamard(y), x)


def test_probes_begin_with_the_hash_and_differ():
    x = np.random.default_rng(1).normal(size=(20, 10))
    for parts in (1, 2):
        p = X.probes(x, 0, parts, 12)
        assert (p[:, :1] == X.probes(x, 0, parts, 1)).all()
        assert all(len(set(r)) == 12 for r in p.tolist())


def test_probes_of_all_buckets_are_all_buckets():
    x = np.random.default_rng(2).normal(size=(5, 8))
    assert all(sorted(r) == list(range(16)) for r in X.probes(x, 0, 1, 16).tolist())
    assert all(sorted(r) == list(range(256)) for r in X.probes(x, 1, 2, 256).tolist())


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = X.nearest(df, F.col("vec_id") % 50 == 0).collect()
    want = dict(exact([(r.vec_id, r.embedding) for r in df.collect()], lambda i: i % 50 == 0).values())
    hits = sum((r.query_id, r.vec_id) in {(q, i) for q, top in want.items() for i, _ in top} for r in got)
    assert len(got) == 5 * len(want) and hits / len(got) >= 0.9
    for r in got:
        e = dict(want[r.query_id])
        assert r.vec_id not in e or r.score == pytest.approx(e[r.vec_id], abs=1e-12)


def test_clustered_vectors_are_pruned(spark):
    """100,000 vectors in clusters and some without any: over nine in ten neighbours from under a twentieth of the rows."""
    rng = np.random.default_rng(12)
    n, width, k = 100_000, 32, 5
    centres = rng.normal(size=(2000, width))
    x = (centres[rng.integers(0, 2000, n)] + 0.25 * rng.normal(size=(n, width))).astype(np.float32)
    x[:: 100] = rng.normal(size=(n // 100, width))
    asks = np.arange(0, n, 2000) + 7
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    score = unit[asks] @ unit.T
    score[np.arange(len(asks)), asks] = -2
    near = np.argsort(-score, axis=1, kind="stable")[:, :k]
    how = X.fitted(np.repeat(unit[asks], k, axis=0), unit[near.reshape(-1)], n)
    seen = np.zeros((len(asks), n), dtype=bool)
    for table in range(how.tables):
        buckets, asked = X.probes(unit, table, how.parts, 1)[:, 0], X.probes(unit[asks], table, how.parts, how.probes)
        for i in range(len(asks)):
            seen[i] |= np.isin(buckets, asked[i])
    assert np.take_along_axis(seen, near, axis=1).mean() >= 0.9 and seen.mean() <= 0.05, (how, seen.mean())
    rows = pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x[:20_000].tolist()})
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = X.nearest(df, F.col("vec_id") % 500 == 7).collect()
    want = {}
    for q in range(7, 20_000, 500):
        s = unit[:20_000] @ unit[q]
        s[q] = -2
        want[q] = set(np.argsort(-s, kind="stable")[:k].tolist())
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * len(want) * k


def test_small_and_odd_tables_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(12)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(9)]  # equal vectors, one of them asking
    rows += [(3, rows[3][1]), (3, rows[3][1]), (3, rows[4][1]), (100, rows[5][1]), (100, rows[5][1])]  # rows that share an id, some of them asking
    rows += [(200, None), (250, [0.0] * 6), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (350, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (400, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (450, [1.0, 2.0]), (451, [2.0, 1.0]), (500, [])]
    got = X.nearest(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = exact([r for r in rows if r[1] is None or len(r[1])], lambda i: i % 50 == 0)
    rounded = lambda answers: sorted((q, k, i, round(s, 9)) for q, top in answers for k, (i, s) in enumerate(top, 1))
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == rounded(want.values())
    assert X.nearest(table(spark, []), F.col("vec_id") % 50 == 0).collect() == []


def test_cells_hold_all_of_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(X, "CELL", 16)
    rng = np.random.default_rng(8)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.01 * rng.normal(size=8)).tolist()) for i in range(300)]  # all in one bucket
    want = dict(exact(rows, lambda i: i % 50 == 0).values())
    for how in (X.Setting(1, 1, 16), X.Setting(2, 1, 3)):
        got = X.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, setting=how).collect()
        assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {(q, k + 1): i for q, top in want.items() for k, (i, _) in enumerate(top)}


def test_pipeline_stages_are_the_operators(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, rows = [], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf)
        out.write.parquet(str(tmp_path / str(k)))
        rows, before = spark.read.parquet(str(tmp_path / str(k))), rows
        seen.append(rows)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == docs.columns
    classified, unique, clean, mixed, packed = seen
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in classified.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1) and not all(i in kept for i, q in labels.items() if q == 0)
    ids, texts = zip(*((r.doc_id, r.text) for r in sorted(classified.collect())))
    smallest = groups(range(len(ids)), similar_pairs(texts))
    left = sorted(r.doc_id for r in unique.collect())
    assert {ids[i] for i in smallest.values()} <= set(left) and len(left) <= 1.02 * len(set(smallest.values()))
    assert all(not pii_crf.base_spans(r.text) for r in clean.collect()) and clean.count() == unique.count()
    assert packed.count() == mixed.count() and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(r.doc_id for r in packed.collect())


def test_pipeline_against_plain_python(spark):
    """run() again in plain Python, from what the classifier and the near-dedup keep: redaction, sizes, targets, copies' totals and packing."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    field = pii_crf.train()
    out = corpus_pipeline.run(spark, sf).collect()
    before = {r.doc_id: r for r in docs.collect()}
    size = lambda t: len((t or "").encode().split())
    for r in out:
        (base, more), text = pii_crf.spans_of([before[r.doc_id].text], field)[0], before[r.doc_id].text
        assert r.text == pii_crf.redacted(text, base + more) and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source) and r.n_tokens == size(r.text)
    kept = {r.doc_id: r for r in corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, sf), sf).collect()}
    words = {}
    for i in kept:
        text = pii_crf.redacted(before[i].text, sum(pii_crf.spans_of([before[i].text], field)[0], []))
        words[i] = size(text)
    sources = sorted({r.source for r in kept.values()})
    own = {s: sum(n for i, n in words.items() if kept[i].source == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(own.values()), set(sources)
    while True:  # fill up sources and share the excess until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * own[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * own[s]
            left -= target[s]
        open_ -= full
    target |= share
    for s in sources:
        taken = sum(r.n_tokens for r in out if r.source == s)
        assert abs(taken - target[s]) <= 0.05 * target[s] + 2 * max(n for i, n in words.items() if kept[i].source == s)
    times = Counter(r.doc_id for r in out)
    assert max(times.values()) <= 2
    lengths = sorted(set(r.n_tokens for r in out))
    bounds = packing.best_bounds(np.array(lengths), np.array([sum(r.n_tokens == n for r in out) for n in lengths]))
    batches = Counter()
    for r in out:
        assert r.bucket == min(b for b in bounds if b >= r.n_tokens)
        batches[r.batch, r.bucket] += 1
    assert all(n <= max(1, packing.BUDGET // max(1, b)) for (_, b), n in batches.items())


def test_pipeline_stages_on_odd_and_empty_tables(spark, edge_docs, no_docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("some", "none"):
        labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (4, 0, 0), (6, 1, 0)] if name == "some" else [], "doc_id long, quality int, toxic int")
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, edge_docs, str(tmp_path / name))
            rows = out.collect()
            assert rows, stage_name
            if stage_name != "packing":
                assert out.columns == edge_docs.columns
            assert stage(spark, no_docs, str(tmp_path / name)).collect() == []
    assert {r.doc_id for r in rule_ensemble.kept_by_quality(edge_docs, spark.read.parquet(str(tmp_path / "none" / "labels.parquet"))).collect()} == {1, 2, 3, 4, None, 5, 6, 7, 8, 9}
    assert mixing.mix(edge_docs).where("text IS NULL").count() >= 0
