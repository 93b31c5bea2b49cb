import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lampwick.llm import mixing, packing


def plain_targets(sizes, weights=(3, 1, 2), total=1.5, most=2.0):
    order = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    want, left, open_ = {}, total * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return want | {s: level * weight[s] for s in open_}
        for s in full:
            want[s] = most * sizes[s]
            left -= want[s]
        open_ -= full
    return want


@pytest.mark.parametrize("seed", range(3))
def test_targets_fill_in_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"0s{i}": rng.choice((0, 10, 1000, 5000, 100_000)) for i in range(9)}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "_lw_key string, source_size long")).collect()
    want = plain_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r["_lw_key"]])


def test_copies_follow_the_targets(spark, sample):
    df = mixing.with_copies(sample.select("doc_id", "text", "source"))
    rows = df.collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in mixing.with_copies(sample.repartition(7)).collect())
    for _, own in itertools.groupby(sorted(rows, key=lambda r: r.source), key=lambda r: r.source):
        own = list(own)
        assert all(0 <= r.copies <= 2 for r in own)
        rate = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - rate * len(own)) <= 1  # systematic: within one of what is expected
    mixed = mixing.mix(sample)
    assert mixed.columns == sample.columns
    assert mixed.count() == sum(r.copies for r in rows)


def test_systematic_sampling_is_a_prefix_sum(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") < 400, "big").otherwise("small").alias("source"))
    rows = mixing.with_copies(docs).collect()
    for source in ("big", "small"):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.copies for r in own) - own[0].target / 2) <= 1


def test_mixing_edges(edge_docs, no_docs, edge_rows):
    got = mixing.with_copies(edge_docs)
    rows = got.collect()
    assert len(rows) == len(edge_rows)
    assert {r.source for r in rows} == {"a", "b", None, "ß", ""}
    assert all(r.size == 0 for r in rows if not (r.text or "").strip(" \t\n"))
    assert got.columns.count("size") == 1 and "rank" in got.columns and all(r["rank"] is None for r in rows)
    assert mixing.with_copies(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


def brute_bounds(lengths, counts, buckets):
    best = None
    for cut in itertools.combinations(range(len(lengths) - 1), min(buckets, len(lengths)) - 1):
        ends = [*cut, len(lengths) - 1]
        padding = 0
        for i, (n, c) in enumerate(zip(lengths, counts)):
            padding += (lengths[next(e for e in ends if e >= i)] - n) * c
        best = padding if best is None else min(best, padding)
    return best


def padding_of(bounds, lengths, counts):
    return sum((min(b for b in bounds if b >= n) - n) * c for n, c in zip(lengths, counts))


def test_bounds_are_the_best():
    rng = random.Random(1)
    for _ in range(40):
        m = rng.randint(1, 9)
        lengths = np.array(sorted(rng.sample(range(0, 60), m)))
        counts = np.array([rng.randint(1, 20) for _ in range(m)])
        k = rng.randint(1, 5)
        bounds = packing.best_bounds(lengths, counts, k)
        assert len(bounds) <= k
        assert padding_of(bounds, lengths.tolist(), counts.tolist()) == brute_bounds(lengths.tolist(), counts.tolist(), k)
    assert packing.best_bounds(np.array([]), np.array([])) == []


def test_many_lengths_against_every_start():
    """The split of ranges against the plain recurrence, on histograms too wide to try all cuts."""
    rng = np.random.default_rng(2)
    for m, k in ((1, 3), (2, 5), (257, 16), (700, 9)):
        lengths = np.sort(rng.choice(40_000, m, replace=False))
        counts = rng.integers(1, 1000, m)
        before = np.concatenate([[0], np.cumsum(counts)])
        least = before[1:] * lengths
        for _ in range(1, min(k, m)):
            earlier = np.concatenate([[0], least[:-1]])
            least = np.array([min(earlier[i] + (before[j + 1] - before[i]) * lengths[j] for i in range(j + 1)) for j in range(m)])
        bounds = packing.best_bounds(lengths, counts, k)
        assert len(bounds) <= k and padding_of(bounds, lengths.tolist(), counts.tolist()) == least[-1] - (lengths * counts).sum()


def test_packing_of_a_table_is_the_best(spark):
    """The whole operator against all cuts, with lengths far above a thousand words."""
    rng = random.Random(4)
    sizes = [rng.choice((0, 3, 40, 900, 1023, 1025, 1026, 1500, 2047, 2049, 5000, 5003)) for _ in range(60)]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    lengths = sorted(set(sizes))
    rows = packing.packed(docs, buckets=4, budget=10_000).collect()
    assert sum(r.padding for r in rows) == brute_bounds(lengths, [sizes.count(n) for n in lengths], 4)
    for r in rows:
        assert r.bucket == min(b for b in {x.bucket for x in rows} if b >= r.n_tokens) and r.n_slots == max(1, 10_000 // max(1, r.bucket))


def test_batches_keep_the_budget(sample):
    rows = packing.packed(sample, buckets=6, budget=3000).collect()
    assert len(rows) == sample.count()
    batches = {}
    for r in rows:
        assert r.n_tokens == len((r.text or "").encode().split()) and r.padding == r.bucket - r.n_tokens >= 0
        batches.setdefault(r.batch, []).append(r)
    for own in batches.values():
        assert len({r.bucket for r in own}) == 1
        assert len(own) * own[0].bucket <= 3000 or len(own) == 1
    by_bucket = {}
    for own in batches.values():
        by_bucket.setdefault(own[0].bucket, []).append(len(own))
    assert all(sorted(n)[1:] == [max(n)] * (len(n) - 1) for n in by_bucket.values())  # all but one are full
    totals = packing.batches(sample, 6, 3000).agg(F.sum("n_docs"), F.count("*")).first()
    assert tuple(totals) == (len(rows), len(batches))


def test_packing_edges(edge_docs, no_docs, edge_rows):
    rows = packing.packed(edge_docs, buckets=3, budget=100).collect()
    assert len(rows) == len(edge_rows)
    long_row = next(r for r in rows if r.doc_id == 6)
    assert long_row.n_tokens == 120_000 and sum(r.batch == long_row.batch for r in rows) == 1
    assert packing.packed(no_docs).collect() == []
