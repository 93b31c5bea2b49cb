"""Packing into length buckets whose bounds make padding least."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, materialise, md5_int, n_words
from .ranks import bin_offsets, binned, n_sub_bins, with_rank

BUCKETS, BUDGET = 16, 16384


def cheapest(earlier: np.ndarray, before: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end j the least earlier[i] + (before[j + 1] - before[i]) * lengths[j] over i <= j, and the first i that has it.

    The first best i never falls as j rises, so the ends in the middle of ranges
    split both ends and starts: all ranges of one depth are tried at once, with
    about as many tries as there are lengths.
    """
    m = len(lengths)
    least, start = np.empty(m), np.empty(m, dtype=np.int64)
    low, high = np.array([0]), np.array([m - 1])  # ends
    first, last = np.array([0]), np.array([m - 1])  # starts
    while len(low):
        middle = (low + high) // 2
        n = np.minimum(middle, last) - first + 1
        at = np.cumsum(n) - n
        i = np.arange(n.sum()) + np.repeat(first - at, n)
        j = np.repeat(middle, n)
        cost = earlier[i] + (before[j + 1] - before[i]) * lengths[j]
        best = np.minimum.reduceat(cost, at)
        where = np.minimum.reduceat(np.where(cost == np.repeat(best, n), i, m), at)
        least[middle], start[middle] = best, where
        left, right = low < middle, middle < high
        low, high, first, last = (
            np.concatenate([low[left], middle[right] + 1]), np.concatenate([middle[left] - 1, high[right]]),
            np.concatenate([first[left], where[right]]), np.concatenate([where[left], last[right]]),
        )
    return least, start


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, at most ``buckets`` of them, that make the padding least: dynamic programming over the histogram.

    lengths rise. The cost of a bucket that ends at j is its documents times
    lengths[j]; what the documents hold themselves is the same for any bounds.
    Ties go to the earlier start.
    """
    m = len(lengths)
    if not m:
        return []
    lengths = lengths.astype(np.float64)
    before = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    cost = before[1:] * lengths
    starts = [np.zeros(m, dtype=np.int64)]
    for _ in range(1, min(buckets, m)):
        cost, start = cheapest(np.concatenate([[0.0], cost[:-1]]), before, lengths)
        starts.append(start)
    bounds, j = [], m - 1
    for start in reversed(starts):
        if j < 0:
            break
        bounds.append(int(lengths[j]))
        j = int(start[j]) - 1
    return bounds[::-1]


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Adds n_tokens, bucket (its bound), batch, padding and n_slots.

    Tokens are words; null texts have none. A bucket is padded to its bound, and
    a batch of it holds budget // bound documents; where one document alone is
    over the budget, it is a batch by itself and stays whole. Batches fill in
    the order of the bucket's ranks, so all but the last of a bucket are full.
    Repeated rows are separate documents; columns of these names are replaced;
    no rows give no rows. Only the histogram reaches the driver: a row for each
    length that occurs, so no more rows than the longest text has words, whatever
    the number of documents.
    """
    added = ("n_tokens", "bucket", "batch", "padding", "n_slots")
    names = [c for c in docs.columns if c.lower() not in added]
    docs, own = aside(docs.select(*names), "_lw_")
    docs = docs.withColumn("n_tokens", n_words())
    facts = materialise(docs.groupBy(F.col("n_tokens").alias("length"), md5_int(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_lw_hash"), F.length(F.bin("n_tokens")).alias("_lw_class")).agg(F.count("*").alias("n")), "lengths")
    bins = facts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").toPandas()
    bounds = best_bounds(bins["length"].to_numpy(), bins["n"].to_numpy(), buckets) or [0]
    rows = int(bins["n"].sum())
    ends = F.array(*map(F.lit, bounds))
    # never null, so that no join asks for it again below the word count, once per bound
    bucket = lambda c: F.coalesce(F.get(F.filter(ends, lambda b: b >= c), F.lit(0)).cast("long"), F.lit(-1).cast("long"))
    counts = facts.groupBy(bucket(F.col("length")).alias("bucket"), "_lw_class", (F.col("_lw_hash") % n_sub_bins(rows)).cast("int").alias("_lw_sub")).agg(F.sum("n").alias("n"))
    df = binned(docs.withColumn("bucket", bucket(F.col("n_tokens"))), "bucket", "n_tokens", "doc_id", rows)
    ranked = with_rank(df, "bucket", "n_tokens", "doc_id", bin_offsets(counts, "bucket"), F.xxhash64("text"))
    slots = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket")))).cast("long")
    batch = F.concat_ws("-", F.col("bucket").cast("string"), F.floor((F.col("_lw_rank") - 1) / slots).cast("string"))
    return ranked.withColumns({"n_slots": slots, "batch": batch, "padding": F.col("bucket") - F.col("n_tokens")}).select(*own, *added)


def batches(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per batch: batch, bucket, n_docs, n_tokens, padding."""
    return packed(docs, buckets, budget).groupBy("batch", "bucket").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("padding").alias("padding"))
