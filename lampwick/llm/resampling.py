"""Drawing documents that resemble a target: hashed n-gram weights, noise, and the highest scores by a selection without a sort of all."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workdir import looked_up
from .common import materialise_at, pieces

BUCKETS, RUNS, SCALE = 10_000, 2, 1000
SHARE, LEAST_WORDS, SEED = 0.25, 20, 7
#: What is left of the selection is sorted by the driver once it has at most so many keys.
FEW = 10_000
#: Bytes of a text whose words are held as objects at a time.
PART = 1 << 20

#: A-Z lowered; ASCII other than digits and letters parts words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def features(data: bytes | None, runs: int = RUNS, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """For parts of the text: how many words, and the buckets of the runs of 1 to ``runs`` words that end there."""
    data = (data or b"").translate(_PLAIN)
    at, before = 0, []
    while at < len(data):
        end = data.find(b" ", at + PART)
        end = len(data) if end < 0 else end
        own = data[at:end].split()
        words, at = before + own, end
        sums, found = [crc32(w) for w in words], []
        for n in range(1, runs + 1):
            found += sums[max(0, len(before) - n + 1) :]
            sums = [crc32(b" " + w, c) for c, w in zip(sums, words[n:])]
        yield len(own), np.array(found, dtype=np.int64) % buckets
        before = words[-(runs - 1) :] if runs > 1 else []


def bucket_counts(docs: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task adds up its own, so at most ``buckets`` rows leave it."""

    def run(batches):
        held = np.zeros(buckets, dtype=np.int64)
        for part in pieces(batches):
            for data in part.column(0).to_pylist():
                for _, found in features(data, runs, buckets):
                    held += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(held[own])], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored log ratio of each bucket's smoothed shares."""
    ours, theirs = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(SCALE * math.log((t + 1) * ours / ((s + 1) * theirs))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """(doc_id, text) as (doc_id, n_features, n_words, weight): the floored mean gain of a text's features, 0 without any."""

    def run(batches):
        for part in pieces(batches):
            rows = []
            for data in part.column(1).to_pylist():
                n = words = total = 0
                for own, found in features(data, runs, len(gain)):
                    n, words, total = n + len(found), words + own, total + int(gain[found].sum())
                rows.append((n, words, total // n if n else 0))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_features", "n_words", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, n_features long, n_words long, weight long")


def noise(seed: int = SEED) -> Column:
    """Gumbel noise of a document, from a hash of the seed and its id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


ORDER = ("score", "doc_id", "tie")


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("score", "descending"), ("doc_id", "ascending"), ("tie", "ascending")], null_placement="at_end"))


def _ahead(key) -> Column:
    """Whether a row stands before the key: higher score, then smaller doc_id (null last), then tie."""
    doc, same = F.col("doc_id"), F.col("doc_id").eqNullSafe(F.lit(key["doc_id"]))
    before = doc.isNotNull() if key["doc_id"] is None else F.coalesce(doc < F.lit(key["doc_id"]), F.lit(False))
    return (F.col("score") > key["score"]) | ((F.col("score") == key["score"]) & (before | (same & (F.col("tie") < key["tie"]))))


def cutoff(keys: DataFrame, take: int, few: int = FEW):
    """The take-th of keys (score, doc_id, tie, of a written table; tie has no equals) in the order of ``_ahead``; None for none.

    Each task gives the median of the keys left in its part, and how many they
    are. The median of these, weighted so, has at least a quarter of the keys
    left on either side; one count tells which side goes. The driver gets one
    row from each task, and the last ``few`` keys.
    """
    left, n, ended = keys.select(*ORDER), keys.count(), take
    if not 0 < take <= n:
        return None

    def medians(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            part = _sorted(pa.Table.from_batches(held))
            yield from part.slice(part.num_rows // 2, 1).append_column("n", pa.array([part.num_rows], pa.int64())).to_batches()

    kind = keys.schema["doc_id"].dataType.simpleString()
    while n > few:
        found = _sorted(left.mapInArrow(medians, f"score long, doc_id {kind}, tie long, n long").toArrow())
        half = np.searchsorted(np.cumsum(found["n"].to_numpy()), n / 2)
        pivot = found.slice(int(half), 1).to_pylist()[0]
        ahead = left.where(_ahead(pivot)).count()
        if ahead + 1 == ended:
            return pivot
        if ahead >= ended:
            left, n = left.where(_ahead(pivot)), ahead
        else:
            same = (F.col("score") == pivot["score"]) & (F.col("tie") == pivot["tie"])
            left, n, ended = left.where(~_ahead(pivot) & ~same), n - ahead - 1, ended - ahead - 1
    last = left.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "tie").limit(ended).collect()[-1]
    return last.asDict()


def ranked(spark: SparkSession, drawn: DataFrame) -> DataFrame:
    """The rows with ``rank`` from 1 in the order of ``_ahead``: sorted by ranges, each range numbered by itself after those before."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"))
    ranges = drawn.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id())
    dealt, _ = materialise_at(ranges, "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("rank", own.cast("long")).join(looked_up(offsets), "_range").withColumn("rank", F.col("rank") + F.col("_before")).drop("_range", "_before")


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """A written table of doc_id, n_features, n_words, weight, score and tie, a number of the row; one row per document."""
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    rows = with_weights(docs, gain, runs)
    return materialise_at(rows.withColumns({"score": F.col("weight") + noise(seed), "tie": F.monotonically_increasing_id()}), "scored")[0]


def importance_ranks(docs: DataFrame, target: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS, **how) -> DataFrame:
    """One row per document: doc_id, n_features, n_words, weight, score and rank, null where it isn't drawn.

    docs: doc_id, text; target: text. The ``share`` highest scores of the
    documents with ``least_words`` words are drawn, ties to smaller ids; a null
    id comes after others of its score. Null and empty texts have no features
    and weight 0. Of repeated rows each has its own rank. No rows give no rows;
    other columns are ignored.
    """
    rows = scored(docs, target, **how)
    able = rows.where(F.col("n_words") >= least_words)
    last = cutoff(able, math.floor(able.count() * share))
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop("tie")
    wins = (F.col("n_words") >= least_words) & (_ahead(last) | (F.col("tie") == last["tie"]))
    others = rows.where(~wins).withColumn("rank", F.lit(None).cast("long"))
    return ranked(docs.sparkSession, rows.where(wins)).unionByName(others).drop("tie")


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, least_words: int = LEAST_WORDS, **how) -> DataFrame:
    """The drawn documents with all their columns. Repeated ids at the cutoff stay or go alike; a null id is an id."""
    ids = importance_ranks(docs, target, share, least_words, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_lw_id")).distinct()
    return docs.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_lw_id")), "left_semi")
