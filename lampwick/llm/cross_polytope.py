"""Approximate nearest neighbours by cross-polytope hashing.

How many tables are used, how many hashes are joined for a bucket and how many
buckets a query looks into is fitted to the vectors: for a bounded sample of
queries the exact neighbours are found by one pass over all rows, and the
cheapest setting is taken that would collect FIT_RECALL of them. On clustered
vectors this prunes nearly all rows; on vectors without any structure no hash
can, and it comes near to a full search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, pieces

SEED = 7
#: Settings that are tried: tables, joined hashes, and the most buckets that a query looks into in a table.
TABLES, PARTS, MOST_PROBES = (1, 2, 4, 8, 12), (1, 2), 1024
#: Queries of the sample, and the part of their neighbours that the setting must collect.
SAMPLE, FIT_RECALL = 128, 0.97
#: What looking into a bucket costs, in vectors compared.
LOOK = 32.0
#: Vectors and queries that one cell of a search holds at most, about.
CELL = 2048
FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("near", T.LongType()), T.StructField("score", T.DoubleType())])
SENT = T.StructType([T.StructField("gid", T.LongType()), T.StructField("table", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("vector", T.BinaryType())])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard; the signs depend on width, table and part only."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, width, table, part]).integers(0, 2, (3, width)) * 2.0 - 1
    for s in signs:
        y = hadamard(y * s)
    return y


def probes(x: np.ndarray, table: int, parts: int, count: int) -> np.ndarray:
    """For each unit row the ``count`` likeliest buckets, the nearest first.

    A part hashes to the nearest signed axis; the next ones are the signed axes
    with the next largest components. With several parts, the buckets with the
    largest sums of components come first. Rows go some at a time, as many as
    keep small what is sorted.
    """
    wide = 2 << max(1, (x.shape[1] - 1).bit_length())
    step = max(1, (1 << 20) // (min(count, wide) * wide if parts > 1 else wide))
    return np.concatenate([_probes(x[at : at + step], table, parts, count) for at in range(0, max(1, len(x)), step)])


def _probes(x: np.ndarray, table: int, parts: int, count: int) -> np.ndarray:
    keys, sums = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    for part in range(parts):
        y = rotated(x, table, part)
        width = y.shape[1]
        signed = np.stack([y, -y], axis=2).reshape(len(y), 2 * width)  # the code of a signed axis is its place here
        code = np.argsort(-signed, axis=1, kind="stable")[:, : min(count, 2 * width)]
        value = np.take_along_axis(signed, code, axis=1)
        keys = (keys[:, :, None] * (2 * width) + code[:, None, :]).reshape(len(x), -1)
        sums = (sums[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-sums, axis=1, kind="stable")[:, :count]
        keys, sums = np.take_along_axis(keys, best, axis=1), np.take_along_axis(sums, best, axis=1)
    return keys


@dataclass(frozen=True)
class Setting:
    tables: int
    parts: int
    probes: int


def fitted(queries: np.ndarray, near: np.ndarray, rows: int) -> Setting:
    """The cheapest setting that collects FIT_RECALL of the pairs of unit vectors (queries[i], near[i]) in a table of so many rows."""
    width = 1 << max(1, (queries.shape[1] - 1).bit_length())
    best = None
    for parts in PARTS:
        buckets = (2 * width) ** parts
        most = min(buckets, MOST_PROBES)
        need = np.full(len(queries), np.inf)
        for table in range(max(TABLES)):
            asked, own = probes(queries, table, parts, most), probes(near, table, parts, 1)
            hit = asked == own
            need = np.minimum(need, np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, np.inf))
            if table + 1 in TABLES:
                count = np.sort(need)[min(len(need) - 1, math.ceil(FIT_RECALL * len(need)) - 1)]
                cost = (table + 1) * count * (rows / buckets + LOOK)
                if count <= most and (best is None or cost < best[0]):
                    best = cost, Setting(table + 1, parts, int(count))
    return best[1] if best else Setting(1, 1, 2 * width)  # all buckets


def _dense(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length of a list column, as (places, matrix)."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    return [(rows, flat[starts[rows][:, None] + np.arange(length)]) for length in np.unique(lengths) for rows in [np.nonzero(lengths == length)[0]]]


def _sampled(gids: np.ndarray, vectors: list[np.ndarray], k: int):
    """The k nearest in each batch of every sampled query."""

    def run(batches):
        schema = pa.schema([("query", pa.int64()), ("near", pa.int64()), ("score", pa.float64()), ("embedding", pa.list_(pa.float64()))])
        for part in pieces(batches, 4096):
            ids, out = part.column(0).to_numpy(zero_copy_only=False), []
            for rows, x in _dense(part.column(1)):
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for gid, v in zip(gids, vectors):
                    if len(v) == x.shape[1]:
                        score = np.where(ids[rows] == gid, -np.inf, unit @ (v / np.linalg.norm(v)))
                        out += [(gid, ids[rows[i]], score[i], x[i]) for i in np.argsort(-score, kind="stable")[:k] if score[i] > -np.inf]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def fit(distinct: DataFrame, k: int) -> Setting:
    """From (gid, asks, embedding): see fitted(). What reaches the driver are SAMPLE queries with k neighbours each."""
    sample = distinct.where("asks").orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).select("gid", "embedding").collect()
    gids, vectors = np.array([r.gid for r in sample], dtype=np.int64), [np.array(r.embedding, dtype=np.float64) for r in sample]
    near = distinct.select("gid", "embedding").mapInArrow(_sampled(gids, vectors, k), "query long, near long, score double, embedding array<double>")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    rows = near.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k).select("query", "embedding").collect()
    of = dict(zip(gids.tolist(), vectors))
    usual = max((len(v) for v in vectors), default=0, key=[len(v) for v in vectors].count)
    pairs = [(of[r["query"]], np.array(r.embedding)) for r in rows if len(r.embedding) == usual]
    if not pairs:
        return Setting(1, 1, 2)
    a, b = (np.stack(x) for x in zip(*pairs))
    return fitted(a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True), distinct.count())


def _sender(how: Setting, count: int, single: bool):
    """Rows (gid, vector) to one row per table and probe. Vectors of different lengths never share a bucket.

    Vectors travel in the precision that they came in.
    """

    def run(batches):
        schema = pa.schema([("gid", pa.int64()), ("table", pa.int32()), ("bucket", pa.int64()), ("vector", pa.binary())])
        for part in pieces(batches, 1024):
            gids = part.column(0).to_numpy(zero_copy_only=False)
            for rows, x in _dense(part.column(1)):
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                raw = pa.array([r.tobytes() for r in (x.astype(np.float32) if single else x)], pa.binary())
                for table in range(how.tables):
                    keys = probes(unit, table, how.parts, count) * 65536 + x.shape[1]
                    place = np.repeat(np.arange(len(rows)), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(gids[rows][place]), pa.array(np.full(len(place), table, dtype=np.int32)), pa.array(keys.reshape(-1)), raw.take(pa.array(place))], schema=schema)

    return run


def _search(k: int, single: bool):
    """Within a cell, the k vectors of largest cosine for each query, smaller gid first among equals."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        asked = cell["asks"].to_numpy()
        if asked.all() or not asked.any():
            return pd.DataFrame({"query": pd.Series([], dtype="int64"), "near": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        x = np.frombuffer(b"".join(cell["vector"]), dtype=np.float32 if single else np.float64).reshape(len(cell), -1).astype(np.float64)
        gid, norm = cell["gid"].to_numpy(), np.sqrt((x * x).sum(axis=1))
        order = np.argsort(gid[~asked], kind="stable")
        base, ids, base_norm = x[~asked][order], gid[~asked][order], norm[~asked][order]
        out = []
        for i in np.nonzero(asked)[0]:
            score = (base * x[i]).sum(axis=1) / (base_norm * norm[i])
            best = np.argsort(-score, kind="stable")[:k]
            out.append((np.full(len(best), gid[i]), ids[best], score[best]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query", "near", "score"), zip(*out))})

    return run


def _cells(base: DataFrame, asks: DataFrame, k: int, single: bool) -> DataFrame:
    """The search of every query of a bucket among all vectors of the bucket, in cells of CELL by CELL.

    A bucket that holds much is cut by a hash of the vectors and of the queries,
    so nothing of it is left out and no cell grows with it. The cuts are joined by
    table and bucket; a hot bucket is split by adaptive skew handling.
    """
    n = lambda df, c: df.groupBy("table", "bucket").agg(F.ceil(F.count("*") / CELL).cast("int").alias(c))
    cuts = materialise(n(base, "base_cuts").join(n(asks, "ask_cuts").hint("merge"), ["table", "bucket"]), "cuts").hint("merge")
    cut = lambda c: F.pmod(F.xxhash64("gid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = base.join(cuts, ["table", "bucket"]).withColumn("x", cut("base_cuts")).withColumn("y", every("ask_cuts")).withColumn("asks", F.lit(False))
    right = asks.join(cuts, ["table", "bucket"]).withColumn("y", cut("ask_cuts")).withColumn("x", every("base_cuts")).withColumn("asks", F.lit(True))
    cols = ["table", "bucket", "x", "y", "asks", "gid", "vector"]
    return left.select(*cols).unionByName(right.select(*cols)).groupBy("table", "bucket", "x", "y").applyInPandas(_search(k, single), FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, setting: Setting | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by cosine in double precision.

    vectors: vec_id, embedding (array of numbers); is_query: a Column over
    vec_id. Every row is indexed; ``setting`` is fitted to the vectors unless
    given. Candidates are ranked by their exact cosine; ties go to the smaller
    vec_id. A query that has found fewer than k is searched among all rows, in
    cells.

    Rows whose vector or id is null, or whose vector is empty, zero or holds a
    null or a non-finite component take no part; vectors are compared with those
    of their own length. Rows that share a vec_id are rows of their own: each is
    a candidate of the others, and each query row has its own answer. Equal
    vectors are indexed once, with their k + 1 smallest ids, which is all that
    an answer can hold of them. Other columns are ignored; no rows give no rows.
    """
    e = F.col("embedding")
    value = F.transform(e, lambda x: x.cast("double"))
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & ~bad & F.exists(value, lambda x: x != 0))
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    rows = materialise(fine.withColumns({"asks": F.coalesce(is_query, F.lit(False)), "row": F.monotonically_increasing_id()}), "vectors")
    groups = rows.groupBy("embedding").agg(F.min("row").alias("gid"), F.bool_or("asks").alias("asks"))
    firsts = rows.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id", "row"))).where(F.col("n") <= k + 1)
    firsts = firsts.groupBy("embedding").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    distinct = materialise(groups.join(firsts.hint("merge"), "embedding").select("gid", "asks", "ids", "embedding"), "distinct")
    queries = rows.where("asks").join(distinct.select("gid", "embedding").hint("merge"), "embedding").select(F.col("vec_id").alias("query_id"), "row", "gid")
    queries = materialise(queries, "queries")

    how = setting or fit(distinct.select("gid", "asks", "embedding"), k)
    send = lambda df, count: materialise(df.select("gid", "embedding").mapInArrow(_sender(how, count, single), SENT), "sent")
    found = materialise(_cells(send(distinct, 1), send(distinct.where("asks"), how.probes), k + 1, single), "found")
    answers = _answers(found, distinct, queries, k)
    n_rows = rows.count()
    short = queries.join(answers.groupBy(F.col("query_row").alias("row")).count().hint("merge"), "row", "left").where(F.coalesce("count", F.lit(0)) < min(k, n_rows - 1)).select("gid").distinct()
    short = materialise(short, "short")
    if short.limit(1).count():
        whole = lambda df: df.select("gid", F.lit(-1).alias("table"), (F.size("embedding").cast("long")).alias("bucket"), "embedding").mapInArrow(_raw(single), SENT)
        rest = _cells(materialise(whole(distinct), "all"), materialise(whole(distinct.join(short.hint("merge"), "gid", "left_semi")), "short"), k + 1, single)
        found = materialise(found.unionByName(rest), "found")
        answers = _answers(found, distinct, queries, k)
    return answers.drop("query_row")


def _raw(single: bool):
    kind = np.float32 if single else np.float64

    def run(batches):
        for part in pieces(batches, 4096):
            vectors = [np.asarray(v, dtype=kind).tobytes() for v in part.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(vectors, pa.binary())], names=["gid", "table", "bucket", "vector"])

    return run


def _answers(found: DataFrame, distinct: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """From groups to rows: at most k + 1 groups a query, at most k + 1 ids a group."""
    by = Window.partitionBy("query")
    top = found.distinct().withColumn("n", F.row_number().over(by.orderBy(F.desc("score"), "near"))).where(F.col("n") <= k + 1)
    ids = distinct.select(F.col("gid").alias("near"), "ids").hint("merge")
    wide = top.join(ids, "near").select("query", "score", F.explode("ids").alias("id"))
    best = wide.withColumn("n", F.row_number().over(by.orderBy(F.desc("score"), "id.vec_id", "id.row"))).where(F.col("n") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("all")).hint("merge")
    mine = queries.join(lists, queries["gid"] == lists["query"])
    others = F.slice(F.filter("all", lambda x: x["id"]["row"] != F.col("row")), 1, k)
    one = F.col("one")
    return mine.select("query_id", "row", F.posexplode(others).alias("pos", "one")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), one["id"]["vec_id"].alias("vec_id"), (-one["less"]).alias("score"), F.col("row").alias("query_row"))
