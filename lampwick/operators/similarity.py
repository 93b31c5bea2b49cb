"""Choosing examples for a query by character sets or vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import chars, jaccard
from ..workdir import looked_up, materialise, typed

#: Example tables of at most so many characters or numbers in all are sent to every task; larger ones are dealt into blocks of that size.
SMALL = 1_000_000


def scored_pairs(queries: DataFrame, examples: DataFrame, items: str, score: Column, small: int = SMALL) -> DataFrame:
    """Every query beside every example with ``score``: each query asks all examples, which is what a search is.

    What the arrays ``items`` of the examples hold is summed first. Up to
    ``small`` they are one block, which is broadcast; beyond, there are as many
    blocks as that goes into the sum, and each query is sent once to each, so
    neither side is whole in any task and a block is no larger for more data.
    """
    held = examples.agg(F.coalesce(F.sum(F.size(items)), F.lit(0))).first()[0]
    blocks = max(1, -(-held // small))
    dealt = examples.withColumn("_block", F.pmod(F.xxhash64("example_pos"), F.lit(blocks)).cast("int"))
    asked = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = F.broadcast(dealt) if blocks == 1 else dealt.hint("shuffle_hash")
    return asked.join(dealt, "_block").drop("_block").withColumn("score", score)


def _blocks_beside(queries: DataFrame, examples: DataFrame, run, **out: str) -> DataFrame:
    """What ``run`` makes of each block of queries beside each block of examples, as columns query_id, example_pos and those of ``out``.

    queries: query_id, _parts (blocks of queries in all), _blocks (numbers of
    example blocks to ask), _items; examples: example_pos, _block, _items. A task
    holds one block of either side.
    """
    parts = queries.select("_parts").first()
    parts = parts[0] if parts else 1
    asked = queries.select("query_id", F.explode("_blocks").alias("_block"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("_part"), "_items")
    dealt = examples.select("example_pos", "_block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), "_items")
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "example_pos": examples.schema["example_pos"].dataType.simpleString()} | out
    made = lambda q, e: typed(run(q, e), **kinds)
    return asked.groupBy("_block", "_part").cogroup(dealt.groupBy("_block", "_part")).applyInPandas(made, ", ".join(f"{c} {kind}" for c, kind in kinds.items()))


def _best(found: DataFrame, k: int) -> DataFrame:
    """Of the k best of each block the k best of all."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "example_pos")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class _Postings:
    """For each character the places of the sets that hold it."""

    def __init__(self, sets: list):
        self.sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        letters, which = np.unique(np.concatenate([*sets, [""]]).astype(str), return_inverse=True)
        order = np.argsort(which[:-1], kind="stable")
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)[order]
        cuts = np.searchsorted(which[:-1][order], np.arange(len(letters) + 1))
        self.place = {c: slice(cuts[i], cuts[i + 1]) for i, c in enumerate(letters.tolist())}

    def shared(self, letters) -> np.ndarray:
        """How many of the letters each set holds."""
        hit = [self.rows[self.place[c]] for c in letters if c in self.place]
        return np.bincount(np.concatenate(hit), minlength=len(self.sizes)) if hit else np.zeros(len(self.sizes), dtype=np.int64)


def _n_parts(queries: DataFrame, small: int) -> int:
    """Blocks of queries of at most about ``small`` items, and some for each core."""
    held = queries.agg(F.coalesce(F.sum(F.size("_items")), F.lit(0))).first()[0]
    return max(queries.sparkSession.sparkContext.defaultParallelism, -(-held // small))


def _top(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, by ``order`` among equals; those that are -inf are none."""
    if len(scores) > k:
        own = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        own = np.arange(len(scores))
    own = own[scores[own] > -np.inf]
    return own[np.lexsort((order[own], -scores[own]))[:k]]


def _order(values: pd.Series) -> np.ndarray:
    return values.rank(method="dense", na_option="top").to_numpy()


def _size_blocks(sizes: dict[int, int], small: int) -> list[tuple[int, int, int]]:
    """(least size, largest size, parts) of groups of sets, from how many sets have each size: about ``small`` items to a part."""
    groups: list[list[int]] = []
    for size in sorted(sizes):
        items = size * sizes[size]
        if groups and groups[-1][2] + items <= small:
            groups[-1][1:] = size, groups[-1][2] + items
        else:
            groups.append([size, size, items])
    return [(low, high, max(1, -(-items // small))) for low, high, items in groups]


def similarity_top_k(queries: DataFrame, examples: DataFrame, k: int = 5, threshold: float = 0.0, small: int = SMALL) -> DataFrame:
    """query_id, example_pos, score, rank: the k examples most alike in characters, earlier examples first among equals.

    queries: query_id, query; examples: example_pos, input. Empty queries find
    nothing. Two sets alike by t differ in size by a factor of at most 1 / t, so
    examples lie in blocks by size and a query asks only the blocks that its
    size allows. In a block each character has the places of its examples,
    and what they share with a query is one count over those places; a pair
    without a common character is never looked at.
    """
    q = queries.where(F.col("query") != "").select("query_id", chars(F.col("query")).alias("_items"))
    e = examples.select("example_pos", F.coalesce(chars(F.col("input")), F.array().cast("array<string>")).alias("_items"))
    # There are no more sizes than characters, so these tables are small whatever the number of rows.
    groups = _size_blocks({r[0]: r[1] for r in e.groupBy(F.size("_items").alias("s")).count().collect()}, small)
    first = [0, *np.cumsum([n for *_, n in groups]).tolist()]
    at = [low for low, *_ in groups]
    group = F.size(F.filter(F.array(*map(F.lit, at)), lambda x: x <= F.size("_items"))) - 1 if groups else F.lit(0)
    starts, widths = F.array(*(F.lit(int(x)) for x in first)), F.array(*(F.lit(n) for *_, n in groups)) if groups else F.array(F.lit(1))
    e = e.withColumn("_group", group).withColumn("_block", (F.get(starts, F.col("_group")) + F.pmod(F.xxhash64("example_pos"), F.get(widths, F.col("_group")))).cast("int"))

    def asks(size: int) -> list[int]:
        own = [i for i, (low, high, _) in enumerate(groups) if high + 1e-9 >= threshold * size and low * threshold <= size + 1e-9]
        return [b for i in own for b in range(first[i], first[i + 1])]

    rows = [(r[0], asks(r[0])) for r in q.groupBy(F.size("_items").alias("s")).count().collect()]
    wanted = q.sparkSession.createDataFrame(rows, "_size int, _blocks array<int>")
    q = q.withColumn("_size", F.size("_items")).join(looked_up(wanted), "_size").withColumn("_parts", F.lit(_n_parts(q, small)))

    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(there):
            held, order, pos = _Postings(there["_items"].tolist()), _order(there["example_pos"]), there["example_pos"].tolist()
            for key, own in zip(asked["query_id"].tolist(), asked["_items"].tolist()):
                both = held.shared(own)
                score = both / np.maximum(len(own) + held.sizes - both, 1)
                score[score < threshold] = -np.inf
                out += [(key, pos[i], score[i]) for i in _top(score, order, k).tolist()]
        return pd.DataFrame(out, columns=["query_id", "example_pos", "score"])

    return _best(_blocks_beside(q, e, run, score="double"), k)


#: Characters of examples, and of queries, whose pairs a task makes at once.
PAIRS = 40_000


def example_candidates(queries: DataFrame, examples: DataFrame, small: int = PAIRS) -> DataFrame:
    """query_id, example_pos: all pairs with at least one character in common, each once.

    Blocks of queries meet blocks of examples, and a pair comes from counts over
    the places of its characters, so nothing is made for each shared character.
    Null and empty texts have no characters.
    """
    items = lambda c: F.coalesce(chars(F.col(c)), F.array().cast("array<string>")).alias("_items")
    q, e = queries.select("query_id", items("query")), examples.select("example_pos", items("input"))
    blocks = max(1, -(-e.agg(F.coalesce(F.sum(F.size("_items")), F.lit(0))).first()[0] // small))
    e = e.withColumn("_block", F.pmod(F.xxhash64("example_pos"), F.lit(blocks)).cast("int"))
    q = q.withColumn("_blocks", F.sequence(F.lit(0), F.lit(blocks - 1))).withColumn("_parts", F.lit(_n_parts(q, small)))

    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(there) or not len(asked):
            return pd.DataFrame({"query_id": asked["query_id"][:0], "example_pos": there["example_pos"][:0]})
        held = _Postings(there["_items"].tolist())
        hits = [np.flatnonzero(held.shared(own)) for own in asked["_items"].tolist()]
        return pd.DataFrame({"query_id": asked["query_id"].repeat([len(h) for h in hits]).to_numpy(), "example_pos": there["example_pos"].to_numpy()[np.concatenate(hits)]})

    return _blocks_beside(q, e, run)


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, small: int = SMALL) -> DataFrame:
    """The same by cosine. queries: query_id, query_vector; vectors: example_pos, vector. A query isn't its own answer.

    A block of queries meets a block of vectors in one matrix product; what
    may be among the k best is scored again by itself, so that equal vectors have
    equal scores. Vectors that are null, zero, of another length or that hold a null give none.
    """
    q = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("_items")).where("_items IS NOT NULL")
    v = vectors.select("example_pos", F.col("vector").cast("array<double>").alias("_items")).where("_items IS NOT NULL")
    blocks = max(1, -(-v.agg(F.coalesce(F.sum(F.size("_items")), F.lit(0))).first()[0] // small))
    v = v.withColumn("_block", F.pmod(F.xxhash64("example_pos"), F.lit(blocks)).cast("int"))
    q = q.withColumn("_blocks", F.sequence(F.lit(0), F.lit(blocks - 1))).withColumn("_parts", F.lit(_n_parts(q, small)))

    def sound(rows: pd.DataFrame, key: str) -> dict[int, tuple]:
        """By length: keys, vectors and norms of rows that have a direction."""
        out = {}
        for size, own in rows.groupby(rows["_items"].map(len)):
            held = np.array([np.array(x, dtype=float) for x in own["_items"]]).reshape(len(own), size)
            norms = np.sqrt((held * held).sum(axis=1))
            good = norms > 0  # nan is not
            if good.any():
                out[size] = own[key][good].reset_index(drop=True), held[good], norms[good]
        return out

    def run(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        beside = sound(there, "example_pos")
        for size, (keys, ours, our_norms) in sound(asked, "query_id").items():
            if size not in beside:
                continue
            pos, theirs, norms = beside[size]
            order, pos = _order(pos), pos.to_numpy()
            step = max(1, 4_000_000 // len(pos))
            for at in range(0, len(keys), step):
                scores = ours[at : at + step] @ theirs.T / (our_norms[at : at + step, None] * norms)
                for i, score in enumerate(scores, at):
                    score[pos == keys[i]] = -np.inf
                    least = np.partition(score, -k)[-k] if len(score) > k else -np.inf
                    near = np.flatnonzero(score >= least - 1e-9) if least > -np.inf else np.flatnonzero(score > -np.inf)
                    exact = (theirs[near] * ours[i]).sum(axis=1) / (our_norms[i] * norms[near])
                    out += [(keys[i], pos[near[j]], exact[j]) for j in _top(exact, order[near], k).tolist()]
        return pd.DataFrame(out, columns=["query_id", "example_pos", "score"])

    return _best(_blocks_beside(q, v, run, score="double"), k)


def mmr_rows(relevance: np.ndarray, alike_row, k: int, weight: float) -> list[int]:
    """Places of a maximal-marginal-relevance choice: the most relevant, then what is relevant and unlike those chosen."""
    weight = min(1.0, max(0.0, weight))
    chosen: list[int] = []
    nearest = np.zeros(len(relevance))
    while len(chosen) < min(k, len(relevance)):
        gain = relevance.copy() if not chosen else weight * relevance - (1 - weight) * nearest
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        chosen.append(best)
        nearest = np.maximum(nearest, alike_row(best))
    return chosen


def mmr(relevance: np.ndarray, alike, k: int, weight: float) -> list[int]:
    """mmr_rows() with the likeness of two places."""
    return mmr_rows(relevance, lambda i: [alike(i, j) for j in range(len(relevance))], k, weight)


def _mmr_small(q: DataFrame, e: DataFrame, k: int, weight: float) -> DataFrame:
    """mmr_top_k() where all examples fit in a task: each character has the places of its examples, so a likeness to all is one count."""
    rows = sorted(e.collect(), key=lambda r: r["example_pos"])
    places: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        for c in r["_e"]:
            places.setdefault(c, []).append(i)
    sizes = np.array([len(r["_e"]) for r in rows], dtype=np.int64)
    sent = q.sparkSession.sparkContext.broadcast(([r["example_pos"] for r in rows], [r["_e"] for r in rows], sizes, {c: np.array(x, dtype=np.int32) for c, x in places.items()}))

    def run(batches):
        pos, sets, sizes, places = sent.value

        def alike(letters) -> np.ndarray:
            hit = [places[c] for c in letters if c in places]
            both = np.bincount(np.concatenate(hit), minlength=len(pos)) if hit else np.zeros(len(pos), dtype=np.int64)
            return both / np.maximum(len(letters) + sizes - both, 1)

        for batch in batches:
            out = []
            for key, letters in zip(batch["query_id"], batch["_q"]):
                score = alike(letters)
                out += [(key, pos[i], score[i], r) for r, i in enumerate(mmr_rows(score, lambda i: alike(sets[i]), k, weight), 1)]
            yield pd.DataFrame(out, columns=["query_id", "example_pos", "score", "rank"])

    kind = q.schema["query_id"].dataType.simpleString(), e.schema["example_pos"].dataType.simpleString()
    return q.mapInPandas(run, f"query_id {kind[0]}, example_pos {kind[1]}, score double, rank int")


def mmr_top_k(queries: DataFrame, examples: DataFrame, k: int = 5, weight: float = 0.5, small: int = SMALL) -> DataFrame:
    """query_id, example_pos, score, rank by maximal marginal relevance among all examples, earlier ones first among equals.

    Up to ``small`` characters of examples are sent to every task. Beyond, there is one round
    for each rank: every query meets every example that it hasn't chosen, and the
    best is taken by partial aggregation. Only the choices, at most k for each
    query, are kept from round to round.
    """
    weight = min(1.0, max(0.0, weight))
    q = queries.where(F.col("query") != "").select("query_id", chars(F.col("query")).alias("_q"))
    e = examples.select("example_pos", chars(F.col("input")).alias("_e"))
    if e.agg(F.coalesce(F.sum(F.size("_e")), F.lit(0))).first()[0] <= small:
        return _mmr_small(q, e, k, weight)
    one = f"struct<example_pos:{e.schema['example_pos'].dataType.simpleString()},score:double,_e:array<string>>"
    asked = q.withColumn("_chosen", F.array().cast(f"array<{one}>"))
    for at in range(k):
        pairs = scored_pairs(asked, e, "_e", jaccard(F.col("_q"), F.col("_e")), small)
        pairs = pairs.where(~F.exists("_chosen", lambda c: c["example_pos"] == F.col("example_pos")))
        nearest = F.array_max(F.transform("_chosen", lambda c: jaccard(c["_e"], F.col("_e"))))
        gain = weight * F.col("score") - (1 - weight) * nearest if at else F.col("score")
        order = F.struct(gain.alias("gain"), (-F.col("example_pos")).alias("early"))
        best = pairs.groupBy("query_id").agg(F.max_by(F.struct("example_pos", "score", "_e"), order).alias("_new"))
        more = asked.join(best.hint("merge"), "query_id", "left")
        asked = more.select("query_id", "_q", F.when(F.col("_new").isNull(), F.col("_chosen")).otherwise(F.array_append("_chosen", F.col("_new").cast(one))).alias("_chosen"))
        asked = materialise(asked, "chosen")
    rows = asked.select("query_id", F.posexplode("_chosen").alias("at", "c"))
    return rows.select("query_id", "c.example_pos", "c.score", (F.col("at") + 1).alias("rank"))


SELECTORS = {"similarity": similarity_top_k, "diversity": mmr_top_k}


def register_selector(name: str, select) -> None:
    SELECTORS[name] = select
