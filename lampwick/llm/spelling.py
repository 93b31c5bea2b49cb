"""Grouping spelling variants: words at one edit from each other, found in a trie of letter-group counts.

One inserted, deleted or replaced letter changes the counts of letters by at
most one surplus and one deficit. Words are arranged by how often they hold the
letters of one group, then of the next, and so on; a search for what is near a
word walks down with a budget of one surplus and one deficit, and only what
it reaches is compared letter by letter. Few coarse groups are the top of the
trie: each of its nodes goes to one task with the words below it, and every
word is sent to the nodes that its budget reaches. The fine groups are the
levels within a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise_at, pieces, text_of

RUN, LEAST, OCCURRENCES, TIMES = r"[A-Za-zÀ-ÿ]+", 7, 2, 10
#: Coarse groups at the top of the trie: the first number with which no node has more than so many words.
TOPS, NODE_WORDS = (2, 4, 8, 16), 50_000
#: Fine groups; words searched at once; paths followed at once.
LEVELS, BATCH, PATHS = 32, 8192, 1 << 15

_WEIGHT = np.random.default_rng(12).integers(1, 1 << 63, 4096, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def noisy_words(docs: DataFrame, pattern: str = RUN, every: int = 31) -> DataFrame:
    """(word): the runs of all texts with A-Z lowered; where a hash of document and run says so, one letter is left out."""
    run, h = F.col("run"), F.col("h")
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(), F.lit(pattern), F.lit(0))).alias("run"))
    rows = found.where(F.length("run") >= LEAST).withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (h % F.length(run)).cast("int")
    return rows.select(F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run).alias("word"))


def counted(words: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words with so many code points and occurrences; null is no word."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _matrix(words: list[str], size: int) -> np.ndarray:
    """Code points, a row for each word of that size."""
    return np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(len(words), size)


def _counts(codes: np.ndarray, groups: int) -> np.ndarray:
    """How many letters of each group a word has; a letter's group is its code point modulo their number."""
    group = (codes % groups).astype(np.uint8)
    return np.stack([(group == g).sum(axis=1) for g in range(groups)], axis=1).astype(np.int32)


def _by_size(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def _node(counts: np.ndarray) -> np.ndarray:
    """A number for a vector of counts that a change of the vector changes by a fixed number, modulo 2**64."""
    return (counts.astype(np.uint64) * _WEIGHT[: counts.shape[1]]).sum(axis=1, dtype=np.uint64)


def steps(groups: int) -> list[tuple[int, int]]:
    """(surplus, deficit) groups, -1 for none, by which a word of the same size or one letter more can differ.

    Of a step between words of one size and its reverse only one is here: one of the two words asks.
    """
    return [(-1, -1)] + [(a, b) for a in range(groups) for b in range(a + 1, groups)] + [(a, -1) for a in range(groups)]


def nodes_of(words: DataFrame, groups: int) -> DataFrame:
    """(node): the top node of each word."""

    def run(batches):
        for part in pieces(batches, BATCH):
            words = part.column(0).to_pylist()
            for size, own in _by_size(words):
                yield pa.RecordBatch.from_arrays([pa.array(_node(_counts(_matrix([words[i] for i in own], size), groups)).view(np.int64))], names=["node"])

    return words.select("word").mapInArrow(run, "node long")


def dealt(words: DataFrame, groups: int) -> DataFrame:
    """(node, asks, word, n): each word at its own top node with ``asks`` 0, and again at the nodes that its budget reaches, with 1 at its own and 2 at others."""

    def run(batches):
        for part in pieces(batches, 1024):
            words = part.column(0).to_pylist()
            for size, own in _by_size(words):
                counts = _counts(_matrix([words[i] for i in own], size), groups)
                home = _node(counts)
                nodes, rows, asks = [home], [own], [np.zeros(len(own), dtype=np.int8)]
                for more, less in steps(groups):
                    able = np.flatnonzero(counts[:, less] > 0) if less >= 0 else np.arange(len(own))
                    gain = _WEIGHT[[more]] * np.uint64(more >= 0) - _WEIGHT[[less]] * np.uint64(less >= 0)
                    nodes.append(home[able] + gain)
                    rows.append(own[able])
                    asks.append(np.full(len(able), 1 if more == less else 2, dtype=np.int8))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(np.concatenate(asks)), part.column(0).take(at), part.column(1).take(at)], names=["node", "asks", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "node long, asks byte, word string, n long")


class Trie:
    """Words of one size by successive letter-group counts."""

    def __init__(self, words: list[str]):
        self.words, self.size = words, len(words[0])
        self.codes = _matrix(words, self.size)
        counts = _counts(self.codes, LEVELS)
        self.base = self.size + 3
        #: For each level the sorted edges, (node, count + 1) as one number; a child's number is its place among them.
        self.edges: list[np.ndarray] = []
        at, paths = np.zeros(len(words), dtype=np.int64), []
        for g in range(LEVELS):
            edges, at = np.unique(at * self.base + counts[:, g] + 1, return_inverse=True)
            self.edges.append(edges)
            paths.append(at)
        #: Leaves come in the order of their paths, so those below a node are a range.
        leaf_path = np.zeros((len(self.edges[-1]), LEVELS), dtype=np.int64)
        leaf_path[at] = np.stack(paths, axis=1)
        self.first = [np.searchsorted(leaf_path[:, g], np.arange(len(self.edges[g]))) for g in range(LEVELS)]
        self.leaves = [np.diff(np.append(f, len(leaf_path))) for f in self.first]
        self.vectors = np.zeros((len(leaf_path), LEVELS), dtype=np.int32)
        self.vectors[at] = counts
        self.leaf = at
        self.halves: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def reached(self, counts: np.ndarray, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first, by blocks of paths: (row of counts, leaf) for leaves within one surplus and that deficit.

        A path below which only one leaf is left ends there, and that leaf's counts are compared at once.
        """
        n = len(counts)
        stack = [(0, np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), np.full(n, bool(deficit)))]
        while stack:
            level, row, node, more, less = stack.pop()
            if len(row) > PATHS:
                half = len(row) // 2
                stack += [(level, *(x[:half] for x in (row, node, more, less))), (level, *(x[half:] for x in (row, node, more, less)))]
                continue
            grown = []
            for step, able in ((0, slice(None)), (1, more), (-1, less)):
                r, m, s = row[able], more[able], less[able]
                key = node[able] * self.base + counts[r, level] + 1 + step
                at = np.searchsorted(self.edges[level], key)
                hit = self.edges[level][np.minimum(at, len(self.edges[level]) - 1)] == key
                r, at = r[hit], at[hit]
                grown.append((r, at, m[hit] if step != 1 else np.zeros(len(r), dtype=bool), s[hit] if step != -1 else np.zeros(len(r), dtype=bool)))
            row, node, more, less = (np.concatenate(x) for x in zip(*grown))
            single = (self.leaves[level][node] == 1) if level < LEVELS - 1 else np.ones(len(node), dtype=bool)
            leaf = self.first[level][node[single]]
            apart = self.vectors[leaf] - counts[row[single]]
            good = (np.maximum(apart, 0).sum(axis=1) <= 1) & (np.maximum(-apart, 0).sum(axis=1) <= deficit)
            if good.any():
                yield row[single][good], leaf[good]
            if not single.all():
                stack.append((level + 1, *(x[~single] for x in (row, node, more, less))))

    def _half(self, codes: np.ndarray, size: int, head: bool) -> np.ndarray:
        """A hash of the letters before, or from, the middle of a word of that size, counted from the nearer end."""
        cut = size // 2
        own = codes[:, :cut] if head else codes[:, codes.shape[1] - (size - cut) :]
        weight = np.resize(_WEIGHT, own.shape[1]) + np.arange(own.shape[1], dtype=np.uint64) * np.uint64(2)
        return (own.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in words, place in the trie's words) at one edit; words are of one size, the trie's or one less.

        Two words at one edit agree before or after the middle, so a leaf's
        words are looked up by these halves; each that agrees is compared.
        """
        size = len(words[0])
        codes = _matrix(words, size)
        found = []
        for row, leaf in self.reached(_counts(codes, LEVELS), int(size == self.size)):
            for head in (True, False):
                if (size, head) not in self.halves:
                    key = self._half(self.codes, size, head) + self.leaf.astype(np.uint64) * _WEIGHT[-1]
                    order = np.argsort(key, kind="stable")
                    self.halves[size, head] = key[order], order
                keys, order = self.halves[size, head]
                want = self._half(codes, size, head)[row] + leaf.astype(np.uint64) * _WEIGHT[-1]
                low, n = np.searchsorted(keys, want), np.searchsorted(keys, want, side="right")
                n -= low
                for a in range(0, len(n), BATCH):
                    few = n[a : a + BATCH]
                    asking = np.repeat(row[a : a + BATCH], few)
                    there = order[np.repeat(low[a : a + BATCH], few) + np.arange(len(asking)) - np.repeat(np.cumsum(few) - few, few)]
                    mine, own = codes[asking], self.codes[there]
                    if size == self.size:
                        good = (mine != own).sum(axis=1) == 1
                    else:
                        ahead = np.logical_and.accumulate(mine == own[:, :-1], axis=1).sum(axis=1)
                        behind = np.logical_and.accumulate((mine == own[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                        good = ahead + behind >= size
                    found.append(np.stack([asking[good], there[good]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
        return pairs[:, 0], pairs[:, 1]


def near_pairs(words: DataFrame, groups: int) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words at one edit.

    A task gets the words of a top node first, builds their trie, and then
    takes those that ask by and by. Words of the node ask each other; what
    asks from elsewhere, of the trie's size or one letter less, isn't asked, so its pairs are turned here.
    """

    def found(trie: Trie, counts: list[int], words: list[str], ns: list[int], elsewhere: bool):
        for size, own in _by_size(words):
            if size not in (trie.size, trie.size - 1):
                continue  # a node number that two vectors share
            a, b = trie.near([words[i] for i in own])
            a, b = own[a].tolist(), b.tolist()
            rows = [(words[i], trie.words[j], counts[j]) for i, j in zip(a, b)]
            if elsewhere:  # those asked here don't ask there
                rows += [(trie.words[j], words[i], ns[i]) for i, j in zip(a, b)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["word", "near", "near_n"])

    def run(batches):
        state, tries, words, ns = None, [], [], []

        def close():
            """What has come for a node and role: the words of a trie, or some that ask."""
            if words and not state[1]:
                tries[:] = [(Trie([words[i] for i in own]), [ns[i] for i in own]) for _, own in _by_size(words)]
            elif words:
                for trie, counts in tries:
                    yield from found(trie, counts, words, ns, state[1] == 2)
            words.clear(), ns.clear()

        for batch in pieces(batches, BATCH):
            node, asks = batch.column("node").to_numpy(), batch.column("asks").to_numpy()
            cuts = [0, *(np.flatnonzero((node[1:] != node[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(node)]
            texts, counts = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            for a, b in zip(cuts, cuts[1:]):
                own = int(node[a]), int(asks[a])
                if own != state:
                    yield from close()
                    if state is None or own[0] != state[0]:
                        tries = []
                    state = own
                words += texts[a:b]
                ns += counts[a:b]
                if own[1] and len(words) >= BATCH:
                    yield from close()
        yield from close()

    rows = dealt(words, groups).repartition("node").sortWithinPartitions("node", "asks")
    return rows.mapInArrow(run, "word string, near string, near_n long")


def followed(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last. Each round doubles the steps; a chain has as many as counts can grow ``TIMES``-fold."""
    spark = links.sparkSession
    roots, at = materialise_at(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        if not roots.join(ahead, "root").limit(1).count():
            return roots
        new, new_at = materialise_at(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(spark, at)
        roots, at = new, new_at


def variants(words: DataFrame, times: int = TIMES, node_words: int = NODE_WORDS) -> DataFrame:
    """From distinct (word, n): word, form, root, n, n_near and form_n.

    n_near counts the words at exactly one inserted, deleted or replaced code
    point. A word's form is that of the largest n, of equals the first by code
    points, if it has ``times`` the word's n; root follows forms to the last. A
    null word is none. No rows give no rows.
    """
    words, _ = materialise_at(words.where("word IS NOT NULL").select("word", "n"), "words")
    for groups in TOPS:
        if (nodes_of(words, groups).groupBy("node").count().agg(F.max("count")).first()[0] or 0) <= node_words:
            break
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    stats = near_pairs(words, groups).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    large = -F.col("best.n") >= times * F.col("n")
    own, _ = materialise_at(words.join(stats.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.n")).alias("form_n")), "forms")
    roots = followed(own.where("form IS NOT NULL").select("word", "form"))
    return own.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def text_variants(docs: DataFrame) -> DataFrame:
    """variants() of the words in the texts of documents (doc_id, text) as noisy_words() gives them. Null and empty texts have none; other columns are ignored."""
    return variants(counted(noisy_words(docs)))
