"""SimHash near-duplicates, found by balls that meet in the middle.

Two fingerprints that differ in at most 2 bits have a word in between that is
within 1 bit of both. So each distinct fingerprint is sent to every word of its
ball of radius 1 (65 words), and all that meet at a word link to the smallest
one there; by the triangle inequality they are within 2 bits, so a star of
links is exact and no pairs are made.

The radius asked for is odd, 3, and half of it is 1.5. The odd bit is taken by
puncturing: the 64 bits are cut into four blocks of 16, and one block at a time
is masked. Of 3 differing bits at least one lies in some block; with that block
masked at most 2 differ, and balls of radius 1 over the other 48 bits (49 words)
meet. What meets there is verified, and only between what the first step has
not linked yet, so a large group of near copies is not multiplied out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import aside, discard, materialise, materialise_at, pieces, words_of
from .components import components
from .suffix_tree import Vocabulary, filter_of, mixed, parts

BITS, BLOCK, RADIUS = 64, 16, 3
SEED = 42


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash, unsigned; zero for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    at = range(max(1, len(words) - shingle + 1))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in at]
    set_bits = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        part = np.array(hashes[i : i + 8192], dtype=">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``fp``, a long that holds the 64 bits. Null texts count as empty."""
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("fp", T.LongType(), False)])

    def run(batches):
        for part in pieces(batches):
            fps = [_signed(fingerprint(t, shingle)) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fps, pa.int64())], names=[*carry, "fp"])

    return docs.select(*carry, "text").mapInArrow(run, schema)


#: Words of 32 bits in a wide fingerprint (an even number), and words in a shingle that it is made of. Short shingles change
#: less than those of the similarity asked for: at a Jaccard similarity of 0.8 for five words, one bit in ten differs.
WIDE, FEATURE = 6, 2
PRINTS = tuple(f"f{k}" for k in range(WIDE // 2))
#: Pairs that differ in more of the 192 bits aren't compared in a round: at 0.8 some 18 differ, 4 more or less.
FAR = 36
#: Rounds of links by SimHash, and with how many a node is compared in a round. What they leave is found exactly.
ROUNDS, NEAREST = 2, 4
#: Share of a text's shingles, beyond those that may be its own, that must be met elsewhere for it to be asked about further.
MORE = 0.1
#: Words that a task remembers the hashes of, about; shingles in a block of nodes, about.
WORDS_HELD = 100_000
BLOCK_SHINGLES = 500_000


def wide_fingerprints(texts: list[str | None], vocabulary: Vocabulary) -> np.ndarray:
    """For each text the SimHash of WIDE times 32 bits (a uint32 each) over its distinct FEATURE-word shingles; zeros without words."""
    hashes, numbers, sizes = vocabulary.read(texts)
    owner, token = np.repeat(np.arange(len(sizes)), sizes), hashes[numbers]
    key = mixed(np.roll(token, 1), token)  # the text's first word comes with what ended the text before
    first = np.cumsum(sizes) - sizes
    key[first] = mixed(np.zeros(len(first), dtype=np.uint64), token[first])
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    owner, key = owner[new], key[new]
    n = np.bincount(owner, minlength=len(sizes))
    counts = np.zeros((len(sizes), 32 * WIDE), dtype=np.int32)
    for at in range(0, len(key), 1 << 15):
        part, own = key[at : at + (1 << 15)], owner[at : at + (1 << 15)]
        words = np.stack([mixed(part, np.full(len(part), k, dtype=np.uint64)) for k in range(WIDE // 2)], axis=1)
        bits = np.unpackbits(words.view(np.uint8).reshape(len(part), -1), axis=1)
        starts = np.nonzero(np.diff(own, prepend=-1))[0]
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out = np.packbits(2 * counts > n[:, None], axis=1).view(np.uint32)
    out[sizes < 2] = 0
    return out


def _ball(col: Column, bits: range) -> list[Column]:
    return [col, *(col.bitwiseXOR(F.lit(_signed(1 << i))) for i in bits)]


def spread(df: DataFrame, key: str, rows: int = 20_000) -> DataFrame:
    """Dealt over enough tasks for what each row will be multiplied into."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows + 1), key)


def near_roots(nodes: DataFrame) -> DataFrame:
    """(fp, root) for each distinct ``fp`` that has another within RADIUS bits; root is the smallest of its component."""
    fp = F.col("fp")
    nodes = spread(nodes, "fp")
    near = nodes.select(fp, F.explode(F.array(*_ball(fp, range(BITS)))).alias("word"))
    first = near.select("fp", F.min("fp").over(Window.partitionBy("word")).alias("low")).where("fp <> low")
    close = components(first.select(F.col("fp").alias("a"), F.col("low").alias("b")))

    words = []
    for k in range(BITS // BLOCK):
        mask = ((1 << BLOCK) - 1) << (k * BLOCK)
        rest = fp.bitwiseAND(F.lit(_signed(~mask & ((1 << BITS) - 1)))).bitwiseOR(F.lit(_signed((k + 1) << (k * BLOCK))))
        words += _ball(rest, range(0, k * BLOCK)) + _ball(rest, range((k + 1) * BLOCK, BITS))[1:]
    punctured = nodes.select(fp, F.explode(F.array(*words)).alias("word"))
    word = Window.partitionBy("word")
    met = punctured.withColumns({"low": F.min("fp").over(word), "high": F.max("fp").over(word)}).where("low <> high").select("fp", "word")
    met = materialise(met, "met")
    known = close.select(F.col("node").alias("fp"), F.col("root").alias("comp")).hint("merge")
    labelled = met.join(known, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    labelled = labelled.withColumns({"low": F.min("comp").over(word), "high": F.max("comp").over(word)}).where("low <> high")
    mixed = materialise(labelled.select("word", "fp", "comp"), "mixed")
    a, b = (mixed.select("word", F.col("fp").alias(f"fp_{x}"), F.col("comp").alias(x)) for x in "ab")
    apart = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    more = a.hint("merge").join(b, (a["word"] == b["word"]) & (F.col("a") < F.col("b")) & (apart <= RADIUS)).select("a", "b")
    over = components(more)

    top = over.select(F.col("node").alias("comp"), F.col("root").alias("top")).hint("merge")
    all_nodes = close.select(F.col("node").alias("fp"), F.col("root").alias("comp")).unionByName(
        over.select(F.col("node").alias("fp"), F.col("node").alias("comp"))
    ).distinct()
    # A component of the first step may be named by a fingerprint that the second step knows by itself: both rows agree.
    return all_nodes.join(top, "comp", "left").select("fp", F.coalesce("top", "comp").alias("root"))


def near_components(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id.

    Links join fingerprints that differ in at most 3 bits; equal ones are linked.
    component_id is the smallest doc_id that can be reached. Null and empty texts
    have fingerprint zero and link to each other. Repeated rows stay repeated. A
    null doc_id stays and counts for nothing: a component of null ids only has a
    null component_id. Other columns are ignored. No rows in, no rows out.
    """
    fps = materialise(with_fingerprints(docs, shingle), "fps")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = near_roots(nodes.select("fp"))
    placed = nodes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialise(placed, "placed")
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = materialise(placed.join(least.hint("merge"), "root").select("fp", "component_id"), "by_fp")
    return fps.join(by_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def word_sets(texts: list[str | None], shingle: int, vocabulary: Vocabulary) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; of its whole words where they are fewer."""
    hashes, numbers, sizes = vocabulary.read(texts)
    out, at = [], 0
    for size in sizes.tolist():
        words = hashes[numbers[at : at + size - 1]]
        at += size
        n = min(shingle, len(words))
        key = words[: len(words) - n + 1] if n else words
        for k in range(1, n):
            key = mixed(key, words[k : len(words) - n + 1 + k])
        out.append(np.unique(key).view(np.int64))
    return out


def _contents(batches):
    """(number, content, doc_id): a hash of the words, equal for copies, for each text."""
    vocabulary = Vocabulary(WORDS_HELD)
    for part in parts(batches, 1):
        hashes, numbers, sizes = vocabulary.read(part.column(1).to_pylist())
        data, ends = hashes[numbers].tobytes(), np.cumsum(sizes) * 8
        content = [xxhash.xxh3_128_digest(data[b - 8 * n : b]) for b, n in zip(ends.tolist(), sizes.tolist())]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary()), part.column(2)], names=["number", "content", "doc_id"])


def _hash(numbers: pa.Array) -> np.ndarray:
    n = numbers.to_numpy(zero_copy_only=False).view(np.uint64)
    return mixed(np.zeros(len(n), dtype=np.uint64), n)


def _hashed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_hash(batch.column(0)).view(np.int64))], names=["key"])


def _own(n: int, similarity: float) -> int:
    """How many of ``n`` shingles a text that is similar to this one can lack."""
    return int((1 - similarity) * n + 1e-9)


def _met(n: int, similarity: float) -> int:
    """How many shingles a head must share, beyond those that may be the text's own."""
    return min(n - _own(n, similarity), max(1, math.ceil(MORE * n)))


def _heads(shingle: int, similarity: float, sent):
    """(id, key, need): the lowest hashes of each set, and how many of them must be in the head of a similar one.

    Of a head of _own + _met hashes, _met or more are common with a similar set,
    the lowest common ones, and its head holds as many of these as its own _met
    says; it has at least the similarity's share of this set's size.
    """

    def run(batches):
        vocabulary, wanted = Vocabulary(WORDS_HELD), sent.value
        for part in parts(batches, 1):
            part = part.filter(pa.array(wanted(_hash(part.column(0)))))
            sets = word_sets(part.column(1).to_pylist(), shingle, vocabulary)
            heads = [s[: _own(len(s), similarity) + _met(len(s), similarity)] for s in sets]
            need = [_met(math.ceil(similarity * len(s) - 1e-9), similarity) for s in sets]
            sizes = np.array([len(h) for h in heads], dtype=np.int64)
            id, need = (np.repeat(np.asarray(x), sizes) for x in (part.column(0).to_numpy(zero_copy_only=False), np.array(need, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(id), pa.array(np.concatenate(heads) if heads else np.zeros(0, dtype=np.int64)), pa.array(need)], names=["id", "key", "need"])

    return run


def _sets(shingle: int, sent):
    """(id, f0, f1, f2, shingles): the wide fingerprint and the set of each text whose number passes."""

    def run(batches):
        vocabulary, wanted = Vocabulary(WORDS_HELD), sent.value
        for part in parts(batches, 1):
            part = part.filter(pa.array(wanted(_hash(part.column(0)))))
            if not part.num_rows:
                continue
            texts = part.column(1).to_pylist()
            sets, longs = word_sets(texts, shingle, vocabulary), wide_fingerprints(texts, vocabulary).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(list(map(len, sets)), dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            prints = (pa.array(np.ascontiguousarray(longs[:, k])) for k in range(WIDE // 2))
            yield pa.RecordBatch.from_arrays([part.column(0), *prints, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", *PRINTS, "shingles"])

    return run


def _comparer(similarity: float):
    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(sets["id"], sets["shingles"]))

        def held(a: int, b: int) -> bool:
            x, y = of[a], of[b]
            same = len(np.intersect1d(x, y, assume_unique=True))
            return same >= similarity * (len(x) + len(y) - same)

        return pairs.loc[[held(a, b) for a, b in zip(pairs["a"], pairs["b"])], ["a", "b"]]

    return run


def _merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) for every id of ``known`` after links (a, b) between comps; comp is the smallest."""
    over = components(links).select(F.col("node").alias("comp"), F.col("root").alias("top"))
    joined = known.join(over.hint("merge"), "comp", "left")
    return materialise(joined.select("id", F.coalesce("top", "comp").alias("comp")), "comps")


def similar_roots(nodes: DataFrame, numbered: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, comp) for the nodes that can have a similar one; nodes: id, of different texts; numbered: number, text. No link is missed.

    A text can lack only so many shingles of one that is similar (_own). First
    the lowest hashes of each set meet; texts of which too few are met elsewhere
    have no similar one and go. Of those that stay, whole sets are counted, and
    those with too many shingles of their own go too.

    SimHash then joins most of what is similar: each node is sent to the ball of
    radius 1 around each 32-bit word of its fingerprint, so nodes within 2 bits
    in a word meet. Of those that meet at a word, each is compared with one in
    each round: that with the smallest share of own shingles, then one by chance,
    unless it is joined with that one already. A node keeps the NEAREST of these
    by the whole fingerprints, so a large group of near copies is not multiplied
    out: a round has as many pairs as nodes, times a constant.

    The rest is exact. Ordered by how often they occur, the first _own + 1 shingles of
    each set are its keys, and similar sets share a key. All that meet at a key and
    are in different components yet are compared, but for pairs that their sizes
    and the key's places in both sets rule out.
    """
    spare = []
    broadcast = numbered.sparkSession.sparkContext.broadcast

    def kept(df: DataFrame, tag: str) -> DataFrame:
        table, path = materialise_at(df, tag)
        spare.append(path)
        return table

    def freed(n: int) -> None:
        for path in spare[n:]:
            discard(numbered.sparkSession, path)
        del spare[n:]

    def meeting(df: DataFrame, at: str) -> DataFrame:
        """The rows whose ``at`` another id has too; running frames: a task never holds what meets."""
        same = Window.partitionBy(at).orderBy("id")
        df = df.withColumns({"_low": F.first("id").over(same), "_next": F.lead("id").over(same)})
        return df.where("id <> _low OR _next IS NOT NULL").drop("_low", "_next")

    texts = numbered.select("number", "text")
    sent = broadcast(filter_of(nodes.select("id").mapInArrow(_hashed, "key long")))
    heads = meeting(texts.mapInArrow(_heads(shingle, similarity, sent), "id long, key long, need int"), "key")
    some = heads.groupBy("id").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("id")
    some = kept(some.join(nodes.select("id").hint("merge"), "id", "left_semi"), "some")
    sent.destroy()
    sent = broadcast(filter_of(some.mapInArrow(_hashed, "key long")))
    longs = ", ".join(f"{f} long" for f in PRINTS)
    sets = texts.mapInArrow(_sets(shingle, sent), f"id long, {longs}, shingles array<long>").join(some.hint("merge"), "id", "left_semi")
    sets = kept(sets, "sets")
    sent.destroy()

    n, shared = F.col("n"), F.col("shared")
    own = F.floor((1 - similarity) * n + 1e-9)
    rows = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    rows = rows.withColumn("held", F.count("*").over(Window.partitionBy("key"))).where("held > 1")
    of_id = Window.partitionBy("id")
    rows = rows.withColumns({"shared": F.count("*").over(of_id), "place": F.row_number().over(of_id.orderBy("held", "key"))})
    keys = kept(rows.where((n - shared <= own) & (F.col("place") <= own + 1 - (n - shared))).select("id", "key", "n", "shared", "place"), "keys")
    facts = keys.groupBy("id").agg(F.max("n").alias("n"), F.max("shared").alias("shared"))
    facts = kept(facts.hint("merge").join(sets.select("id", *PRINTS), "id"), "facts")

    half = F.lit((1 << 32) - 1)
    words = []
    for k in range(WIDE):
        long = F.col(f"f{k // 2}")
        word = (long.bitwiseAND(half) if k % 2 == 0 else F.shiftrightunsigned(long, 32)).bitwiseOR(F.lit(k << 32))
        words += _ball(word, range(32))
    # A pair is possible only if what either can have in common with others is enough for the sizes of both.
    most = lambda common: F.floor(common * ((1 + similarity) / similarity) - n + 1e-6)
    near = spread(facts, "id").select("id", "n", most(shared).alias("most"), (1 - shared / n).alias("alone"), F.explode(F.array(*words)).alias("word"))
    met = kept(meeting(near, "word"), "met")
    blocks = max(1, -(-facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BLOCK_SHINGLES))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")

    def alike(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of ids that are similar. They are compared by blocks of nodes, so that a set travels once for a pair of blocks, not for a pair."""
        close = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select(block("a").alias("x"), block("b").alias("y"), "a", "b"), "close")
        needed = close.select("x", "y", F.col("a").alias("id")).unionByName(close.select("x", "y", F.col("b").alias("id"))).distinct()
        needed = kept(needed.hint("merge").join(sets.select("id", "shingles"), "id"), "needed")
        return kept(close.groupBy("x", "y").cogroup(needed.groupBy("x", "y")).applyInPandas(_comparer(similarity), "a long, b long"), "alike")

    def joined(comps: DataFrame, pairs: DataFrame) -> DataFrame:
        at = len(spare)
        of = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}")).hint("merge")
        out = _merged(comps, alike(pairs).join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
        freed(at)
        return out

    side = lambda c: facts.select(F.col("id").alias(c), *(F.col(f).alias(f"{f}_{c}") for f in PRINTS)).hint("merge")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in PRINTS))
    comps = facts.select("id", F.col("id").alias("comp"))
    for k in range(ROUNDS):
        labelled = met.join(comps.hint("merge"), "id")
        order = F.xxhash64("id", F.lit(k)) if k else F.struct("alone", "id")
        ends = labelled.groupBy("word").agg(F.min_by(F.struct("id", "comp", "n", "most"), order).alias("end")).hint("merge")
        star = labelled.join(ends, "word").where("comp <> end.comp AND n <= end.most AND end.n <= most").select(F.col("id").alias("a"), F.col("end.id").alias("b")).distinct()
        star = star.join(side("a"), "a").join(side("b"), "b").where(apart <= FAR).select("a", "b", apart.alias("apart"))
        nearest = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
        comps = joined(comps, star.withColumn("place", nearest).where(F.col("place") <= NEAREST).select("a", "b"))

    # The first key that two have in common has none in common before it, so only what comes from there on counts.
    left = keys.join(comps.hint("merge"), "id").withColumn("most", most(shared - F.col("place") + 1)).where(F.col("most") >= similarity * n - 1e-6)
    spans = left.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("most").alias("high"))
    spans = spans.groupBy("key").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("comps"))
    left = left.join(spans.where("comps > 1").hint("merge"), "key").where("low <= most AND n <= high")
    left = kept(left.select("key", "id", "comp", "n", "most", (F.col("comp") == F.col("main")).alias("main")), "left")
    # The largest component at a key isn't joined with itself.
    a, b = (left.select("key", F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("comp", "n", "most", "main"))) for c in "ab")
    possible = (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a"))
    once = F.col("main_b") | (F.col("a") < F.col("b"))
    rest = a.where("NOT main_a").hint("merge").join(b, (a["key"] == b["key"]) & (F.col("comp_a") != F.col("comp_b")) & once & possible).select("a", "b")
    comps = joined(comps, rest)
    freed(0)
    return comps


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Keeps one row of each group of similar texts: one with the smallest doc_id, null last.

    Texts with the same words are copies; others are linked where their sets of
    ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more,
    and groups are what links connect. Most links are found by ball hashing of a
    wide SimHash, the others by an exact search (similar_roots). Null, empty and
    blank texts are copies of each other. Rows with equal doc_id are told apart by
    a number given when they are first read and written, so of repeated rows one
    stays. Columns are as they came. No rows give no rows.
    """
    number = "_row_number_here"
    docs, own = aside(docs, number)
    numbered, _ = materialise_at(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(number).alias("number"), "text", "doc_id")
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("content", T.BinaryType()), docs.schema["doc_id"]])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "number")).alias("first")
    nodes = texts.mapInArrow(_contents, schema).groupBy("content").agg(first)
    nodes = materialise(nodes.select("first", F.col("first.number").alias("id")), "nodes")
    roots = similar_roots(nodes.select("id"), texts, shingle, similarity)
    placed = nodes.join(roots.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    keep = placed.groupBy("comp").agg(F.min("first").alias("first")).select(F.col("first.number").alias(number))
    return numbered.join(keep.hint("shuffle_hash"), number, "left_semi").select(*own)
