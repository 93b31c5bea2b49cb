"""Language-model scoring by a probabilistic suffix tree over words.

Tokens are words with A-Z lowered, and one end after each text. The root of the
tree gives each token (c + 1) / (N + V + 1). A context, the last one or more words,
remembers the tokens that follow it LEAST times or more and of which it tells
at least REMEMBER nats: over their occurrences, the log ratio of their
probability in the context to that in its suffix, each occurrence being judged
by the others (so that chance repeats don't count). All others share the rest of
its distribution, PRIOR among it, as its suffix gives them. A context is retained
where this tells DIVERGENCE nats or more of all that follows it. A token is
scored in the longest retained context before it; the suffix of a context is its
longest retained one. No length is fixed: beyond two words, contexts become
longer by a word while those of the last length told over WORTH of all that was
told.

Everything is counted over all training texts and lies in Spark tables of
64-bit hashes of words, contexts and windows (context and token), so the tree
grows with the corpus. A row of these tables is a block: the entries of a task
that belong to one range of keys (a bucket), as columns of bytes. Spark deals the
blocks out by their buckets, and a task takes one bucket after the other. Words
and contexts with HOT_SHARE of all tokens are no task's own: their entries are
dealt out by windows, and what is known of them is sent to every task.

Logarithms telescope: a token's score is the sum of the values of its own key, of
the retained contexts before it and of its windows that these remember, so
scoring asks for keys and adds up values, for one part of the documents after the
other, so that what is asked at once stays below a share of the text. Two more things of bounded size are
sent to every task to keep keys from being asked for, and change no result: the
values of keys with at least HEAD_SHARE of all tokens, and a bit filter that
tells most absent keys.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workdir import new_path, write
from .common import crc_mod, discard, materialise_at, words_of

#: Occurrences that a context can remember a token from; also the least of a context.
LEAST = 2
#: Weight of the suffix's distribution in a context's own.
PRIOR = 4.0
#: Nats that a remembered token, and a retained context, must tell.
REMEMBER, DIVERGENCE = 4.0, 6.0
#: Contexts are made a word longer while those of the last length tell this share of all nats told by retained contexts.
WORTH = 0.1
#: A key with this share of all tokens or more is sent to every task: at most 1 / HEAD_SHARE of them for each kind.
HEAD_SHARE = 2.5e-7
#: The bit filter of keys has at most 2 ** FILTER_BITS words of 64 bits, that of filter_of() 2 ** SET_BITS.
FILTER_BITS, SET_BITS = 22, 21
#: Texts of so many bytes, or one text, are held by a task at a time.
PART_BYTES = 4 << 20
#: Words and contexts with this share of all tokens or more are sent to every task: at most 1 / HOT_SHARE for each length.
HOT_SHARE = 1e-3
#: A bucket is for about so many bytes of text; a task gathers so many windows before it writes their blocks.
BUCKET_BYTES, FOLD = 4 << 20, 3 << 18
#: Documents are asked for in as many rounds as keep what is asked at once below this share of all text, and below so many bytes.
ROUND_SHARE, ROUND_BYTES = 1.0, 64 << 20
#: Bytes of a key that is asked for, with the row that asks; keys that a task gathers before it writes their blocks.
ASK_BYTES, GATHER = 10, 3 << 18
#: Rows and bytes that Spark sends to Python at a time, here; texts and blocks are long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
START, END = b"\n", b" "  # no word holds white space
BACK = 0x5851F42D4C957F2D  # tells the key of a context's rest from the key of a word

U = np.uint64


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, in this order."""
    x = a * U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Vocabulary:
    """The words that a task has met: their numbers and hashes. It begins anew beyond ``most``, so it stays small."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.numbers, self.hashes = _Numbers(), np.zeros(0, dtype=U)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words' hashes by number, the start's being 0; numbers of all tokens; and each text's number of tokens."""
        if len(self.numbers) > self.most:
            self.clear()
        get = self.numbers.__getitem__
        get(START)
        end = get(END)
        rows, sizes = [], []
        for text in texts:
            words = words_of(text)
            rows.append(np.fromiter((*map(get, words), end), dtype=np.int32, count=len(words) + 1))
            sizes.append(len(words) + 1)
        new = list(islice(self.numbers, len(self.hashes), None))
        fresh = np.fromiter((xxhash.xxh64_intdigest(w) for w in new), dtype=U, count=len(new))
        self.hashes = np.concatenate([self.hashes, mixed(np.zeros(len(new), dtype=U), fresh)])
        return self.hashes, np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32), np.array(sizes, dtype=np.int64)


class Filter:
    """Bits of a set of keys: a key of the set always passes, few others do while there is room."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift, self.empty = bits, U(64 - (len(bits).bit_length() - 1)), not bits.any()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        mask = (U(1) << (keys & U(63))) | (U(1) << ((keys >> U(6)) & U(63)))
        return (self.bits[keys >> self.shift] & mask) == mask

    def share(self) -> float:
        """Of the keys that aren't in the set, those that pass."""
        return float(np.mean((np.bitwise_count(self.bits) / 64.0) ** 2))


def filter_of(keys: DataFrame) -> Filter:
    """Built by Spark; what reaches the driver has at most 2 ** SET_BITS rows at any number of keys."""
    bits = min(SET_BITS, max(6, keys.count().bit_length()))
    one, key = F.lit(1).cast("long"), F.col("key")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftright(key, by).bitwiseAND(F.lit(63)).cast("int"))
    slots = keys.groupBy(F.shiftrightunsigned(key, 64 - bits).alias("slot")).agg(F.bit_or(bit(0).bitwiseOR(bit(6))).alias("word")).toArrow()
    out = np.zeros(1 << bits, dtype=np.int64)
    for part in slots.to_batches():
        out[part["slot"].to_numpy()] = part["word"].to_numpy()
    return Filter(out.view(U))


def parts(batches, text: int):
    """Slices of Arrow batches of up to PART_BYTES of text each, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(size.tolist()):
            if held and held + n > PART_BYTES:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


LOWER, SPACE = np.arange(256, dtype=np.uint8), np.zeros(256, dtype=bool)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE[list(b" \t\n\v\f\r")] = True
#: Bytes of a word that are hashed eight at a time, for all words at once.
SHORT = 64
#: The hashes of a text's start and end.
STARTS, ENDS = U(0x57A27D0C9B3F1E65), U(0xE9D64B1F30A8C577)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, and each text's number of tokens."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    rows = len(texts)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    some = np.diff(ends) > 0
    data = np.concatenate([LOWER[data], np.zeros(8, dtype=np.uint8)])
    word = ~SPACE[data[:-8]]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    for edge, at in ((first, ends[:-1][some]), (last, ends[1:][some] - 1)):
        edge[at] = word[at]
    at = np.nonzero(first)[0]
    length = np.nonzero(last)[0] + 1 - at
    eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U)
    hashes, which = np.zeros(len(at), dtype=U), np.arange(len(at))
    for k in range(0, SHORT, 8):
        which = which[length[which] > k]
        if not len(which):
            break
        hashes[which] = mixed(hashes[which], eights[at[which] + k] & masks[np.minimum(length[which] - k, 8)])
    for i in np.nonzero(length > SHORT)[0]:
        rest = xxhash.xxh64_intdigest(data[at[i] + SHORT : at[i] + length[i]].tobytes())
        hashes[i : i + 1] = mixed(hashes[i : i + 1], np.array([rest], dtype=U))
    counts = np.diff(np.searchsorted(at, ends))
    out = np.full(len(at) + rows, ENDS, dtype=U)
    out[np.arange(len(at)) + np.repeat(np.arange(rows), counts)] = mixed(hashes, length.astype(U))
    return out, counts + 1


class Places:
    """The tokens of some texts with the windows that end in them; none reaches further back than one start.

    The key of a context of k words is that of the window that its last word ends, so it also names that window. The key of
    a window is a hash of its context and of the window one word shorter that ends with it, which is the token itself at last.
    """

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.token = tokens

    def levels(self, depth: int):
        """For each length, the keys of the contexts of all tokens and of their windows, and the tokens that have so long a context."""
        key = self.token
        for length in range(1, depth + 1):
            context = np.roll(key, 1)
            if length == 1:
                context[self.place == 0] = STARTS
            key = mixed(~context, key)
            yield context, key, np.nonzero(self.place >= length - 1)[0]

    def open(self, length: int, repeated: Filter) -> tuple[np.ndarray, ...]:
        """Of windows with ``length`` words: keys, contexts, and the windows one word shorter at the old end.

        Those that may repeat: a window does so only where both windows in it do that are one word shorter.
        """
        low = self.token
        for at, (context, key, which) in enumerate(self.levels(length), 1):
            if at == length:
                break
            low = key
        which = which[repeated(context[which])]
        which = which[repeated(low[which])]
        return key[which], context[which], low[which]


#: Kinds of blocks. TABLE: key, n, value (lp, the log probability). WINDOWS: key (the context), low, n, value (lp of low). HOT: size
#: (the context), total and gain of what it may remember. TELLS: gain. TOKENS, VALUES: key, n, value (log10). ASKED: size (the part), key, low (the
#: row in it, in 16 or 32 bits). DOCS: no block, but a document. BITS: size (the first word's place), key (words of a filter). n has as few bytes
#: as it needs.
TABLE, WINDOWS, HOT, TELLS, TOKENS, VALUES, ASKED, DOCS, BITS = range(9)
BLOCK = "bucket int, kind int, size long, total double, gain double, key binary, low binary, n binary, value binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("size", pa.int64()), ("total", pa.float64()), ("gain", pa.float64()), *((c, pa.binary()) for c in ("key", "low", "n", "value"))])
DTYPES = U, U, np.int64, np.float64
HIGH = U(0xFFFFFFFF00000000)


def _counts(blob, entries: int) -> np.ndarray:
    """n of a block."""
    return np.frombuffer(blob, dtype=f"u{len(blob) // entries}").astype(np.int64) if entries else np.zeros(0, dtype=np.int64)


def order_of(keys: np.ndarray) -> np.ndarray:
    """np.argsort, by a sort of the keys' first bits with their places behind them, which is faster."""
    bits = U(max(1, len(keys).bit_length()))
    order = (np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=U)) & ((U(1) << bits) - U(1))).astype(np.int64)
    held = keys[order]
    if (held[1:] < held[:-1]).any():
        order = order[np.argsort(held, kind="stable")]
    return order


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal entries begin."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.nonzero(new)[0]


def _folded(key: np.ndarray, deal: np.ndarray, context: np.ndarray, low: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct windows with the sums of n (None: 1 each), in the order of the first half of ``deal``."""
    half = (deal & HIGH) | (key >> U(32))
    order = order_of(half)
    half, held = half[order], key[order]
    mingled = (half[1:] == half[:-1]) & (held[1:] != held[:-1])
    if mingled.any():  # windows that agree in both halves
        at = np.nonzero(np.isin(half, half[1:][mingled]))[0]
        order[at] = order[at][np.lexsort((held[at], half[at]))]
    at = _starts(key[order])
    sums = np.diff(np.append(at, len(order))) if n is None else np.add.reduceat(n[order], at) if len(at) else n
    at = order[at]
    return key[at], deal[at], context[at], low[at], sums


def _row(kind: int, size: int, total: float | None, gain: float) -> list:
    return [0, kind, size, total, gain, None, None, None, None]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


class Buckets:
    """Ranges of keys, all as wide, by the first half of their bits."""

    def __init__(self, n: int):
        self.n = n

    def of(self, deal: np.ndarray) -> np.ndarray:
        return ((deal >> U(32)) * U(self.n) >> U(32)).astype(np.int64)

    def blocks(self, kind: int, deal: np.ndarray, key, low=None, n=None, value=None, size: int | None = None, ordered: bool = False):
        """A batch of blocks of these entries, dealt out by ``deal``."""
        if not len(deal):
            return
        columns = [key, low, n, value]
        if n is not None and not ordered and n.max() < 1 << 16:
            columns[2] = n.astype(np.uint16)
        if not ordered:
            order = order_of(deal)
            deal, columns = deal[order], [c if c is None else c[order] for c in columns]
        own = self.of(deal)
        at = _starts(own)
        n = columns[2]
        held = [memoryview(np.ascontiguousarray(c)).cast("B") if c is not None else None for c in columns]
        sums = np.add.reduceat(n, at).tolist() if ordered and n is not None else [None] * len(at)
        most = np.maximum.reduceat(n, at).tolist() if n is not None else at.tolist()
        rows = []
        for a, z, total, top in zip(at.tolist(), [*at[1:].tolist(), len(own)], sums, most):
            blobs = [None if h is None else bytes(h[a * c.itemsize : z * c.itemsize]) for h, c in zip(held, columns)]
            if n is not None:
                blobs[2] = n[a:z].astype(f"u{next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)}").tobytes()
            rows.append([int(own[a]), kind, z - a if size is None else size, total, None, *blobs])
        yield _batch(rows)

    def dealt(self, blocks: DataFrame, run, schema: str | T.StructType = BLOCK) -> DataFrame:
        """``run`` over the blocks of each task's buckets, one bucket after the other."""
        n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return blocks.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket").mapInArrow(run, schema)


def _by_bucket(batches):
    """Each bucket with its blocks by kind: size, key, low, n, value."""
    now, held = None, defaultdict(list)
    for batch in batches:
        buckets, kinds, sizes = (batch.column(i).to_pylist() for i in range(3))
        columns = [batch.column(i) for i in range(5, 9)]
        for j, bucket in enumerate(buckets):
            if bucket != now:
                if now is not None:
                    yield now, held
                now, held = bucket, defaultdict(list)
            blobs = [c[j].as_buffer() if c[j].is_valid else None for c in columns]
            widths = [8 if x is None else 8 * x.size // blobs[0].size for x in blobs]  # only rows that ask, and n, have less than 8 bytes
            dtypes = U, f"u{widths[1]}", f"u{widths[2]}", np.float64
            held[kinds[j]].append((sizes[j], *(None if x is None else np.frombuffer(x, dtype=t) for x, t in zip(blobs, dtypes))))
    if now is not None:
        yield now, held


def _column(blocks: list[tuple], i: int) -> np.ndarray:
    return np.concatenate([b[i] for b in blocks]).astype(DTYPES[i - 1], copy=False) if blocks else np.zeros(0, dtype=DTYPES[i - 1])


class Hot:
    """Keys that many windows share, with their n and lp; sent to every task."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, lp: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n, self.lp = keys[order], n[order], lp[order]
        self.may = np.zeros(1 << 16, dtype=bool)
        self.may[self.keys >> U(48)] = True

    def among(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hot ones in ``keys``, and in ``self.keys``."""
        at = np.nonzero(self.may[keys >> U(48)])[0]
        i = np.minimum(np.searchsorted(self.keys, keys[at]), max(0, len(self.keys) - 1))
        same = self.keys[i] == keys[at] if len(at) else np.zeros(0, dtype=bool)
        return at[same], i[same]

    def deal(self, keys: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """``keys``, but the window where a key is hot."""
        at, _ = self.among(keys)
        out = keys.copy()
        out[at] = windows[at]
        return out


def _tokens(buckets: Buckets):
    """TABLE: tokens with their counts; the start among them."""

    def run(batches):
        held, size, starts = [], 0, 0

        def out():
            key = np.concatenate(held)
            held.clear()
            key.sort()
            at = _starts(key)
            return buckets.blocks(TABLE, key[at], key[at], n=np.diff(np.append(at, len(key))), ordered=True)

        for part in parts(batches, 0):
            tokens, sizes = tokens_of(part.column(0))
            held.append(tokens)
            size, starts = size + len(tokens), starts + len(sizes)
            if size >= FOLD:
                yield from out()
                size = 0
        if held:
            yield from out()
        if starts:
            start = np.array([STARTS], dtype=U)
            yield from buckets.blocks(TABLE, start, start, n=np.array([starts]))

    return run


def _counted(buckets: Buckets, bits: int):
    """TABLE: tokens and the start with their counts over all; TOKENS: the same with values, without the start; BITS of those met LEAST times."""

    def run(batches):
        for _, held in _by_bucket(batches):
            key, n = _column(held[TABLE], 1), _column(held[TABLE], 3)
            order = order_of(key)
            key, n = key[order], n[order]
            at = _starts(key)
            key, n = key[at], np.add.reduceat(n, at)
            yield from buckets.blocks(TABLE, key, key, n=n, ordered=True)
            if (n >= LEAST).any():
                yield _batch([_words(key[n >= LEAST], bits)])
            own = key != STARTS
            yield from buckets.blocks(TOKENS, key[own], key[own], n=n[own], value=np.log10(n[own] + 1.0), ordered=True)

    return run


def _with_lp(tokens: float):
    """Adds the log probability of tokens."""

    def run(batches):
        at = SCHEMA.get_field_index("value")
        for batch in batches:
            lp = [np.log((_counts(x, n) + 1.0) / tokens).tobytes() for n, x in zip(batch.column(2).to_pylist(), batch.column(at - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(lp, pa.binary())], schema=SCHEMA)

    return run


def _entries(least: float, kinds: tuple[int, ...]):
    """key, n, value of entries met ``least`` times or more."""

    def run(batches):
        for batch in batches:
            held = []
            for kind, *blob in zip(batch.column(1).to_pylist(), *(batch.column(i).to_pylist() for i in (5, 7, 8))):
                if kind in kinds:
                    n = _counts(blob[1], len(blob[0]) // 8)
                    own = n >= least
                    if own.any():
                        held.append((np.frombuffer(blob[0], dtype=np.int64)[own], n[own], np.frombuffer(blob[2], dtype=np.float64)[own]))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["key", "n", "value"])

    return run


def _words(key: np.ndarray, bits: int) -> list:
    """A BITS row: the words of a filter from that of the first of these keys, which are in order, to that of the last."""
    slot = (key >> U(64 - bits)).astype(np.int64)
    at = _starts(slot)
    out = np.zeros(slot[-1] - slot[0] + 1, dtype=U)
    out[slot[at] - slot[0]] = np.bitwise_or.reduceat((U(1) << (key & U(63))) | (U(1) << ((key >> U(6)) & U(63))), at)
    return [0, BITS, int(slot[0]), None, None, out.tobytes(), None, None, None]


def _bits(bits: int):
    """BITS of the keys of blocks."""

    def run(batches):
        for _, held in _by_bucket(batches):
            yield _batch([_words(np.sort(_column([b for kind in held.values() for b in kind], 1)), bits)])

    return run


def _filter_of(words: DataFrame, bits: int) -> Filter:
    """Of BITS; what reaches the driver has at most 2 ** bits words, and one more for each bucket."""
    out = np.zeros(1 << bits, dtype=U)
    for batch in words.select("size", "key").toArrow().to_batches():
        for at, blob in zip(*(c.to_pylist() for c in batch.columns)):
            word = np.frombuffer(blob, dtype=U)
            out[at : at + len(word)] |= word
    return Filter(out)


def _filter(buckets: Buckets, blocks: DataFrame, bits: int) -> Filter:
    """Of the blocks' keys."""
    words, at = materialise_at(buckets.dealt(blocks.select("bucket", "kind", "size", *(F.lit(None).cast(t).alias(c) for c, t in (("total", "double"), ("gain", "double"))), "key", *(F.lit(None).cast("binary").alias(c) for c in ("low", "n", "value"))), _bits(bits)), "bits")
    out = _filter_of(words, bits)
    discard(blocks.sparkSession, at)
    return out


def _windows(length: int, sent, buckets: Buckets):
    """WINDOWS: those of ``length`` words and a token that may be told of, with their counts; dealt out by the shorter window (low)."""

    def run(batches):
        (repeated, hot), held, size = sent.value, [], 0

        def out():
            key, context, low = (np.concatenate(x) for x in zip(*held))
            held.clear()
            key, deal, context, low, n = _folded(key, hot.deal(low, key), context, low)
            yield from buckets.blocks(WINDOWS, deal, context, low, n, ordered=True)

        for part in parts(batches, 0):
            held.append(Places(*tokens_of(part.column(0))).open(length, repeated))
            size += len(held[-1][0])
            if size >= FOLD:
                yield from out()
                size = 0
        if held:
            yield from out()

    return run


def _gain(n: np.ndarray, total: np.ndarray, lp: np.ndarray) -> np.ndarray:
    """Nats that a window tells if its context remembers it."""
    return n * (np.log(n - 1.0 + PRIOR * np.exp(lp)) - np.log(total - 1.0 + PRIOR) - lp)


def _tells(whole: np.ndarray, seen: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Nats that a context tells by what it remembers, less what the others lose in the rest."""
    alone = whole - seen
    return gain + alone * np.log((alone - 1.0 + PRIOR) / (whole - 1.0 + PRIOR))


def _met(sent, buckets: Buckets):
    """WINDOWS met LEAST times with lp of the shorter window, dealt out by context; HOT: what hot contexts may remember."""

    def run(batches):
        _, hot = sent.value
        kept, size = [], 0
        seen, gains = np.zeros(len(hot.keys)), np.zeros(len(hot.keys))

        def out():
            context, low, n, lp = (np.concatenate(x) for x in zip(*kept))
            yield from buckets.blocks(WINDOWS, hot.deal(context, mixed(~context, low)), context, low, n, lp)

        for _, held in _by_bucket(batches):
            if not held[WINDOWS]:
                continue
            context, low, n = (_column(held[WINDOWS], i) for i in (1, 2, 3))
            key = mixed(~context, low)
            _, _, context, low, n = _folded(key, low, context, low, n)
            own = n >= LEAST
            context, low, n = context[own], low[own], n[own]
            keys = np.concatenate([_column(held[TABLE], 1), hot.keys])
            order = order_of(keys)
            lp = np.concatenate([_column(held[TABLE], 4), hot.lp])[order][np.searchsorted(keys[order], low)]
            at, i = hot.among(context)
            gain = _gain(n[at], hot.n[i], lp[at])
            told = gain >= REMEMBER
            seen += np.bincount(i[told], n[at][told], len(seen))
            gains += np.bincount(i[told], gain[told], len(seen))
            kept.append((context, low, n, lp))
            size += len(n)
            if size >= FOLD:
                yield from out()
                kept, size = [], 0
        if size:
            yield from out()
        if rows := [_row(HOT, int(hot.keys.view(np.int64)[i]), float(seen[i]), float(gains[i])) for i in np.nonzero(seen)[0]]:
            yield _batch(rows)

    return run


def _grown(sent, buckets: Buckets):
    """TABLE of windows met LEAST times; VALUES of what is remembered and of retained contexts; TELLS."""

    def run(batches):
        hot, hot_tells, hot_rest = sent.value
        told_all, kept, size = 0.0, defaultdict(list), 0

        def out():
            for kind in list(kept):
                key, n, value = (np.concatenate(x) for x in zip(*kept.pop(kind)))
                yield from buckets.blocks(kind, key, key, n=n, value=value)

        for bucket, held in _by_bucket(batches):
            mine = np.nonzero((buckets.of(hot.keys) == bucket) & ~np.isnan(hot_rest))[0]
            kept[VALUES].append((hot.keys[mine] ^ U(BACK), hot.n[mine], np.log10(hot_rest[mine] / (hot.n[mine] + PRIOR))))
            told_all += float(hot_tells[mine].sum())
            if held[WINDOWS]:
                context, low, n, lp = (_column(held[WINDOWS], i) for i in (1, 2, 3, 4))
                order = order_of(context)
                context, low, n, lp = context[order], low[order], n[order], lp[order]
                at = _starts(context)
                keys = np.concatenate([_column(held[TABLE], 1), hot.keys])
                order = order_of(keys)
                total = np.concatenate([_column(held[TABLE], 3), hot.n])[order][np.searchsorted(keys[order], context[at])]
                times = np.diff(np.append(at, len(context)))
                whole = np.repeat(total, times)
                gain = _gain(n, whole, lp)
                told = gain >= REMEMBER
                seen, gained = np.add.reduceat(np.where(told, n, 0), at), np.add.reduceat(np.where(told, gain, 0.0), at)
                tells = np.where(seen > 0, _tells(total, seen, gained), -np.inf)
                group = np.where(tells >= DIVERGENCE, total - seen + PRIOR, np.nan)
                j, i = hot.among(context[at])  # here are only some of their windows
                tells[j], group[j] = -np.inf, hot_rest[i]
                own = tells >= DIVERGENCE
                told_all += float(tells[own].sum())
                kept[VALUES].append((context[at][own] ^ U(BACK), total[own], np.log10(group[own] / (total[own] + PRIOR))))
                rest, p, key = np.repeat(group, times), np.exp(lp), mixed(~context, low)
                fine = ~np.isnan(rest)
                lp = np.where(fine, np.log((np.where(told, n, 0) + rest * p) / (whole + PRIOR)), lp)
                told &= fine
                kept[VALUES].append((key[told], n[told], np.log10(1.0 + n[told] / (rest[told] * p[told]))))
                kept[TABLE].append((key, n, lp))
                size += len(n)
            if size >= FOLD:
                yield from out()
                size = 0
        yield from out()
        yield _batch([_row(TELLS, 0, None, told_all)])

    return run


def _by_kind(blocks: DataFrame, tag: str) -> tuple[Callable[[int], DataFrame], str]:
    """Writes the blocks, each kind into a folder of its own, so that one can be discarded before the others; and gives what reads a kind, and the path."""
    path = new_path(blocks.sparkSession, tag)
    write(blocks, path, "kind")
    read = blocks.sparkSession.read.schema(BLOCK).parquet(path).select(*SCHEMA.names)
    return lambda kind: read.where(F.col("kind") == kind), path


def _folder(path: str, kind: int) -> str:
    return f"{path}/kind={kind}"


class Model:
    """The tree as tables of blocks: key, n, value (log10) of tokens (TOKENS), windows and contexts (VALUES); with N and V.

    The value of a token is log10(c + 1); of a window its gain over the share of
    its context's rest that it would have had; of a context its rest.
    """

    def __init__(self, docs: DataFrame, train: Column, depth: int | None = None):
        self.spark = docs.sparkSession
        self.texts = docs.where(train).select("text")
        length = F.coalesce(F.octet_length("text"), F.lit(0))
        self.bytes, self.rows, learnt, texts = (x or 0 for x in docs.agg(F.sum(length), F.count(F.lit(1)), F.sum(F.when(train, length)), F.count(F.when(train, 1))).first())
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        count = max(1, -(-self.bytes // BUCKET_BYTES))
        self.buckets = buckets = Buckets(count if count < partitions else partitions * -(-count // partitions))
        self.bits = min(FILTER_BITS, max(6, int(self.bytes // 4 + self.rows).bit_length()))
        of, read = _by_kind(buckets.dealt(self.texts.mapInArrow(_tokens(buckets), BLOCK), _counted(buckets, self.bits)), "tokens")
        repeated = _filter_of(of(BITS), self.bits)
        tokens = of(TOKENS)
        self.n, self.v = tokens.agg(F.coalesce(F.sum("total"), F.lit(0.0)).cast("long"), F.coalesce(F.sum("size"), F.lit(0)).cast("long")).first()
        self.tokens = self.rows + (self.n - texts) * self.bytes / max(1, learnt)  # of all documents, about
        table = of(TABLE).mapInArrow(_with_lp(self.n + self.v + 1.0), BLOCK)
        values = [tokens]
        self.depth, told, ends = 0, 0.0, False
        while not ends:
            self.depth += 1
            of, out_at = self._longer(self.depth, table, repeated or _filter(buckets, table, self.bits))
            repeated = None
            for kind in (TABLE, BITS):
                discard(self.spark, _folder(read, kind))
            tells = of(TELLS).agg(F.coalesce(F.sum("gain"), F.lit(0.0))).first()[0]
            told += tells
            ends = self.depth == depth or (depth is None and self.depth > 1 and tells <= WORTH * told)
            values.append(of(VALUES))
            table, read = of(TABLE), out_at
        discard(self.spark, _folder(read, TABLE))
        self.values = reduce(DataFrame.unionByName, values)

    def _longer(self, length: int, table: DataFrame, repeated: Filter) -> tuple[Callable[[int], DataFrame], str]:
        """_by_kind() of _grown() of windows of ``length`` words, from the TABLE of those one word shorter."""
        context, buckets, none = self.spark.sparkContext, self.buckets, F.lit(None).cast("binary")
        most = table.mapInArrow(_entries(max(1.0, HOT_SHARE * self.n), (TABLE,)), "key long, n long, value double").toArrow()
        hot = Hot(most["key"].to_numpy().view(U), most["n"].to_numpy(), most["value"].to_numpy())
        sent = context.broadcast((repeated, hot))
        windows = self.texts.mapInArrow(_windows(length, sent, buckets), BLOCK)
        met, met_at = materialise_at(buckets.dealt(windows.unionByName(table.withColumn("n", none)), _met(sent, buckets)), "met")
        sent.destroy()
        seen, gains = np.zeros(len(hot.keys)), np.zeros(len(hot.keys))
        for key, *sums in met.where(F.col("kind") == HOT).groupBy("size").agg(F.sum("total"), F.sum("gain")).collect():
            at = np.searchsorted(hot.keys, np.int64(key).view(U))
            seen[at], gains[at] = sums
        tells = np.where(seen > 0, _tells(hot.n, seen, gains), -np.inf)
        sent = context.broadcast((hot, tells, np.where(tells >= DIVERGENCE, hot.n - seen + PRIOR, np.nan)))
        out = _by_kind(buckets.dealt(met.where(F.col("kind") == WINDOWS).unionByName(table.withColumn("value", none)), _grown(sent, buckets)), "grown")
        sent.destroy()
        discard(self.spark, met_at)
        return out

    def send(self) -> None:
        """What scoring tasks get: the filter of contexts and windows, and the head's keys and values."""
        entries = _entries(max(1.0, HEAD_SHARE * self.n), (TOKENS, VALUES))
        head = self.values.mapInArrow(entries, "key long, n long, value double").select("key", "value").toArrow()
        keys = head["key"].to_numpy().view(U)
        order = np.argsort(keys)
        passes = _filter(self.buckets, self.values.where(F.col("kind") == VALUES), self.bits)
        self.sent = self.spark.sparkContext.broadcast((passes, keys[order], head["value"].to_numpy()[order]))
        self.asked = ASK_BYTES * self.tokens * (1 + 2 * self.depth * passes.share())  # at the most, about

    def rounds(self) -> int:
        return max(1, -(-int(self.asked) // max(ROUND_BYTES, int(ROUND_SHARE * self.bytes))))


def _sums(owner: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(owner, values, n).astype(np.int64 if values is None else np.float64)  # of nothing, numpy counts in integers


DOC = {"train": "boolean", "n_tokens": "bigint", "head_known": "bigint", "head_base": "double", "head_more": "double", "row": "bigint"}
ANSWER = {"part": "bigint", "rows": "binary", "known": "binary", "base": "binary", "more": "binary"}


def _scorer(sent, depth: int, buckets: Buckets):
    """Rows of (doc_id, text, train) to what the head says of them, and the keys that may be in the tail, in blocks."""

    def run(batches):
        passes, keys, values = sent.value
        count = 0

        def ask(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which keys the head holds, and their values."""
            if not len(keys):
                return np.zeros(len(asked), dtype=bool), np.zeros(len(asked))
            i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return keys[i] == asked, values[i]

        def out():
            nonlocal count
            rows = sum(map(len, sizes))
            owner, key = (np.concatenate([x[i] for x in tokens]) for i in (0, 1))
            order = order_of(key)
            owner, key = owner[order], key[order]
            held, value = ask(key)
            known, base = _sums(owner[held], None, rows), _sums(owner[held], value[held], rows)
            rare = owner[~held], key[~held]
            owner, key = (np.concatenate([x[i] for x in left]) for i in (0, 1))
            order = order_of(key)
            owner, key = owner[order], key[order]
            held, value = ask(key)
            more = _sums(owner[held], value[held], rows)
            owner, key = np.concatenate([rare[0], owner[~held]]).astype(np.uint16 if rows <= 1 << 16 else np.uint32), np.concatenate([rare[1], key[~held]])
            name = (TaskContext.get().partitionId() << 40) + (count << 20)  # of the group; with a row's place added, of the row
            if rows > 1 << 20:
                raise ValueError("a batch has over a million rows")
            count += 1
            own = [*(pa.concat_arrays(x) for x in zip(*docs)), pa.array(np.concatenate(sizes)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(more), pa.array(name + np.arange(rows))]
            names = ["doc_id", *DOC, *SCHEMA.names]
            dealt = pa.array(((np.arange(rows) + count) % buckets.n).astype(np.int32)), pa.array(np.full(rows, DOCS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*own, *dealt, *(pa.nulls(rows, t) for t in SCHEMA.types[2:])], names=names)
            for asked in buckets.blocks(ASKED, key, key, owner, size=name):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(asked.num_rows, x.type) for x in own), *asked.columns], names=names)
            for x in (docs, sizes, tokens, left):
                x.clear()

        docs, sizes, tokens, left = [], [], [], []  # of a group of parts
        rows = size = 0
        for part in parts(batches, 1):
            if rows and rows + part.num_rows > 1 << 16:
                yield from out()
                rows = size = 0
            token, each = tokens_of(part.column(1))
            places = Places(token, each)
            tokens.append((places.owner + rows, token))
            for context, window, alive in places.levels(depth):
                back = context[alive] ^ U(BACK)
                seen = passes(back)
                alive, back = alive[seen], back[seen]
                window = window[alive]
                fine = passes(window)
                left += [(places.owner[alive] + rows, back), (places.owner[alive[fine]] + rows, window[fine])]
                size += len(back) + int(fine.sum())
            docs.append((part.column(0), part.column(2)))
            sizes.append(each)
            rows, size = rows + part.num_rows, size + len(token)
            if size >= GATHER:
                yield from out()
                rows = size = 0
        if rows:
            yield from out()

    return run


def _answers(batches):
    """What the tail says of the rows of each part that ask a bucket's keys; and the documents, as they are."""
    passed, names, empty = [], [], []

    def blocks_only():
        for batch in batches:
            docs = pc.equal(batch.column("kind"), DOCS)
            own = batch.select(["doc_id", *DOC])
            names[:], empty[:] = [*own.schema.names, *ANSWER], [pa.nulls(1, t) for t in own.schema.types]
            if (own := own.filter(docs)).num_rows:
                passed.append(pa.RecordBatch.from_arrays([*own.columns, *(pa.nulls(own.num_rows, pa.int64() if t == "bigint" else pa.binary()) for t in ANSWER.values())], names=names))
            yield batch.select(SCHEMA.names).filter(pc.invert(docs))

    for _, held in _by_bucket(blocks_only()):
        yield from passed
        passed.clear()
        blocks = held[TOKENS] + held[VALUES]
        token = np.repeat([True, False], [sum(len(b[1]) for b in held[k]) for k in (TOKENS, VALUES)])
        keys = _column(blocks, 1)
        order = order_of(keys)
        keys, values, token = keys[order], _column(blocks, 4)[order], token[order]
        if not len(keys):
            continue
        said = []
        for part, key, row, *_ in held[ASKED]:
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            found = keys[i] == key
            i, row = i[found], row[found].astype(np.int64)
            own = np.nonzero(np.bincount(row))[0]
            if len(own):
                known, base = np.bincount(row, token[i])[own], np.bincount(row, np.where(token[i], values[i], 0.0))[own]
                more = np.bincount(row, np.where(token[i], 0.0, values[i]))[own]
                said.append((part, *(x.tobytes() for x in (own.astype(np.int32), known.astype(np.int32), base, more))))
        if said:
            nulls = [pa.nulls(len(said), x.type) for x in empty]
            yield pa.RecordBatch.from_arrays([*nulls, *(pa.array(x, pa.binary() if i else pa.int64()) for i, x in enumerate(zip(*said)))], names=names)
    yield from passed


def _added(batches):
    """The sums of each part's rows over all that was said of them; a part's blocks follow each other."""
    now, rows = None, []

    def out():
        row, known, base, more = (np.concatenate([np.frombuffer(x, dtype=t) for x in c]) for c, t in zip(zip(*rows), (np.int32, np.int32, np.float64, np.float64)))
        own = np.unique(row)
        return pa.RecordBatch.from_arrays([pa.array(now + own.astype(np.int64)), pa.array(np.bincount(row, known)[own].astype(np.int64)), pa.array(np.bincount(row, base)[own]), pa.array(np.bincount(row, more)[own])], names=["row", "known", "base", "more"])

    for batch in batches:
        for part, *said in zip(*(c.to_pylist() for c in batch.columns)):
            if part != now and rows:
                yield out()
                rows = []
            now = part
            rows.append(said)
    if rows:
        yield out()


def score(docs: DataFrame, train: Column, depth: int | None = None) -> DataFrame:
    """_scored(), with few rows and bytes in a batch."""
    conf = docs.sparkSession.conf
    before = {k: conf.get(k) for k in BATCH}
    for k, v in BATCH.items():
        conf.set(k, v)
    try:
        return _scored(docs, train, depth)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def _scored(docs: DataFrame, train: Column, depth: int | None) -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a boolean Column that says which rows are learnt from; null is
    no; ``depth`` stops the tree at contexts of so many words (None: by what they
    tell, see WORTH). ``score`` is the log10 probability of the text's tokens in the tree (an
    unknown one has the root's 1 / (N + V + 1)); base_score is that of the root
    alone. Null texts count as empty ones: one token, the end. Repeated rows are
    scored and counted each; other columns are ignored; without training rows
    every token has probability 1. Memory follows the longest single text.
    """
    train = F.coalesce(train, F.lit(False))
    model = Model(docs, train, depth)
    model.send()
    rounds = model.rounds()
    least = float(np.log10(model.n + model.v + 1.0))
    own = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in DOC.items()))])
    answer = T.StructType([*own, *T.StructType.fromDDL(", ".join(f"{c} {t}" for c, t in ANSWER.items()))])
    values, answered = model.values.withColumn("n", F.lit(None).cast("binary")), []
    docs = docs.select("doc_id", "text", train.alias("train"))
    for i in range(rounds):
        some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == i) if rounds > 1 else docs
        asked = some.mapInArrow(_scorer(model.sent, model.depth, model.buckets), T.StructType([*own, *T.StructType.fromDDL(BLOCK)]))
        out, out_at = materialise_at(model.buckets.dealt(asked.unionByName(values, allowMissingColumns=True), _answers, answer), "answers")
        said = out.where("part IS NOT NULL").select(*ANSWER).repartition("part").sortWithinPartitions("part")
        sums = said.mapInArrow(_added, "row long, known long, base double, more double")
        answered.append(materialise_at(out.where("part IS NULL").drop(*ANSWER).join(sums.hint("merge"), "row", "left"), "answered")[0])
        discard(docs.sparkSession, out_at)
    model.sent.destroy()
    whole = reduce(DataFrame.unionByName, answered)
    base = F.col("head_base") + F.coalesce("base", F.lit(0.0)) - F.col("n_tokens") * F.lit(least)
    return whole.select(
        "doc_id", "train", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.col("head_more") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def score_held_out(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """score(), learning from the rows whose crc32(doc_id as text) mod folds is not ``held``; held_out says which are."""
    out = score(docs, crc_mod("doc_id", folds) != held)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
