"""Removing repeated passages by longest-previous-factor arrays over suffix order.

A passage is ``LEAST`` bytes that start at two places. Every such string has an
anchor: the place in it whose ``GRAM`` bytes hash lowest. Equal strings
have equal anchors at equal offsets, so strings that can be equal share the
bytes at their anchor, and a suffix array is needed only within them. The
strings with one anchor start in a run; the bytes that the run covers are a
context. Equal contexts are folded first: only the first of them goes on. What
differs around equal anchors is dealt out by anchor, and each task sorts
the suffixes of its contexts and takes from suffix order, for each
place, the nearest earlier place before and after it (previous and next smaller
positions) and so the longest previous factor; the same for later places.
An anchor with very many contexts is parted: strings are told apart by their
offset to it in ever narrower blocks and by all bytes that a block's
strings share, until few contexts share them or a block is one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise_at, pieces, text_of

LEAST, GRAM = 200, 32
#: Bytes of text whose anchors, and bytes of contexts whose suffixes, are in hand at a time.
CHUNK, ARRAY = 1 << 20, 1 << 20
#: So many contexts of one anchor go to one suffix array; more are parted by narrower blocks of offsets.
MOST = 1024
BLOCKS = (24, 4, 1)

_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray, *more) -> np.ndarray:
    """Spreads hashes (the finisher of a public 64-bit hash), with other values mixed in."""
    for x in (0, *more):
        h = h ^ (np.asarray(x).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        h = h ^ (h >> np.uint64(33))
    return h


class _Hashes:
    """Hashes of any stretch of some bytes, from sums of powers modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.back = _powers(_INVERSE, n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, n)[:-1], out=self.sums[1:])

    def __call__(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values: from running minima of blocks, forward and backward."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, x.max(), dtype=x.dtype)]).reshape(-1, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def contexts(data: bytes, ends: list[int], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The contexts of texts that stand one after another and end at ``ends``: first start, number of starts, offset of the anchor from the first, hash at the anchor, hash of the context."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    if len(data) < least:
        return none
    raw = np.frombuffer(data, dtype=np.uint8)
    hashed = _Hashes(raw)
    n = len(raw) - gram + 1
    at = np.arange(n)
    low = (_mixed(hashed(at, at + gram)) & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)  # of equal ones the first
    anchor = (_window_least(low, least - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = 0
    for end in ends:
        anchor[max(begin, end - least + 1) : end] = -1  # no string of the length starts here
        begin = end
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    width = np.diff(np.append(first, len(anchor)))
    whole = anchor[first] >= 0
    first, width = first[whole], width[whole]
    offset = anchor[first] - first
    core = _mixed(hashed(anchor[first], anchor[first] + gram))
    return first, width, offset, core, _mixed(hashed(first, first + width - 1 + least), offset, width)


FIELDS = ("core", "hull", "doc_id", "text_hash", "at", "width", "offset")
_KIND = "core long, hull long, doc_id {id}, text_hash long, at long, width int, offset int"


def text_contexts(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """The contexts of all texts of (doc_id, text_hash, data), texts of up to CHUNK bytes together and longer ones in overlapping parts."""

    def found(held: list[tuple[int, int, bytes]], doc_ids, hashes):
        ends = np.cumsum([len(d) for *_, d in held])
        first, width, offset, core, hull = contexts(b"".join(d for *_, d in held), ends.tolist(), least, gram)
        which = np.searchsorted(ends, first, side="right")
        rows = np.array([r for r, *_ in held], dtype=np.int64)[which] if len(first) else first
        base = np.array([b - (e - len(d)) for (_, b, d), e in zip(held, ends.tolist())], dtype=np.int64)[which] if len(first) else first
        ids = pa.array(rows)
        signed = lambda x: pa.array(x.view(np.int64))
        return pa.RecordBatch.from_arrays([signed(core), signed(hull), doc_ids.take(ids), hashes.take(ids), pa.array(first + base), pa.array(width.astype(np.int32)), pa.array(offset.astype(np.int32))], names=FIELDS)

    def run(batches):
        for part in pieces(batches):
            held, size = [], 0
            for r, data in enumerate(part.column(2)):
                data = memoryview(data.as_buffer()) if data.is_valid else b""
                for at in range(0, max(1, len(data) - least + 1), CHUNK):
                    own = data[at : at + CHUNK + least - 1]
                    if len(own) < least:
                        continue
                    held.append((r, at, own))
                    size += len(own)
                    if size >= CHUNK:
                        yield found(held, part.column(0), part.column(1))
                        held, size = [], 0
            if held:
                yield found(held, part.column(0), part.column(1))

    return docs.select("doc_id", "text_hash", "data").mapInArrow(run, _KIND.format(id=docs.schema["doc_id"].dataType.simpleString()))


def folded(found: DataFrame) -> DataFrame:
    """Contexts that are not alone at their anchor, with ``whole`` (an equal one is elsewhere), ``first`` (of equal ones the first place) and ``n_hulls``, the different contexts at the anchor.

    Equal contexts are counted before they are shuffled; the join back to their
    places has one row for each context on its right side.
    """
    place = F.struct("doc_id", "text_hash", "at")
    hulls = found.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(place).alias("least"))
    cores = hulls.groupBy("core").agg(F.count("*").alias("n_hulls"))
    known = hulls.join(cores.hint("merge"), "core").where("n > 1 OR n_hulls > 1")
    out = found.join(known.hint("merge"), ["core", "hull"])
    return out.withColumns({"whole": F.col("n") > 1, "first": place == F.col("least")}).drop("n", "least")


def parted(open_: DataFrame, block: int, least: int = LEAST) -> DataFrame:
    """Contexts with their bytes, parted by blocks of offsets to the anchor; the hash at the anchor becomes that of all bytes that the strings of a block share."""

    def run(batches):
        for batch in pieces(batches, 1024):
            out = {f: [] for f in (*FIELDS, "data")}
            rows = {f: batch.column(f).to_pylist() for f in out}
            raw = b"".join(rows["data"])
            hashed = _Hashes(np.frombuffer(raw, dtype=np.uint8))
            base = 0
            for r, (at, width, offset, data) in enumerate(zip(rows["at"], rows["width"], rows["offset"], rows["data"])):
                low = offset - width + 1  # offsets of the context's strings: low to offset
                for b in range(low // block, offset // block + 1):
                    most, fewest = min(offset, b * block + block - 1), max(low, b * block)
                    start, n = offset - most, most - fewest + 1
                    anchor = base + offset
                    core = _mixed(hashed(np.array([anchor - b * block]), np.array([anchor - (b * block + block - 1) + least])), b, block)
                    hull = _mixed(hashed(np.array([base + start]), np.array([base + start + n - 1 + least])), most, n)
                    own = (core.view(np.int64)[0], hull.view(np.int64)[0], rows["doc_id"][r], rows["text_hash"][r], at + start, n, most, data[start : start + n - 1 + least])
                    for f, v in zip(out, own):
                        out[f].append(v)
                base += len(data)
            schema = pa.schema([pa.field("core", pa.int64()), pa.field("hull", pa.int64()), batch.schema.field("doc_id"), pa.field("text_hash", pa.int64()), pa.field("at", pa.int64()), pa.field("width", pa.int32()), pa.field("offset", pa.int32()), pa.field("data", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return open_.select(*FIELDS, "data").mapInArrow(run, _KIND.format(id=open_.schema["doc_id"].dataType.simpleString()) + ", data binary")


def suffix_order(data: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of their suffixes, each cut after ``least`` bytes, equal ones by place; and how many bytes, up to ``least``, each shares with the one before it.

    Ranks of strings of 8 bytes, then by doubling; the last rank joins two that overlap.
    """
    padded = np.concatenate([data, np.zeros(2 * least + 16, dtype=np.uint8)])
    n = len(data) + least
    eight = np.ndarray(shape=(n,), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    ranks, size = {8: np.unique(eight, return_inverse=True)[1].astype(np.int64)}, 8
    while 2 * size <= least:
        r = ranks[size]
        pair = r * np.int64(n + 1)
        pair[:-size] += r[size:] + 1
        size *= 2
        ranks[size] = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    r = ranks[size]
    order = starts[np.argsort(r[starts] * np.int64(n + 1) + r[starts + least - size], kind="stable")]
    shared = np.zeros(len(order), dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for s in sorted(ranks, reverse=True):
        step = np.where(ranks[s][a] == ranks[s][b], s, 0)
        a, b = a + step, b + step
    on = np.ones(len(a), dtype=bool)
    for _ in range(7):
        on &= padded[a] == padded[b]
        a, b = a + on, b + on
    shared[1:] = np.minimum(a - order[:-1], least)
    return order, shared


def _nearest(order: np.ndarray, shared: np.ndarray, sign: int) -> np.ndarray:
    """For each rank the longest string shared with the nearest rank before and after it whose place is smaller (larger for sign -1).

    Jumps of powers of two over least places and least shared lengths, so all ranks search at once.
    """
    best = np.zeros(len(order), dtype=np.int64)
    for turned in (False, True):
        # link[i]: what i shares with the rank before it, in the direction of the search
        place = sign * (order[::-1] if turned else order)
        link = np.concatenate([[0], shared[1:][::-1]]) if turned else shared
        n, levels = len(place), max(1, int(len(place)).bit_length())
        least_place, least_link = [place], [link]
        for k in range(levels - 1):
            step = 1 << k
            p, l = least_place[-1].copy(), least_link[-1].copy()
            p[step:] = np.minimum(p[step:], least_place[-1][:-step])
            l[step:] = np.minimum(l[step:], least_link[-1][:-step])
            least_place.append(p)
            least_link.append(l)
        at, got = np.arange(n) - 1, link.copy()
        for k in range(levels - 1, -1, -1):
            step = 1 << k
            inside = at - step + 1 >= 0
            spot = np.where(inside, at, 0)
            jump = inside & (least_place[k][spot] > place)
            got = np.where(jump, np.minimum(got, least_link[k][spot]), got)
            at = np.where(jump, at - step, at)
        got[(at < 0) | (place[np.maximum(at, 0)] > place)] = 0
        best = np.maximum(best, got[::-1] if turned else got)
    return best


def factors(data: bytes, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """For each start the longest previous and the longest next factor, cut after ``least`` bytes; those shorter are given as 0.

    Where neighbours in suffix order share fewer bytes, nothing that counts is
    shared across, so only runs of ranks that share ``least`` are searched.
    """
    order, shared = suffix_order(np.frombuffer(data, dtype=np.uint8), starts, least)
    tied = shared >= least
    runs = np.flatnonzero(tied | np.append(tied[1:], False))
    order, shared = order[runs], np.where(tied[runs], shared[runs], 0)
    where = np.searchsorted(starts, order)
    earlier, later = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    earlier[where], later[where] = _nearest(order, shared, 1), _nearest(order, shared, -1)
    return earlier, later


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of true flags; a run ends before each place in ``breaks``."""
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    begin |= flags & breaks
    first = np.flatnonzero(begin)
    last = flags.copy()
    last[:-1] &= ~flags[1:] | breaks[1:]
    return first, np.flatnonzero(last) - first + 1


def repeated_starts(open_: DataFrame, keep_first: bool, least: int = LEAST) -> DataFrame:
    """Runs of starts (doc_id, text_hash, at, width) whose string has an earlier place, or any other unless ``keep_first``, among contexts with the same anchor.

    Contexts come sorted by anchor, then place; whole anchors are put together
    until they have ARRAY bytes. An anchor has at most MOST contexts here.
    """

    def array(table: pa.Table):
        data, widths = table["data"].to_pylist(), table["width"].to_numpy().astype(np.int64)
        begin = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]]).astype(np.int64)
        total = int(widths.sum())
        row = np.repeat(np.arange(len(widths)), widths)
        inner = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
        earlier, later = factors(b"".join(data), begin[row] + inner, least)
        flags = earlier >= least if keep_first else np.maximum(earlier, later) >= least
        first, length = _runs(flags, inner == 0)
        ids = pa.array(row[first])
        return pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().take(ids), table["text_hash"].combine_chunks().take(ids), pa.array(table["at"].to_numpy()[row[first]] + inner[first]), pa.array(length.astype(np.int32))], names=["doc_id", "text_hash", "at", "width"])

    def run(batches):
        held, size = [], 0
        for batch in pieces(batches, 2048):
            core = batch.column("core").to_numpy()
            cuts = [0, *(np.flatnonzero(core[1:] != core[:-1]) + 1).tolist(), len(core)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if size >= ARRAY and held[-1].column("core")[0].as_py() != part.column("core")[0].as_py():
                    yield array(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(part)
                size += part.column("data").nbytes
        if held:
            yield array(pa.Table.from_batches(held))

    kind = open_.schema["doc_id"].dataType.simpleString()
    rows = open_.select("core", "doc_id", "text_hash", "at", "width", "data").repartition("core").sortWithinPartitions("core", "doc_id", "text_hash", "at")
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, at long, width int")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and data, the text's bytes."""
    return docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("data"))


def with_lists(texts: DataFrame, rows: DataFrame, fields: list[str], how: str) -> DataFrame:
    """The texts beside a list of their rows."""
    lists = rows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*fields)).alias("list"))
    right = lists.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "list").hint("merge")
    return texts.join(right, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), how).drop("_id", "_hash")


def cut_out(texts: DataFrame, places: DataFrame, least: int = LEAST) -> DataFrame:
    """The contexts at these places with their bytes. A text that repeated rows have gives them once."""
    fields = ["core", "hull", "at", "width", "offset", "n_hulls"]
    rows = with_lists(texts, places, fields, "inner").withColumn("c", F.explode("list"))
    data = F.substring(F.col("data"), F.col("c.at").cast("int") + 1, F.col("c.width") - 1 + least)
    return rows.select("doc_id", "text_hash", *(f"c.{f}" for f in fields), data.alias("data")).dropDuplicates(["core", "hull"])


def find_repeats(docs: DataFrame, keep_first: bool = True, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Runs of starts (doc_id, text_hash, at, width), in bytes, of strings of ``least`` bytes that stand at an earlier place too, or anywhere else unless ``keep_first``.

    Places go by doc_id (null first), hash of the text, byte. Rows equal in
    doc_id and text are one place for ``keep_first`` (they stay or go
    alike) and each other's repeats otherwise. Null texts are empty; texts under ``least`` bytes have no strings.
    """
    spark, texts = docs.sparkSession, keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found, found_at = materialise_at(text_contexts(texts, least, gram), "contexts")
    marks, old = [], [found_at]
    for block in (*BLOCKS, None):
        kept, kept_at = materialise_at(folded(found), "folded")
        for path in old:
            discard(spark, path)
        whole = kept.where("whole AND NOT first" if keep_first else "whole")
        marks.append(whole.select("doc_id", "text_hash", "at", "width"))
        if block is None:
            break
        places = kept.where(F.col("first") & (F.col("n_hulls") > 1))
        open_, open_at = materialise_at(places.select(*FIELDS, "n_hulls", "data") if "data" in kept.columns else cut_out(texts, places, least), "open")
        marks.append(materialise_at(repeated_starts(open_.where(F.col("n_hulls") <= MOST), keep_first, least), "repeats")[0])
        crowded = open_.where(F.col("n_hulls") > MOST)
        if not crowded.limit(1).count():
            discard(spark, open_at)
            break
        found, found_at = materialise_at(parted(crowded, block, least), "contexts")
        old = [open_at, found_at]
    out = spark.createDataFrame([], f"doc_id {kind}, text_hash long, at long, width int")
    for m in marks:
        out = out.unionByName(m)
    return out.distinct()


def _spans(list_: list[dict] | None, size: int, least: int) -> list[tuple[int, int]]:
    """Maximal removed stretches of a text, from its runs of starts."""
    out: list[tuple[int, int]] = []
    for at, width in sorted((x["at"], x["width"]) for x in list_ or []):
        end = min(size, at + width - 1 + least)
        if out and at <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((at, end))
    return out


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(data)]))


def removed(docs: DataFrame, keep_first: bool = True, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left) and kept, these bytes.

    See find_repeats() for what goes and for nulls and repeated rows. No rows give no rows; other columns are ignored.
    """
    rows = with_lists(keyed(docs), find_repeats(docs, keep_first, least), ["at", "width"], "left").select("doc_id", "data", "list")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in pieces(batches, 64):
            out = []
            for data, list_ in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                spans = _spans(list_, len(data), least)
                kept = _without(data, spans)
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
