from base64 import b64encode
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lampwick.llm import compression, suffix_tree
from lampwick.llm.common import crc_mod


def plain_base(text):
    words = (text or "").encode().split()
    n = len(words)
    seen = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    marked = set()
    for i in range(n - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            marked.update(range(i, i + 8))
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    chars = len(b"".join(words).decode())
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return n, chars, symbols, dup, len(marked), n < 20 or 100 * len(marked) > 30 * n


def test_base_rules(edge_rows, sample):
    for text in [r[1] for r in edge_rows] + [r.text for r in sample.limit(80).collect()] + ["a b c d e f g h " * 9, "x\nx \nx\n\n" * 20]:
        assert compression.base_rules(text) == plain_base(text)


def test_verdicts(sample, spark):
    rows = compression.compression_bands(sample).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    fine = [r.kept for r in rows if labels.get(r.doc_id) == 1 and r.n_words >= 20]
    assert all(fine)
    assert compression.judge("spam " * 3000)[6] is False
    noise = np.random.default_rng(0).integers(33, 0x3000, 3000)
    text = " ".join(chr(c) for c in noise if not 0xD800 <= c < 0xE000)
    assert compression.judge(text)[-1] == "incompressible" and not compression.judge(text)[5]
    mixed = sample.orderBy("n_chars", ascending=False).first().text[:4096] + "".join(f"{i % 3}{i % 7} " for i in range(12_000))
    assert compression.judge(mixed)[6] is False


def test_noise_is_rejected_and_prose_kept(sample):
    rng = np.random.default_rng(6)
    base64 = " ".join(b64encode(rng.bytes(int(n))).decode() for n in rng.integers(3, 10, 8000))
    words = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(n))) for n in rng.integers(3, 10, 8000))
    for n in (300, 500, 520, 1000, 1030, 4000, 4200, 16000, 16500, 40000):
        assert compression.judge(base64[:n])[-1] == "incompressible", n
    for n in (4200, 16000, 16500, 40000):
        assert compression.judge(words[:n])[-1] in ("incompressible", "chunks"), n
    rows = sample.collect()
    prose = max((r.text for r in rows), key=len)[:16384]
    assert compression.judge(prose)[-1] is None and compression.judge(prose + "\n" + base64[:8192])[-1] is not None
    clean = [r for r in rows if not compression.base_rules(r.text)[-1]]
    assert len({r.lang for r in clean}) == 4
    assert not [r.doc_id for r in clean if compression.judge(r.text)[-1] in ("incompressible", "chunks")]


def test_verdicts_against_plain_python(sample, edge_docs):
    """The query's verdict again: one-shot compression of the whole and of each chunk, and the bands looked up by hand."""
    zip_ = lambda b: len(zstandard.compress(b, 3)) - size_field(b)
    size_field = lambda b: len(zstandard.compress(b, 3)) - len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b))
    for docs in (sample, edge_docs):
        texts = {(r.doc_id, r.text): 1 for r in docs.select("doc_id", "text").collect()}
        kept = Counter((r.doc_id, r.kept, r.n_words) for r in compression.compression_bands(docs).collect())
        for i, t in texts:
            data = (t or "").encode()
            base = plain_base(t)
            fine = not base[-1]
            if fine:
                least, most = [(a, b) for n, a, b in compression.BANDS if len(data) >= n][-1]
                parts = [data[a : a + 4096] for a in range(0, len(data), 4096)]
                if len(parts) > 1 and len(parts[-1]) < 2048:
                    parts[-2:] = [parts[-2] + parts[-1]]
                bad = sum(not 0.2 <= zip_(p) / len(p) <= 0.65 for p in parts) if len(parts) > 1 else 0
                fine = least <= zip_(data) / len(data) <= most and bad <= compression.BAD_CHUNKS * len(parts)
            assert kept[i, fine, base[0]] >= 1, i


def test_chunks_cover_the_text():
    data = bytes(range(256)) * 70
    whole, bad = compression.compression(data)
    assert whole == len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(data)) / len(data)
    assert bad == 1.0  # each chunk repeats 256 bytes
    assert compression.compression(b"") == (None, 0.0)


def test_compression_edges(edge_docs, no_docs, edge_rows):
    rows = compression.compression_bands(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    assert all(r.base_failed and not r.kept for r in rows if not r.n_words)
    assert compression.compression_bands(no_docs).collect() == []


def plain_base_score(rows, train):
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for (_, t), own in zip(rows, train) if own for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return {i: (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


def test_base_score(spark, sample, monkeypatch):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    train = [r.t for r in sample.select((crc_mod("doc_id", 7) != 2).alias("t")).collect()]
    want = plain_base_score(rows, train)
    for share in (suffix_tree.HEAD_SHARE, 0.01):  # all words at the head, and most of them in the join
        monkeypatch.setattr(suffix_tree, "HEAD_SHARE", share)
        got = suffix_tree.score_held_out(sample).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
            assert r.base_score == pytest.approx(want[r.doc_id][3])


def plain_tree(texts, depth=None):
    """The tree in plain Python: the root's counts, and retained contexts (words, the oldest first) with their remembered counts, rest and total."""
    tokens = [[None, *(t or "").encode().lower().split(), b""] for t in texts]
    root = Counter(w for row in tokens for w in row[1:])
    kept, length, all_told, tells = {}, 0, 0.0, 0.0
    while length != depth and (depth or length < 2 or tells > suffix_tree.WORTH * all_told):
        length, tells, follow = length + 1, 0.0, {}
        for row in tokens:
            for i in range(length, len(row)):
                follow.setdefault(tuple(row[i - length : i]), Counter())[row[i]] += 1
        for context, seen in follow.items():
            total, own, gain = sum(seen.values()), {}, 0.0
            for w, n in seen.items():
                p = plain_probability(root, kept, context[1:], w)
                told = n * np.log((n - 1 + suffix_tree.PRIOR * p) / (total - 1 + suffix_tree.PRIOR) / p)
                if n >= suffix_tree.LEAST and told >= suffix_tree.REMEMBER:
                    own[w], gain = n, gain + told
            alone = total - sum(own.values())
            gain += alone * np.log((alone - 1 + suffix_tree.PRIOR) / (total - 1 + suffix_tree.PRIOR))
            if own and gain >= suffix_tree.DIVERGENCE:
                kept[context], tells = (own, alone + suffix_tree.PRIOR, total), tells + gain
        all_told += tells
    return root, kept


def plain_probability(root, kept, context, word):
    while context and context not in kept:
        context = context[1:]
    if not context:
        return (root[word] + 1) / (sum(root.values()) + len(root) + 1)
    own, rest, total = kept[context]
    return (own.get(word, 0) + rest * plain_probability(root, kept, context[1:], word)) / (total + suffix_tree.PRIOR)


def plain_score(root, kept, text):
    row = [None, *(text or "").encode().lower().split(), b""]
    deepest = max(map(len, kept), default=0)
    return sum(log10(plain_probability(root, kept, tuple(row[max(0, i - deepest) : i]), row[i])) for i in range(1, len(row)))


def test_tree_and_scores_against_plain_python(spark, sample, monkeypatch):
    rng = np.random.default_rng(3)
    song = "a b c d e f the bird sings on and on all night long".split()
    made = [" ".join(song[: int(n)]) + " " + " ".join(rng.choice(["the", "of", "x", "y", "zoo"], int(n))) for n in rng.integers(1, 14, 60)] + ["red q r win", "blue q r lose", "a y r mid", "b x r mid"] * 15 + [f"{a} w x y {b}" for a, b in (("no", "way"), ("on", "top"), ("up", "hill"))] * 12
    rows = [*[(i, t, "a") for i, t in enumerate(made)], (900, None, None), (901, "", None), (902, made[5], None), *[(1000 + r.doc_id, r.text, "b") for r in sample.limit(60).collect()]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    train = F.col("doc_id") % 3 != 0
    texts = [t for i, t, _ in rows if i % 3]
    cases = (None, suffix_tree.HEAD_SHARE, 21, 8 << 20, suffix_tree.WORTH), (None, 0.01, 21, 2000, 1e-9), (2, 2.0, 6, 1, suffix_tree.WORTH), (4, 0.01, 21, 2000, suffix_tree.WORTH)
    lengths = []
    for depth, share, bits, part, worth in cases:  # the head holds all, some or nothing; filters tell much or nothing
        monkeypatch.setattr(suffix_tree, "HEAD_SHARE", share)
        monkeypatch.setattr(suffix_tree, "FILTER_BITS", bits)
        monkeypatch.setattr(suffix_tree, "PART_BYTES", part)
        monkeypatch.setattr(suffix_tree, "WORTH", worth)
        root, kept = plain_tree(texts, depth)
        lengths.append(max(map(len, kept)))
        got = {r.doc_id: r for r in suffix_tree.score(docs, train, depth).collect()}
        assert len(got) == len(rows)
        for i, text, _ in rows:
            assert got[i].score == pytest.approx(plain_score(root, kept, text)), (i, depth)
    assert max(lengths) >= 3


def test_every_state_is_a_distribution():
    texts = ["the cat and the dog"] * 9 + ["a cat sat"] * 5 + ["the dog sat"]
    root, kept = plain_tree(texts, 2)
    assert kept
    for context in [*kept, (), (b"zzz", b"cat")]:
        assert sum(plain_probability(root, kept, context, w) for w in [*root, b"unknown"]) == pytest.approx(1.0)


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = suffix_tree.score_held_out(docs).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_copies_score_apart(spark):
    """A text that the training side holds twice is likelier than one of the same words that it doesn't hold."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(80)]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(100, texts[0], True), (101, texts[0], False), (102, " ".join(reversed(texts[0].split())), False)]
    got = {r.doc_id: r for r in suffix_tree.score(spark.createDataFrame(rows, "doc_id long, text string, own boolean"), F.col("own")).collect()}
    assert got[101].base_score == pytest.approx(got[102].base_score)
    assert got[101].score > got[102].score + 60


def test_suffix_edges(edge_docs, no_docs, edge_rows):
    rows = suffix_tree.score_held_out(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5))
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert suffix_tree.score_held_out(no_docs).collect() == []
    untrained = suffix_tree.score(edge_docs, crc_mod("doc_id", 7) < 0).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in untrained)


def test_hot_words_buckets_and_folds_change_no_score(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["the", "of", "a", *(f"w{i}" for i in range(30))]
    texts = [" ".join(rng.choice(words, int(n), p=[0.3, 0.1, 0.1, *[0.5 / 30] * 30])) for n in rng.integers(0, 40, 60)] + ["the w1 the w2 the w3 of"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root, kept = plain_tree(texts, 3)
    for hot, size, fold in ((2.0, 64, 10), (0.05, 200, 50)):  # nothing is hot, and a few words; many buckets and folds
        for name, value in (("HOT_SHARE", hot), ("BUCKET_BYTES", size), ("FOLD", fold), ("PART_BYTES", 100), ("HEAD_SHARE", 0.02)):
            monkeypatch.setattr(suffix_tree, name, value)
        for r in suffix_tree.score(docs, F.lit(True), 3).collect():
            assert r.score == pytest.approx(plain_score(root, kept, texts[r.doc_id])), (hot, r.doc_id)


def test_what_is_counted_travels_in_blocks(spark, sample, monkeypatch):
    """A table has rows for blocks and documents, not for each window: these took more disk and time than the check allows."""
    rows, bare = [], suffix_tree.materialise_at

    def counted(df, tag):
        out = bare(df, tag)
        rows.append((tag, out[0].count()))
        return out

    monkeypatch.setattr(suffix_tree, "materialise_at", counted)
    n = suffix_tree.score_held_out(sample).count()
    assert max(k for _, k in rows) <= n + 200, rows


def test_windows_that_agree_in_both_halves_are_told_apart():
    low = np.array([7 << 40] * 6, dtype=np.uint64)
    key = np.array([1 << 32 | x for x in (5, 9, 5, 5, 9, 2)], dtype=np.uint64)
    got = suffix_tree._folded(key, low, key + np.uint64(1), low, np.ones(6, dtype=np.int64))
    assert dict(zip(got[0].tolist(), got[4].tolist())) == {1 << 32 | 5: 3, 1 << 32 | 9: 2, 1 << 32 | 2: 1}


def test_tokens_are_words_with_an_end():
    texts = ["", None, "A b  a\tB", " ".join("x" * n for n in (7, 8, 9, 64, 65, 66)) + " " + "X" * 65, "é É \x00 \x00\x00 a\xa0b\n", "   ", "12345678 123456789 12345678"]
    tokens, sizes = suffix_tree.tokens_of(pa.array(["z", *texts])[1:])
    words = [[*(t or "").encode().lower().split(), b""] for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    pairs = set(zip((w for row in words for w in row), tokens.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({t for _, t in pairs})


def test_what_is_asked_at_once_is_bounded(spark, sample, monkeypatch):
    """Filters that tell nothing, as on large corpora, let all keys be asked for: seven a token. One part of the documents asks
    after the other."""
    docs = sample.limit(120).unionByName(sample.limit(5)).select("doc_id", "text").localCheckpoint()
    want = {r.doc_id: r for r in suffix_tree.score_held_out(docs).collect()}
    asked, dealt = [], suffix_tree.Buckets.dealt

    def counted(self, blocks, run, schema=suffix_tree.BLOCK):
        blocks = blocks.localCheckpoint()
        asked.append(blocks.where(F.col("kind") == suffix_tree.ASKED).agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("low")), F.lit(0))).first()[0])
        return dealt(self, blocks, run, schema)

    monkeypatch.setattr(suffix_tree.Buckets, "dealt", counted)
    for name, value in (("FILTER_BITS", 6), ("HEAD_SHARE", 2.0), ("ROUND_BYTES", 1)):
        monkeypatch.setattr(suffix_tree, name, value, raising=False)
    got = suffix_tree.score_held_out(docs).collect()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert sum(asked) > 4 * size
    assert max(asked) < 2 * size
    assert len(got) == 125
    for r in got:
        assert (r.n_known, r.n_tokens) == (want[r.doc_id].n_known, want[r.doc_id].n_tokens)
        assert r.score == pytest.approx(want[r.doc_id].score) and r.base_score == pytest.approx(want[r.doc_id].base_score)


def test_blocks_are_as_many_as_the_text_asks_for(spark, sample):
    """Not as many as Spark has partitions, of which little text has too many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        assert suffix_tree.Model(sample.limit(20), F.lit(True), 1).buckets.n == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
