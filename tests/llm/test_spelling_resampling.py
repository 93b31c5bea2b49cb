import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from lampwick.llm import queries, resampling, spelling

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def plain_near(words):
    out, cut = set(), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cut[w[:i], w[i + 1 :]].add(w)
    whole = set(words)
    for (a, b), own in cut.items():
        out |= {(x, y) for x in own for y in own if x != y}
        if a + b in whole:
            out |= {(x, a + b) for x in own} | {(a + b, x) for x in own}
    return out


def plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            at = h % len(w)
            counts[w[:at] + w[at + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = defaultdict(set)
    for a, b in plain_near(n):
        near[a].add(b)
    forms = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None))
    return out


def test_trie_finds_all_near_words():
    rng = random.Random(1)
    parts = ["th", "er", "on", "an", "re", "ti", "ing", "es", "in", "at", "e", "a", "é", "ñ"]
    words = sorted({"".join(rng.choices(parts, k=rng.randint(3, 5))) for _ in range(4000)} | {"a" * 300, "a" * 301, "a" * 299 + "b"})
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    got = set()
    for size, own in by.items():
        trie = spelling.Trie(own)
        for asking in (size, size - 1):
            if by.get(asking):
                for i, j in zip(*trie.near(by[asking])):
                    got.add((by[asking][i], own[j]))
                    if asking < size:
                        got.add((own[j], by[asking][i]))
    assert got == plain_near(words)


@pytest.mark.parametrize("node_words", [1, 50_000])
def test_variants_of_texts(sample, node_words):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    found = spelling.variants(spelling.counted(spelling.noisy_words(sample)), node_words=node_words).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == plain_variants(rows)


def test_chains_of_forms_and_ties(spark):
    rows = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 5000), ("xbcdefg", 2), ("mnopqrs", 1), ("mnopqrst", 10), ("mnopqrsa", 10), ("lonewolf", 3)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame([*rows, (None, 5)], "word string, n long")).collect()}
    assert len(found) == len(rows)
    assert found["abcdefg"].root == "abcdefghij" and found["abcdefg"].form == "abcdefgh" and found["abcdefghij"].form is None
    assert (found["mnopqrs"].form, found["mnopqrs"].form_n) == ("mnopqrsa", 10)
    assert found["xbcdefg"].n_near == 1 and found["xbcdefg"].form is None
    assert (found["lonewolf"].root, found["lonewolf"].n_near) == ("lonewolf", 0)


def test_odd_rows_of_words(spark, edge_rows, edge_docs, no_docs):
    assert {tuple(r) for r in spelling.text_variants(edge_docs).collect()} == plain_variants([(i, t) for i, t, _ in edge_rows])
    assert spelling.text_variants(no_docs).count() == 0


def plain_ranks(docs, target, least_words=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w, w[1:]))]]

    rows = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in features(x)[1])
    ours, theirs = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * ours / ((s[b] + 1) * theirs))) for b in range(10000)]
    out = []
    for i, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[2] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(r, k) for k, r in enumerate(able[: 25 * len(able) // 100], 1)]
    return Counter((*r, k) for r, k in drawn) + Counter((*r, None) for r in out) - Counter((*r, None) for r, _ in drawn)


def test_resampling_against_plain_python(spark, sample, edge_rows, edge_docs, no_docs):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [r.text for r in target.collect()]
    assert Counter(tuple(r) for r in resampling.importance_ranks(sample, target).collect()) == plain_ranks([(r.doc_id, r.text) for r in sample.collect()], texts)
    assert Counter(tuple(r) for r in resampling.importance_ranks(edge_docs, target, least_words=3).collect()) == plain_ranks([(i, t) for i, t, _ in edge_rows], texts, 3)
    assert resampling.importance_ranks(no_docs, target).count() == 0 == resampling.resample(no_docs, target).count()
    assert resampling.importance_ranks(sample, no_docs).where("rank IS NOT NULL").count() == 48


def test_drawn_texts_keep_their_columns(spark, sample):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    drawn = resampling.resample(sample, target)
    ids = {r.doc_id for r in resampling.importance_ranks(sample, target).where("rank IS NOT NULL").collect()}
    assert drawn.columns == sample.columns and {r.doc_id for r in drawn.collect()} == ids and len(ids) == 48


def test_features_of_parts(monkeypatch):
    text = " ".join(f"Wörd{i % 7} x{i % 3}-Y" for i in range(200)).encode()
    whole = [(n, f) for n, f in resampling.features(text, runs=3)]
    monkeypatch.setattr(resampling, "PART", 50)
    parts = list(resampling.features(text, runs=3))
    assert len(parts) > 10 and sum(n for n, _ in parts) == whole[0][0]
    assert Counter(b for _, f in parts for b in f.tolist()) == Counter(whole[0][1].tolist())


@pytest.mark.parametrize("few", [1, 7])
def test_selection_finds_the_exact_cutoff(spark, few):
    rng = random.Random(few)
    rows = [(rng.choice([5, 5, 5, rng.randrange(40)]), rng.choice([None, 3, rng.randrange(300)]), i) for i in range(700)]
    keys = spark.createDataFrame(rows, "score long, doc_id long, tie long").repartition(5)
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for take in (1, 175, 350, 699, 700):
        found = resampling.cutoff(keys, take, few)
        assert (found["score"], found["doc_id"], found["tie"]) == order[take - 1]
    assert resampling.cutoff(keys, 0, few) is None and resampling.cutoff(keys, 701, few) is None


@pytest.mark.parametrize("name", ["op11_suffix_arrays", "op12_frequency_trie", "op13_importance_resampling"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*names).collect()
    assert Counter(map(tuple, rows)) == Counter(cursor.fetchall())
