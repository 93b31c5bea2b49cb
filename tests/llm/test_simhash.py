import random
from collections import Counter
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from lampwick.llm import simhash
from lampwick.llm.components import components


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprint_is_the_definition(edge_rows):
    for _, text, _ in edge_rows[:5] + edge_rows[8:]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_of_chains_stars_and_pairs(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups({x for p in links for x in p} - {300}, [p for p in links if p[0] != p[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_roots_against_all_pairs(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(25):  # walks of small steps, so that groups hang together at 1, 2 and 3 bits
        f = rng.getrandbits(64)
        for _ in range(8):
            fps.append(f)
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 3, 3, 4))):
                f ^= 1 << b
    fps = sorted({simhash._signed(f) for f in fps})
    near = [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = groups(fps, near)
    got = {r.fp: r.root for r in simhash.near_roots(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_near_components_on_a_table(spark, sample):
    docs = sample.where("doc_id < 120")
    rows = docs.collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = groups(fps, [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = simhash.near_components(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == fps


def test_edges(edge_docs, no_docs, edge_rows):
    got = simhash.near_components(edge_docs).collect()
    assert len(got) == len(edge_rows)
    of = {(r.doc_id, r.fp): r.component_id for r in got}
    assert of[2, [f for i, f in of if i == 2][0]] == 1
    assert all(c == 3 for (i, f), c in of.items() if f == 0)  # null, empty and blank texts, with or without an id
    assert simhash.near_components(no_docs).collect() == []


def plain_shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def similar_pairs(texts, least=0.8):
    """All pairs of places whose shingle sets have a Jaccard similarity of ``least`` or more, by shared shingles."""
    sets = [plain_shingles(t) for t in texts]
    holders = {}
    for i, own in enumerate(sets):
        for x in own:
            holders.setdefault(x, []).append(i)
    seen = Counter(p for held in holders.values() for p in combinations(held, 2))
    return {(a, b) for (a, b), n in seen.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)}


def edited(rng, words, share):
    return " ".join(rng.choice(words) + "x" if rng.random() < share else w for w in words)


def test_similar_texts_against_all_pairs(spark):
    """No link is made that isn't one, and nearly all there are."""
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    for share in (0.005, 0.01, 0.015, 0.02):
        texts += [edited(rng, (texts[i] or "x").split(), share) for i in rng.sample(range(1000), 60) if len((texts[i] or "").split()) > 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = similar_pairs(texts)
    want = groups(range(len(texts)), pairs)
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert set(want.values()) <= left  # the smallest of each group stays
    gone = len(texts) - len(set(want.values()))
    found = len(texts) - len(left)
    assert gone > 200 and found >= 0.95 * gone, (found, gone)
    found_of_different = sum(b not in left for a, b in pairs if texts[a] != texts[b])
    assert found_of_different >= 0.95 * sum(texts[a] != texts[b] for a, b in pairs)


def test_a_large_group_of_near_copies(spark):
    """Copies of one text, each with other edits: groups are those of all pairs, also where some are like few others only."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [edited(rng, words, rng.choice((0.005, 0.01, 0.02, 0.04))) for _ in range(400)]
    want = groups(range(len(texts)), similar_pairs(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert set(want.values()) <= left and len(left) <= len(set(want.values())) + 8


def test_no_similar_pair_is_left_out(spark):
    """Pairs at the very threshold, whose fingerprints differ in every word, and a group in which many are like few others only."""
    rng = random.Random(12)
    texts = []
    for n in (19, 24, 60, 150, 400) * 24:
        words = [f"w{rng.randrange(9000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for at in rng.sample(range(0, n // 5), round(n / 46)):
            words[at * 5] += "x"
        texts.append(" ".join(words[: n - rng.randrange(3)]))
    words = [f"v{rng.randrange(5000)}" for _ in range(150)]
    texts += [edited(rng, words, rng.choice((0.01, 0.02, 0.03, 0.04))) for _ in range(300)]
    pairs = similar_pairs(texts)
    want = groups(range(len(texts)), pairs)
    assert len(set(want.values())) < len(texts) - 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(want.values())


def test_dropping_keeps_one_row_of_each_group(edge_docs, no_docs):
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 3, None, 6, 7, 8, 9], key=str)
    assert simhash.drop_near_duplicates(no_docs).count() == 0


def test_a_hot_group_makes_no_pairs(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text that is there very often").alias("text"))
    got = simhash.near_components(rows)
    assert got.groupBy("component_id").count().collect()[0]["count"] == 3000
    assert [r.doc_id for r in simhash.drop_near_duplicates(rows).collect()] == [0]
