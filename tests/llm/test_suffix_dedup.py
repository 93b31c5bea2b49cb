import hashlib
from collections import Counter

import numpy as np
import pytest

from lampwick.llm import queries, suffix_dedup


def plain(rows, keep_first, least=200):
    """rows: (doc_id, text) in the order of places. Every string of the length at every place, one by one."""
    data = [(t or "").encode() for _, t in rows]
    places: dict[bytes, list] = {}
    for r, b in enumerate(data):
        for s in range(len(b) - least + 1):
            places.setdefault(b[s : s + least], []).append((r, s))
    gone = [bytearray(len(b)) for b in data]
    for own in places.values():
        first = rows[own[0][0]], own[0][1]
        for r, s in own:
            if len(own) > 1 and not (keep_first and (rows[r], s) == first):
                gone[r][s : s + least] = b"\1" * least
    out = Counter()
    for (i, _), b, g in zip(rows, data, gone):
        kept = bytes(x for x, y in zip(b, g) if not y)
        out[i, len(b), len(b) - len(kept), len([x for x in bytes(g).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(docs, keep_first):
    return Counter(tuple(r) for r in suffix_dedup.removed(docs, keep_first).drop("kept").collect())


@pytest.mark.parametrize("keep_first", [True, False])
def test_against_all_strings(sample, keep_first):
    rows = sorted((r.doc_id, r.text) for r in sample.collect())
    assert found(sample, keep_first) == plain(rows, keep_first)


@pytest.mark.parametrize("keep_first", [True, False])
def test_odd_rows(edge_rows, edge_docs, keep_first):
    rows = sorted(((i, t) for i, t, _ in edge_rows if t is None or len(t) < 10_000), key=lambda r: (r[0] is not None, r[0] or 0))
    assert found(edge_docs.where("text IS NULL OR length(text) < 10000"), keep_first) == plain(rows, keep_first)
    long = suffix_dedup.removed(edge_docs, keep_first).where("doc_id = 6").first()
    assert long.n_removed == long.n_bytes - len(long.kept) > 0


@pytest.mark.parametrize("most", [0, 1, 3])
def test_crowded_anchors_are_parted(spark, monkeypatch, most):
    """A line that many texts share, each with its own surroundings, and runs of one letter."""
    rng = np.random.default_rng(most)
    word = lambda n: "".join(rng.choice(list("abcdef "), n))
    line, short = word(230), word(150)
    rows = [(i, word(int(rng.integers(0, 300))) + (line if i % 3 else short) + word(int(rng.integers(0, 300)))) for i in range(60)]
    rows += [(100, "z" * 450), (101, "zy" * 120), (102, "z" * 199), (103, "z" * 200 + line[:210]), (104, "漢" * 70), (105, "x" + "漢" * 67)]
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for keep_first in (True, False):
        assert found(docs, keep_first) == plain(rows, keep_first)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    monkeypatch.setattr(suffix_dedup, "ARRAY", 400)
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("ab"), 1500))
    rows = [(1, text), (2, text[200:900] + "c" + text[300:800]), (3, "ab" * 500)]
    docs = [(suffix_dedup.keyed(spark.createDataFrame(rows, "doc_id long, text string")))]
    parts = suffix_dedup.text_contexts(docs[0])
    starts = Counter()
    for r in parts.collect():
        starts.update((r.doc_id, s) for s in range(r.at, r.at + r.width))
    assert starts == Counter((i, s) for i, t in rows for s in range(len(t) - 199))
    assert found(docs[0].selectExpr("doc_id", "CAST(data AS string) AS text"), False) == plain(rows, False)


def test_longest_previous_factors():
    rng = np.random.default_rng(2)
    data = bytes(rng.choice([97, 98], 260, p=[0.8, 0.2])) * 2 + b"a" * 60
    least = 24
    starts = np.arange(len(data) - least + 1)
    earlier, later = suffix_dedup.factors(data, starts, least)
    place: dict[bytes, list[int]] = {}
    for s in starts.tolist():
        place.setdefault(data[s : s + least], []).append(s)
    assert (earlier >= least).tolist() == [place[data[s : s + least]][0] < s for s in starts.tolist()]
    assert (later >= least).tolist() == [place[data[s : s + least]][-1] > s for s in starts.tolist()]
    order, shared = suffix_dedup.suffix_order(np.frombuffer(data, dtype=np.uint8), starts, least)
    assert order.tolist() == sorted(starts.tolist(), key=lambda s: (data[s : s + least], s))
    common = lambda a, b: next((i for i in range(least) if data[a + i] != data[b + i]), least)
    assert shared[1:].tolist() == [common(a, b) for a, b in zip(order.tolist(), order[1:].tolist())]


def test_no_rows_and_registry(no_docs):
    assert suffix_dedup.removed(no_docs).count() == 0
    assert "op11_suffix_arrays" in queries.QUERIES
