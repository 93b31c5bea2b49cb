"""Personal data: plain patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail and IP addresses, cards and phones as they are usually
written. The field finds those in other writings ("anna dot berg at mail dot
org", "10[.]0[.]12[.]7", "(678) 555-5272"). It is trained from the small table
in pii_labels.py and decoded by Viterbi over padded numpy batches.

Only words near a telling one (with a digit, an at sign or a spelled dot) can be
labelled: elsewhere the label is O by definition of the model, and so a chain
falls into independent pieces there, and the pieces alone are decoded. That also
bounds what it can find: personal data in words alone ("four one one one") is
not looked for.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces
from .pii_labels import LABELLED

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
NEAR = 4
WORD = re.compile(r"[^ \t-\r]+")
#: A telling word, and what each one holds somewhere (in lower case).
TELLING = re.compile(r"[^0-9@]*[0-9@].*|[(\[]?(?:dot|punkt|punto|point)[)\]]?|.*[\[(](?:at|dot)[\])].*", re.I | re.S)
SIGNS = ("@", "dot", "punkt", "punto", "point", "(at)", "[at]")
HINT = re.compile(r"[0-9@]|dot|punkt|punto|point|[\[(]at[\])]", re.I)
DIGIT = re.compile("[0-9]")
CUES = frozenset("at dot punkt punto point com org net de es edu uk co mail email e-mail address phone tel tel. fax mobile call ring number ip host server traffic card visa no. version row id order token isbn pages section sections licensed license under to from".split())

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def ip_ok(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) < 4 and int(p or 0) < 256 for p in parts)


def card_ok(text: str) -> bool:
    d = digits_of(text)
    return 12 <= len(d) <= 19 and luhn(d)


def phone_ok(text: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in text) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern finds them, leftmost and without overlaps, from one at sign to the next: linear in the text."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    return out


def base_spans(text: str) -> list[Span]:
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if ip_ok(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if card_ok(m[0])]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if phone_ok(m[0])]
    return sorted(found)


def shape(word: str, runs: bool) -> str:
    s = re.sub(r"[^\W\d_]+", "a", word)
    return re.sub(r"[0-9]+", (lambda m: f"9{min(len(m[0]), 20)}") if runs else "9", s)[:24]


def own_features(word: str) -> tuple[str, ...]:
    low = word.lower()
    n = len(digits_of(word))
    size = next(b for b in (0, 2, 3, 4, 8, 11, 15, 16, 19, 10**9) if n <= b)
    out = [f"s={shape(word, False)}", f"r={shape(word, True)}", f"n={size}", f"k={low.strip('.,;:!?') in CUES and low.strip('.,;:!?')}"]
    out += [f"has={c}" for c in "@+()[]./-_" if c in word]
    if re.search(r"\d[A-Fa-f]|[A-Fa-f]\d", word):
        out.append("hex")
    return tuple(out)


STEPS = (-2, -1, 1, 2)


def features(words: list[str]) -> list[list[str]]:
    own = [own_features(w) for w in words]
    out = []
    for i, f in enumerate(own):
        row = ["one", *f]
        for step in STEPS:
            j = i + step
            other = own[j] if 0 <= j < len(own) else ("edge",)
            row += [f"{step}:{x}" for x in other[:4]]
        out.append(row)
    return out


class Field:
    """Weights of features by label, and of transitions; a chain begins and ends next to O."""

    #: Words of the padded chains that are decoded at once, and words whose weights a task remembers.
    CELLS, KNOWN = 1 << 16, 50_000

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self.known: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.index, self.emit, self.move

    def __setstate__(self, state):
        self.__init__(*state)

    def _sum(self, names) -> np.ndarray:
        found = [k for k in map(self.index.get, names) if k is not None]
        return self.emit[found].sum(axis=0)

    def weights(self, word: str) -> np.ndarray:
        """What a word adds to the labels of itself and of its neighbours at -2, -1, 1 and 2 from it: a feature belongs to one word."""
        held = self.known.get(word)
        if held is None:
            own = own_features(word)
            held = np.array([self._sum(("one", *own)), *(self._sum(f"{step}:{x}" for x in own[:4]) for step in STEPS)])
            if len(word) <= 64 and len(self.known) < self.KNOWN:
                self.known[word] = held
        return held

    def scores(self, words: list[str]) -> np.ndarray:
        return self._scores([words])

    def _scores(self, chains: list[list[str]]) -> np.ndarray:
        """The labels' scores of all words of the chains, one after the other."""
        lengths = np.array(list(map(len, chains)))
        number: dict[str, int] = {}
        n = int(lengths.sum())
        at = np.fromiter((number.setdefault(w, len(number)) for c in chains for w in c), dtype=np.int64, count=n)
        own = np.array([self.weights(w) for w in number])
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        after = np.repeat(lengths, lengths) - 1 - place
        out = own[at, 0]
        for k, step in enumerate(STEPS, 1):
            inside = np.nonzero(place >= -step if step < 0 else after >= step)[0]
            edge = self._sum([f"{step}:edge"])
            out += edge
            out[inside] += own[at[inside + step], k] - edge
        return out

    def decode(self, chains: list[list[str]]) -> list[list[int]]:
        """Viterbi over batches of chains of like length, each padded to its longest, CELLS words in all or one chain."""
        out: list[list[int]] = [[] for _ in chains]
        order = sorted((i for i in range(len(chains)) if chains[i]), key=lambda i: len(chains[i]), reverse=True)
        while order:
            longest = len(chains[order[0]])
            now, order = order[: max(1, self.CELLS // longest)], order[max(1, self.CELLS // longest) :]
            for i, labels in zip(now, self._batch([chains[i] for i in now], longest)):
                out[i] = labels
        return out

    def _batch(self, chains: list[list[str]], longest: int) -> list[list[int]]:
        """Padding repeats the last state."""
        n, size = len(chains), len(LABELS)
        lengths = np.array(list(map(len, chains)))
        score = np.zeros((longest, n, size))
        row = np.repeat(np.arange(n), lengths)
        score[np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = self._scores(chains)
        best = self.move[0] + score[0]
        back = np.empty((longest, n, size), dtype=np.int8)
        stay = np.arange(size, dtype=np.int8)
        for t in range(1, longest):
            ways = best[:, :, None] + self.move[None]
            live = (lengths > t)[:, None]
            back[t] = np.where(live, ways.argmax(axis=1), stay)
            best = np.where(live, ways.max(axis=1) + score[t], best)
        state = (best + self.move[:, 0]).argmax(axis=1)
        out = np.zeros((n, longest), dtype=np.int8)
        rows = np.arange(n)
        for t in range(longest - 1, 0, -1):
            out[:, t] = state
            state = back[t, rows, state]
        out[:, 0] = state
        return [row[:k].tolist() for row, k in zip(out, lengths)]


def parse_row(row: str) -> tuple[list[str], list[int]]:
    words, labels = [], []
    for piece in re.split(r"(\{[a-z]+:[^}]*\})", row):
        m = re.fullmatch(r"\{([a-z]+):([^}]*)\}", piece)
        for i, w in enumerate(WORD.findall(m[2] if m else piece)):
            words.append(w)
            labels.append(LABELS.index(f"{'I' if i else 'B'}-{m[1]}") if m else 0)
    return words, labels


def varied(row: str, rng: np.random.Generator) -> str:
    """Other digits, the same number of them: shapes carry the labels."""
    return "".join(str(rng.integers(0, 10)) if c.isdigit() else c for c in row)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(rows: tuple[str, ...] = LABELLED, copies: int = 2, epochs: int = 25, rate: float = 0.15, shrink: float = 2e-3, seed: int = 5) -> Field:
    """Maximises the conditional likelihood of the rows' labels by AdaGrad; the same rows give the same field."""
    rng = np.random.default_rng(seed)
    table = [parse_row(r if not k else varied(r, rng)) for r in rows for k in range(copies)]
    index: dict[str, int] = {}
    ready = []
    for words, labels in table:
        ready.append(([[index.setdefault(x, len(index)) for x in row] for row in features(words)], np.array(labels)))
    size = len(LABELS)
    emit, move = np.zeros((len(index), size)), np.zeros((size, size))
    forbidden = np.zeros((size, size))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        forbidden[[i for i in range(size) if i not in (inside - 1, inside)], inside] = -30.0
    past_e, past_m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    for _ in range(epochs):
        for i in rng.permutation(len(ready)):
            rows_f, gold = ready[i]
            n = len(gold)
            score = np.array([emit[f].sum(axis=0) for f in rows_f])
            way = move + forbidden
            ahead, behind = np.empty((n, size)), np.empty((n, size))
            ahead[0] = way[0] + score[0]
            for t in range(1, n):
                ahead[t] = log_sum(ahead[t - 1][:, None] + way, 0) + score[t]
            behind[-1] = way[:, 0]
            for t in range(n - 2, -1, -1):
                behind[t] = log_sum(way + (score[t + 1] + behind[t + 1])[None], 1)
            total = log_sum(ahead[-1] + behind[-1], 0)
            node = np.exp(ahead + behind - total)
            node[np.arange(n), gold] -= 1.0
            edge = np.exp(ahead[:-1, :, None] + way[None] + (score[1:] + behind[1:])[:, None, :] - total).sum(axis=0) if n > 1 else np.zeros_like(move)
            if n > 1:
                np.add.at(edge, (gold[:-1], gold[1:]), -1.0)
            start = np.exp(way[0] + score[0] + behind[0] - total)
            start[gold[0]] -= 1.0
            edge[0] += start
            end = np.exp(ahead[-1] + way[:, 0] - total)
            end[gold[-1]] -= 1.0
            edge[:, 0] += end
            for f, g in zip(rows_f, node):
                d = g + shrink * emit[f]
                past_e[f] += d * d
                emit[f] -= rate * d / np.sqrt(past_e[f])
            d = edge + shrink * move
            past_m += d * d
            move -= rate * d / np.sqrt(past_m)
    return Field(index, emit, move + forbidden)


def chains_of(text: str) -> list[list[tuple[str, int, int]]]:
    """Pieces of lines in which a label is possible: up to NEAR words on each side of telling words; (word, start, end).

    Every word and every line end is looked at a bounded number of times, so this is linear in the text.
    """
    out: list[list[tuple[str, int, int]]] = []
    if not DIGIT.search(text):
        low = text.lower()
        if not any(sign in low for sign in SIGNS):
            return out
    done = tried = line = 0  # ends of the last chain, of the last word tried, and of the line that this one is in
    for hint in HINT.finditer(text):
        if hint.start() < tried:
            continue
        # a hint begins a word or stands behind the last one tried, so no part of a word is read twice
        a = hint.start()
        while a > tried and text[a - 1] not in SPACE:
            a -= 1
        m = WORD.match(text, a)
        tried = m.end()
        if not TELLING.fullmatch(m[0]):
            continue
        if a >= line:
            line = text.find("\n", tried)
            line = len(text) if line < 0 else line
        chain, last = [*words_before(text, done, a), (m[0], a, tried)], 0
        while last < NEAR:
            w = WORD.search(text, tried, line)
            if not w:
                break
            chain.append((w[0], w.start(), w.end()))
            last = 0 if TELLING.fullmatch(w[0]) else last + 1
            tried = w.end()
        done = tried
        out.append(chain)
    return out


SPACE = " \t\n\x0b\x0c\r"


def words_before(text: str, low: int, end: int) -> list[tuple[str, int, int]]:
    """Up to NEAR words of the line before ``end``, none of them before ``low``."""
    found: list[tuple[str, int, int]] = []
    pos = end
    while len(found) < NEAR and pos > low:
        b = pos
        while b > low and text[b - 1] in SPACE and text[b - 1] != "\n":
            b -= 1
        a = b
        while a > low and text[a - 1] not in SPACE:
            a -= 1
        if a == b:
            break
        found.append((text[a:b], a, b))
        pos = a
    return found[::-1]


BLANKS = re.compile(r"[ \t\r\x0b\x0c]+")
UNSPELL = [(re.compile(p, re.I), r) for p, r in ((r" ?[\[(] ?at ?[\])] ?| at ", "@"), (r" ?[\[(] ?(?:dot|\.) ?[\])] ?| (?:dot|punkt|punto|point) | \. ", "."))]
EDGE = " \t\r\x0b\x0c.,;:!?\"'“”«»<>{}|*#$%&"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def sound(kind: str, text: str) -> bool:
    """Whether what the field has labelled can be that kind once spelled plainly."""
    plain = BLANKS.sub(" ", text)  # so that no pattern meets a run of blanks
    for pattern, to in UNSPELL:
        plain = pattern.sub(to, plain)
    if kind == "email":
        return bool(EMAIL.fullmatch(plain))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain)) and ip_ok(plain)
    if re.search(r"[^\W\d_]", text):
        return False
    return card_ok(text) if kind == "card" else phone_ok(text) and bool(re.fullmatch(r"[ ().0-9/-]+", text))


def added_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """For each text the sound spans that the field labels."""
    out: list[list[Span]] = []
    chains, owner = [], []
    for i, text in enumerate(texts):
        for chain in chains_of(text):
            chains.append(chain)
            owner.append(i)
        out.append([])
    for chain, labels, i in zip(chains, field.decode([[w for w, _, _ in c] for c in chains]), owner):
        out[i] += labelled_spans(texts[i], chain, labels)
    return out


def labelled_spans(text: str, chain: list[tuple[str, int, int]], labels: list[int]) -> list[Span]:
    found, i = [], 0
    while i < len(labels):
        if not labels[i]:
            i += 1
            continue
        kind, j = (labels[i] - 1) // 2, i + 1
        while j < len(labels) and labels[j] == 2 + 2 * kind:
            j += 1
        a, b = chain[i][1], chain[j - 1][2]
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        if b > a and sound(KINDS[kind], text[a:b]):
            found.append((a, kind, b))
        i = j
    return found


def apart(more: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``more`` that meet none of ``base``; both by start."""
    if not more or not base:
        return more
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))
    return [s for s in more if not (k := bisect_left(starts, s[2])) or reach[k - 1] <= s[0]]


def spans_of(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and the field's that meet none of them, for each text."""
    out = []
    for text, more in zip(texts, added_spans(texts, field)):
        base = base_spans(text)
        out.append((base, apart(more, base)))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """Each span as [KIND]; of overlapping ones the first gives the name and all of them go."""
    out, pos = [], 0
    for a, k, b in sorted(spans):
        if a >= pos:
            out += [text[pos:a], f"[{KINDS[k].upper()}]"]
        pos = max(pos, b)
    return "".join([*out, text[pos:]])


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_<kind> and base_sha256 of the base spans, spans (all), n_added.

    Offsets are code points. Null texts count as empty. Every row is searched by
    itself, so repeated rows give repeated rows; other columns are ignored; no
    rows give no rows. Time and memory are linear in the length of a text.
    """
    field = field or train()
    counts = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    schema = T.StructType([docs.schema["doc_id"], *counts, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])

    def run(batches):
        for part in pieces(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            rows = []
            for base, more in spans_of(texts, field):
                n = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with every span of its text replaced by its kind; null texts stay null, other columns stay."""
    field = field or train()
    place = docs.columns.index("text")

    def run(batches):
        for part in pieces(batches):
            texts = part.column(place).to_pylist()
            found = spans_of([t or "" for t in texts], field)
            new = [t if not t or not (base or more) else redacted(t, base + more) for t, (base, more) in zip(texts, found)]
            yield part.set_column(place, part.schema.field(place), pa.array(new, part.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where docs has it, as the length of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs
