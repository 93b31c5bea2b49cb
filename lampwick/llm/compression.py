"""Quality rules: compression bands, beside plain repetition rules."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pieces

#: By least bytes of the text: ratio of compressed to whole bytes, least and most. Short texts carry the frame's own bytes.
#: From 256 bytes the most lies between prose and base64, from 4 KB between prose and random words; below, prose and base64 overlap.
BANDS = ((0, 0.0, 99.0), (32, 0.35, 1.6), (64, 0.35, 1.45), (128, 0.33, 1.2), (256, 0.3, 0.82), (512, 0.28, 0.77), (1024, 0.25, 0.7), (4096, 0.22, 0.57), (16384, 0.2, 0.55))
#: The same for one whole chunk.
CHUNK, CHUNK_LEAST, CHUNK_MOST = 4096, 0.2, 0.65
#: A text is rejected when over this part of its chunks lies outside their band.
BAD_CHUNKS = 0.2
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("ratio", "double"), ("bad_chunks", "double"), ("reason", "string")]


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if n_bytes >= least)


def compression(data: bytes, level: int = 3) -> tuple[float | None, float]:
    """Ratio of the whole, and the part of the fixed chunks outside their band. A last chunk under half the size joins the one before."""
    if not data:
        return None, 0.0
    zip_ = zstandard.ZstdCompressor(level=level, write_content_size=False)
    whole = len(zip_.compress(data)) / len(data)
    ends = [*range(CHUNK, len(data) - CHUNK // 2 + 1, CHUNK), len(data)]
    if len(ends) < 2:
        return whole, 0.0
    ratios = [len(zip_.compress(data[a:b])) / (b - a) for a, b in zip([0, *ends], ends)]
    return whole, sum(not CHUNK_LEAST <= r <= CHUNK_MOST for r in ratios) / len(ratios)


def base_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a text."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    windows = Counter(zip(*(words[i:] for i in range(WINDOW)))) if n >= WINDOW else {}
    if len(windows) < n - WINDOW + 1:
        end = 0
        for i, w in enumerate(zip(*(words[i:] for i in range(WINDOW)))):
            if windows[w] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, n < 20 or 100 * repeated > 30 * n


def judge(text: str | None) -> tuple:
    base = base_rules(text)
    data = text.encode("utf-8", "surrogatepass") if text else b""
    ratio, bad = compression(data)
    low, high = band(len(data))
    if base[-1]:
        reason = "few words" if base[0] < 20 else "repeated words"
    elif ratio is not None and ratio < low:
        reason = "repetitive"
    elif ratio is not None and ratio > high:
        reason = "incompressible"
    elif bad > BAD_CHUNKS:
        reason = "chunks"
    else:
        reason = None
    return (*base, reason is None, ratio, bad, reason)


def compression_bands(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and FIELDS.

    ``kept`` is false where base_failed is; else it is whether the zstandard
    ratios of the whole text (by its length: BANDS) and of its fixed chunks lie
    within their limits. A null text is an empty one: no words, base_failed.
    Each row is judged by itself: repeated rows give repeated rows, and columns
    other than doc_id and text are ignored.
    """
    kinds = {"long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "string": T.StringType()}
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, kinds[k]) for n, k in FIELDS)])
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches):
        for part in pieces(batches):
            rows = [judge(t) for t in part.column(1).to_pylist()]
            cols = list(zip(*rows)) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, arrow[k]) for c, (_, k) in zip(cols, FIELDS))], names=["doc_id", *(n for n, _ in FIELDS)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
