import pytest

CLASHES = "score double, predicted int, size long, copies long, target double, source_size long, fp long, component_id long, kept boolean, n_words long, batch string, bucket long, rank int, held_out boolean, train boolean, row long, spans string, padding long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def make_docs(spark, rows):
    """rows: (doc_id, text, source); the other columns are there, null."""
    n = len(CLASHES.split(", "))
    return spark.createDataFrame([(i, t, None, s, len(t or ""), *[None] * n) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    same = "The same text stands here twice and has some words in it, more than twenty of them, so that it counts as a text at all, surely."
    return [
        (1, same, "a"), (1, same, "a"), (2, same, "b"), (3, None, None), (4, "", "a"), (None, "no id here", "b"), (None, None, None),
        (5, " \t\n ", "a"), (6, long_text, "a"), (7, "x", None), (8, "é ü     漢字 😀 \u0000", "ß"), (9, "!!!\n!!!\n!!!", ""),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return make_docs(spark, edge_rows).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
