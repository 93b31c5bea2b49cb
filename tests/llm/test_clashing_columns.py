"""Input columns that are named like those which the stages make for themselves come out as they were."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

OWN = ["size", "source_size", "target", "copies", "_lw_key", "_lw_class", "_lw_sub", "_lw_rank", "_lw_in_bin", "_lw_copy", "_s_n_words", "label", "_row_number_here"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n.split()[0] for n, _ in corpus_pipeline.STAGES])
def test_stage_leaves_columns_alone(spark, sample, stage):
    plain = sample.where("doc_id < 60")
    docs = plain.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in OWN})
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in OWN)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, plain, "/root/testdata/sf0.001").collect())
