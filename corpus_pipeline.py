"""From raw documents to packed batches: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lampwick.llm import mixing, packing, pii_crf, rule_ensemble, simhash
from lampwick.llm.common import materialise, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go. It is fitted on the labelled ones of docs.

    Null texts are judged as empty ones, repeated rows each by itself; a null
    doc_id has no label. Without labels, or with no rows, nothing is rejected.
    """
    return rule_ensemble.kept_by_quality(docs, read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five-word shingles, 0.8) stays, that with the smallest doc_id.

    Null, empty and blank texts are one group; a null doc_id comes last; of
    repeated rows one stays. No rows give no rows.
    """
    return simhash.drop_near_duplicates(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text.

    Null texts stay null, repeated rows and rows without an id stay; no rows give no rows.
    """
    return pii_crf.with_length(pii_crf.redact(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it: not at all, once or twice.

    Null texts have no words; a null source is a source, the last one; repeated
    rows are documents of their own. No rows give no rows.
    """
    return mixing.mix(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their bucket and batch. Null texts have no words; repeated rows are documents of their own; no rows give no rows."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", pii_redaction),
    ("mixing sources to target weights", source_mixing),
    ("packing", length_packing),
]

#: No SQL says what a fitted ensemble, a SimHash or a random field decides; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
