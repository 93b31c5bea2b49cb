"""The queries opN_<name> and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, cross_polytope, license_scan, mixing, packing, pii_crf, resampling, rule_ensemble, simhash, spelling, suffix_dedup, suffix_tree, tool_calls
from .common import crc_mod, read
from .license_sql import OP1_SQL
from .text_sql import OP11_SQL, OP12_SQL, OP13_SQL
from .tool_sql import OP2_SQL


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tool_calls.events_of(read(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(events, spark.createDataFrame(tool_calls.TOOLS, "tool string, arg string, type string, required boolean"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(read(spark, sf_dir, "documents"))


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_bands(read(spark, sf_dir, "documents"))


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_held_out(read(spark, sf_dir, "documents"))


def op7_systematic_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "bucket", "batch", "padding", "n_slots")


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(read(spark, sf_dir, "documents"), keep_first=False).drop("kept")


def op12_frequency_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.text_variants(read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.importance_ranks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_SIZES = r"""
    SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey
    FROM documents
"""
OP7_SQL = rf"""
WITH sized AS ({_SIZES}),
binned AS (
    SELECT *, CASE WHEN size = 0 THEN 1 ELSE length(bin(size)) END AS class,
           ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % (SELECT greatest(1, floor(sqrt(count(*) // 16)))::BIGINT FROM documents) AS sub
    FROM sized
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY class, sub, size, doc_id) AS rank FROM binned),
sizes AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighed AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sizes),
roomy AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS room FROM weighed
),
levels AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM roomy WINDOW before AS (ORDER BY room, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
targets AS (
    SELECT skey, source_size, least(cap, coalesce((SELECT arg_min(level, (room, skey)) FROM levels WHERE level <= room) * weight, cap)) AS target,
           (('0x' || substr(md5(skey || '|0'), 1, 8))::BIGINT % 1024 * 2 + 1)::DOUBLE / 2048 AS start
    FROM levels
),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target,
       (size * (floor(start + rate * rank) - floor(start + rate * (rank - 1))))::BIGINT AS taken
FROM ranked JOIN rated USING (skey)
"""

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_tool_calls, op3_rule_ensemble, op4_pii_crf, op5_compression_bands, op6_suffix_tree, op7_systematic_sampling, op8_length_buckets, op9_cross_polytope, op10_simhash_balls, op11_suffix_arrays, op12_frequency_trie, op13_importance_resampling)}
ORACLE_SQL = {"op1_license_scan": OP1_SQL, "op2_tool_calls": OP2_SQL, "op7_systematic_sampling": OP7_SQL, "op11_suffix_arrays": OP11_SQL, "op12_frequency_trie": OP12_SQL, "op13_importance_resampling": OP13_SQL}
