"""Configuration: rule files and key-value texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RULE_FILE

THRESHOLD = 0.8


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """One row per link and page type from nested rule files; fields that aren't known are ignored, defaults are filled in."""
    files = spark.read.schema(RULE_FILE).option("multiLine", True).json(path)
    df = files.select("link_name", F.posexplode("pages").alias("rule_pos", "p"))
    c, d = "p.classify", "p.dedup"
    empty = F.array().cast("array<string>")
    return df.select(
        "link_name", "rule_pos", "p.page_type", *(F.coalesce(F.col(f"{c}.{n}"), empty).alias(n) for n in ("keywords", "exclude", "verify_regexes")),
        F.coalesce(f"{c}.min_matches", F.lit(1)).alias("min_matches"), F.coalesce(f"{c}.threshold", F.lit(THRESHOLD)).alias("threshold"), F.coalesce(f"{c}.case_sensitive", F.lit(False)).alias("case_sensitive"),
        F.col(f"{d}.strategy_class").alias("dedup_strategy"), F.col(f"{d}.rule").alias("dedup_rule"), F.col(f"{d}.id.mach").alias("id_patterns"), F.col(f"{d}.id.strategy_class").alias("id_strategy"),
        F.try_element_at(f"{d}.param", F.lit("window_size")).alias("_a"), F.try_element_at(f"{d}.params", F.lit("window_size")).alias("_b"),
    ).withColumn("window_size", F.coalesce("_a", "_b")).drop("_a", "_b")


def read_config_table(texts: DataFrame) -> DataFrame:
    """(namespace, key, value) from (namespace, content): a JSON object, else ``k=v`` lines, else ``k: v`` lines.

    Blank lines and those after # are skipped, quotes around a value go; values
    of an object that aren't texts stay as their JSON.
    """
    body = F.trim("content")
    is_json = body.startswith("{")
    object_ = F.try_variant_get(F.try_parse_json("content"), "$", "map<string,variant>")
    value = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))
    pairs = F.transform(F.map_entries(object_), lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value")))
    lines = F.filter(F.transform(F.split("content", "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    sign = F.when(F.exists(lines, lambda x: x.rlike("^[^:=]+=")), "=").otherwise(":")

    def cut(line):
        at = F.when(sign == "=", F.position(F.lit("="), line)).otherwise(F.position(F.lit(":"), line))
        raw = F.trim(F.substring(line, at + 1, F.length(line)))
        plain = F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")
        return F.when(at > 1, F.struct(F.trim(F.substring(line, F.lit(1), at - 1)).alias("key"), plain.alias("value")))

    flat = F.filter(F.transform(lines, cut), lambda p: p.isNotNull())
    return texts.select("namespace", F.explode(F.when(is_json, pairs).otherwise(flat)).alias("p")).select("namespace", "p.key", "p.value")


def config_texts(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, content) of a folder of configuration files, named by their stem."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("content"))
    return files.select(F.regexp_extract("f", r"([^/]*?)(\.[^./]*)?$", 1).alias("namespace"), "content")
