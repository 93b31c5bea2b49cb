"""Classifying pages by keyword and pattern rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE = 0.8


def _strings(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def classify_pages(pages: DataFrame, rules: DataFrame, text: str = "ocr_text", case_sensitive: bool = False) -> DataFrame:
    """The columns of pages, page_type, matched_keywords, match_count: one row per matching type, or one ``unknown`` row.

    rules: page_type, keywords, exclude, verify_regexes (arrays), min_matches. A
    type matches where no exclude keyword is held, every pattern is found and at
    least min_matches keywords are held. Rules are a configuration: few rows, all
    of which every page is tested against, so they travel as one array beside
    each page and no page row is multiplied by those that fail.
    """
    low = (lambda c: c) if case_sensitive else F.lower
    fold = (lambda a: a) if case_sensitive else (lambda a: F.transform(a, F.lower))
    rule = F.struct("page_type", fold(_strings("keywords")).alias("words"), _strings("keywords").alias("keywords"), fold(_strings("exclude")).alias("exclude"), F.filter(_strings("verify_regexes"), lambda p: F.trim(p) != "").alias("patterns"), F.coalesce("min_matches", F.lit(1)).alias("least"))
    table = rules.where(F.col("page_type") != "unknown").agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
    said = F.coalesce(F.col(text), F.lit(""))
    search = low(said)

    def holds(p: Column) -> Column:
        given = p.rlike(r"^\(\?-?i\)") if not case_sensitive else F.lit(True)
        return F.rlike(said, F.when(given, p).otherwise(F.concat(F.lit("(?i)"), p)))

    def matched(r: Column) -> Column:
        hits = F.filter(r["keywords"], lambda k: search.contains(low(k)))
        fine = ~F.exists(r["exclude"], search.contains) & F.forall(r["patterns"], holds) & (F.size(hits) >= r["least"])
        return F.when(fine, F.struct(r["page_type"].alias("page_type"), hits.alias("matched_keywords"), F.size(hits).alias("match_count")))

    none = F.struct(F.lit("unknown").alias("page_type"), F.array().cast("array<string>").alias("matched_keywords"), F.lit(0).alias("match_count"))
    found = F.filter(F.transform("_rules", matched), lambda m: m.isNotNull())
    rows = pages.withColumn("_rules", table.scalar()).withColumn("_m", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(none))))
    return rows.select(*pages.columns, "_m.*")


def classification_rows(pages: DataFrame, rules: DataFrame, text: str = "ocr_text") -> DataFrame:
    """classify_pages() with a constant confidence; blank texts are ``unknown`` whatever the rules say."""
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    rows = classify_pages(pages.withColumn(text, F.when(~blank, F.col(text))), rules, text)
    return rows.withColumn("confidence", F.when(F.col("page_type") == "unknown", 0.0).otherwise(CONFIDENCE))


def classification_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("page_type").agg(F.count("*").alias("pages"))
