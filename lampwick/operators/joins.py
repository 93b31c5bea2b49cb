"""Lookups and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ttl_seconds
from ..workdir import looked_up


def new_objects(listing: DataFrame, processed: DataFrame) -> DataFrame:
    """Listed objects that aren't processed yet, by bucket and key."""
    return listing.join(processed.select("bucket", "object_key"), ["bucket", "object_key"], "left_anti")


def page_text_join(images: DataFrame, texts: DataFrame) -> DataFrame:
    return images.join(texts.select("image_path", "ocr_text"), "image_path", "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))


def page_rule_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages with their type's rule; ``has_rule`` says whether there is one. Rules are configuration and unique by type."""
    return pages.join(looked_up(rules.withColumn("has_rule", F.lit(True))), "page_type", "left").withColumn("has_rule", F.coalesce("has_rule", F.lit(False)))


def supplier_rate_lookup(probes: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds o_supplier_rate, the live rate of (city_name, partner_name) as text, '' where there is none."""
    live = rates.where("deleted = 0").select("city_name", "partner_name", F.col("response_rate").cast("string").alias("o_supplier_rate"))
    return probes.join(live, ["city_name", "partner_name"], "left").withColumn("o_supplier_rate", F.coalesce("o_supplier_rate", F.lit("")))


def city_id_lookup(df: DataFrame, cities: DataFrame, name: str = "city_name", suffix: str = "市") -> DataFrame:
    """Adds std_city and city_id: the name if it is known, else with the suffix if that is, else as it is."""
    plain = cities.select(F.col("name").alias(name), F.col("city_id").alias("_a"))
    longer = cities.where(F.col("name").endswith(suffix)).select(F.expr(f"left(name, length(name) - {len(suffix)})").alias(name), F.col("city_id").alias("_b"))
    out = df.join(plain, name, "left").join(longer, name, "left")
    std = F.when(F.col("_a").isNull() & F.col("_b").isNotNull(), F.concat(F.col(name), F.lit(suffix))).otherwise(F.col(name))
    return out.withColumns({"std_city": std, "city_id": F.coalesce("_a", "_b")}).drop("_a", "_b")


def city_contains_lookup(df: DataFrame, cities: DataFrame, name: str = "province_city") -> DataFrame:
    """Adds city: the longest known city name (then the first by name) that the last ``-`` part holds, else that part.

    The city list is a fixed dimension of some hundred names and goes along as
    one sorted array, a scalar of the query, so no row is multiplied by it.
    """
    rank = F.struct((-F.length("name")).alias("n"), "name")
    table = cities.agg(F.transform(F.array_sort(F.collect_set(rank)), lambda c: c["name"]).alias("_cities"))
    part = F.coalesce(F.element_at(F.split(F.col(name), "-"), -1), F.lit(""))
    hit = F.get(F.filter("_cities", lambda c: part.contains(c)), F.lit(0))
    return df.withColumn("_cities", table.scalar()).withColumn("city", F.coalesce(hit, part)).drop("_cities")


def cache_key(biz: Column, prompt: Column, image: Column) -> Column:
    """llm_cache:{biz}:{sha256(prompt)}:{sha256(image)}; null without an image, which isn't cached."""
    return F.when(F.coalesce(image, F.lit("")) != "", F.concat_ws(":", F.lit("llm_cache"), biz, F.sha2(prompt, 256), F.sha2(image, 256)))


def cached_inference_join(requests: DataFrame, cache: DataFrame, ttls: DataFrame, now_ms: Column) -> DataFrame:
    """Adds cache_key, cached_content and hit: the newest answer of the key that is younger than the business's life."""
    newest = cache.groupBy("cache_key").agg(F.max_by("content", "ts").alias("cached_content"), F.max("ts").alias("_ts"))
    life = ttls.select("biz_type", ttl_seconds(F.col("ttl")).alias("_ttl"))
    df = requests.withColumn("cache_key", cache_key(F.col("biz_type"), F.col("prompt"), F.col("image_url"))).join(looked_up(life), "biz_type", "left").join(newest.hint("merge"), "cache_key", "left")
    hit = F.coalesce(now_ms - F.col("_ts") < F.coalesce("_ttl", ttl_seconds(F.lit(None).cast("string"))) * 1000, F.lit(False))
    return df.withColumns({"hit": hit, "cached_content": F.when(hit, F.col("cached_content"))}).drop("_ts", "_ttl")


def cache_put(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new rows (cache_key, content, ts, business_name) added; readers take the newest."""
    return cache.unionByName(answers.where(F.col("cache_key").isNotNull()).select(*cache.columns))


def template_resolve(asked: DataFrame, templates: DataFrame, defaults: DataFrame) -> DataFrame:
    """Adds template and resolved ('exact', 'latest', 'default' or 'none').

    asked: biz_type, stage, version. With a null version the template stored
    without one, then 'latest', then the default of (biz_type, stage), then that
    of the stage alone; with a version only that one, then the default.
    """
    t = templates.withColumn("_v", F.coalesce("version", F.lit("")))
    exact = t.select("biz_type", "stage", "_v", F.col("template").alias("_exact"))
    latest = t.where("_v = 'latest'").select("biz_type", "stage", F.col("template").alias("_latest"))
    own = defaults.where("biz_type IS NOT NULL").select("biz_type", "stage", F.col("template").alias("_own"))
    any_ = defaults.where("biz_type IS NULL").select("stage", F.col("template").alias("_any"))
    df = asked.withColumn("_v", F.coalesce("version", F.lit(""))).join(looked_up(exact), ["biz_type", "stage", "_v"], "left")
    df = df.join(looked_up(latest), ["biz_type", "stage"], "left").join(looked_up(own), ["biz_type", "stage"], "left").join(looked_up(any_), "stage", "left")
    late = F.when(F.col("version").isNull(), F.col("_latest"))
    how = F.when(F.col("_exact").isNotNull(), "exact").when(late.isNotNull(), "latest").when(F.coalesce("_own", "_any").isNotNull(), "default").otherwise("none")
    return df.withColumns({"template": F.coalesce("_exact", late, "_own", "_any"), "resolved": how}).drop("_v", "_exact", "_latest", "_own", "_any")
