"""Object listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_media, split_bucket_key

ALLOWED_IMAGES, MOST_BYTES = ("jpg", "jpeg", "png", "gif", "webp", "bmp"), 10 << 20


def scan_objects(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """path, length, modified of the files below a folder. Contents are not read: that column is pruned."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def as_objects(listing: DataFrame, root: str) -> DataFrame:
    """bucket and object_key of paths below ``root``."""
    rest = F.regexp_replace("path", rf"^\Q{root.rstrip('/')}\E/", "")
    return listing.select(split_bucket_key(rest).alias("p"), "length", "modified").select("p.*", "length", "modified")


def list_prefixes(listing: DataFrame, prefix: str = "") -> DataFrame:
    """The distinct first folders below a prefix."""
    rest = F.regexp_replace("object_key", rf"^\Q{prefix}\E", "")
    return listing.where(F.col("object_key").startswith(prefix) & rest.contains("/")).select(F.split_part(rest, F.lit("/"), F.lit(1)).alias("prefix")).distinct()


def filter_media_ext(listing: DataFrame) -> DataFrame:
    return listing.where(is_media(F.col("object_key")))


def fits_upload(key: Column, length: Column, most: int = MOST_BYTES, allowed: tuple[str, ...] = ALLOWED_IMAGES) -> Column:
    return F.lower(F.regexp_extract(key, r"\.([^.]+)$", 1)).isin(*allowed) & (length <= most)


def filter_media_type_size(listing: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    return listing.where(fits_upload(F.col("object_key"), F.col("length"), most))
