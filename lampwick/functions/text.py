"""Column expressions over strings: names, paths, URLs, spellings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "flv", "webm")
# Supplier names by the name they are written with.
SUPPLIER_NAMES = {"星辉": "星徽出行", "星徽": "星徽出行", "曹操": "曹操出行", "T3": "T3出行"}
ESCAPED_TAGS = ("&lt;p&gt;", "&lt;/p&gt;", "&lt;br&gt;")


def media_extension(key: Column) -> Column:
    """From the last dot to a question mark, in lower case; null without a dot or where it is the first or last character."""
    tail = F.regexp_extract(key, r"(?s)^.+\.([^.]+)$", 1)
    return F.nullif(F.lower(F.regexp_replace(tail, r"\?.*$", "")), F.lit(""))


def is_media(key: Column) -> Column:
    return F.coalesce(media_extension(key).isin(*MEDIA_EXTENSIONS), F.lit(False))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The file name up to its last dot, if that isn't its first character."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def frame_index(path: Column, last: bool = False) -> Column:
    """The first digit run of the stem, or the last one, as an int; -1 where there is none that fits."""
    run = F.regexp_extract(file_stem(path), r"(\d+)\D*$" if last else r"(\d+)", 1)
    return F.coalesce(run.try_cast("int"), F.lit(-1))


def split_bucket_key(path: Column, default: str = "default-bucket") -> Column:
    slash = F.instr(path, "/")
    return F.struct(F.when(slash > 0, F.substring_index(path, "/", 1)).otherwise(default).alias("bucket"), F.when(slash > 0, F.regexp_replace(path, r"^[^/]*/", "")).otherwise(path).alias("object_key"))


def normalize_separators(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"[ －＋+-]+", "-"), "-$", "")


def normalize_supplier(name: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for p in SUPPLIER_NAMES.items() for x in p))
    return F.coalesce(F.try_element_at(pairs, name), name)


def video_name_fields(path: Column, order: Sequence[str] | None = None, delimiter: str = "-") -> Column:
    """struct(city_name, supplier_name, driver_name) of a file name; null with under three fields or no folder.

    Eight digits in front, with four fields or more: city, supplier, driver follow.
    Else by the given order, else (four or more) from the end: supplier, driver,
    city, and one more.
    """
    fields = F.split(normalize_separators(file_stem(path)), rf"\Q{delimiter}\E")
    n = F.size(fields)
    at = lambda i: F.try_element_at(fields, F.lit(i))
    dated = (n >= 4) & at(1).rlike(r"^\d{8}$")
    places = {name: (list(order).index(name) + 1 if name in order else None) for name in ("city_name", "supplier_name", "driver_name")} if order else {"city_name": -2, "supplier_name": -4, "driver_name": -3}
    fixed = {"city_name": 2, "supplier_name": 3, "driver_name": 4}
    free = F.lit(True) if order else n >= 4
    out = [F.when(dated, at(fixed[k])).when(free, at(p) if p else F.lit(None)).alias(k) for k, p in places.items()]
    return F.when((n >= 3) & (F.size(F.split(path, "/")) >= 2), F.struct(*out))


def parent_folder(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def survey_image_urls(data: Column, old_host: str, new_host: str) -> Column:
    """A comma list as an array: no empty ones, host renamed, ``//`` given a scheme, trailing ``_`` and ``,`` cut."""

    def one(url: Column) -> Column:
        moved = F.replace(url, F.lit(old_host), F.lit(new_host))
        full = F.when(moved.startswith("//"), F.concat(F.lit("http:"), moved)).otherwise(moved)
        return F.regexp_replace(full, "[_,]+$", "")

    return F.filter(F.transform(F.split(F.coalesce(data, F.lit("")), ","), one), lambda u: u != "")


def prefixed_urls(paths: Column, prefix: str, suffix: str) -> Column:
    held = F.filter(paths, lambda p: p.isNotNull() & (p != ""))
    return F.transform(held, lambda p: F.concat(F.lit(prefix), p, F.lit(suffix)))


def clean_urls(urls: Column, url: Column) -> Column:
    """The list if there is one, else the single value; trimmed, without blanks."""
    given = F.when(F.size(urls) > 0, urls).otherwise(F.array(url))
    return F.filter(F.transform(given, lambda u: F.trim(u)), lambda u: u.isNotNull() & (u != ""))


def strip_markup(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for tag in ESCAPED_TAGS:
        out = F.replace(out, F.lit(tag), F.lit(""))
    return out


def normalize_parens(text: Column) -> Column:
    return F.translate(text, "()", "（）")


def merge_string(a: Column, b: Column) -> Column:
    return F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))


def _known_biz(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("gaode") | low.contains("高德"), "GAODE").when(low.contains("xiaola") | low.contains("小拉"), "XIAOLA")


def infer_biz_type(task_type: Column, link_name: Column) -> Column:
    typed = F.nullif(task_type, F.lit(""))
    return F.coalesce(_known_biz(typed), F.upper(typed), _known_biz(link_name), F.lit("DEFAULT"))


def chars(text: Column, empty: bool = False) -> Column:
    """The set of characters, an empty array for null. ``empty``: as SQL splits texts, an empty one has one empty character and null has no set."""
    if empty:
        return F.array_distinct(F.split(text, ""))
    return F.array_remove(F.array_distinct(F.split(F.coalesce(text, F.lit("")), "")), "")


def _or_none(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def both_sets(a: Column, b: Column) -> Column:
    """What is in both; as in SQL, a second set that is null has no elements, and a first one that is null gives null."""
    return F.array_intersect(a, _or_none(b))


def either_set(a: Column, b: Column) -> Column:
    """What is in one or both; null has no elements."""
    return F.array_union(_or_none(a), _or_none(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where either is empty."""
    both, one = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / one).otherwise(0.0)
