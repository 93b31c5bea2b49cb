"""Column expressions over numbers, times, maps, arrays and JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def java_hash(text: Column) -> Column:
    """Java's String.hashCode as a long, for texts of the basic plane."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)


def canary_share(task_id: Column) -> Column:
    """The place of an id in [0, 1), in steps of 1/10000; below 0 for the one hash that has no positive counterpart."""
    h = java_hash(task_id)
    return F.when(h == -(1 << 31), h % 10_000).otherwise(F.abs(h) % 10_000) / 10_000.0


def quality_tier(width: Column, height: Column) -> Column:
    short = F.least(width, height)
    tier = reduce(lambda c, t: c.when(short >= t[0], t[1]), ((1440, "2K (1440p)"), (1080, "1080p"), (720, "720p"), (480, "480p"), (360, "360p"), (240, "240p")), F.when(short >= 2160, "4K (2160p)"))
    return tier.otherwise(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(" (低清)")))


def size_bucket(n: Column) -> Column:
    mb = 1 << 20
    return F.when(n < mb, "<1MB").when(n < 10 * mb, "1-10MB").when(n < 100 * mb, "10-100MB").when(n < 500 * mb, "100-500MB").otherwise("500MB+")


def derive_fps(frames: Column, duration: Column, rate: Column) -> Column:
    """frames / duration if that is a likely rate, else the ``num/den`` text, else 30."""
    counted = F.try_divide(frames.cast("double"), duration)
    num = F.split_part(rate, F.lit("/"), F.lit(1)).try_cast("double")
    told = F.try_divide(num, F.split_part(rate, F.lit("/"), F.lit(2)).try_cast("double"))
    return F.when((counted > 1) & (counted < 120), counted).when((num > 0) & (num < 1000) & (told > 0) & (told < 120), told).otherwise(30.0)


def frame_step(fps: Column, interval: Column) -> Column:
    return F.greatest(F.lit(1), (fps * interval).cast("int"))


def corner_box(region: Column) -> Column:
    """struct(x, y, w, h) of a polygon [[x, y], ...]: x and y are means of the two smallest, w and h the right and lower edges."""
    axis = lambda i: F.array_sort(F.transform(region, lambda p: F.get(p, F.lit(i))))
    low = lambda a: (F.get(a, F.lit(0)) + F.get(a, F.lit(1))) / 2
    high = lambda a: F.element_at(a, -1)
    enough = F.size(region) >= 2
    value = lambda c: F.when(enough, c).otherwise(0.0)
    xs, ys = axis(0), axis(1)
    return F.struct(value(low(xs)).alias("x"), value(low(ys)).alias("y"), value(high(xs)).alias("w"), value(high(ys)).alias("h"))


def clamp_confidence(c: Column) -> Column:
    return F.round(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), 3)


def float_prefix(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^([\d.]+)", 1).try_cast("double"), F.lit(0.0))


def merge_float(a: Column, b: Column) -> Column:
    return F.when(a != 0, a).otherwise(b)


def parse_minutes(text: Column) -> Column:
    """A number, or hours (小时) and minutes (分钟); 0 otherwise."""
    number = F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))
    found = F.regexp_extract(text, r"((\d+)小时\s*(\d*\.?\d+)分钟|(\d+\.?\d*)小时|(\d*\.?\d+)分钟)", 0)
    part = lambda p: F.nullif(F.regexp_extract(found, p, 1), F.lit("")).try_cast("double")
    hours, minutes = part(r"^(\d+\.?\d*)小时"), part(r"(\d*\.?\d+)分钟$")
    return F.coalesce(number, F.when(found != "", F.coalesce(hours, F.lit(0.0)) * 60 + F.coalesce(minutes, F.lit(0.0))), F.lit(0.0))


def ms_to_datetime(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def datetime_to_seconds(text: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def ttl_seconds(text: Column) -> Column:
    """A configured life in seconds: 7 days unless it is a number from 60 on, 30 days at most."""
    n = text.try_cast("long")
    return F.when(n.isNull() | (n < 60), 7 * DAY).otherwise(F.least(n, F.lit(30 * DAY))).cast("long")


def json_path_list(json: Column, path: str) -> Column:
    """Texts at a dotted path; ``#`` takes the next field of each element and ends the path.

    A missing field gives an empty list, a list at the end its strings only, any
    other value at the end nothing unless it is a string.
    """
    parts = path.split(".")
    value = F.try_parse_json(json)
    empty = F.array().cast("array<string>")
    if "#" in parts:
        at = parts.index("#")
        head, field = parts[:at], parts[at + 1] if at + 1 < len(parts) else None
        if field is None:
            return empty
        items = F.try_variant_get(value, ".".join(["$", *head]), "array<variant>")
        texts = F.transform(items, lambda x: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{field}", "variant")).rlike("^(ARRAY|OBJECT)"), None).otherwise(F.try_variant_get(x, f"$.{field}", "string")))
        return F.coalesce(F.filter(texts, lambda t: t.isNotNull()), empty)
    spot = F.try_variant_get(value, ".".join(["$", *parts]), "variant")
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    items = F.filter(F.transform(F.try_variant_get(spot, "$", "array<variant>"), string), lambda t: t.isNotNull())
    return F.coalesce(items, F.when(string(spot).isNotNull(), F.array(string(spot))), empty)


def overlay(*maps: Column) -> Column:
    """Maps merged, later ones winning; null maps count as empty."""
    entries = F.concat(*(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def prompt_context(base: Column, custom: Column) -> Column:
    # What a context has unless it says otherwise.
    defaults = F.create_map(F.lit("targetField"), F.lit("关键信息"), F.lit("role"), F.lit("数据分析专家"))
    return overlay(defaults, base, custom)


def tag_key(tags: Column) -> Column:
    """A map of tags as one text, sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
