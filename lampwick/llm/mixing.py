"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import aside, materialise, md5_int, n_words
from .ranks import bin_offsets, binned, n_sub_bins, with_rank

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL, MOST = 1.5, 2.0


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """From (_lw_key, source_size), one row per source: the same with ``target``, in words.

    Sources in order of _lw_key (code points; a null source has the last key) weigh
    as the weights repeat. Together they get ``total`` times all words, none over
    ``most`` times its own. That is a water level: with sources in order of
    room per weight, the first k are full and the rest get the level times
    their weight. The table has one row per source, not per document.
    """
    every = Window.partitionBy(F.lit(0))
    place = (F.row_number().over(every.orderBy("_lw_key")) - 1) % len(weights)
    df = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    df = df.withColumns({"cap": most * F.col("source_size"), "room": most * F.col("source_size") / F.col("weight")})
    before = every.orderBy("room", "_lw_key").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "_used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)), "_all": F.sum("source_size").over(every), "_weights": F.sum("weight").over(every)})
    level = (total * F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_used"))
    first = F.min(F.when(level <= F.col("room"), F.struct("room", "_lw_key", level.alias("level")))).over(every)
    return df.withColumn("_level", first["level"]).withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap")))).select("_lw_key", "source_size", "target")


def with_copies(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Adds size, source_size, target and ``copies``, how often the mix takes the document.

    Every document of a source expects target / source_size copies. Its place in
    the source gives the prefix sum, rank times that; one offset per source,
    a hash of its name and the seed, is added, and a document is taken once per
    integer that its step crosses. Places go by size within bins, so that taken
    words come near the target, and depend on the rows alone: reruns agree.
    Null texts have size 0; a null source is a source; repeated rows are
    separate documents; columns of these names in the input are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    docs, own = aside(docs.select(*names), "_lw_")
    docs = docs.withColumns({"size": n_words(), "_lw_key": F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))})
    facts = materialise(docs.groupBy("_lw_key", F.length(F.bin("size")).alias("_lw_class"), md5_int(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_lw_hash")).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "facts")
    rows = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = facts.groupBy("_lw_key", "_lw_class", (F.col("_lw_hash") % n_sub_bins(rows)).cast("int").alias("_lw_sub")).agg(F.sum("n").alias("n"))
    targets = source_targets(facts.groupBy("_lw_key").agg(F.sum("words").alias("source_size")), weights, total, most)
    offset = (md5_int("_lw_key", F.lit(seed)) % 1024 * 2 + 1) / 2048
    sources = targets.withColumns({"_lw_rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), "_lw_offset": offset})
    offsets = bin_offsets(counts, "_lw_key").join(sources, "_lw_key")
    ranked = with_rank(binned(docs, "_lw_key", "size", "doc_id", rows), "_lw_key", "size", "doc_id", offsets, F.xxhash64("text"))
    step = lambda n: F.floor(F.col("_lw_offset") + F.col("_lw_rate") * n)
    return ranked.withColumn("copies", step(F.col("_lw_rank")) - step(F.col("_lw_rank") - 1)).select(*own, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with.

    Null texts, a null source or id, ties and repeated rows are as in
    with_copies(); a document without words is taken as its rank says. No rows
    give no rows.
    """
    docs, own = aside(docs, "size", "source_size", "target", "copies", "_lw_")
    return with_copies(docs, seed, **how).withColumn("_lw_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*own)
