"""Ranks within groups of any size, without sorting a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import md5_int


def n_sub_bins(rows: int) -> int:
    """A quarter of the square root of the rows, at least 1: bins and rows in a bin grow alike."""
    return max(1, math.isqrt(rows // 16))


def binned(df: DataFrame, group: str, size: str, key: str, rows: int) -> DataFrame:
    """Adds ``_lw_class`` (bit length of the size) and ``_lw_sub`` (a hash of the key): with the group, the bin of a row."""
    return df.withColumns({"_lw_class": F.length(F.bin(F.col(size))), "_lw_sub": (md5_int(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n_sub_bins(rows)).cast("int")})


def bin_offsets(counts: DataFrame, group: str) -> DataFrame:
    """From (group, _lw_class, _lw_sub, n): how many rows of the group stand in earlier bins."""
    before = Window.partitionBy(group).orderBy("_lw_class", "_lw_sub").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_lw_before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def with_rank(df: DataFrame, group: str, size: str, key: str, offsets: DataFrame, *ties: str | Column) -> DataFrame:
    """Adds ``_lw_rank`` from 1 within the group: by class, hash, size, key, then ties. ``df`` comes from binned().

    A bin is sorted in one task and holds a small part of even a hot group; the
    ranks of earlier bins are added from a table with one row per bin.
    """
    own = Window.partitionBy(group, "_lw_class", "_lw_sub").orderBy(F.col(size), F.col(key), *ties)
    inner = df.withColumn("_lw_in_bin", F.row_number().over(own))
    return inner.join(offsets.drop("n").hint("merge"), [group, "_lw_class", "_lw_sub"]).withColumn("_lw_rank", F.col("_lw_before") + F.col("_lw_in_bin"))
