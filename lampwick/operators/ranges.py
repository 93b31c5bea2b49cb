"""Order within groups of any size: rows are dealt out by ranges of their order, and small tables of blocks, the part of a group in a range, link the ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..workdir import materialise


#: Groups of more rows than this are dealt out by ranges.
LARGE = 1_000_000


def over(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """The groups of more than LARGE rows."""
    return (df.groupBy(*group).count() if group else df.agg(F.count("*").alias("count"))).where(F.col("count") > LARGE).drop("count")


def dealt(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """A written table with ``_range``, rising with (group, order). A group lies in as many successive ranges as it needs; no task sorts more than a range."""
    by = [*map(F.col, group), *order]
    return materialise(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).withColumn("_range", F.spark_partition_id()), "ranges")


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows with ``_range`` and ``_row``, the row's number from 1 within its block.

    Where any group is over LARGE the rows are dealt(); else all are one range, each
    group one block, and nothing is written. The result of both is the same but for how blocks are cut.
    """
    large = bool(over(df, group).limit(1).count())
    rows = dealt(df, group, order) if large else df.withColumn("_range", F.lit(0))
    return rows.withColumn("_row", F.row_number().over(within(group).orderBy(*order)))


def within(group: Sequence[str]):
    """The window of a block."""
    return Window.partitionBy("_range", *group)


def blocks_before(group: Sequence[str]):
    """For a table with one row for each block: the window of a group's blocks, in order. A group has no more of them than there are ranges."""
    return Window.partitionBy(*group).orderBy("_range")


def beside(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", hint: str = "merge") -> DataFrame:
    """``df`` with the other columns of ``table``, joined on keys of which nulls are equal."""
    other = table.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)}).hint(hint)
    same = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    return df.join(other, same, how).drop(*(f"_k_{i}" for i in range(len(keys))))
