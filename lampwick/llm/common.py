"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workdir import materialise, new_path, write

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def materialise_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """materialise(), with the path of the table, for those who discard it later."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, the empty one for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, list[Column]]:
    """docs with its columns whose names begin with one of ``taken`` under other names, and what to select to have all as they came."""
    others = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower().startswith(taken)}
    return docs.withColumnsRenamed(others), [F.col(f"`{others.get(c, c)}`").alias(c) for c in docs.columns]


def n_words(col: str | Column = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id (crc32 of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def md5_int(*cols: str | Column) -> Column:
    """The first 32 bits of the MD5 of the joined values, as a long: a hash that SQL engines share."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered; bytes.lower and bytes.split do exactly this, for ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def pieces(batches, rows: int = 256):
    """Arrow batches in slices of so many rows, so that what a task holds stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
