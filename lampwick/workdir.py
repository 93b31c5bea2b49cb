"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


#: Whether a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The temporary folder of a process that is driver and executor at once.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where that is unset and the session is one local process, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        folder = _own[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, *by: str) -> None:
    """Writes a table of the job's own, in folders by the columns named. The shuffle files behind it go with the end of the write, as nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` and reads it back: lineage is cut and its size is known."""
    path = new_path(df.sparkSession, tag)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(table: DataFrame, most: int = 10_000) -> DataFrame:
    """``table`` with the hint for a join that looks rows up in it: sent to every task if it has at most ``most`` rows, else merged."""
    return table.hint("broadcast" if table.limit(most + 1).count() <= most else "merge")


def typed(frame: pd.DataFrame, **kinds: str) -> pd.DataFrame:
    """The frame with columns of the Spark types named, so that an empty one has types too; what isn't a number goes as objects."""
    numbers = {"bigint": "int64", "long": "int64", "int": "int64", "double": "float64"}
    return frame.astype({c: numbers.get(kind, "object") for c, kind in kinds.items() if kind not in numbers or not frame[c].isna().any()})
