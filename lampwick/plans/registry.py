"""Queries over the given tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Tables
from . import more_queries, stream_queries, table_queries, text_queries

MODULES = (text_queries, table_queries, more_queries, stream_queries)


def _over_tables(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(Tables(spark, sf_dir))

    return run


QUERIES = {name: _over_tables(f) for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
