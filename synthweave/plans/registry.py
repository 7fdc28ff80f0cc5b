"""Query registry: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Each builder takes ``(spark, sf_dir)`` and reads the driver tables (or views
Spark derives from them) in full.  Double columns are rounded to 9 places in
the final projection -- and identically in the oracle -- so summation-order
noise does not break value hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Round floating columns to 9 places (the oracle does the same)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f"`{f.name}`").cast("double"), 9).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register a query builder (and its oracle SQL when one exists)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from synthweave.plans import (queries_bleu, queries_chat, queries_core, queries_distance,  # noqa: F401
                                  queries_fed, queries_io, queries_lm, queries_privacy, queries_stream)
