"""Loading the driver tables (one parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; Catalyst prunes columns and pushes filters into the scan.

    The number of scan tasks is the session's business
    (``spark.sql.files.maxPartitionBytes``, row groups of the files).
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def register_all(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view of the same name (for spark.sql)."""
    for t in TABLES:
        load(spark, sf_dir, t).createOrReplaceTempView(t)
