"""Row filters and positional windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthweave.operators.ranking import nth_row, select_first, up_to


def filter_language(df: DataFrame, language: str = "English", column: str = "language") -> DataFrame:
    """keep one language; a plain predicate, pushed into the parquet scan."""
    return df.where(F.col(column) == language)


def first_n(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """the first ``n`` rows by position (``row_id`` order)."""
    return select_first(df, n, [F.col(order)])


def row_range(df: DataFrame, start: int, end: int = -1, order: str = "row_id") -> DataFrame:
    """rows at 0-based positions ``[start, end)``; ``end=-1`` means to the end."""
    by = [F.col(order)]
    last = nth_row(df, end, by) if end > 0 else None
    rows = df.where(F.lit(False)) if end != -1 and end <= start else df if last is None else df.where(up_to(by, last))
    first = nth_row(df, start, by) if start > 0 else None
    if start > 0 and first is None:
        return df.where(F.lit(False))
    return rows if first is None else rows.where(~up_to(by, first))


def answer_nonempty(df: DataFrame, column: str = "output") -> DataFrame:
    """keep rows whose answer is neither NULL nor ''."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def generation_coverage(prompts: DataFrame, generations: DataFrame, key: str = "row_id") -> DataFrame:
    """F9 re-aimed: per prompt, how many generations came back.

    Instead of guessing alignment by position, generations are matched to
    prompts on their key: 0 = missing, 1 = ok, >1 = duplicated.
    """
    counts = generations.groupBy(key).agg(F.count(F.lit(1)).alias("n_outputs"))
    status = (F.when(F.col("n_outputs") == 0, "missing")
              .when(F.col("n_outputs") == 1, "ok").otherwise("duplicate"))
    return (prompts.select(key).join(counts, key, "left")
            .withColumn("n_outputs", F.coalesce(F.col("n_outputs"), F.lit(0)).cast("bigint"))
            .withColumn("status", status))
