"""Sharding rows into clients.

A shard is a ``client_id`` column, not a file; writers partition by it.
Positions come from the distributed ranks in ``operators.ranking``; only keys
and orders are ranked, and wide rows are joined to their shard by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthweave.functions.keys import hash_bits, hash_key
from synthweave.operators.ranking import positions, rank_within_groups


def shard_iid(df: DataFrame, num_clients: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Seeded shuffle, then row i of the shuffled order goes to shard i mod n."""
    ranked = positions(df, key, [hash_key(key, seed=seed), F.col(key)], [hash_bits(key, seed=seed)], "_pos")
    shards = ranked.select(key, F.pmod(F.col("_pos") - 1, F.lit(num_clients)).cast("int").alias("client_id"))
    return df.drop("client_id").join(shards, key)


def shard_length(df: DataFrame, num_clients: int, exact: bool = False,
                 column: str = "instruction", key: str = "row_id") -> DataFrame:
    """Stable sort by ``len(instruction)``, chunks of ``N // n`` rows.

    A remainder forms an extra, smaller shard (index ``n``) as in the
    reference; ``exact=True`` spreads rows over exactly ``n`` shards instead.
    ``N < n`` fails the job like the reference's zero-step range.
    """
    ranked = positions(df, key, [F.length(column), F.col(key)], out="_pos")
    total = df.select(F.count(F.lit(1))).scalar()
    chunk = F.floor(total / F.lit(num_clients))
    if exact:
        shard = F.floor((F.col("_pos") - 1) * F.lit(num_clients) / total)
    else:
        shard = F.when(chunk == 0, F.raise_error(F.lit("fewer rows than clients")).cast("long")) \
                 .otherwise(F.floor((F.col("_pos") - 1) / chunk))
    return df.drop("client_id").join(ranked.select(key, shard.cast("int").alias("client_id")), key)


def shard_skew(df: DataFrame, num_clients: int, category: str = "category", key: str = "row_id") -> DataFrame:
    """Category-skewed shards.

    With ``k`` categories (sorted), ``a = n // k`` and ``b = n % k``: the
    first ``b`` categories get ``a + 1`` shards, the rest ``a``; each shard
    holds ``len // shards`` rows in row order and the tail rows are dropped.
    """
    stats = df.groupBy(category).agg(F.count(F.lit(1)).alias("_sw_len"))
    # one row per category: ordering it (for the shard offsets) runs in one
    # task, which is bounded by the number of categories, not by the rows
    w = Window.orderBy(category)
    k = F.count(F.lit(1)).over(Window.partitionBy())
    idx = F.row_number().over(w) - 1
    a = F.floor(F.lit(num_clients) / k)
    b = F.pmod(F.lit(num_clients), k)
    stats = (stats.withColumn("_sw_idx", idx)
             .withColumn("_sw_shards", F.when(F.col("_sw_idx") < b, a + 1).otherwise(a))
             .withColumn("_sw_first", F.coalesce(F.sum("_sw_shards").over(
                 w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("_sw_size", F.when(F.col("_sw_shards") > 0,
                                            F.floor(F.col("_sw_len") / F.col("_sw_shards"))).otherwise(0))
             .withColumn("_sw_before", F.coalesce(F.sum("_sw_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .select(category, "_sw_idx", "_sw_before", "_sw_shards", "_sw_first", "_sw_size"))
    # a place within the category is the place by (category, key) less the rows of the categories before
    numbered = df.select(key, category).join(stats.select(category, "_sw_idx"), category)
    ranked = positions(numbered, key, [F.col("_sw_idx"), F.col(key)], out="_sw_at")
    placed = (numbered.join(ranked, key).join(stats.drop("_sw_idx"), category).withColumn("_pos", F.col("_sw_at") - F.col("_sw_before"))
              .where((F.col("_sw_size") > 0) & (F.col("_pos") <= F.col("_sw_size") * F.col("_sw_shards"))))
    shards = placed.select(key, (F.col("_sw_first") + F.floor((F.col("_pos") - 1) / F.col("_sw_size"))).cast("int").alias("client_id"))
    return df.drop("client_id").join(shards, key)


def shard_sizes(df: DataFrame, client_col: str = "client_id") -> DataFrame:
    """T5: rows per shard (``sample_num_list``)."""
    return df.groupBy(client_col).agg(F.count(F.lit(1)).alias("n"))


def author_map(df: DataFrame, author: str = "author", key: str = "row_id") -> DataFrame:
    """T4: author -> its row ids, as rows ``(author, idx, row_id)``.

    The relational form of the mapping: no author's rows are ever gathered
    into one array or task (positions come from the skew-safe group rank).
    """
    return (rank_within_groups(df.select(author, key), [author], [key], "idx")
            .withColumn("idx", F.col("idx") - 1).select(author, "idx", key))
