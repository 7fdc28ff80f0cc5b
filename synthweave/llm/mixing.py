"""Mixing sources to target weights.

Tokens are summed by source, each source's target share is found by raising a
common water level (no target above ``ceiling`` times its source), and every
document is emitted ``floor(rate)`` times plus one copy drawn with the
fraction as its probability.  The draw is a hash of the document's key and
the seed, so reruns, retries and other partitionings agree.

A null text has size 0; a null source is a source of its own, sorted last;
documents of size 0 count nothing and are emitted by their source's rate
(0 where the whole source is empty).  Rows without a key are drawn by the
hash of their text.  Repeated rows draw alike.  Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthweave.session import materialize

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = 17
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def text_size(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row for each source.

    With the sources ordered by ``ceiling * size / weight``, the level that
    holds when the first k are full is (all sizes - their ceilings) / (weights
    of the rest); the first source that this level does not fill ends the
    search.  Windows run over the source table only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = (sizes.withColumn("pos", F.row_number().over(by_name) - 1)
         .withColumn("w", F.get(cycle, F.col("pos") % len(weights)))
         .withColumn("cap", F.col("source_size").cast("double") * float(ceiling))
         .withColumn("all", F.sum("source_size").over(total).cast("double"))
         .withColumn("full_at", F.col("cap") / F.col("w")))
    order = Window.orderBy("full_at", "pos")
    t = (t.withColumn("caps", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("ws", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.col("all") - F.col("caps")) / F.col("ws")))
    holds = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "pos", "level"))
    t = t.withColumn("found", F.min(holds).over(total))
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("w") * F.col("found.level")), F.col("cap")).alias("target"))


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """``floor(rate)`` plus 1 with probability ``rate - floor(rate)``."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("bigint")
    drawn = bits.cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("bigint")


def _with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the source table on; it is broadcast only when its row count was checked to be small."""
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plan = plan.withColumnRenamed("source", "mix_source")
    return rows.join(F.broadcast(plan) if small else plan, F.col("mix_key_source").eqNullSafe(F.col("mix_source")), "left")


def plan_mix(sized: DataFrame, weights: tuple = WEIGHTS, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """Add ``source_size, target, copies, taken`` to rows ``(key, source, size)``."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(targets(sizes, weights, ceiling))
    rows = _with_source(sized.withColumn("mix_key_source", F.col("source")), plan)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (rows.withColumn("copies", copies(rate, F.col("key"), seed))
            .withColumn("taken", F.col("copies") * F.col("size")).drop("mix_key_source", "mix_source"))


def sized(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The narrow rows ``(key, id, source, size)`` that mixing needs."""
    return df.select(*_narrow(key, source, text), F.col(f"`{key}`").alias("id"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple = WEIGHTS,
        ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, all columns kept.

    Sizes are summed first, then one more pass joins the small source table
    and repeats rows; the rows themselves are never shuffled when the source
    table is small enough to broadcast.
    """
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                    *_narrow(key, source, text))
    sizes = row.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(targets(sizes, weights, ceiling))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = _with_source(row.withColumn("mix_key_source", F.col("source")).drop("size"), plan)
    n = copies(rate, F.col("key"), seed).cast("int")
    return (out.select("row", n.alias("n")).where("n > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*"))


def _narrow(key: str, source: str, text: str) -> list[Column]:
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return [name.alias("key"), F.col(f"`{source}`").alias("source"), text_size(F.col(f"`{text}`")).alias("size")]


def oracle_sql(weights: tuple = WEIGHTS, ceiling: int = CEILING, seed: int = SEED) -> str:
    cycle = ", ".join(f"{float(w)!r}::double" for w in weights)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(doc_id::varchar, md5(coalesce(text, ''))) AS key,
                  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS pos FROM s),
q AS (SELECT *, [{cycle}][(pos % {len(weights)} + 1)::int] AS w, source_size::double * {float(ceiling)!r}::double AS cap,
             (sum(source_size) OVER ())::double AS total FROM p),
r AS (SELECT *, cap / w AS full_at FROM q),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(w) OVER (ORDER BY full_at, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, pos LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT level FROM f)), cap) AS target FROM l),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::double ELSE 0.0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN ('0x' || substring(md5(key || ':{seed}'), 1, 13))::bigint::double / {float(1 << 52)!r}::double < rate - floor(rate)
                       THEN 1 ELSE 0 END)::bigint * size)::bigint AS taken FROM j"""
