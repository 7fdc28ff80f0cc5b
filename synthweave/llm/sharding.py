"""Sharding by a permutation-filled lookup table (as in consistent load balancers).

Each shard walks its own permutation of the slots of a prime-sized table;
the shards take turns, each claiming the first slot of its walk that is still
free, until the table is full.  Every shard gets the same number of slots
(to within one) and a change of the shard list moves few slots.  The table
has ``slots`` rows -- a parameter, not data -- so broadcasting it is bounded,
and a row's place costs one hash and one lookup.

Placement depends on the key alone: repeated rows meet in one shard, a null
key is a key like any other, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 2039        # a prime, over 100 slots for each of the shards below
SHARDS = 16


def _number(text: Column, salt: str) -> Column:
    """60 bits of ``md5(salt || text)``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, 15), 16, 10).cast("bigint")


def _number_of(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``(slot int, shard string)`` for the shard ``names``, filled turn by turn in one fold.

    The fold runs over the ``slots`` turns; its state is the table so far and
    how far each shard has walked.  Shard ``s`` visits slot
    ``(offset + step * skip) % slots``; ``slots`` being prime, every skip from
    1 to ``slots - 1`` visits all of them.
    """
    if not _is_prime(slots) or not 0 < len(names) <= slots or len(set(names)) != len(names):
        raise ValueError("slots must be prime and at least as many as the distinct shards")
    n = len(names)
    offset = F.array(*[F.lit(_number_of(f"offset:{x}") % slots) for x in names])
    skip = F.array(*[F.lit(_number_of(f"skip:{x}") % (slots - 1) + 1) for x in names])
    start = F.struct(F.array_repeat(F.lit(-1), slots).alias("table"),
                     F.array_repeat(F.lit(0), n).alias("walked"))

    def turn(state: Column, t: Column) -> Column:
        shard = (t % n).cast("int")
        at = lambda step: ((F.get(offset, shard) + step * F.get(skip, shard)) % slots).cast("int")
        free = lambda step: F.get(state["table"], at(step)) == -1
        step = F.get(F.filter(F.sequence(F.get(state["walked"], shard), F.lit(slots - 1)), free), F.lit(0))
        found = F.transform(F.array(step), lambda s: F.struct(s.alias("step"), at(s).alias("slot")))
        return F.get(F.transform(found, lambda f: F.struct(
            F.transform(state["table"], lambda x, i: F.when(i == f["slot"], shard).otherwise(x)).alias("table"),
            F.transform(state["walked"], lambda x, i: F.when(i == shard, f["step"] + 1).otherwise(x)).alias("walked"))),
            F.lit(0))

    filled = spark.range(1).select(F.array(*[F.lit(x) for x in names]).alias("names"), F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, turn)["table"].alias("table"))
    return (filled.select("names", F.posexplode("table").alias("slot", "shard_no"))
            .select("slot", F.get("names", F.col("shard_no")).alias("shard")))


def assign_shards(df: DataFrame, key: str, names: list[str], slots: int = SLOTS,
                  slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """Add the slot and shard of every row (input columns of those names are replaced)."""
    table = lookup_table(df.sparkSession, names, slots).select(
        F.col("slot").alias(slot_col), F.col("shard").alias(shard_col))
    kept = df.drop(slot_col, shard_col)
    text = F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit("null"))
    placed = kept.withColumn(slot_col, (_number(text, "key:") % slots).cast("int"))
    return placed.join(F.broadcast(table), slot_col).select(*[F.col(f"`{c}`") for c in kept.columns], slot_col, shard_col)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def oracle_sql(n: int = SHARDS, slots: int = SLOTS) -> str:
    """The query's rows in DuckDB; the fill is a recursive table with one row for each turn."""
    num = lambda salt, x: f"('0x' || substring(md5('{salt}' || {x}), 1, 15))::bigint"
    names = ", ".join(f"'{x}'" for x in shard_names(n))
    return f"""
WITH RECURSIVE s AS (
  SELECT names, list_transform(names, lambda x: {num('offset:', 'x')} % {slots}) AS off,
         list_transform(names, lambda x: {num('skip:', 'x')} % {slots - 1} + 1) AS skip
  FROM (SELECT [{names}] AS names)),
turns(t, taken, used, slot) AS (
  SELECT 0, []::bigint[], list_transform(range(0, {n}), lambda x: 0::bigint), -1::bigint
  UNION ALL
  SELECT t + 1, list_append(taken, (off[t % {n} + 1] + step * skip[t % {n} + 1]) % {slots}),
         list_transform(used, lambda x, i: CASE WHEN i = t % {n} + 1 THEN step + 1 ELSE x END),
         (off[t % {n} + 1] + step * skip[t % {n} + 1]) % {slots}
  FROM (SELECT t, taken, used, off, skip,
               list_filter(range(used[t % {n} + 1], {slots}),
                           lambda j: NOT list_contains(taken, (off[t % {n} + 1] + j * skip[t % {n} + 1]) % {slots}))[1] AS step
        FROM turns, s WHERE t < {slots})),
tab AS (SELECT slot, names[(t - 1) % {n} + 1] AS shard FROM turns, s WHERE t > 0),
d AS (SELECT doc_id, ({num('key:', "coalesce('=' || doc_id::varchar, 'null')")} % {slots})::int AS slot FROM documents)
SELECT doc_id, d.slot, shard FROM d JOIN tab ON d.slot = tab.slot"""
