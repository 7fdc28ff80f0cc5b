"""Distributed positional ranks, selections and per-group limits.

The reference identifies rows by position.  A global ``row_number()`` window
moves every row into one task; these do not:

* :func:`select_first` -- the first ``n`` rows of an order are a filter once
  the n-th row's values are known.  Histograms of at most ``BINS`` rows find
  its bin, then only that bin is looked at, until few rows are left.  Nothing
  is sorted, ranked or stored, whatever ``n``.
* :func:`positions` -- every row's place in an integer order.  Rows get a
  code that grows with the order and that few rows share (exact histograms,
  crowded bins are split further), so places are a window per code plus the
  code's offset.  Bounds come from counts, not from samples: runs agree.
  Only the key and the order travel; wide rows are joined to them by key.
* :func:`global_row_number`, :func:`rank_within_groups` -- for orders that are
  no integers (texts): range partitions, numbered locally, with prefix sums
  over partitions.  The numbered rows are written to the session's shared
  folder once, because range bounds are sampled and two executions need not
  agree on them: pass narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthweave.session import materialize, stored

_LOCAL_BITS = 33
BINS = 1 << 12          # bins of a histogram
SUB_BINS = 1 << 6       # parts that a crowded bin is split into
FEW = 10_000            # rows that a selection looks at one by one


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def nth_row(df: DataFrame, n: int, order: list[Column]) -> tuple | None:
    """The values of ``order`` (numbers, ascending, no nulls) in its ``n``-th row; None if there are fewer rows.

    Each pass reads the order's columns only and returns one histogram.
    """
    names = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*[c.alias(x) for c, x in zip(order, names)])
    left, at = n, 0
    while True:
        c = F.col(names[at])
        total, lo, hi = rows.agg(F.count(F.lit(1)), F.min(c), F.max(c)).first()
        if left > total:
            return None
        if total <= FEW or (lo == hi and at == len(names) - 1):
            return tuple(rows.orderBy(*names).limit(FEW).collect()[min(left, FEW) - 1])
        if lo == hi:
            at += 1
            continue
        if isinstance(lo, float):
            place = F.least(F.floor((c - lo) / F.lit((hi - lo) / BINS)), F.lit(BINS - 1)).cast("bigint")
        else:
            shift = max((int(hi) - int(lo)).bit_length() - BINS.bit_length() + 1, 0)
            place = F.shiftright(c.cast("bigint"), shift)
        for r in sorted(rows.groupBy(place.alias("b")).count().collect()):
            if left <= r["count"]:
                rows = rows.where(place == r["b"])
                break
            left -= r["count"]


def up_to(order: list[Column], values: tuple, inclusive: bool = True) -> Column:
    """Whether a row's ``order`` comes before ``values``, or equals them."""
    out = F.lit(inclusive)
    for c, v in reversed(list(zip(order, values))):
        out = (c < F.lit(v)) | ((c == F.lit(v)) & out)
    return out


def select_first(df: DataFrame, n: int, order: list[Column]) -> DataFrame | None:
    """The first ``min(n, rows)`` rows under ``order`` (numbers, ascending; total): a filter, no sort and no join."""
    last = nth_row(df, n, order) if n > 0 else None
    if last is None:
        return df if n > 0 else df.where(F.lit(False))
    return df.where(up_to(order, last))


def order_code(rows: DataFrame, by: list[str], crowd: int | None = None) -> Column:
    """A bigint that grows with the order of the integer columns ``by`` and that at most ``crowd`` rows share (unless they tie)."""
    limits = rows.agg(F.count(F.lit(1)), *[f(c) for c in by for f in (F.min, F.max)]).first()
    crowd = crowd or max(4 * limits[0] // BINS, FEW)
    code, crowded, bins, bits = F.lit(0).cast("bigint"), None, BINS, 0
    for i, c in enumerate(by):
        lo, hi = limits[2 * i + 1], limits[2 * i + 2]
        if lo is None:
            break
        shift = (hi - lo).bit_length()
        rest = F.col(c).cast("bigint") - F.lit(lo)
        while shift and bits <= 36:                                     # codes stay far from 64 bits, and plans short
            bits += bins.bit_length() - 1
            shift = max(shift - (bins.bit_length() - 1), 0)
            part = F.shiftright(rest, shift).bitwiseAND(bins - 1)
            code = code * bins + (part if crowded is None else F.when(code.isin(crowded), part).otherwise(F.lit(0).cast("bigint")))
            crowded = [r["b"] for r in rows.groupBy(code.alias("b")).count().where(F.col("count") > crowd).select("b").collect()]
            bins = SUB_BINS
            if not crowded:
                return code
    return code


def positions(df: DataFrame, key: str, order: list[Column], by: list[Column] | None = None, out: str = "rn", crowd: int | None = None) -> DataFrame:
    """``(key, out)``: 1-based places under ``order`` (total).

    ``by``: integer columns that grow with the order (the order itself, by
    default), from which the codes are taken.  Stored once, narrow.
    """
    by = by or order
    o, b = [f"_o{i}" for i in range(len(order))], [f"_c{i}" for i in range(len(by))]
    rows = stored(df.select(F.col(f"`{key}`").alias("_key"), *[c.alias(x) for c, x in zip(order, o)], *[c.cast("bigint").alias(x) for c, x in zip(by, b)]))
    coded = rows.withColumn("_code", order_code(rows, b, crowd))
    counts = coded.groupBy("_code").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_code").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_code", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per code: at most BINS and some thousands more for crowded ones -> broadcast is size-safe
    local = F.row_number().over(Window.partitionBy("_code").orderBy(*o))
    return (coded.withColumn("_at", local).join(F.broadcast(offsets), "_code")
            .select(F.col("_key").alias(key), (F.col("_off") + F.col("_at")).cast("bigint").alias(out)))


def global_row_number(df: DataFrame, order: list, out: str = "rn",
                      partitions: int | None = None) -> DataFrame:
    """Add a 1-based position ``out`` under ``order`` (which must be total)."""
    n = _partitions(df, partitions)
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_sw_mid", F.monotonically_increasing_id())
              .withColumn("_sw_pid", F.shiftright("_sw_mid", _LOCAL_BITS))
              .withColumn("_sw_loc", F.col("_sw_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)))
    ranged = materialize(ranged)
    counts = ranged.groupBy("_sw_pid").agg(F.count(F.lit(1)).alias("_sw_cnt"))
    w = Window.orderBy("_sw_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_sw_pid", F.coalesce(F.sum("_sw_cnt").over(w), F.lit(0)).alias("_sw_off"))
    # one row per partition: bounded by ``n`` -> broadcast is size-safe
    return (ranged.join(F.broadcast(offsets), "_sw_pid")
            .withColumn(out, (F.col("_sw_off") + F.col("_sw_loc") + 1).cast("bigint"))
            .drop("_sw_mid", "_sw_pid", "_sw_loc", "_sw_off"))


def rank_within_groups(df: DataFrame, group: list[str], order: list, out: str = "rn",
                       partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by group order by order)`` without hot tasks.

    Rows are ranked globally on ``group + order``; the first global position
    of each group is found per (partition, group) -- a table no larger than
    partitions + groups -- and joined back on ``(partition, group)``, a key
    that splits a hot group across partitions.
    """
    n = _partitions(df, partitions)
    full = [*group, *order]
    ranged = (df.repartitionByRange(n, *full).sortWithinPartitions(*full)
              .withColumn("_sw_mid", F.monotonically_increasing_id())
              .withColumn("_sw_pid", F.shiftright("_sw_mid", _LOCAL_BITS))
              .withColumn("_sw_loc", F.col("_sw_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)))
    ranged = materialize(ranged)
    counts = ranged.groupBy("_sw_pid").agg(F.count(F.lit(1)).alias("_sw_cnt"))
    w = Window.orderBy("_sw_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_sw_pid", F.coalesce(F.sum("_sw_cnt").over(w), F.lit(0)).alias("_sw_off"))
    with_pos = (ranged.join(F.broadcast(offsets), "_sw_pid")
                .withColumn("_sw_g", F.col("_sw_off") + F.col("_sw_loc")))
    firsts = (with_pos.groupBy("_sw_pid", *group).agg(F.min("_sw_g").alias("_sw_pmin")))
    starts = (firsts.groupBy(*group).agg(F.min("_sw_pmin").alias("_sw_start")))
    keyed = firsts.join(starts, group).select("_sw_pid", *group, "_sw_start")
    return (with_pos.join(keyed, ["_sw_pid", *group])
            .withColumn(out, (F.col("_sw_g") - F.col("_sw_start") + 1).cast("bigint"))
            .drop("_sw_mid", "_sw_pid", "_sw_loc", "_sw_off", "_sw_g", "_sw_start"))


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int,
                    salt_buckets: int = 32, salt_cols: list | None = None,
                    out: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows of each group under ``order``.

    Two levels, so no task ever holds a whole hot group: first the top ``n``
    per (group, salt) -- Spark inserts a partial group limit before that
    shuffle -- then the top ``n`` of the at most ``n * salt_buckets``
    survivors per group.  ``order`` must be total.
    """
    salt = F.pmod(F.xxhash64(*(salt_cols if salt_cols is not None else [F.col(c) for c in df.columns])),
                  F.lit(salt_buckets))
    w1 = Window.partitionBy(*group, "_sw_salt").orderBy(*order)
    w2 = Window.partitionBy(*group).orderBy(*order)
    stage1 = (df.withColumn("_sw_salt", salt)
              .withColumn("_sw_r1", F.row_number().over(w1))
              .where(F.col("_sw_r1") <= n).drop("_sw_r1", "_sw_salt"))
    rn = out or "_sw_r2"
    res = stage1.withColumn(rn, F.row_number().over(w2)).where(F.col(rn) <= n)
    return res if out else res.drop(rn)
