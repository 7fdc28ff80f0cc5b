"""Seed-stable samplers (M1-M7).

Every draw ranks rows by ``md5(concat(key, ':', seed))`` (see
``functions.keys``), so results do not depend on partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthweave.functions.keys import HASH_RANGE, hash_key, hash_order, hash_pos, hash_bits
from synthweave.operators.ranking import nth_row, positions, select_first, top_n_per_group, up_to


def sample_exact(df: DataFrame, n: int, seed: int = 0, key: str = "row_id",
                 check: bool = True) -> DataFrame:
    """M1: exactly ``n`` rows without replacement; error if ``n`` > rows.

    The n-th smallest draw is found by histograms; the sample is a filter.
    """
    order = [*hash_order(key, seed=seed), F.col(key)]
    last = nth_row(df, n, order) if n > 0 else None
    if check and n > 0 and last is None:
        raise ValueError(f"cannot draw {n} rows: the table has fewer")
    return df.where(F.lit(False)) if n <= 0 else df if last is None else df.where(up_to(order, last))


def shuffle_limit(df: DataFrame, n: int, seed: int = 2023, key: str = "row_id") -> DataFrame:
    """M3: seeded shuffle, then the first ``min(n, rows)`` rows."""
    return select_first(df, n, [*hash_order(key, seed=seed), F.col(key)])


def sample_per_group(df: DataFrame, group: str, n: int, seed: int = 0, key: str = "row_id") -> DataFrame:
    """M2 / S3: ``min(n, rows)`` rows of every group (file, client), skew-safe."""
    ranked = df.withColumn("_sw_k", hash_key(key, seed=seed))
    return top_n_per_group(ranked, [group], ["_sw_k", key], n,
                           salt_cols=[F.col(key)]).drop("_sw_k")


def position_index(df: DataFrame, key: str = "row_id", out: str = "pos") -> DataFrame:
    """``(key, out)``: 0-based dense position in order of the integer ``key`` (the reference's row index); no other column travels."""
    return positions(df, key, [F.col(key)], out=out).withColumn(out, F.col(out) - 1)


def dense_positions(df: DataFrame, order: str = "row_id", out: str = "pos") -> DataFrame:
    """The rows with their 0-based position, joined by key."""
    return df.join(position_index(df, order, out), order)


def fewshot_draw(corpus: DataFrame, rounds: DataFrame, k: int = 3,
                 seed: int = 0, round_col: str = "round_id", indexed: DataFrame | None = None,
                 index_list: list[int] | None = None) -> DataFrame:
    """M4 + J1: ``k`` distinct exemplars per round, looked up by position.

    Slot ``s`` draws one of the ``N - s`` positions still free:
    ``md5(r:s:seed) mod (N - s)``, moved past the earlier picks.  Exact
    sampling without replacement, row-local.  ``index_list`` gives every
    round the same positions instead, in that order; one outside the corpus
    fails the job.  ``indexed`` may carry the corpus' ``(row_id, pos)`` when
    the caller already built it.  The job fails when N < k, as the reference
    does.  Texts are joined once, by row id.
    Output: ``(round_id, slot, row_id, instruction, response)``, slot in 0..k-1.
    """
    if indexed is None:
        indexed = position_index(corpus)
    n_rows = corpus.select(F.count(F.lit(1))).scalar()  # scalar subquery
    # each pick is moved past the smaller earlier picks, in ascending order
    def pick(taken, s):
        raw = hash_pos(F.col(round_col), s, seed=seed, n=F.col("_sw_n") - s)
        free = F.aggregate(F.array_sort(taken), raw, lambda x, p: x + F.when(x >= p, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return F.concat(taken, F.array(free))

    picks = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<bigint>"), pick)
    few = F.lit("the corpus holds too few exemplars")
    if index_list is not None:
        fits = F.col("_sw_n") > max([*index_list, -1])
        picks = F.array(*[F.lit(i).cast("bigint") for i in index_list])
        few = F.lit("a listed exemplar lies outside the corpus")
    else:
        fits = F.col("_sw_n") >= k
    picked = F.when(~fits, F.raise_error(few).cast("array<bigint>")).otherwise(picks)
    drawn = (rounds.select(round_col, n_rows.alias("_sw_n"))
             .select(round_col, F.posexplode(picked).alias("slot", "pos"))
             .withColumn("slot", F.col("slot").cast("int")))
    return (drawn.join(indexed.select("row_id", "pos"), "pos").join(corpus.select("row_id", "instruction", "response"), "row_id")
            .select(round_col, "slot", "row_id", "instruction", "response"))


def round_subset(df: DataFrame, round_idx: int, size: int, group: str = "client_id") -> DataFrame:
    """M5: per client, ``size`` rows drawn with seed = round; error if too few."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_sw_n"))
    guarded = (df.join(sizes, group)
               .withColumn("_sw_n", F.when(F.col("_sw_n") < size,
                                           F.raise_error(F.lit("sample larger than population"))
                                           .cast("bigint")).otherwise(F.col("_sw_n"))))
    out = sample_per_group(guarded, group, size, seed=round_idx)
    return out.drop("_sw_n").withColumn("round", F.lit(round_idx).cast("int"))


def client_draw(clients: DataFrame, n_rounds: int, sample_clients: int,
                fed_alg: str = "fedavg", client_col: str = "client_id") -> DataFrame:
    """M6: participating clients per round, ``(round, client_id)``.

    ``local<d>`` / ``dplocal<d>``: only client ``d`` (last character);
    fewer clients than ``sample_clients``: all of them; otherwise a
    seed-per-round draw of ``sample_clients`` clients (hash rank of
    ``client:round``).  Each client row expands into its rounds (a generator,
    not a join); the per-round top-k is the salted two-level limit.
    """
    grid = (clients.select(client_col)
            .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(n_rounds - 1)))))
    if fed_alg.startswith("local") or fed_alg.startswith("dplocal"):
        only = int(fed_alg[-1])
        return grid.where(F.col(client_col) == only).select("round", client_col)
    ranked = grid.withColumn("_sw_k", hash_key(client_col, "round", seed=0))
    return (top_n_per_group(ranked, ["round"], ["_sw_k", client_col], sample_clients,
                            salt_cols=[F.col(client_col)]).select("round", client_col))


def author_sample(df: DataFrame, rate: float, seed: int = 0, author: str = "author") -> DataFrame:
    """M7: Poisson sampling of whole authors with probability ``rate``.

    The decision is made once per author (hash of author and seed), then rows
    follow their author through a semi-join -- no author group is collected.
    """
    authors = (df.select(author).distinct()
               .where(hash_bits(author, seed=seed) < F.lit(int(rate * HASH_RANGE))))
    return df.join(authors, author, "left_semi")
