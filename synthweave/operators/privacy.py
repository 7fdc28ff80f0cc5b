"""Privacy operators (D1-D5): bounded noised sums and an RDP ledger.

* :func:`clip_sum` -- per-unit L2 clipping, then a sum per coordinate, plus
  Gaussian noise ``sigma * C``.  The noise is a deterministic function of
  ``(coordinate, seed)`` (Box-Muller over hash-derived uniforms), so a retried
  task adds exactly the same noise.  Production runs must use a fresh secret
  seed; the fixed seed is for tests only.
* :func:`rdp_ledger` -- the Renyi-DP cost of the subsampled Gaussian
  mechanism at integer orders, composed over steps and converted to
  ``(epsilon, delta)``.  Runs x orders x binomial terms are rows; the
  log-sum-exp over terms is a window over at most ``max_order + 1`` rows.
  Integer orders give a valid, slightly looser bound than fractional ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthweave.functions.keys import HASH_RANGE, hash_bits

ORDERS = (2, 64)


def clip_sum(df: DataFrame, unit: str, coord: str, value: str, clip: float,
             sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """``sum_u v_u * min(1, C / ||v_u||)`` per coordinate, plus N(0, (sigma C)^2).

    ``df`` holds one row per (unit, coordinate).  Norms come from a group-by
    on the unit joined back on the unit key (one row per unit on that side).
    """
    norms = df.groupBy(unit).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_sw_norm"))
    scale = F.when(F.col("_sw_norm") > clip, F.lit(clip) / F.col("_sw_norm")).otherwise(F.lit(1.0))
    clipped = df.join(norms, unit).withColumn("_sw_v", F.col(value) * scale)
    total = clipped.groupBy(coord).agg(F.sum("_sw_v").alias("clipped_sum"),
                                       F.count(F.lit(1)).alias("n_units"))
    if sigma == 0:
        return total.withColumn("noised_sum", F.col("clipped_sum"))
    return total.withColumn("noised_sum", F.col("clipped_sum") + F.lit(sigma * clip) * gaussian(coord, seed))


def gaussian(key: str, seed: int):
    """Standard normal draw determined by ``(key, seed)`` (Box-Muller)."""
    u1 = (hash_bits(key, F.lit("u1"), seed=seed) + 0.5) / float(HASH_RANGE)
    u2 = (hash_bits(key, F.lit("u2"), seed=seed) + 0.5) / float(HASH_RANGE)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def rdp_terms(runs: DataFrame, q: str = "q", sigma: str = "sigma", orders=ORDERS) -> DataFrame:
    """RDP of one step at each integer order ``alpha`` for every run row.

    ``ln sum_k C(a,k) (1-q)^(a-k) q^k exp((k^2-k) / (2 s^2)) / (a - 1)``;
    ``ln C(a,k)`` is a running sum of ``ln(a-j+1) - ln j``.
    """
    lo, hi = orders
    a = runs.withColumn("alpha", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    t = a.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("alpha"))))
    key = [c for c in a.columns]
    w = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.log(F.col("alpha") - F.col("k") + 1) - F.log(F.col("k")))
    t = t.withColumn("_lb", F.sum(step).over(w))
    term = (F.col("_lb") + (F.col("alpha") - F.col("k")) * F.log1p(-F.col(q)) + F.col("k") * F.log(F.col(q))
            + (F.col("k") * F.col("k") - F.col("k")) / (2 * F.col(sigma) * F.col(sigma)))
    t = t.withColumn("_t", term)
    mx = F.max("_t").over(Window.partitionBy(*key))
    t = t.withColumn("_m", mx)
    agg = t.groupBy(*key).agg(F.first("_m").alias("_m"), F.sum(F.exp(F.col("_t") - F.col("_m"))).alias("_s"))
    rdp = (F.when(F.col(q) >= 1, F.col("alpha") / (2 * F.col(sigma) * F.col(sigma)))
           .when(F.col(q) <= 0, F.lit(0.0))
           .otherwise((F.col("_m") + F.log("_s")) / (F.col("alpha") - 1)))
    return agg.withColumn("rdp", rdp).drop("_m", "_s")


def rdp_array(q: Column, sigma: Column, orders: tuple[int, int] = ORDERS) -> Column:
    """D3 in one expression: a step's Rényi divergence at every order of the range, as an array.

    Row-local, so it also runs on streams; the log-sum-exp over the binomial
    terms keeps the largest term and the rest's sum relative to it.
    """
    q, sigma = q.cast("double"), sigma.cast("double")

    def divergence(alpha: Column) -> Column:
        def add(acc: Column, k: Column) -> Column:
            lb = acc["lb"] + F.when(k == 0, F.lit(0.0)).otherwise(F.log(alpha - k + 1) - F.log(k))
            t = lb + (alpha - k) * F.log1p(-q) + k * F.log(q) + (k * k - k) / (2 * sigma * sigma)
            m = F.greatest(acc["m"], t)
            return F.struct(lb.alias("lb"), m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(t - m)).alias("s"))

        start = F.struct(F.lit(0.0).alias("lb"), F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))
        sampled = F.aggregate(F.sequence(F.lit(0), alpha), start, add, lambda acc: (acc["m"] + F.log(acc["s"])) / (alpha - 1))
        return F.when(q >= 1, alpha / (2 * sigma * sigma)).when(q <= 0, F.lit(0.0)).otherwise(sampled)

    return F.transform(F.sequence(F.lit(orders[0]), F.lit(orders[1])), divergence)


def rdp_ledger(runs: DataFrame, run_key: list[str], q: str = "q", sigma: str = "sigma", steps: str = "steps",
               delta: str = "delta", orders=ORDERS) -> DataFrame:
    """D3: ``eps = min_a  rdp_a * steps - (ln delta + ln a) / (a - 1) + ln((a - 1) / a)``, floored at 0."""
    r = rdp_terms(runs, q, sigma, orders)
    eps_a = (F.col("rdp") * F.col(steps) - (F.log(F.col(delta)) + F.log("alpha")) / (F.col("alpha") - 1)
             + F.log((F.col("alpha") - 1) / F.col("alpha")))
    r = r.withColumn("_eps", eps_a)
    best = r.groupBy(*run_key).agg(F.min_by("alpha", "_eps").alias("best_alpha"), F.min("_eps").alias("_e"))
    return (runs.join(best, run_key)
            .withColumn("epsilon", F.greatest(F.col("_e"), F.lit(0.0))).drop("_e"))


def calibrate_sigma(runs: DataFrame, run_key: list[str], target_eps: float, sigmas: list[float],
                    **kw) -> DataFrame:
    """The smallest noise multiplier on a grid whose epsilon meets the target."""
    grid = runs.withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    led = rdp_ledger(grid, run_key + ["sigma"], **kw)
    return (led.where(F.col("epsilon") <= target_eps)
            .groupBy(*run_key).agg(F.min("sigma").alias("sigma")))


def sample_rate(n_units: str, batch: int, world: int = 1, accumulation: int = 1):
    """``q = batch * world * accumulation / units`` (capped at 1)."""
    return F.least(F.lit(float(batch * world * accumulation)) / F.col(n_units), F.lit(1.0))
