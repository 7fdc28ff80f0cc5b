"""Registered queries: privacy accounting, author sampling and mapping, round subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthweave.operators import privacy as D
from synthweave.operators import sample as M
from synthweave.operators import shard as S
from synthweave.plans.oracle_views import md5_key, with_views
from synthweave.plans.registry import query
from synthweave.sources import fixtures as V
from synthweave.sources.tables import load

CLIP = 100.0
DELTA = 1e-5
STEPS = 5000
BATCH = 16
SIGMAS = [0.5 + 0.25 * i for i in range(11)]


@query("dp_clip_sum", with_views("v_contrib", extra="""
  nrm AS (SELECT author, sqrt(sum(value * value)) AS norm FROM v_contrib GROUP BY author)""") + f"""
SELECT key, round(sum(value * CASE WHEN norm > {CLIP} THEN {CLIP} / norm ELSE 1.0 END), 9) AS clipped_sum,
       count(*) AS n_units
FROM v_contrib JOIN nrm USING (author) GROUP BY key""")
def dp_clip_sum(spark, sf_dir):
    return D.clip_sum(V.v_contrib(spark, sf_dir), "author", "key", "value", CLIP).select("key", "clipped_sum", "n_units")


def _u(tag):
    return (f"((('0x' || substr(md5(CAST(key AS VARCHAR) || ':' || '{tag}' || ':' || '42'), 1, 15))::BIGINT) + 0.5)"
            " / 1152921504606846976.0")


@query("dp_noised_sum", with_views("v_contrib", extra="""
  nrm AS (SELECT author, sqrt(sum(value * value)) AS norm FROM v_contrib GROUP BY author),""" + f"""
  cs AS (SELECT key, sum(value * CASE WHEN norm > {CLIP} THEN {CLIP} / norm ELSE 1.0 END) AS s
         FROM v_contrib JOIN nrm USING (author) GROUP BY key)""") + f"""
SELECT key, round(s + {CLIP} * sqrt(-2.0 * ln({_u('u1')})) * cos(2.0 * pi() * {_u('u2')}), 9) AS noised_sum FROM cs""")
def dp_noised_sum(spark, sf_dir):
    return D.clip_sum(V.v_contrib(spark, sf_dir), "author", "key", "value", CLIP, sigma=1.0, seed=42) \
        .select("key", "noised_sum")


def runs(spark, sf_dir):
    """One accounting run per client: sample rate from its size, fixed steps and delta."""
    sizes = V.v_client_sizes(spark, sf_dir)
    return sizes.select("client_id", D.sample_rate("n", BATCH).alias("q"), F.lit(1.0).alias("sigma"),
                        F.lit(STEPS).alias("steps"), F.lit(DELTA).alias("delta"))


def _sql_ledger(runs_sql: str, key: str) -> str:
    return f"""
  runs AS ({runs_sql}),
  ta AS (SELECT runs.*, CAST(unnest(range(2, 65)) AS BIGINT) AS alpha FROM runs),
  tk AS (SELECT ta.*, CAST(unnest(range(0, alpha + 1)) AS BIGINT) AS k FROM ta),
  tt AS (SELECT {key}, q, sigma, steps, delta, alpha,
                lgamma(alpha + 1) - lgamma(k + 1) - lgamma(alpha - k + 1) + (alpha - k) * ln(1 - q) + k * ln(q)
                + (k * k - k) / (2 * sigma * sigma) AS t FROM tk),
  ra AS (SELECT {key}, steps, delta, alpha, (max(t) + ln(sum(exp(t - mx)))) / (alpha - 1) AS rdp
         FROM (SELECT *, max(t) OVER (PARTITION BY {key}, alpha) AS mx FROM tt) x GROUP BY {key}, steps, delta, alpha),
  ea AS (SELECT {key}, alpha, rdp * steps - (ln(delta) + ln(alpha)) / (alpha - 1) + ln((alpha - 1) / alpha) AS e FROM ra),
  led AS (SELECT {key}, arg_min(alpha, e) AS best_alpha, greatest(min(e), 0) AS epsilon FROM ea GROUP BY {key})"""


_RUNS_SQL = f"SELECT client_id, least({float(BATCH)} / n, 1.0) AS q, 1.0 AS sigma, {STEPS} AS steps, {DELTA} AS delta FROM v_client_sizes"


@query("dp_ledger", with_views("v_client_sizes", extra=_sql_ledger(_RUNS_SQL, "client_id").strip()) + """
SELECT client_id, best_alpha, round(epsilon, 9) AS epsilon FROM led""")
def dp_ledger(spark, sf_dir):
    return D.rdp_ledger(runs(spark, sf_dir), ["client_id"]).select(
        "client_id", F.col("best_alpha").cast("bigint").alias("best_alpha"), "epsilon")


_SIG_SQL = (f"SELECT client_id, least({float(BATCH)} / n, 1.0) AS q, s.sigma, {STEPS} AS steps, {DELTA} AS delta "
            f"FROM v_client_sizes, (SELECT CAST(unnest([{', '.join(repr(x) for x in SIGMAS)}]) AS DOUBLE) AS sigma) s")


@query("dp_calibrate", with_views("v_client_sizes", extra=_sql_ledger(_SIG_SQL, "client_id, sigma").strip()) + """
SELECT client_id, min(sigma) AS sigma FROM led WHERE epsilon <= 20 GROUP BY client_id""")
def dp_calibrate(spark, sf_dir):
    base = runs(spark, sf_dir).drop("sigma")
    return D.calibrate_sigma(base, ["client_id"], 20.0, SIGMAS)


_CKPT_SQL = (f"SELECT client_id, step_at AS steps, least({float(BATCH)} / n, 1.0) AS q, 1.0 AS sigma, {DELTA} AS delta "
             f"FROM v_client_sizes, (SELECT unnest(range(500, {STEPS} + 1, 500)) AS step_at) c")


@query("dp_over_budget", with_views("v_client_sizes", extra=_sql_ledger(_CKPT_SQL, "client_id, steps").strip()) + """
SELECT client_id, CAST(steps AS BIGINT) AS steps, round(epsilon, 9) AS epsilon FROM led WHERE epsilon > 1""")
def dp_over_budget(spark, sf_dir):
    from synthweave.plans.jobs import over_budget
    return over_budget(runs(spark, sf_dir).drop("steps"), ["client_id"], 500, STEPS, 1.0)


@query("author_sample", with_views("v_contrib") + """
SELECT author, key FROM v_contrib WHERE author IN (
  SELECT DISTINCT author FROM v_contrib
  WHERE ('0x' || substr(md5(CAST(author AS VARCHAR) || ':' || '3'), 1, 15))::BIGINT < """ + str(int(0.2 * (1 << 60))) + ")")
def author_sample(spark, sf_dir):
    return M.author_sample(V.v_contrib(spark, sf_dir), 0.2, seed=3).select("author", "key")


@query("author_map", """
SELECT user_id AS author, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, event_id AS row_id
FROM events""")
def author_map(spark, sf_dir):
    ev = load(spark, sf_dir, "events").select(F.col("user_id").alias("author"), F.col("event_id").alias("row_id"))
    return S.author_map(ev)


@query("round_subset", with_views("v_corpus") + f"""
SELECT client_id, row_id, CAST(3 AS INTEGER) AS round FROM (
  SELECT client_id, row_id, row_number() OVER (PARTITION BY client_id ORDER BY {md5_key('row_id', 3)}, row_id) AS rn
  FROM v_corpus) t WHERE rn <= 10""")
def round_subset(spark, sf_dir):
    return M.round_subset(V.v_corpus(spark, sf_dir), 3, 10).select("client_id", "row_id", "round")
