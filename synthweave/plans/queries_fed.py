"""Registered queries: federated server rules, client draw, round metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthweave.operators import federated as FD
from synthweave.operators import sample as M
from synthweave.plans.oracle_views import with_views
from synthweave.plans.registry import query
from synthweave.sources import fixtures as V
from synthweave.sources.tables import load

K_CLIENTS = 4
LOCAL_STEPS = 10
LR = 0.01


def v_global(spark, sf_dir):
    """Previous global model: ``avg(l_tax)`` on the same parameter space."""
    li = load(spark, sf_dir, "lineitem")
    return (li.groupBy(F.concat("l_returnflag", "l_linestatus").alias("key"),
                       F.col("l_linenumber").cast("int").alias("pos"))
            .agg(F.avg("l_tax").alias("value")))


def participants(spark, sf_dir, n_rounds=1, k=K_CLIENTS):
    return M.client_draw(V.v_client_sizes(spark, sf_dir).select("client_id"), n_rounds, k)


def quality(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return (li.groupBy((F.col("l_suppkey") % 10).cast("int").alias("client_id"))
            .agg((F.avg("l_quantity") / 50).alias("a")))


_BASE = """
  v_global AS (SELECT l_returnflag || l_linestatus AS key, CAST(l_linenumber AS INTEGER) AS pos,
                      avg(l_tax) AS value FROM lineitem GROUP BY 1, 2),
  grid AS (SELECT r.round, c.client_id FROM v_client_sizes c, range(0, {rounds}) r(round)),
  parts AS (SELECT CAST(round AS INTEGER) AS round, client_id FROM (
              SELECT round, client_id, row_number() OVER (PARTITION BY round ORDER BY
                     md5(CAST(client_id AS VARCHAR) || ':' || CAST(round AS VARCHAR) || ':' || '0'), client_id) AS rn
              FROM grid) t WHERE rn <= """ + str(K_CLIENTS) + """),
  u AS (SELECT x.*, s.n FROM v_updates x JOIN v_client_sizes s USING (client_id))"""


def _base(rounds=1, extra=""):
    return with_views("v_updates", "v_client_sizes", extra=_BASE.format(rounds=rounds).strip() + ("," + extra if extra else ""))


@query("client_draw", _base(rounds=20) + """
SELECT round, client_id FROM parts""")
def client_draw(spark, sf_dir):
    return participants(spark, sf_dir, 20).select(F.col("round").cast("int").alias("round"), "client_id")


@query("client_draw_local", with_views("v_client_sizes") + """
SELECT CAST(r.round AS INTEGER) AS round, client_id FROM v_client_sizes, range(0, 5) r(round) WHERE client_id = 3""")
def client_draw_local(spark, sf_dir):
    return (M.client_draw(V.v_client_sizes(spark, sf_dir).select("client_id"), 5, K_CLIENTS, fed_alg="local3")
            .select(F.col("round").cast("int").alias("round"), "client_id"))


_AVG = """
  avg0 AS (SELECT key, pos, sum(value * n) / sum(n) AS value FROM u WHERE client_id IN (SELECT client_id FROM parts WHERE round = 0)
           GROUP BY key, pos)"""


@query("fed_avg", _base(extra=_AVG) + """
SELECT key, pos, round(value, 9) AS value FROM avg0""")
def fed_avg(spark, sf_dir):
    p = participants(spark, sf_dir).where(F.col("round") == 0)
    return FD.fed_avg(V.v_updates(spark, sf_dir), V.v_client_sizes(spark, sf_dir), p)


@query("job_fed_round", _base(extra=_AVG) + """
SELECT a.key, a.pos, round(a.value, 9) AS value, round(a.value - g.value, 9) AS change
FROM avg0 a JOIN v_global g USING (key, pos)""")
def job_fed_round(spark, sf_dir):
    from synthweave.plans.jobs import job_fed_round as run
    return run(V.v_updates(spark, sf_dir), V.v_client_sizes(spark, sf_dir),
               participants(spark, sf_dir), v_global(spark, sf_dir))


def _sql_wdelta(r: int, g: str) -> str:
    return f"""
  wd{r} AS (SELECT u.key, u.pos, sum((u.value - g.value) * u.n) / sum(u.n) AS delta
            FROM u JOIN {g} g USING (key, pos)
            WHERE u.client_id IN (SELECT client_id FROM parts WHERE round = {r}) GROUP BY u.key, u.pos)"""


@query("fed_avgm", _base(rounds=2, extra=_sql_wdelta(0, "v_global") + """,
  m0 AS (SELECT key, pos, g.value + d.delta AS value, d.delta AS v FROM v_global g JOIN wd0 d USING (key, pos)),""" +
                        _sql_wdelta(1, "m0") + """,
  m1 AS (SELECT key, pos, g.value + (0.5 * g.v + 0.5 * d.delta) AS value, 0.5 * g.v + 0.5 * d.delta AS v
         FROM m0 g JOIN wd1 d USING (key, pos))""") + """
SELECT key, pos, round(value, 9) AS value, round(v, 9) AS v FROM m1""")
def fed_avgm(spark, sf_dir):
    up, sz, gl = V.v_updates(spark, sf_dir), V.v_client_sizes(spark, sf_dir), v_global(spark, sf_dir)
    parts = participants(spark, sf_dir, 2)
    st = FD.init_state(gl)
    r0 = FD.fed_avgm(up, sz, parts.where(F.col("round") == 0), gl, st, 0)
    r1 = FD.fed_avgm(up, sz, parts.where(F.col("round") == 1), r0.select("key", "pos", "value"),
                     r0.select("key", "pos", "v"), 1)
    return r1


def _sql_adaptive(rule: str) -> str:
    def step(r, g_table, v_prev, s_prev):
        v = "d.delta" if (rule == "adagrad" or r == 0) else f"0.9 * ({v_prev}) + 0.1 * d.delta"
        s = {"adagrad": "s_prev + v * v",
             "yogi": "s_prev - 0.01 * v * v * sign(s_prev - v * v)",
             "adam": "0.99 * s_prev + 0.01 * v * v"}[rule]
        return f"""
  md{r} AS (SELECT u.key, u.pos, avg(u.value - g.value) AS delta FROM u JOIN {g_table} g USING (key, pos)
            WHERE u.client_id IN (SELECT client_id FROM parts WHERE round = {r}) GROUP BY u.key, u.pos),
  a{r}v AS (SELECT key, pos, g.value AS g, {v} AS v, {s_prev} AS s_prev FROM {g_table} g JOIN md{r} d USING (key, pos)),
  a{r} AS (SELECT key, pos, g, v, {s} AS s FROM a{r}v),
  r{r} AS (SELECT key, pos, g + 0.01 * v / (sqrt(s) + 0.001) AS value, v, s FROM a{r})"""
    return step(0, "v_global", "0", "0.000001") + "," + step(1, "r0", "g.v", "g.s")


def _adaptive_query(rule):
    def build(spark, sf_dir):
        up, gl = V.v_updates(spark, sf_dir), v_global(spark, sf_dir)
        parts = participants(spark, sf_dir, 2)
        fn = {"adagrad": FD.fed_adagrad, "yogi": FD.fed_yogi, "adam": FD.fed_adam}[rule]
        r0 = fn(up, parts.where(F.col("round") == 0), gl, FD.init_state(gl), 0)
        r1 = fn(up, parts.where(F.col("round") == 1), r0.select("key", "pos", "value"),
                r0.select("key", "pos", "v", "s"), 1)
        return r1.select("key", "pos", "value", "v", "s")
    return build


for _rule in ("adagrad", "yogi", "adam"):
    query(f"fed_{_rule}", _base(rounds=2, extra=_sql_adaptive(_rule).strip()) + """
SELECT key, pos, round(value, 9) AS value, round(v, 9) AS v, round(s, 9) AS s FROM r1""")(_adaptive_query(_rule))


@query("fed_quality", _base(extra="""
  q AS (SELECT CAST(l_suppkey % 10 AS INTEGER) AS client_id, avg(l_quantity) / 50 AS a FROM lineitem GROUP BY 1)""") + """
SELECT key, pos, round(sum(u.value * q.a * u.n) / (sum(u.n) * (SELECT sum(a) FROM q)), 9) AS value
FROM u JOIN q USING (client_id) WHERE client_id IN (SELECT client_id FROM parts WHERE round = 0)
GROUP BY key, pos""")
def fed_quality(spark, sf_dir):
    p = participants(spark, sf_dir).where(F.col("round") == 0)
    return FD.fed_quality(V.v_updates(spark, sf_dir), V.v_client_sizes(spark, sf_dir), p, quality(spark, sf_dir))


_VARIATE = f"""
  var AS (SELECT u.client_id, u.key, u.pos, (g.value - u.value) / ({LOCAL_STEPS} * {LR}) AS c_i,
                 (g.value - u.value) / ({LOCAL_STEPS} * {LR}) AS delta
          FROM v_updates u JOIN v_global g USING (key, pos))"""


@query("scaffold_variate", _base(extra=_VARIATE) + """
SELECT client_id, key, pos, round(c_i, 9) AS c_i, round(delta, 9) AS delta FROM var""")
def scaffold_variate(spark, sf_dir):
    gl = v_global(spark, sf_dir)
    up = V.v_updates(spark, sf_dir)
    empty = up.select("client_id", "key", "pos", F.lit(0.0).alias("c_i")).where(F.lit(False))
    return FD.scaffold_variate(up, gl, FD.init_state(gl), empty, LOCAL_STEPS, LR)


@query("fed_scaffold", _base(extra=_AVG + "," + _VARIATE) + """
SELECT a.key, a.pos, round(a.value, 9) AS value,
       round(coalesce(d.dc, 0), 9) AS c
FROM avg0 a LEFT JOIN (SELECT key, pos, sum(delta) / 10 AS dc FROM var
                       WHERE client_id IN (SELECT client_id FROM parts WHERE round = 0) GROUP BY key, pos) d
USING (key, pos)""")
def fed_scaffold(spark, sf_dir):
    gl = v_global(spark, sf_dir)
    up, sz = V.v_updates(spark, sf_dir), V.v_client_sizes(spark, sf_dir)
    st = FD.init_state(gl)
    empty = up.select("client_id", "key", "pos", F.lit(0.0).alias("c_i")).where(F.lit(False))
    deltas = FD.scaffold_variate(up, gl, st, empty, LOCAL_STEPS, LR)
    p = participants(spark, sf_dir).where(F.col("round") == 0)
    return FD.fed_scaffold(up, sz, p, st, deltas, num_clients=10)


@query("client_drift", _base() + """
SELECT client_id, round(0.005 * sum((u.value - g.value) * (u.value - g.value)), 9) AS drift
FROM v_updates u JOIN v_global g USING (key, pos) GROUP BY client_id""")
def client_drift(spark, sf_dir):
    return FD.client_drift(V.v_updates(spark, sf_dir), v_global(spark, sf_dir))


_LOSS = """
  trained AS (SELECT p.round, p.client_id, avg(abs(x.value - g.value)) / (p.round + 1) AS loss
              FROM parts p JOIN v_updates x USING (client_id) JOIN v_global g USING (key, pos)
              GROUP BY p.round, p.client_id),
  matrix AS (SELECT CAST(gr.round AS INTEGER) AS round, gr.client_id, coalesce(t.loss, -1) AS loss
             FROM grid gr LEFT JOIN trained t ON t.round = gr.round AND t.client_id = gr.client_id)"""


def losses(spark, sf_dir):
    return V.v_losses(spark, sf_dir, participants(spark, sf_dir, 20), v_global(spark, sf_dir))


@query("loss_matrix", _base(rounds=20, extra=_LOSS) + """
SELECT round, client_id, round(loss, 9) AS loss FROM matrix""")
def loss_matrix(spark, sf_dir):
    from synthweave.plans.jobs import loss_matrix as lm
    return lm(losses(spark, sf_dir), V.v_client_sizes(spark, sf_dir), 20)


@query("round_metrics", _base(rounds=20, extra=_LOSS) + """
SELECT round, round(avg(nullif(loss, -1)), 9) AS mean_loss, count(nullif(loss, -1)) AS n_trained,
       count(*) AS n_clients
FROM matrix GROUP BY round""")
def round_metrics(spark, sf_dir):
    from synthweave.plans.jobs import loss_matrix as lm
    m = lm(losses(spark, sf_dir), V.v_client_sizes(spark, sf_dir), 20)
    loss = F.when(F.col("loss") != -1, F.col("loss"))
    return m.groupBy("round").agg(F.avg(loss).alias("mean_loss"), F.count(loss).alias("n_trained"),
                                  F.count(F.lit(1)).alias("n_clients"))
