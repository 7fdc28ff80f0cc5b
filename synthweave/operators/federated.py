"""Aggregating client updates.

Model state is a long table ``(key, pos, value)``; client updates are
``(round, client_id, key, pos, value)``.  Every server rule is one shuffle on
``(key, pos)`` with map-side partial sums, plus joins against per-client
tables (sizes, participation, quality) whose size is the client count.

Defaults (fixed values of the reference's configuration): momentum .5,
tau 1e-3, eta 1e-2, beta1 .9, beta2 .99, mu .01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOMENTUM = 0.5
TAU = 1e-3
ETA = 1e-2
BETA1 = 0.9
BETA2 = 0.99
MU = 0.01

PARAM = ["key", "pos"]


def _round_inputs(updates: DataFrame, sizes: DataFrame, participants: DataFrame) -> DataFrame:
    """Updates of this round's participants with their sample counts."""
    return (updates.join(participants.select("client_id"), "client_id", "left_semi")
            .join(sizes.select("client_id", "n"), "client_id"))


def fed_avg(updates: DataFrame, sizes: DataFrame, participants: DataFrame) -> DataFrame:
    """G1: ``g = sum(w * n_c) / sum(n_c)`` over participants."""
    u = _round_inputs(updates, sizes, participants)
    return (u.groupBy(*PARAM).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")))


def weighted_delta(updates, sizes, participants, glob) -> DataFrame:
    """``sum((w - g) * n_c) / N`` per parameter."""
    u = _round_inputs(updates, sizes, participants).join(glob.withColumnRenamed("value", "g"), PARAM)
    return u.groupBy(*PARAM).agg(
        (F.sum((F.col("value") - F.col("g")) * F.col("n")) / F.sum("n")).alias("delta"))


def mean_delta(updates, participants, glob) -> DataFrame:
    """Unweighted ``mean(w - g)`` over participants."""
    u = (updates.join(participants.select("client_id"), "client_id", "left_semi")
         .join(glob.withColumnRenamed("value", "g"), PARAM))
    return u.groupBy(*PARAM).agg(F.avg(F.col("value") - F.col("g")).alias("delta"))


def init_state(glob: DataFrame, tau: float = TAU) -> DataFrame:
    """``v = 0``, ``s = tau^2``, SCAFFOLD ``c = 0`` on the parameter space."""
    return glob.select(*PARAM, F.lit(0.0).alias("v"), F.lit(tau * tau).alias("s"), F.lit(0.0).alias("c"))


def fed_avgm(updates, sizes, participants, glob, state, round_idx: int,
             momentum: float = MOMENTUM) -> DataFrame:
    """``v = m v + (1 - m) delta`` (round 0: ``v = delta``); ``g += v``.

    Output ``(key, pos, value, v)``: the new global and the new momentum.
    """
    d = weighted_delta(updates, sizes, participants, glob)
    j = glob.join(d, PARAM).join(state.select(*PARAM, F.col("v").alias("v0")), PARAM)
    v = F.col("delta") if round_idx == 0 else momentum * F.col("v0") + (1 - momentum) * F.col("delta")
    return j.select(*PARAM, (F.col("value") + v).alias("value"), v.alias("v"))


def _adaptive(updates, participants, glob, state, round_idx, rule, beta1, beta2, eta, tau):
    d = mean_delta(updates, participants, glob)
    j = glob.join(d, PARAM).join(state.select(*PARAM, F.col("v").alias("v0"), F.col("s").alias("s0")), PARAM)
    if rule == "adagrad":
        v = F.col("delta")
    else:
        v = F.col("delta") if round_idx == 0 else beta1 * F.col("v0") + (1 - beta1) * F.col("delta")
    j = j.withColumn("v", v)
    v2 = F.col("v") * F.col("v")
    if rule == "adagrad":
        s = F.col("s0") + v2
    elif rule == "yogi":
        s = F.col("s0") - (1 - beta2) * v2 * F.signum(F.col("s0") - v2)
    else:  # adam
        s = beta2 * F.col("s0") + (1 - beta2) * v2
    j = j.withColumn("s", s)
    g = F.col("value") + eta * F.col("v") / (F.sqrt("s") + tau)
    return j.select(*PARAM, g.alias("value"), "v", "s")


def fed_adagrad(updates, participants, glob, state, round_idx=0, eta=ETA, tau=TAU):
    """G4."""
    return _adaptive(updates, participants, glob, state, round_idx, "adagrad", BETA1, BETA2, eta, tau)


def fed_yogi(updates, participants, glob, state, round_idx=0, beta1=BETA1, beta2=BETA2, eta=ETA, tau=TAU):
    """G5."""
    return _adaptive(updates, participants, glob, state, round_idx, "yogi", beta1, beta2, eta, tau)


def fed_adam(updates, participants, glob, state, round_idx=0, beta1=BETA1, beta2=BETA2, eta=ETA, tau=TAU):
    """G6."""
    return _adaptive(updates, participants, glob, state, round_idx, "adam", beta1, beta2, eta, tau)


def fed_quality(updates, sizes, participants, quality: DataFrame) -> DataFrame:
    """``sum(w * A_c * n_c) / (N * sum_all(A))``; ``sum_all`` is over *all* clients."""
    total_a = quality.select(F.sum("a")).scalar()
    u = _round_inputs(updates, sizes, participants).join(quality.select("client_id", "a"), "client_id")
    return u.groupBy(*PARAM).agg(
        (F.sum(F.col("value") * F.col("a") * F.col("n")) / (F.sum("n") * total_a)).alias("value"))


def scaffold_variate(updates, glob, state_c: DataFrame, client_c: DataFrame,
                     local_steps: int, lr: float) -> DataFrame:
    """``c_i+ = (g - w) / (K lr) - (c - c_i)``; ``delta = c_i+ - c_i``.

    ``state_c``: ``(key, pos, c)``; ``client_c``: ``(client_id, key, pos, c_i)``
    (missing = 0).  Output ``(client_id, key, pos, c_i, delta)``.
    """
    j = (updates.join(glob.withColumnRenamed("value", "g"), PARAM)
         .join(state_c.select(*PARAM, "c"), PARAM)
         .join(client_c, ["client_id", *PARAM], "left")
         .withColumn("c_i0", F.coalesce(F.col("c_i"), F.lit(0.0))))
    new = (F.col("g") - F.col("value")) / (local_steps * lr) - (F.col("c") - F.col("c_i0"))
    return j.select("client_id", *PARAM, new.alias("c_i"), (new - F.col("c_i0")).alias("delta"))


def fed_scaffold(updates, sizes, participants, state_c, deltas, num_clients: int) -> DataFrame:
    """FedAvg for ``g``; ``c += sum_participants(delta) / num_clients``."""
    g = fed_avg(updates, sizes, participants)
    dc = (deltas.join(participants.select("client_id"), "client_id", "left_semi")
          .groupBy(*PARAM).agg((F.sum("delta") / num_clients).alias("dc")))
    return (g.join(state_c.select(*PARAM, "c"), PARAM).join(dc, PARAM, "left")
            .select(*PARAM, "value", (F.col("c") + F.coalesce(F.col("dc"), F.lit(0.0))).alias("c")))


def client_drift(updates, glob, mu: float = MU) -> DataFrame:
    """FedProx penalty ``mu / 2 * sum (w - g)^2`` per client."""
    j = updates.join(glob.withColumnRenamed("value", "g"), PARAM)
    return j.groupBy("client_id").agg(
        (F.lit(mu / 2) * F.sum((F.col("value") - F.col("g")) ** 2)).alias("drift"))


def round_metrics(losses: DataFrame, clients: DataFrame, participants: DataFrame) -> DataFrame:
    """A12 + J6: per round mean loss over the clients that trained.

    ``participants (round, client_id)`` left-joins the loss table, so a client
    that did not train has a NULL loss (the reference's -1) and is skipped.
    """
    grid = participants.select("round", "client_id")
    j = grid.join(losses, ["round", "client_id"], "left")
    return j.groupBy("round").agg(F.avg("loss").alias("mean_loss"),
                                  F.count("loss").alias("n_trained"),
                                  F.count(F.lit(1)).alias("n_participants"))
