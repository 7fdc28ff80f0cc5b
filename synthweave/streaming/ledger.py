"""D5 as a running check: a stream of training entries composed into each run's privacy ledger.

An entry says that a run took ``steps`` steps at sample rate ``q`` and noise
``sigma``.  The Rényi divergence of one step at every order is a column
expression (``privacy.rdp_array``); the state of a run is its step count and
its sums over the orders, so it has one size however long the run is.  State
lies in the stream's checkpoint folder and survives lost executors and
restarts.

Entries compose by addition, so epsilon after a batch does not depend on
their order; within a batch they are composed by ``entry``, and a late one
counts when it comes.  Entries with a null among ``q``, ``sigma`` or
``steps``, or with no step, count nothing.  ``delta`` is the entry's own; one
without it is composed, but not checked.  A run's entries of one micro-batch are held by one task: the files
of a trigger (``read_json_stream``'s ``max_files``) bound them.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from synthweave.operators.privacy import ORDERS, rdp_array
from synthweave.session import checkpoint_dir


def epsilons(totals: np.ndarray, delta: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Epsilon of each row of summed divergences (a column per order) at its delta, floored at 0."""
    at = totals - (np.log(delta)[:, None] + np.log(orders)) / (orders - 1) + np.log((orders - 1) / orders)
    return np.maximum(at.min(axis=1), 0.0)


def running_budget(entries: DataFrame, run_key: list[str], max_eps: float, orders: tuple[int, int] = ORDERS) -> DataFrame:
    """``(run_key, entry, steps, epsilon, first)`` of every entry after which a run's epsilon exceeds ``max_eps``.

    ``entries``: a streaming DataFrame ``(run_key, entry, q, sigma, steps,
    delta)``; ``steps`` of the result counts from the run's start, ``first``
    marks the entry that passed the budget, at which a trainer stops.
    """
    alphas = np.arange(orders[0], orders[1] + 1, dtype=np.float64)
    ready = entries.where("q IS NOT NULL AND sigma IS NOT NULL AND steps > 0")
    ready = ready.select(*run_key, "entry", F.col("steps").cast("bigint").alias("steps"), F.col("delta").cast("double").alias("delta"),
                         rdp_array(F.col("q"), F.col("sigma"), orders).alias("rdp"))

    def compose(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, sums, passed = state.get if state.exists else (0, [0.0] * len(alphas), False)
        pdf = pd.concat(list(frames), ignore_index=True).sort_values("entry", kind="stable", ignore_index=True)
        steps = pdf["steps"].to_numpy()
        totals = np.asarray(sums) + np.cumsum(np.stack(pdf["rdp"].to_list()) * steps[:, None], axis=0)
        taken = before + np.cumsum(steps)
        eps = epsilons(totals, pdf["delta"].to_numpy(), alphas)
        over = np.flatnonzero(eps > max_eps)
        state.update((int(taken[-1]), totals[-1].tolist(), bool(passed or len(over))))
        if len(over):
            out = pd.DataFrame({"entry": pdf["entry"].to_numpy()[over], "steps": taken[over], "epsilon": eps[over], "first": False})
            out.loc[0, "first"] = not passed
            for name, value in zip(reversed(run_key), reversed(key)):
                out.insert(0, name, value)
            yield out

    own = ", ".join(f"`{k}` {entries.schema[k].dataType.simpleString()}" for k in run_key)
    return ready.groupBy(*run_key).applyInPandasWithState(
        compose, f"{own}, entry bigint, steps bigint, epsilon double, first boolean", "steps bigint, sums array<double>, passed boolean",
        "append", GroupStateTimeout.NoTimeout)


def run_budget(spark: SparkSession, entries: DataFrame, run_key: list[str], max_eps: float, out_path: str, name: str,
               available_now: bool = True) -> StreamingQuery:
    """Run :func:`running_budget` into Parquet files; a later call with the same ``name`` goes on from the stored state."""
    writer = (running_budget(entries, run_key, max_eps).writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", os.path.join(checkpoint_dir(spark), "streams", name)).option("path", out_path))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
