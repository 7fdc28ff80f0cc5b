"""Registered queries: row-local operators run through Structured Streaming."""

from __future__ import annotations

import os


from pyspark.sql import functions as F

from synthweave.operators import parse as X
from synthweave.plans import queries_privacy as P
from synthweave.plans.registry import ORACLES, query
from synthweave.sources import files as IO
from synthweave.sources import fixtures as V
from synthweave.streaming import ledger as LG
from synthweave.streaming import rowwise as ST


@query("stream_parse_pair")
def stream_parse_pair(spark, sf_dir):
    """X3 over a file stream of raw generations (available-now trigger)."""
    root = IO.scratch(spark, "stream_parse_pair")
    V.v_raw_gen(spark, sf_dir).write.json(os.path.join(root, "in"))
    src = ST.read_json_stream(spark, os.path.join(root, "in"), "round_id long, text string")
    q = ST.run_rowwise(spark, src, lambda d: X.parse_pair(d).select("round_id", "instruction", "output"),
                       os.path.join(root, "out"), name=os.path.basename(root))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(root, "out")).select("round_id", "instruction", "output")


ORACLES["stream_parse_pair"] = ORACLES["parse_pair"]


@query("stream_over_budget", ORACLES["dp_over_budget"])
def stream_over_budget(spark, sf_dir):
    """D5 as a running check: every run's entries of 500 steps as a stream that stops half-way and goes on from its checkpoint."""
    root = IO.scratch(spark, "stream_over_budget")
    every = 500
    entries = P.runs(spark, sf_dir).withColumn("entry", F.explode(F.sequence(F.lit(1), F.lit(P.STEPS // every)))).withColumn("steps", F.lit(every))
    half = P.STEPS // every // 2
    for part in (F.col("entry") <= half, F.col("entry") > half):
        entries.where(part).write.mode("append").json(os.path.join(root, "in"))
        src = ST.read_json_stream(spark, os.path.join(root, "in"), "client_id int, entry long, q double, sigma double, steps long, delta double")
        LG.run_budget(spark, src, ["client_id"], 1.0, os.path.join(root, "out"), name=os.path.basename(root)).awaitTermination()
    return spark.read.parquet(os.path.join(root, "out")).select("client_id", "steps", "epsilon")
