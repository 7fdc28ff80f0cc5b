"""Registered queries: file sources and sinks, shard folders, replicate merging.

Each query writes a table Spark derives from the driver tables into a fresh
folder under ``spark.checkpoint.dir`` and reads it back through the source
under test, so the oracle is the SQL of the table that was written.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from synthweave.operators import normalize as N
from synthweave.operators import sample as M
from synthweave.operators import shard as S
from synthweave.plans import jobs as J
from synthweave.plans.oracle_views import md5_key, with_views
from synthweave.plans.queries_core import _SHARD_LEN_SQL, _sql_alpaca
from synthweave.plans.registry import ORACLES, query
from synthweave.sources import files as IO
from synthweave.sources import fixtures as V


@query("scan_json", with_views("v_pairs") + "SELECT row_id, instruction, response FROM v_pairs")
def scan_json(spark, sf_dir):
    path = os.path.join(IO.scratch(spark, "scan_json"), "pairs.jsonl")
    V.v_pairs(spark, sf_dir).select("row_id", "instruction", "response").write.json(path)
    return IO.read_dataset(spark, path, "row_id long, instruction string, response string")


@query("scan_shards", with_views("v_corpus") + "SELECT client_id, row_id, instruction FROM v_corpus")
def scan_shards(spark, sf_dir):
    path = IO.scratch(spark, "scan_shards")
    IO.write_shards(V.v_corpus(spark, sf_dir).select("row_id", "client_id", "instruction"), path)
    df = IO.scan_shards(spark, path, "row_id long, instruction string")
    return df.select(F.col("shard_id").alias("client_id"), "row_id", "instruction")


@query("scan_mixed_json", with_views("v_pairs", "v_corpus") + """
SELECT 'pairs' AS source, row_id, instruction, false AS corrupt FROM v_pairs
UNION ALL SELECT 'corpus', row_id, instruction, false FROM v_corpus""")
def scan_mixed_json(spark, sf_dir):
    root = IO.scratch(spark, "scan_mixed_json")
    V.v_pairs(spark, sf_dir).select(F.lit("pairs").alias("source"), "row_id", "instruction") \
        .write.json(os.path.join(root, "lines"))
    IO.write_json_arrays(V.v_corpus(spark, sf_dir).select(F.lit("corpus").alias("source"), "row_id", "instruction"),
                         os.path.join(root, "arrays"))
    df = IO.scan_mixed_json(spark, root, "source string, row_id long, instruction string")
    return df.select("source", "row_id", "instruction", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("registry_scan", with_views("v_pairs") + "SELECT row_id, instruction, response FROM v_pairs")
def registry_scan(spark, sf_dir):
    root = IO.scratch(spark, "registry")
    V.v_pairs(spark, sf_dir).select("row_id", F.col("instruction").alias("question"),
                                     F.col("response").alias("answer")).write.parquet(os.path.join(root, "gsm8k"))
    reg = IO.SourceRegistry(spark, root).register("gsm8k", "gsm8k", "parquet",
                                                  lambda d: N.normalize_sft("gsm8k", d), view="gsm8k_train")
    return reg.load("gsm8k").select("row_id", "instruction", "response")


@query("registry_splits", with_views("v_pairs") + """
SELECT row_id, CASE WHEN row_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, instruction, response FROM v_pairs
UNION ALL SELECT row_id, 'socratic', instruction, response FROM v_pairs WHERE row_id % 4 = 1""")
def registry_splits(spark, sf_dir):
    """A source with two configurations, of which one has two splits."""
    root = IO.scratch(spark, "registry_splits")
    raw = V.v_pairs(spark, sf_dir).select("row_id", F.col("instruction").alias("question"), F.col("response").alias("answer"))
    raw.where("row_id % 4 <> 0").write.parquet(f"{root}/gsm8k/main/train")
    raw.where("row_id % 4 = 0").write.json(f"{root}/gsm8k/main/test")
    raw.where("row_id % 4 = 1").write.parquet(f"{root}/gsm8k/socratic/train")
    reg = IO.SourceRegistry(spark, root).register("gsm8k", "gsm8k", None, lambda d: N.normalize_sft("gsm8k", d))
    parts = [reg.load("gsm8k").withColumn("split", F.lit("train")), reg.load("gsm8k", split="test").withColumn("split", F.lit("test")),
             reg.load("gsm8k", config="socratic").withColumn("split", F.lit("socratic"))]
    out = parts[0].select("row_id", "split", "instruction", "response")
    for p in parts[1:]:
        out = out.unionByName(p.select("row_id", "split", "instruction", "response"))
    return out


@query("write_shards", with_views("v_corpus", extra="sl AS (" + _SHARD_LEN_SQL + ")") + """
SELECT sl.client_id, sl.row_id, c.instruction FROM sl JOIN v_corpus c USING (row_id)""")
def write_shards(spark, sf_dir):
    path = IO.scratch(spark, "write_shards")
    IO.write_shards(S.shard_length(V.v_corpus(spark, sf_dir), 10).select("row_id", "client_id", "instruction"), path)
    back = IO.scan_shards(spark, path, "row_id long, instruction string")
    return back.select(F.col("shard_id").alias("client_id"), "row_id", "instruction")


@query("write_verdicts")
def write_verdicts(spark, sf_dir):
    path = IO.scratch(spark, "write_verdicts")
    IO.write_shards(J.job_icl(spark, sf_dir), path, by="verdict")
    back = IO.read_dataset(spark, path, "round_id long, instruction string, output string, max_sim double, index_list array<long>", "json")
    ids = F.array_join(F.col("index_list").cast("array<string>"), ",").alias("index_list")
    return back.select("round_id", "verdict", "instruction", "output", "max_sim", ids)


@query("write_sample_json")
def write_sample_json(spark, sf_dir):
    path = os.path.join(IO.scratch(spark, "write_sample"), "train")
    IO.write_once(J.job_prepare(V.v_alpaca(spark, sf_dir).where(F.col("category") == "en"), 50), path, "json")
    return IO.read_dataset(spark, path, "row_id long, instruction string, response string", "json")


@query("loss_matrix_parquet")
def loss_matrix_parquet(spark, sf_dir):
    from synthweave.plans import queries_fed as QF
    path = IO.scratch(spark, "loss_matrix")
    m = J.loss_matrix(QF.losses(spark, sf_dir), V.v_client_sizes(spark, sf_dir), 20)
    IO.write_once(m, path, "parquet", ["round"])
    return spark.read.parquet(path).select(F.col("round").cast("int").alias("round"), "client_id", "loss")


def _write_replicates(spark, sf_dir, n: int = 3) -> str:
    root = IO.scratch(spark, "replicates")
    # dealt once, without the text that repeats two columns; the writers make it and the replicates
    gen = V.v_alpaca(spark, sf_dir).select("row_id", "client_id", "instruction", "input", "output")
    IO.write_shards(gen, root, above=["rep"], compression="gzip", derived={
        "text": F.concat_ws(" ", "instruction", "output"), "rep": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})
    return root


_REP_SQL = f"""
  reps AS (SELECT 'client' || CAST(client_id AS VARCHAR) || '.json' AS file_name, CAST(r.rep AS INTEGER) AS replicate,
                  row_id, {_sql_alpaca()} AS instruction, output AS response
           FROM v_alpaca, range(0, 3) r(rep))"""


@query("merge_replicates", with_views("v_alpaca", extra=_REP_SQL) + """
SELECT file_name, replicate, row_id, instruction, response FROM reps""")
def merge_replicates(spark, sf_dir):
    merged = IO.merge_replicates(spark, _write_replicates(spark, sf_dir))
    return merged.select("file_name", "replicate", "row_id", "instruction", "response")


_UID = "CAST(row_id AS VARCHAR) || '-' || CAST(replicate AS VARCHAR)"


@query("job_merge_sample", with_views("v_alpaca", extra=_REP_SQL) + f"""
SELECT file_name, replicate, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY {md5_key(_UID, 500)},
                                                              {_UID}) AS rn FROM reps) t
WHERE rn <= 20""")
def job_merge_sample(spark, sf_dir):
    merged = IO.merge_replicates(spark, _write_replicates(spark, sf_dir))
    keyed = merged.withColumn("uid", F.concat_ws("-", F.col("row_id").cast("string"), F.col("replicate").cast("string")))
    return M.sample_per_group(keyed, "file_name", 20, seed=500, key="uid").select("file_name", "replicate", "row_id")


ORACLES["write_verdicts"] = ORACLES["job_icl"]
ORACLES["write_sample_json"] = ORACLES["job_prepare"]
ORACLES["loss_matrix_parquet"] = ORACLES["loss_matrix"]
