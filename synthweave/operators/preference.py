"""Preference pairs (X6-X9): HH-style strings and UltraFeedback rows ->
``(row_id, prompt, chosen, rejected)`` with the prompt rendered by a chat template."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthweave.functions.text import common_prefix_len
from synthweave.operators import chat as C
from synthweave.operators.sample import shuffle_limit
from synthweave.sources import fixtures as V

HUMAN = "\n\nHuman: "
ASSISTANT = "\n\nAssistant: "
# Model name -> template; anything else uses vicuna_v1.1.
MODEL2TEMPLATE = {
    "ehartford/Wizard-Vicuna-7B-Uncensored": "vicuna_v1.1",
    "TheBloke/Wizard-Vicuna-7B-Uncensored-HF": "vicuna_v1.1",
}
DEFAULT_TEMPLATE = "vicuna_v1.1"

__all__ = ["common_prefix_len", "split_hh", "split_ultrafeedback", "process_dpo"]


def v_pref_hh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same prompt, own reply (chosen) vs the next pair's reply (rejected)."""
    p = V.v_pairs(spark, sf_dir)
    nxt = p.select((F.col("row_id") - 2).alias("row_id"), F.col("response").alias("other"))
    head = F.concat(F.lit(HUMAN), F.col("instruction"), F.lit(ASSISTANT))
    return (p.join(nxt, "row_id")
            .select("row_id", F.concat(head, "response").alias("chosen"), F.concat(head, "other").alias("rejected")))


def v_pref_ultra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UltraFeedback layout: ``prompt``, ``chosen`` / ``rejected`` as message arrays."""
    p = V.v_pairs(spark, sf_dir)
    nxt = p.select((F.col("row_id") - 2).alias("row_id"), F.col("response").alias("other"))
    msg = lambda c: F.struct(F.col(c).alias("content"))
    return (p.join(nxt, "row_id")
            .select("row_id", F.col("instruction").alias("prompt"),
                    F.array(msg("instruction"), msg("response")).alias("chosen"),
                    F.array(msg("instruction"), msg("other")).alias("rejected")))


def _hh_messages(df: DataFrame) -> DataFrame:
    """Walk the common prefix into alternating turns (X7), plus the open turn.

    Complete (user, assistant) cycles are the successive matches of
    ``(.*?) ASSISTANT (.*?) HUMAN`` -- the first marker of each kind, in
    order, exactly like a left-to-right walk; after them, text before a further
    assistant marker is a last user turn and anything else is dropped.
    """
    cyc = r"(?s)(.*?)\n\nAssistant: (.*?)\n\nHuman: "
    s = (df.withColumn("_us", F.regexp_extract_all("_s", F.lit(cyc), 1))
         .withColumn("_as", F.regexp_extract_all("_s", F.lit(cyc), 2))
         .withColumn("_rest", F.regexp_replace("_s", r"(?s)^(?:.*?\n\nAssistant: .*?\n\nHuman: )*", ""))
         .withColumn("_has_last", F.instr("_rest", ASSISTANT) > 0))
    n = F.size("_us")
    users = s.select("row_id", F.posexplode("_us").alias("k", "text")).select(
        F.col("row_id").alias("conv_id"), (2 * F.col("k")).alias("i"), F.lit("user").alias("role"), "text")
    assts = s.select("row_id", F.posexplode("_as").alias("k", "text")).select(
        F.col("row_id").alias("conv_id"), (2 * F.col("k") + 1).alias("i"), F.lit("assistant").alias("role"), "text")
    last = s.where("_has_last").select(F.col("row_id").alias("conv_id"), (2 * n).alias("i"), F.lit("user").alias("role"),
                                       F.split_part("_rest", F.lit(ASSISTANT), F.lit(1)).alias("text"))
    open_ = s.select(F.col("row_id").alias("conv_id"),
                     (2 * n + F.when(F.col("_has_last"), 1).otherwise(0)).alias("i"),
                     F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("text"))
    return (users.unionByName(assts).unionByName(last).unionByName(open_)
            .withColumn("sys_text", F.lit(None).cast("string")))


def split_hh(df: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """HH ``chosen`` / ``rejected`` strings -> rendered prompt + the two replies.

    Replies keep one character of the common prefix (its trailing space).  A
    pair without any common prefix is invalid and dropped.
    """
    cp = df.withColumn("_n", common_prefix_len("chosen", "rejected")).where(F.col("_n") > 0)
    walk = cp.withColumn("_s", F.expr(f"substring(substring(chosen, 1, _n), {len(HUMAN) + 1})"))
    prompts = C.render(C.with_template(_hh_messages(walk), template))
    return (cp.join(prompts.select(F.col("conv_id").alias("row_id"), "prompt"), "row_id")
            .select("row_id", "prompt", F.expr("substring(chosen, _n)").alias("chosen"),
                    F.expr("substring(rejected, _n)").alias("rejected")))


def split_ultrafeedback(df: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """One rendered user turn + open turn; replies = ``' ' + second message``."""
    msgs = (df.select(F.col("row_id").alias("conv_id"), F.lit(0).alias("i"), F.lit("user").alias("role"),
                      F.col("prompt").alias("text"))
            .unionByName(df.select(F.col("row_id").alias("conv_id"), F.lit(1).alias("i"),
                                   F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("text")))
            .withColumn("sys_text", F.lit(None).cast("string")))
    prompts = C.render(C.with_template(msgs, template))
    return (df.drop("prompt").join(prompts.select(F.col("conv_id").alias("row_id"), "prompt"), "row_id")
            .select("row_id", "prompt",
                    # a row with fewer than two messages yields NULL instead of failing the job
                    F.concat(F.lit(" "), F.try_element_at("chosen", F.lit(2))["content"]).alias("chosen"),
                    F.concat(F.lit(" "), F.try_element_at("rejected", F.lit(2))["content"]).alias("rejected")))


def process_dpo(df: DataFrame, dataset: str, model: str, n: int, seed: int = 2023) -> DataFrame:
    """Template by model name, dataset-specific split, then shuffle + limit."""
    template = MODEL2TEMPLATE.get(model, DEFAULT_TEMPLATE)
    if dataset == "Anthropic/hh-rlhf":
        out = split_hh(df, template)
    elif dataset == "HuggingFaceH4/ultrafeedback_binarized":
        out = split_ultrafeedback(df, template)
    else:
        out = df
    return shuffle_limit(out, n, seed=seed).select("row_id", "prompt", "chosen", "rejected")
