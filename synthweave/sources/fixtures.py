"""Canonical views derived from the driver tables (see FIXTURES.md part B).

Every view carries a stable ``row_id`` derived from source keys -- never from
``monotonically_increasing_id`` -- so joins after a re-read or a retried task
line up exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthweave.sources.tables import load

TURNS = 1 << 20  # pair id = conv_id * TURNS + turn: distinct for conversations of up to a million turns


def v_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user turn, next assistant turn) pairs of ``conversations``.

    Turns are dense per conversation, so "next turn" is an equi-join on
    ``(conv_id, turn + 1)``: balanced on the composite key even when one
    conversation is huge (a window over ``conv_id`` would put it on one task).
    """
    conv = load(spark, sf_dir, "conversations")
    users = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("instruction"))
    answers = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return (users.join(answers, ["conv_id", "turn"], "inner")
            .select((F.col("conv_id") * TURNS + F.col("turn")).alias("row_id"),
                    "conv_id", "instruction", "response"))


def corpus_from_documents(docs: DataFrame) -> DataFrame:
    nl = F.instr(F.col("text"), "\n")
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.regexp_extract("source", r"(\d+)", 1).try_cast("int").alias("client_id"),
        F.col("lang").alias("category"),
        F.when(nl == 0, F.col("text")).otherwise(F.expr("substring(text, 1, instr(text, '\n') - 1)")).alias("instruction"),
        F.when(nl == 0, F.lit("")).otherwise(F.expr("substring(text, instr(text, '\n') + 1)")).alias("response"),
    )


def v_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as instruction (first line) / response (the rest)."""
    return corpus_from_documents(load(spark, sf_dir, "documents"))


def v_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpaca layout: ``input`` is '' for even row_id, else the category."""
    c = v_corpus(spark, sf_dir)
    inp = F.when(F.col("row_id") % 2 == 0, F.lit("")).otherwise(F.col("category"))
    return c.select("row_id", "client_id", "category", "instruction",
                    inp.alias("input"), F.col("response").alias("output"),
                    F.concat_ws(" ", "instruction", "response").alias("text"))


def v_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client parameter table ``(round, client_id, key, pos, value)``.

    One client per supplier residue mod 10, 42 parameters named by
    return-flag + line-status (key) and line number (pos).
    """
    li = load(spark, sf_dir, "lineitem")
    return (li.groupBy((F.col("l_suppkey") % 10).cast("int").alias("client_id"),
                       F.concat("l_returnflag", "l_linestatus").alias("key"),
                       F.col("l_linenumber").cast("int").alias("pos"))
            .agg(F.avg("l_discount").alias("value"))
            .select(F.lit(0).cast("int").alias("round"), "client_id", "key", "pos", "value"))


def v_client_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return (li.groupBy((F.col("l_suppkey") % 10).cast("int").alias("client_id"))
            .agg(F.count(F.lit(1)).alias("n")))


def v_contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-author contribution vectors: ``sum(value)`` by user and event type."""
    ev = load(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("author"), F.col("event_type").alias("key"))
            .agg(F.sum("value").alias("value")))


def v_arena(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arena layout: one row per conversation, ``conversation_a`` nested.

    Built by a group-by over conversations; a conversation's turn count is the
    natural bound of the nested array (it is one record in the source format).
    """
    conv = load(spark, sf_dir, "conversations").where(F.col("role") != "system")
    lang = F.when(F.col("conv_id") % 4 == 0, F.lit("Chinese")).otherwise(F.lit("English"))
    return (conv.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_t"))
            .select("conv_id",
                    F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversation_a"),
                    lang.alias("language")))


def v_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feature sets of ``embeddings``: side 0 (label < 5), side 1 (>= 5)."""
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.when(F.col("label") < 5, 0).otherwise(1).alias("side"), "embedding")


def v_medical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medical layout (Description, Patient, Doctor) over the pairs view."""
    p = v_pairs(spark, sf_dir)
    return p.select("row_id", F.col("instruction").alias("Description"),
                    F.col("instruction").alias("Patient"), F.col("response").alias("Doctor"))


def v_raw_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw generator output over the pairs: markers around each pair, and every
    7th row damaged in one of three ways (no output marker, a leftover example
    marker, a leftover instruction marker)."""
    p = v_pairs(spark, sf_dir)
    wrapped = F.concat(F.lit("\n##instruction: \n"), F.col("instruction"), F.lit("\n##output:\n"),
                       F.col("response"), F.lit("\n\n###example:\n"))
    kind = F.expr("(row_id div 7) % 3")
    text = (F.when(F.col("row_id") % 7 != 0, wrapped)
            .when(kind == 0, F.concat(F.lit("##instruction: "), F.col("instruction")))
            .when(kind == 1, F.concat(F.lit("##instruction: "), F.col("instruction"), F.lit(" ##output: "),
                                      F.col("response"), F.lit(" ### example more")))
            .otherwise(F.concat(F.lit("##instruction: "), F.col("instruction"), F.lit(" ##output: "),
                                F.col("response"), F.lit(" ##instruction: again"))))
    return p.select(F.col("row_id").alias("round_id"), text.alias("text"))


def v_losses(spark: SparkSession, sf_dir: str, participants: DataFrame, glob: DataFrame) -> DataFrame:
    """A training loss for every participant and round: the mean absolute
    distance of its update from the global model, decayed by round."""
    return (participants.join(v_updates(spark, sf_dir).drop("round"), "client_id")
            .join(glob.withColumnRenamed("value", "g"), ["key", "pos"])
            .groupBy("round", "client_id")
            .agg((F.avg(F.abs(F.col("value") - F.col("g"))) / (F.col("round") + 1)).alias("loss")))
