"""Schema normalisers: raw layouts -> canonical ``(row_id, instruction, response)``.

Each rule is a projection, so Catalyst prunes the raw columns a rule drops
straight out of the scan.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def norm_medical(df: DataFrame) -> DataFrame:
    """instruction = Patient, response = Doctor; raw columns dropped."""
    return (df.withColumn("instruction", F.col("Patient")).withColumn("response", F.col("Doctor"))
            .drop("Description", "Patient", "Doctor"))


def alpaca_always(df: DataFrame) -> DataFrame:
    """``instruction + ' ' + input`` always (trailing blank when input is '')."""
    return (df.withColumn("instruction", F.concat(F.col("instruction"), F.lit(" "), F.col("input")))
            .withColumn("response", F.col("output")).drop("input", "output"))


# Columns of an arena record that no output keeps.
ARENA_DROPPED = ("question_id", "model_a", "model_b", "winner", "judge", "turn", "anony", "language", "tstamp")


def arena_first_turns(df: DataFrame, drop_conversations: bool = True) -> DataFrame:
    """P3/P6g: first turn -> instruction, second -> response; P6g keeps the conversations and their moderation columns."""
    out = (df.withColumn("instruction", F.try_element_at("conversation_a", F.lit(1))["content"])
           .withColumn("response", F.try_element_at("conversation_a", F.lit(2))["content"]))
    drop = list(ARENA_DROPPED)
    if drop_conversations:
        drop += ["conversation_a", "conversation_b", "toxic_chat_tag", "openai_moderation"]
    return out.drop(*drop)


def alpaca_join_expr(instruction="instruction", inp="input"):
    """P4 expression: append input with a space only when it is non-empty."""
    return (F.when(F.col(inp) == "", F.col(instruction))
            .otherwise(F.concat(F.col(instruction), F.lit(" "), F.col(inp))))


def alpaca_format(df: DataFrame, drop: tuple = ("input", "output")) -> DataFrame:
    """P4 (+ P6a / P6c by ``drop``)."""
    return (df.withColumn("instruction", alpaca_join_expr()).withColumn("response", F.col("output"))
            .drop(*drop))


def norm_generated(df: DataFrame) -> DataFrame:
    """P5: merge-time normaliser, row by row: a row without ``input`` or ``output`` keeps its own fields."""
    if "input" in df.columns:
        df = df.withColumn("instruction", F.when(F.col("input").isNull(), F.col("instruction"))
                           .otherwise(alpaca_join_expr())).drop("input", "text")
    if "output" in df.columns:
        own = F.col("response") if "response" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("response", F.coalesce(F.col("output"), own)).drop("output")
    return df


def _wizard(df):  # P6b
    return df.withColumnRenamed("output", "response")


def _math(df):  # P6d
    return (df.withColumnsRenamed({"solution": "response", "problem": "instruction"})
            .drop("level", "type"))


def _gsm8k(df):  # P6e
    return df.withColumnsRenamed({"question": "instruction", "answer": "response"})


def _flashcards(df):  # P6f: order matters -- drop the old instruction first
    return df.drop("instruction").withColumnsRenamed({"input": "instruction", "output": "response"})


def _arena(df):  # P6g: conversation columns are kept
    return arena_first_turns(df, drop_conversations=False)


# Dataset names accepted by the per-dataset dispatch.
SFT_RULES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "lucasmccabe-lmi/CodeAlpaca-20k": lambda d: alpaca_format(d, ("input", "output")),
    "yahma/alpaca-cleaned": lambda d: alpaca_format(d, ("input", "output")),
    "WizardLM/WizardLM_evol_instruct_70k": _wizard,
    "tatsu-lab/alpaca": lambda d: alpaca_format(d, ("input", "output", "text")),
    "vicgalle/alpaca-gpt4": lambda d: alpaca_format(d, ("input", "output", "text")),
    "gbharti/finance-alpaca": lambda d: alpaca_format(d, ("input", "output", "text")),
    "lighteval/MATH": _math,
    "gsm8k": _gsm8k,
    "medalpaca/medical_meadow_medical_flashcards": _flashcards,
    "lmsys/chatbot_arena_conversations": _arena,
    "iamtarun/python_code_instructions_18k_alpaca": lambda d: d,
    "FinGPT/fingpt-sentiment-train": lambda d: d,
    "TIGER-Lab/MathInstruct": lambda d: d,
    "new": lambda d: d,
}


def normalize_sft(name: str, df: DataFrame) -> DataFrame:
    """Per-dataset dispatch to the canonical schema."""
    if name not in SFT_RULES:
        raise NotImplementedError(f"no rule normalises {name!r}")
    return SFT_RULES[name](df)


def prepare(df: DataFrame, map_function=None, remove_columns=None) -> DataFrame:
    """Generic map then drop (sharding is applied by the caller)."""
    if map_function is not None:
        df = df.transform(map_function)
    if remove_columns:
        df = df.drop(*remove_columns)
    return df
