"""Parsing generated text (X1-X5): column expressions, no UDFs.

Python's ``s.split(d)[i]`` raises when the piece is missing; ``split_part``
returns ''.  Every rule below therefore checks the marker first and yields
NULL exactly where the Python code would land in its ``except`` branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.functions import templates as T
from synthweave.functions.text import py_strip, split_part


def instruction_expr(text) -> Column:
    """Text before ``###example:``, then between the 1st and 2nd ``##instruction:``."""
    head = split_part(text, T.MARK_EXAMPLE, 1)
    return F.when(head.contains(T.MARK_INSTRUCTION), py_strip(split_part(head, T.MARK_INSTRUCTION, 2)))


def output_expr(text) -> Column:
    """Before ``###example:``, before the first ``##``, stripped."""
    return py_strip(split_part(split_part(text, T.MARK_EXAMPLE, 1), "##", 1))


def parse_pair(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``instruction`` and ``output``, with the reference's three failure modes.

    Every cut is a column of a layer of its own, so the text is split and
    stripped once however often the rules look at the pieces.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("instruction", "output")]
    rows = df.select(F.struct(*kept).alias("_row"), split_part(text, T.MARK_EXAMPLE, 1).alias("_head"))
    rows = rows.select("_row", F.col("_head").contains(T.MARK_OUTPUT).alias("_has_out"), py_strip(split_part("_head", T.MARK_OUTPUT, 2)).alias("_out"),
                       split_part("_head", T.MARK_OUTPUT, 1).alias("_before"))
    out = F.col("_out")
    bad_example = out.contains(T.BAD_OUTPUT_EXAMPLE[0]) | out.contains(T.BAD_OUTPUT_EXAMPLE[1])
    bad_instr = out.contains(T.BAD_OUTPUT_INSTRUCTION[0]) | out.contains(T.BAD_OUTPUT_INSTRUCTION[1])
    rows = rows.select("_row", "_out", (F.col("_has_out") & ~bad_example & F.col("_before").contains(T.MARK_INSTRUCTION)).alias("_ok"), bad_instr.alias("_bad"),
                       py_strip(split_part("_before", T.MARK_INSTRUCTION, 2)).alias("_instr"))
    return rows.select("_row.*", F.when(F.col("_ok"), F.col("_instr")).alias("instruction"), F.when(F.col("_ok") & ~F.col("_bad"), out).alias("output"))


def parse_instruction(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("instruction", instruction_expr(text))


def parse_output(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("output", output_expr(text))


def clean_response(df: DataFrame, column: str = "response") -> DataFrame:
    """Cut at the first ``##`` (not stripped)."""
    return df.withColumn(column, split_part(column, "##", 1))


def strip_echo_expr(output: str, prompt: str, stop: str | None = None) -> Column:
    """Drop the echoed prompt by length, then stop at a sentinel token."""
    body = F.expr(f"substring(`{output}`, length(`{prompt}`) + 1)")
    if stop:
        body = F.split_part(body, F.lit(stop), F.lit(1))
    return body
