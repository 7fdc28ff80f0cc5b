"""Instruction-following difficulty (A10, A11, F8, K2) over token losses.

IFD of a row = mean loss of the answer tokens given the instruction divided
by the mean loss of the same answer alone.  Spans are located like the
reference: the answer's *last* occurrence in each text marks where its
tokens start, texts are truncated to the token budget, and rows are dropped
when a span is empty, when instruction + answer overflow the budget, or
when the ratio exceeds 1.

Losses come from the counted model (:func:`ifd_rows`), or from a loss table
(S10): one row per data row with its perplexities and token losses, written
by :func:`loss_table` (counted model) or :func:`scored_losses` (a user's
model) and scored by :func:`ifd_from_losses` in any later job.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.operators import lm as L
from synthweave.operators.prompts import ifd_text_exprs
from synthweave.operators.ranking import select_first
from synthweave.session import spread, stored

SCORED_ROWS = 256       # rows whose losses a task of :func:`scored_losses` holds
LOSS_TABLE = "ppl array<double>, token_loss array<array<double>>"


def _texts(df: DataFrame, style: str, key: str) -> DataFrame:
    """``(key, response, _p, _whole, _alone)``: prompt, prompt with answer, answer alone."""
    inp = "input" if "input" in df.columns else None
    prompt, whole, answer = ifd_text_exprs(style, "instruction", inp, "response")
    return df.select(key, "response", prompt.alias("_p"), whole.alias("_whole"), answer.alias("_alone"))


def _budget(max_length: int) -> Column:
    """Tokens that the answer alone may take, given the prompt's ``ilen``."""
    return F.lit(max_length) - F.col("ilen") + 4


def _gate(max_length: int) -> Column:
    """F8 but its ratio: room left, spans not empty, prompt and answer within the budget."""
    return ((F.lit(max_length) - F.col("ilen") > 0) & (F.col("end1") - F.col("start1") > 0) & (F.col("end2") - F.col("start2") > 0)
            & (F.col("ilen") + F.col("end1") - F.col("start1") <= max_length))


def _spans(df: DataFrame, style: str, max_length: int, key: str) -> DataFrame:
    """``(key, ilen, start1, end1, start2, end2, toks1, toks2)`` of every row.

    ``toks`` are hashed tokens cut to the budget, 1 for the answer alone, 2
    for the whole text.
    """
    cut = lambda text: L.tokens(F.expr(f"substring({text}, 1, greatest({L.last_index_sql(text, 'response')}, 0))"))
    fields = [c for c in ("instruction", "input", "response") if c in df.columns]
    rows = _texts(spread(df.select(key, *fields), key), style, key).select(
        key, F.least(F.size(L.tokens("_p")), F.lit(max_length)).alias("ilen"), F.size(cut("_alone")).alias("start1"), F.size(cut("_whole")).alias("start2"),
        L.hashed(L.tokens("_alone")).alias("_t1"), L.hashed(L.tokens("_whole")).alias("_t2"))
    rows = rows.select(key, "ilen", "start1", "start2", F.slice("_t1", 1, F.greatest(_budget(max_length), F.lit(0))).alias("toks1"), F.slice("_t2", 1, max_length).alias("toks2"))
    return rows.select(key, "ilen", "start1", F.size("toks1").alias("end1"), "start2", F.size("toks2").alias("end2"), "toks1", "toks2")


def span_rows(df: DataFrame, style: str = "wiz", max_length: int = 512, key: str = "row_id") -> DataFrame:
    """``(key, ilen, start1, end1, start2, end2, toks1, toks2)`` of the rows that pass F8's span gates.

    Written once: the gate reads the stored spans, so no text of a dropped
    row is tokenised twice, exploded or shuffled.
    """
    return stored(_spans(df, style, max_length, key)).where(_gate(max_length))


def _tagged_losses(spans: DataFrame, lm: L.BigramLM, key: str, scored: Column | None = None) -> DataFrame:
    """``(key, _tag, pos, loss)`` of both texts in one pass: whole texts, or the answers' spans in the rows that are to be ``scored``."""
    rows = spans.select(key, *[c for i in (1, 2) for c in (
        F.col(f"toks{i}").alias(f"_t{i - 1}"), (F.lit(1) if scored is None else F.col(f"start{i}")).alias(f"_first{i - 1}"),
        (F.col(f"end{i}") if scored is None else F.when(scored, F.col(f"end{i}")).otherwise(0)).alias(f"_last{i - 1}"))])
    return L.place_losses(rows, lm, [key], 2).select(key, (F.col("text") + 1).alias("_tag"), "pos", "loss")


def ifd_rows(df: DataFrame, lm: L.BigramLM, style: str = "wiz", max_length: int = 512,
             key: str = "row_id") -> DataFrame:
    """A10 + F8: surviving rows ``(key, mean_alone, mean_cond, ifd)``.

    ``df``: ``(key, instruction, response[, input])``.  The gate empties the
    spans of the rows that it drops; nothing is stored or filtered on the way
    to the places (a filter would tokenise every text again).
    """
    losses = _tagged_losses(_spans(df, style, max_length, key), lm, key, scored=_gate(max_length))
    means = losses.groupBy(key).agg(F.avg(F.when(F.col("_tag") == 1, F.col("loss"))).alias("mean1"),
                                    F.avg(F.when(F.col("_tag") == 2, F.col("loss"))).alias("mean2"))
    return _ratios(means.where("mean1 is not null and mean2 is not null"), key)


def loss_table(df: DataFrame, lm: L.BigramLM, style: str = "wiz", max_length: int = 512, key: str = "row_id") -> DataFrame:
    """``(key, ppl, token_loss)`` of every row that has a span to score.

    Three entries each, as the loss files have them: nothing for the prompt,
    then the answer alone and the whole text.  ``token_loss`` lists the losses
    of tokens 2, 3, ...; ``ppl`` is ``exp`` of the mean loss over the answer.
    A list holds one text's tokens, ``max_length`` at most.
    """
    spans = span_rows(df, style, max_length, key)
    losses = _tagged_losses(spans, lm, key)
    lists = losses.groupBy(key, "_tag").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "loss"))), lambda x: x["loss"]).alias("l"))
    wide = lists.groupBy(key).agg(*[F.max(F.when(F.col("_tag") == i, F.col("l"))).alias(f"l{i}") for i in (1, 2)])
    none = F.array().cast("array<double>")
    rows = spans.drop("toks1", "toks2").join(wide, key, "left").select(key, "start1", "end1", "start2", "end2", *[F.coalesce(f"l{i}", none).alias(f"l{i}") for i in (1, 2)])
    ppl = [F.exp(_mean(_part(F.col(f"l{i}"), F.col(f"start{i}"), F.col(f"end{i}")))) for i in (1, 2)]
    return rows.select(key, F.array(F.lit(0.0), *ppl).alias("ppl"), F.array(none, "l1", "l2").alias("token_loss"))


def _part(losses: Column, start: Column, end: Column) -> Column:
    """Losses of the tokens ``start..end-1``; the list begins with token 1."""
    first = F.greatest(start, F.lit(1))
    return F.slice(losses, first, F.greatest(end - first, F.lit(0)))


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def scored_losses(df: DataFrame, factory: Callable[[], L.Scorer], style: str = "wiz", max_length: int = 512, key: str = "row_id") -> DataFrame:
    """S10 with a user's model: ``(key, ilen, start1, end1, start2, end2, ppl, token_loss)`` of every row.

    ``factory`` runs once per task and loads the model there; it scores
    ``SCORED_ROWS`` texts of an Arrow batch at a time, so only their losses
    are held as lists.  The spans are counted with the model's own tokenizer.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = _texts(df, style, key)
    for text in ("_alone", "_whole"):
        rows = rows.withColumn(f"{text}_head", F.expr(f"substring({text}, 1, greatest({L.last_index_sql(text, 'response')}, 0))"))

    def run(batches):
        model = factory()
        for pdf in (pdf.iloc[at:at + SCORED_ROWS] for pdf in batches for at in range(0, len(pdf), SCORED_ROWS)):
            out = pd.DataFrame({key: pdf[key], "ilen": model.lengths(pdf["_p"]).clip(upper=max_length).astype("int32")})
            lists = {}
            for i, text, limit in ((1, "_alone", max_length - out["ilen"] + 4), (2, "_whole", pd.Series(max_length, pdf.index))):
                out[f"start{i}"] = model.lengths(pdf[f"{text}_head"]).astype("int32")
                out[f"end{i}"] = pd.concat([model.lengths(pdf[text]), limit], axis=1).min(axis=1).clip(lower=0).astype("int32")
                lists[i] = [[float(x) for x in one] for one in model.losses(pdf[text], limit)]
            spans = [[one[max(s, 1) - 1:max(e - 1, 0)] for one, s, e in zip(lists[i], out[f"start{i}"], out[f"end{i}"])] for i in (1, 2)]
            ppl = [pd.Series([sum(x) / len(x) if x else None for x in part], dtype="float64").map(np.exp) for part in spans]
            out["ppl"] = [[0.0, None if a != a else a, None if b != b else b] for a, b in zip(*ppl)]
            out["token_loss"] = [[[], a, b] for a, b in zip(lists[1], lists[2])]
            yield out

    return rows.mapInPandas(run, f"`{key}` {kind}, ilen int, start1 int, end1 int, start2 int, end2 int, {LOSS_TABLE}")


def ifd_from_losses(table: DataFrame, spans: DataFrame | None = None, max_length: int = 512, key: str = "row_id") -> DataFrame:
    """A10 + F8 from a stored loss table: the same rows as :func:`ifd_rows` from scratch.

    ``spans`` (``ilen`` and both spans, by key) is needed where the table has
    none of its own; it may be computed from the data at any later time.
    """
    rows = (table if spans is None else table.join(spans.select(key, "ilen", "start1", "end1", "start2", "end2"), key)).where(_gate(max_length))
    means = rows.select(key, *[_mean(_part(F.get("token_loss", F.lit(i)), F.col(f"start{i}"), F.col(f"end{i}"))).alias(f"mean{i}") for i in (1, 2)])
    return _ratios(means.where("mean1 is not null and mean2 is not null"), key)


def _ratios(means: DataFrame, key: str) -> DataFrame:
    """A10 + the last F8 gate: ``ifd = mean_cond / mean_alone``, kept when <= 1."""
    return (means.withColumn("ifd", F.col("mean2") / F.col("mean1")).where(F.col("ifd") <= 1)
            .select(key, F.col("mean1").alias("mean_alone"), F.col("mean2").alias("mean_cond"), "ifd"))


def ratio_gate(m1: DataFrame, m2: DataFrame, key: str = "row_id") -> DataFrame:
    """A10 + the last F8 gate from two tables of means.

    ``m1``: ``(key, mean1)`` over the answer alone; ``m2``: ``(key, mean2)``
    over the answer after the instruction.
    """
    return _ratios(m1.join(m2, key), key)


def ifd_mean(rows: DataFrame) -> DataFrame:
    """A11."""
    return rows.agg(F.avg("ifd").alias("ifd_mean"), F.count(F.lit(1)).alias("n_rows"))


def ifd_topk(rows: DataFrame, data: DataFrame, rate: float = 0.1, sample_number: int = 0,
             key: str = "row_id") -> DataFrame:
    """K2: the ``k`` highest-IFD rows (ties: higher key first), returned as data rows.

    ``k = sample_number`` or ``int(n * rate)``; ``k = 0`` selects nothing (the
    reference's ``[-0:]`` would select everything -- not reproduced).
    """
    rows = stored(rows.select(key, "ifd"))                  # narrow; read by every pass of the selection
    k = sample_number or int(rows.count() * rate)
    top = select_first(rows, k, [-F.col("ifd"), -F.col(key)]).select(key)
    return data.join(top, key, "left_semi")
