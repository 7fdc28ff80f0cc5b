"""Prompt rendering (R1-R11) as column expressions.

Few-shot prompts fold the k exemplars of one round; a round holds exactly k
rows (k = 3 by default), so the ordered fold is over a bounded group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.functions import templates as T
from synthweave.functions.text import col_, py_strip, split_part


def _fill(template: str, **cols) -> Column:
    """Render ``template`` with ``{name}`` placeholders bound to columns."""
    parts, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        name = rest[i + 1:j]
        if name not in cols:  # literal brace text
            parts.append(F.lit(rest[:j + 1]))
            rest = rest[j + 1:]
            continue
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(col_(cols[name]))
        rest = rest[j + 1:]
    return F.concat(*parts) if parts else F.lit("")


def _fold_rounds(exemplars: DataFrame, piece: Column, round_col: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(F.col("slot"), piece.alias("p"))))
    return (exemplars.groupBy(round_col)
            .agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "").alias("fewshot")))


def prompt_icl(exemplars: DataFrame, round_col: str = "round_id") -> DataFrame:
    """R1: "make a new example" prompt from each round's exemplars."""
    piece = _fill(T.ICL_SAMPLE, instruction="instruction", output="response")
    folded = _fold_rounds(exemplars, piece, round_col)
    return folded.select(round_col, F.concat(F.lit(T.ICL_HEADER), "fewshot", F.lit(T.ICL_TAIL)).alias("prompt"))


def prompt_self1(exemplars: DataFrame, round_col: str = "round_id") -> DataFrame:
    """R2: instruction-only prompt."""
    piece = _fill(T.SELF1_SAMPLE, instruction="instruction")
    folded = _fold_rounds(exemplars, piece, round_col)
    return folded.select(round_col, F.concat("fewshot", F.lit(T.SELF1_TAIL)).alias("prompt"))


def prompt_self2(new_instr: DataFrame, exemplars: DataFrame | None, round_col: str = "round_id",
                 icl: bool = True) -> DataFrame:
    """Answer prompt for a new instruction, cut to 4096 characters.

    ``new_instr``: ``(round_id, instruction)``; exemplars are used only when ``icl``.
    """
    if icl and exemplars is not None:
        piece = _fill(T.SELF2_SAMPLE, instruction="instruction", output="response")
        folded = _fold_rounds(exemplars, piece, round_col)
        base = new_instr.join(folded, round_col, "left")
        few = F.coalesce(F.col("fewshot"), F.lit(""))
    else:
        base, few = new_instr, F.lit("")
    full = F.concat(F.lit(T.SELF2_HEAD), few, F.lit(T.SELF2_MID), F.col("instruction"), F.lit(T.SELF2_TAIL))
    return base.select(round_col, F.substring(full, 1, T.SELF2_MAX_CHARS).alias("prompt"))


def instruct_expr(instruction="instruction") -> Column:
    """R4."""
    return F.concat(F.lit(T.INSTRUCT_HEAD), col_(instruction), F.lit(T.INSTRUCT_TAIL))


def news_cut(instruction="instruction") -> Column:
    """Text between the first and second ``}.``, stripped; '' when absent."""
    return py_strip(split_part(instruction, T.FIN_NEWS_DELIM, 2))


def fin_expr(instruction="instruction") -> Column:
    """Sentiment prompt over the news cut (first 512 characters)."""
    return F.concat(F.lit(T.FIN_HEAD), F.substring(news_cut(instruction), 1, T.FIN_MAX_CHARS), F.lit(T.FIN_TAIL))


def med_expr(instruction="instruction") -> Column:
    """Doctor prompt; the first 93 characters are dropped."""
    body = F.expr(f"substring(`{instruction}`, {T.MED_SKIP_CHARS + 1})") if isinstance(instruction, str) \
        else F.substring(instruction, T.MED_SKIP_CHARS + 1, 2147483647)
    return F.concat(F.lit(T.MED_HEAD), body, F.lit(T.MED_TAIL))


def routed_expr(dataset="dataset", instruction="instruction") -> Column:
    """R8: 'Fin' in the dataset name -> R5, else R6."""
    return F.when(col_(dataset).contains("Fin"), fin_expr(instruction)).otherwise(med_expr(instruction))


def prompt_repeat(exemplars: DataFrame, n: int, round_col: str = "round_id") -> DataFrame:
    """The same few-shot prompt repeated ``n`` times per round (a generator)."""
    return (prompt_icl(exemplars, round_col)
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))


def train_text_expr(style: str, eos: str, instruction="instruction", response="response") -> Column:
    """SFT training text for ``alpaca`` or ``vicuna``."""
    tpl = {"alpaca": T.ALPACA_TRAIN, "vicuna": T.VICUNA_TRAIN}[style]
    a, b = tpl.split("{}")[:2]
    return F.concat(F.lit(a), col_(instruction), F.lit(b), col_(response), F.lit(eos))


def response_mark(style: str) -> str:
    return {"alpaca": T.ALPACA_RESPONSE_MARK, "vicuna": T.VICUNA_RESPONSE_MARK}[style]


def ifd_text_exprs(style: str, instruction="instruction", inp="input", response="response"):
    """``(prompt_text, whole_text, answer_text)`` for ``wiz`` or ``alpaca``.

    ``answer_text`` is the answer alone: ``'### Response:' + response``.
    """
    ins, resp = col_(instruction), col_(response)
    has_input = F.coalesce(col_(inp), F.lit("")) != "" if inp is not None else F.lit(False)
    answer = F.concat(F.lit(T.IFD_RESPONSE), resp)
    if style == "wiz":
        plain = F.concat(ins, F.lit(T.IFD_WIZ_RESPONSE), resp)
        if inp is None:
            return ins, plain, answer
        with_input = F.concat(ins, F.lit(T.IFD_WIZ_INPUT), col_(inp), F.lit(T.IFD_WIZ_RESPONSE), resp)
        return ins, F.when(has_input, with_input).otherwise(plain), answer
    if style == "alpaca":
        p_no = _fill(T.IFD_PROMPT_NO_INPUT, instruction=ins)
        if inp is None:
            return p_no, F.concat(p_no, resp), answer
        p_in = _fill(T.IFD_PROMPT_INPUT, instruction=ins, input=inp)
        prompt = F.when(has_input, p_in).otherwise(p_no)
        return prompt, F.concat(prompt, resp), answer
    raise ValueError(style)


def embed_text_expr(instruction="instruction", response="response") -> Column:
    """R11."""
    a, b = T.EMBED_TEXT.split("{}")[:2]
    return F.concat(F.lit(a), col_(instruction), F.lit(b), col_(response))
