"""Registered queries: training texts, token losses, perplexity, token ids,
completion masks, IFD rows / mean / top-k and the IFD job."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from synthweave.functions import templates as TT
from synthweave.operators import ifd as I
from synthweave.operators import lm as L
from synthweave.operators import prompts as R
from synthweave.plans.oracle_views import with_views
from synthweave.plans.registry import ORACLES, query
from synthweave.sources import files as IO
from synthweave.sources import fixtures as V
from synthweave.sources.tables import load

MAXLEN = 512
NL = "chr(10)"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _q(s: str) -> str:
    """DuckDB expression for a Python string (newlines as chr(10))."""
    parts = s.split("\n")
    return f" || {NL} || ".join("'" + p.replace("'", "''") + "'" for p in parts)


_LM_SQL = f"""
  corp AS (SELECT {_tok('text')} AS t FROM documents),
  bg AS (SELECT t[i] AS h, t[i + 1] AS w, count(*) AS c
         FROM (SELECT t, unnest(generate_series(1, len(t) - 1)) AS i FROM corp WHERE len(t) >= 2) x GROUP BY ALL),
  hist AS (SELECT h, sum(c) AS ch FROM bg GROUP BY h),
  vs AS (SELECT count(DISTINCT tok) AS v FROM (SELECT unnest(t) AS tok FROM corp) y)"""


def _sql_losses(src: str, name: str) -> str:
    """Token losses of ``src(row_id, text, bud)`` into CTE ``name(row_id, pos, loss)``."""
    return f"""
  {name}_t AS (SELECT row_id, t[1:bud] AS t FROM (SELECT row_id, {_tok('text')} AS t, bud FROM {src}) z),
  {name}_p AS (SELECT row_id, p AS pos, t[p] AS h, t[p + 1] AS w, CASE WHEN t[1] = t[p + 1] THEN 1 ELSE 0 END AS f0
               FROM (SELECT row_id, t, unnest(generate_series(1, len(t) - 1)) AS p FROM {name}_t) q),
  {name}_s AS (SELECT *, row_number() OVER (PARTITION BY row_id, w ORDER BY pos) - 1 + f0 AS seen FROM {name}_p),
  {name} AS (SELECT {name}_s.row_id, {name}_s.pos,
                    -ln(0.5 * (seen + 1.0) / (pos + (SELECT v FROM vs))
                        + 0.5 * (coalesce(bg.c, 0) + 1.0) / (coalesce(hist.ch, 0) + (SELECT v FROM vs))) AS loss
             FROM {name}_s LEFT JOIN bg USING (h, w) LEFT JOIN hist USING (h))"""


def _lm(spark, sf_dir):
    return L.BigramLM(load(spark, sf_dir, "documents"), "text")


def _whole(df):
    return df.select("row_id", "response",
                     F.concat("instruction", F.lit(TT.IFD_WIZ_RESPONSE), "response").alias("text"))


_WHOLE_SQL = f"whole AS (SELECT row_id, response, instruction || {_q(TT.IFD_WIZ_RESPONSE)} || response AS text, {MAXLEN} AS bud FROM v_pairs)"


@query("token_loss", with_views("v_pairs", extra=_LM_SQL.strip() + ",\n  " + _WHOLE_SQL + "," + _sql_losses("whole", "ll")) + """
SELECT row_id, CAST(pos AS INTEGER) AS pos, round(loss, 9) AS loss FROM ll""")
def token_loss(spark, sf_dir):
    out = L.token_losses(_whole(V.v_pairs(spark, sf_dir)), _lm(spark, sf_dir), "row_id", "text", MAXLEN)
    return out.select("row_id", F.col("pos").cast("int").alias("pos"), "loss")


@query("perplexity", with_views("v_pairs", extra=_LM_SQL.strip() + ",\n  " + _WHOLE_SQL + "," + _sql_losses("whole", "ll")) + """
SELECT row_id, round(avg(loss), 9) AS mean_loss, round(exp(avg(loss)), 4) AS ppl FROM ll GROUP BY row_id""")
def perplexity(spark, sf_dir):
    losses = L.token_losses(_whole(V.v_pairs(spark, sf_dir)), _lm(spark, sf_dir), "row_id", "text", MAXLEN)
    # perplexities reach 1e4-1e5: compare them at 4 decimals (14 significant digits)
    return (L.perplexity(losses).join(losses.groupBy("row_id").agg(F.avg("loss").alias("mean_loss")), "row_id")
            .select("row_id", "mean_loss", F.round("ppl", 4).alias("ppl")))


def _sql_rfind(t: str, s: str) -> str:
    return (f"CASE WHEN length({s}) = 0 THEN length({t}) WHEN strpos(reverse({t}), reverse({s})) = 0 THEN -1 "
            f"ELSE length({t}) - strpos(reverse({t}), reverse({s})) - length({s}) + 1 END")


@query("answer_loss", with_views("v_pairs", extra=_LM_SQL.strip() + ",\n  " + _WHOLE_SQL + "," + _sql_losses("whole", "ll") + f""",
  st AS (SELECT row_id, len({_tok(f"substr(text, 1, greatest({_sql_rfind('text', 'response')}, 0))")}) AS start FROM whole)""") + """
SELECT row_id, round(avg(loss), 9) AS answer_loss, count(*) AS n_answer_tokens
FROM ll JOIN st USING (row_id) WHERE pos >= start GROUP BY row_id""")
def answer_loss(spark, sf_dir):
    return L.answer_loss(_whole(V.v_pairs(spark, sf_dir)), _lm(spark, sf_dir), "row_id", "text", "response", MAXLEN)


_VOCAB_SQL = """
  uni AS (SELECT tok AS token, count(*) AS cnt FROM (SELECT unnest(t) AS tok FROM corp) u GROUP BY tok),
  voc AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS id FROM uni)"""


def _sql_ids(src: str, seq: int) -> str:
    return f"""
  ids AS (SELECT row_id, CAST(p - 1 AS INTEGER) AS pos, coalesce(voc.id, -1) AS input_id
          FROM (SELECT row_id, t, unnest(generate_series(1, len(t))) AS p FROM
                (SELECT row_id, {_tok('text')}[1:{seq}] AS t FROM {src}) a) b
          LEFT JOIN voc ON voc.token = b.t[b.p])"""


@query("tokenize_truncate", with_views("v_pairs", extra=_LM_SQL.strip() + "," + _VOCAB_SQL
                                       + ",\n  src AS (SELECT row_id, response AS text FROM v_pairs)," + _sql_ids("src", 64)) + """
SELECT row_id, pos, CAST(input_id AS BIGINT) AS input_id, CAST(input_id AS BIGINT) AS label FROM ids""")
def tokenize_truncate(spark, sf_dir):
    voc = L.vocab(_lm(spark, sf_dir))
    df = V.v_pairs(spark, sf_dir).select("row_id", F.col("response").alias("text"))
    return L.tokenize_truncate(df, voc, "row_id", "text", 64).select(
        "row_id", F.col("pos").cast("int").alias("pos"), "input_id", "label")


_ALPACA_A, _ALPACA_B = TT.ALPACA_TRAIN.split("{}")[:2]
_VICUNA_A, _VICUNA_B = TT.VICUNA_TRAIN.split("{}")[:2]


def _sql_train(a: str, b: str) -> str:
    return f"{_q(a)} || instruction || {_q(b)} || response || '</s>'"


@query("completion_mask", with_views("v_pairs", extra=_LM_SQL.strip() + "," + _VOCAB_SQL
                                     + f",\n  src AS (SELECT row_id, {_sql_train(_ALPACA_A, _ALPACA_B)} AS text FROM v_pairs),"
                                     + _sql_ids("src", 128) + f""",
  ms AS (SELECT row_id, len({_tok(f"CASE WHEN strpos(text, {_q(TT.ALPACA_RESPONSE_MARK)}) > 0 THEN substr(text, 1, strpos(text, {_q(TT.ALPACA_RESPONSE_MARK)}) + {len(TT.ALPACA_RESPONSE_MARK) - 1}) ELSE text END")}) AS st FROM src)""") + """
SELECT row_id, pos, CAST(input_id AS BIGINT) AS input_id,
       CAST(CASE WHEN pos < st THEN -100 ELSE input_id END AS BIGINT) AS label
FROM ids JOIN ms USING (row_id)""")
def completion_mask(spark, sf_dir):
    voc = L.vocab(_lm(spark, sf_dir))
    df = V.v_pairs(spark, sf_dir).select("row_id", R.train_text_expr("alpaca", "</s>").alias("text"))
    return L.completion_mask(df, voc, R.response_mark("alpaca"), "row_id", "text", 128).select(
        "row_id", F.col("pos").cast("int").alias("pos"), "input_id", "label")


@query("train_text", with_views("v_pairs") + f"""
SELECT row_id, {_sql_train(_ALPACA_A, _ALPACA_B)} AS text FROM v_pairs""")
def train_text(spark, sf_dir):
    return V.v_pairs(spark, sf_dir).select("row_id", R.train_text_expr("alpaca", "</s>").alias("text"))


@query("train_text_vicuna", with_views("v_pairs") + f"""
SELECT row_id, {_sql_train(_VICUNA_A, _VICUNA_B)} AS text FROM v_pairs""")
def train_text_vicuna(spark, sf_dir):
    return V.v_pairs(spark, sf_dir).select("row_id", R.train_text_expr("vicuna", "</s>").alias("text"))


_P_IN = TT.IFD_PROMPT_INPUT.replace("{instruction}", "\x00I\x00").replace("{input}", "\x00N\x00")
_P_NO = TT.IFD_PROMPT_NO_INPUT.replace("{instruction}", "\x00I\x00")


def _sql_fill(tpl: str) -> str:
    out = []
    for part in tpl.split("\x00"):
        if part == "I":
            out.append("instruction")
        elif part == "N":
            out.append("input")
        elif part:
            out.append(_q(part))
    return " || ".join(out)


@query("ifd_text_alpaca", with_views("v_alpaca") + f"""
SELECT row_id, p AS prompt, p || output AS whole, '### Response:' || output AS answer FROM (
  SELECT row_id, output, CASE WHEN input <> '' THEN {_sql_fill(_P_IN)} ELSE {_sql_fill(_P_NO)} END AS p FROM v_alpaca) t""")
def ifd_text_alpaca(spark, sf_dir):
    df = V.v_alpaca(spark, sf_dir).withColumnRenamed("output", "response")
    p, w, a = R.ifd_text_exprs("alpaca")
    return df.select("row_id", p.alias("prompt"), w.alias("whole"), a.alias("answer"))


@query("ifd_text_wiz", with_views("v_alpaca") + f"""
SELECT row_id, instruction AS prompt,
       CASE WHEN input <> '' THEN instruction || {_q(TT.IFD_WIZ_INPUT)} || input || {_q(TT.IFD_WIZ_RESPONSE)} || output
            ELSE instruction || {_q(TT.IFD_WIZ_RESPONSE)} || output END AS whole,
       '### Response:' || output AS answer FROM v_alpaca""")
def ifd_text_wiz(spark, sf_dir):
    df = V.v_alpaca(spark, sf_dir).withColumnRenamed("output", "response")
    p, w, a = R.ifd_text_exprs("wiz")
    return df.select("row_id", p.alias("prompt"), w.alias("whole"), a.alias("answer"))


@query("embed_text", with_views("v_pairs") + f"""
SELECT row_id, '#instruction:' || {NL} || instruction || {NL} || '#response:' || {NL} || response AS text FROM v_pairs""")
def embed_text(spark, sf_dir):
    return V.v_pairs(spark, sf_dir).select("row_id", R.embed_text_expr().alias("text"))


def _sql_ifd(rows_sql: str, maxlen: int) -> str:
    """IFD rows over ``rows0(row_id, response, p, whole, alone)`` -> CTE ``ifd``."""
    return f"""
  rows0 AS ({rows_sql}),
  rows1 AS (SELECT *, least(len({_tok('p')}), {maxlen}) AS ilen,
                  {_sql_rfind('alone', 'response')} AS i1, {_sql_rfind('whole', 'response')} AS i2 FROM rows0),
  rows2 AS (SELECT *, {maxlen} - ilen + 4 AS b1,
                  len({_tok('substr(alone, 1, greatest(i1, 0))')}) AS start1,
                  least(len({_tok('alone')}), {maxlen} - ilen + 4) AS end1,
                  len({_tok('substr(whole, 1, greatest(i2, 0))')}) AS start2,
                  least(len({_tok('whole')}), {maxlen}) AS end2 FROM rows1),
  gated AS (SELECT * FROM rows2 WHERE {maxlen} - ilen > 0 AND end1 - start1 > 0 AND end2 - start2 > 0
                                  AND ilen + end1 - start1 <= {maxlen}),
  src1 AS (SELECT row_id, alone AS text, b1 AS bud FROM gated),
  src2 AS (SELECT row_id, whole AS text, {maxlen} AS bud FROM gated),{_sql_losses('src1', 'l1')},{_sql_losses('src2', 'l2')},
  m1 AS (SELECT l1.row_id, avg(loss) AS mean1 FROM l1 JOIN gated g USING (row_id) WHERE pos >= start1 AND pos < end1 GROUP BY l1.row_id),
  m2 AS (SELECT l2.row_id, avg(loss) AS mean2 FROM l2 JOIN gated g USING (row_id) WHERE pos >= start2 AND pos < end2 GROUP BY l2.row_id),
  ifd AS (SELECT row_id, mean1 AS mean_alone, mean2 AS mean_cond, mean2 / mean1 AS ifd FROM m1 JOIN m2 USING (row_id)
          WHERE mean2 / mean1 <= 1)"""


_WIZ_ROWS = (f"SELECT row_id, response, instruction AS p, instruction || {_q(TT.IFD_WIZ_RESPONSE)} || response AS whole, "
             f"'### Response:' || response AS alone FROM v_pairs")
_IFD_WIZ = with_views("v_pairs", extra=_LM_SQL.strip() + "," + _sql_ifd(_WIZ_ROWS, MAXLEN))


def _ifd_wiz(spark, sf_dir):
    return I.ifd_rows(V.v_pairs(spark, sf_dir), _lm(spark, sf_dir), "wiz", MAXLEN)


@query("ifd_rows", _IFD_WIZ + """
SELECT row_id, round(mean_alone, 9) AS mean_alone, round(mean_cond, 9) AS mean_cond, round(ifd, 9) AS ifd FROM ifd""")
def ifd_rows(spark, sf_dir):
    return _ifd_wiz(spark, sf_dir)


def _losses_written(spark, sf_dir) -> str:
    """The pairs' loss table (S10), written once; its path."""
    path = IO.scratch(spark, "token_losses")
    IO.write_once(I.loss_table(V.v_pairs(spark, sf_dir), _lm(spark, sf_dir), "wiz", MAXLEN), path)
    return path


def _read_losses(spark, path: str):
    return IO.read_dataset(spark, path, f"row_id bigint, {I.LOSS_TABLE}", "parquet")


@query("loss_table", _IFD_WIZ + """
SELECT g.row_id, round(exp(m1.mean1), 4) AS ppl_alone, round(exp(m2.mean2), 4) AS ppl_cond,
       coalesce(c1.n, 0) AS n_alone, coalesce(c2.n, 0) AS n_cond, round(coalesce(c1.s, 0), 6) AS sum_alone, round(coalesce(c2.s, 0), 6) AS sum_cond
FROM gated g LEFT JOIN m1 USING (row_id) LEFT JOIN m2 USING (row_id)
LEFT JOIN (SELECT row_id, count(*) AS n, sum(loss) AS s FROM l1 GROUP BY row_id) c1 USING (row_id)
LEFT JOIN (SELECT row_id, count(*) AS n, sum(loss) AS s FROM l2 GROUP BY row_id) c2 USING (row_id)""")
def loss_table(spark, sf_dir):
    back = _read_losses(spark, _losses_written(spark, sf_dir))
    total = lambda i: F.round(F.aggregate(F.get("token_loss", F.lit(i)), F.lit(0.0), lambda a, x: a + x), 6)
    return back.select("row_id", F.round(F.get("ppl", F.lit(1)), 4).alias("ppl_alone"), F.round(F.get("ppl", F.lit(2)), 4).alias("ppl_cond"),
                       F.size(F.get("token_loss", F.lit(1))).cast("bigint").alias("n_alone"), F.size(F.get("token_loss", F.lit(2))).cast("bigint").alias("n_cond"),
                       total(1).alias("sum_alone"), total(2).alias("sum_cond"))


@query("ifd_stored", _IFD_WIZ + """
SELECT row_id, round(mean_alone, 9) AS mean_alone, round(mean_cond, 9) AS mean_cond, round(ifd, 9) AS ifd FROM ifd""")
def ifd_stored(spark, sf_dir):
    """IFD rows from a loss table that an earlier job wrote; only the spans are counted again."""
    table = _read_losses(spark, _losses_written(spark, sf_dir))
    return I.ifd_from_losses(table, I.span_rows(V.v_pairs(spark, sf_dir), "wiz", MAXLEN), MAXLEN)


class WordLengthScorer:
    """A model small enough for SQL: words between blanks, each as surprising as it is long."""

    def lengths(self, texts):
        return texts.str.count(r"(?a:\S+)")

    def losses(self, texts, limits):
        return pd.Series([np.log1p([len(w) for w in re.findall(r"(?a:\S+)", t)[1:n]]).tolist() if n > 0 else [] for t, n in zip(texts, limits)], index=texts.index)


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^ \\t\\n\\r\\f\\v]+')"


def _sql_word_losses(i: int, text: str, budget: str) -> str:
    return (f"list_transform(list_slice({_words(text)}, 2, {budget}), lambda w: ln(1 + length(w))) AS loss{i}, "
            f"len({_words(f'substr({text}, 1, greatest(i{i}, 0))')}) AS start{i}, greatest(least(len({_words(text)}), {budget}), 0) AS end{i}")


@query("ifd_scored", with_views("v_pairs", extra=f"""
  rows0 AS ({_WIZ_ROWS}),
  rows1 AS (SELECT *, least(len({_words('p')}), {MAXLEN}) AS ilen, {_sql_rfind('alone', 'response')} AS i1, {_sql_rfind('whole', 'response')} AS i2 FROM rows0),
  rows2 AS (SELECT row_id, ilen, {_sql_word_losses(1, 'alone', f'({MAXLEN} - ilen + 4)')}, {_sql_word_losses(2, 'whole', str(MAXLEN))} FROM rows1),
  means AS (SELECT row_id, list_avg(list_slice(loss1, greatest(start1, 1), end1 - 1)) AS mean1, list_avg(list_slice(loss2, greatest(start2, 1), end2 - 1)) AS mean2
            FROM rows2 WHERE {MAXLEN} - ilen > 0 AND end1 - start1 > 0 AND end2 - start2 > 0 AND ilen + end1 - start1 <= {MAXLEN})""") + """
SELECT row_id, round(mean1, 9) AS mean_alone, round(mean2, 9) AS mean_cond, round(mean2 / mean1, 9) AS ifd
FROM means WHERE mean1 IS NOT NULL AND mean2 IS NOT NULL AND mean2 / mean1 <= 1""")
def ifd_scored(spark, sf_dir):
    """S10 and IFD with a model of the user's, loaded once per task; the loss table is written and read back."""
    path = IO.scratch(spark, "scored_losses")
    IO.write_once(I.scored_losses(V.v_pairs(spark, sf_dir), WordLengthScorer, "wiz", MAXLEN), path)
    return I.ifd_from_losses(spark.read.parquet(path), max_length=MAXLEN)


@query("ifd_mean", _IFD_WIZ + """
SELECT round(avg(ifd), 9) AS ifd_mean, count(*) AS n_rows FROM ifd""")
def ifd_mean(spark, sf_dir):
    return I.ifd_mean(_ifd_wiz(spark, sf_dir))


@query("ifd_topk", _IFD_WIZ + """
SELECT p.row_id, p.instruction, p.response FROM v_pairs p JOIN (
  SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY ifd DESC, row_id DESC) AS rk FROM ifd) r
  WHERE rk <= floor((SELECT count(*) FROM ifd) * 0.1)) t USING (row_id)""")
def ifd_topk(spark, sf_dir):
    return I.ifd_topk(_ifd_wiz(spark, sf_dir), V.v_pairs(spark, sf_dir), rate=0.1) \
        .select("row_id", "instruction", "response")


_ALP_ROWS = (f"SELECT row_id, output AS response, p, p || output AS whole, '### Response:' || output AS alone FROM ("
             f"SELECT row_id, output, CASE WHEN input <> '' THEN {_sql_fill(_P_IN)} ELSE {_sql_fill(_P_NO)} END AS p "
             f"FROM v_alpaca) a")


@query("job_ifd", with_views("v_alpaca", extra=_LM_SQL.strip() + "," + _sql_ifd(_ALP_ROWS, 1024)) + """
SELECT row_id, round(ifd, 9) AS ifd FROM ifd""")
def job_ifd(spark, sf_dir):
    df = V.v_alpaca(spark, sf_dir).withColumnRenamed("output", "response").select("row_id", "instruction", "input", "response")
    return I.ifd_rows(df, _lm(spark, sf_dir), "alpaca", 1024).select("row_id", "ifd")


@query("ifd_selected_file", ORACLES["ifd_topk"])
def ifd_selected_file(spark, sf_dir):
    """The selected subset as JSON array files, read back."""
    path = IO.scratch(spark, "ifd_selected")
    IO.write_json_arrays(ifd_topk(spark, sf_dir), path)
    return IO.scan_mixed_json(spark, path, "row_id long, instruction string, response string").select("row_id", "instruction", "response")


# R10 under its planned name: the generator's ``wiz`` form, used for both stages
query("ifd_text", ORACLES["ifd_text_wiz"])(lambda spark, sf_dir: ifd_text_wiz(spark, sf_dir))
