"""Registered queries: n-gram counts, corpus / sentence / trigram BLEU, mean length."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthweave.operators import bleu as B
from synthweave.plans.oracle_views import with_views
from synthweave.plans.registry import query
from synthweave.session import spread
from synthweave.sources import fixtures as V


_WORD = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"


def _sql_ngrams(src: str, key: str, orders: int = 4) -> str:
    """DuckDB n-grams of list column ``t`` in CTE ``src``: (key..., o, g, c)."""
    return f"""
  (SELECT {key}, o, g, count(*) AS c FROM (
     SELECT {key}, o, array_to_string(t[i:i + o - 1], ' ') AS g FROM (
       SELECT {key}, t, o, unnest(generate_series(1, len(t) - o + 1)) AS i FROM {src}, range(1, {orders + 1}) r(o)) x) y
   GROUP BY ALL)"""


@query("ngram_counts", with_views("v_pairs", extra=f"tok AS (SELECT row_id, regexp_extract_all(response, '{_WORD}') AS t FROM v_pairs)") + f"""
SELECT row_id, CAST(o AS INTEGER) AS "order", md5(g) AS ngram_md5, c AS cnt FROM {_sql_ngrams('tok', 'row_id')} n""")
def ngram_counts(spark, sf_dir):
    p = V.v_pairs(spark, sf_dir).select("row_id", B.tokens("response").alias("tokens"))
    c = B.ngram_counts(p, ["row_id"], hashed=False)
    return c.select("row_id", "order", F.md5("ngram").alias("ngram_md5"), "cnt")


_CORPUS = f"""
  hyp AS (SELECT row_id, regexp_extract_all(response, '{_WORD}') AS t FROM v_pairs),
  refs AS (SELECT row_id, 0 AS ref_id, regexp_extract_all(instruction, '{_WORD}') AS t FROM v_pairs
           UNION ALL
           SELECT a.row_id, 1, regexp_extract_all(b.response, '{_WORD}') FROM v_pairs a JOIN v_pairs b ON b.row_id = a.row_id + 2),
  rmax AS (SELECT row_id, o, g, max(c) AS c FROM {_sql_ngrams('refs', 'row_id, ref_id')} r GROUP BY row_id, o, g),
  hng AS {_sql_ngrams('hyp', 'row_id')},
  mt AS (SELECT h.o, sum(least(h.c, r.c)) AS m FROM hng h JOIN rmax r USING (row_id, o, g) GROUP BY h.o),
  ps AS (SELECT o, sum(greatest(len(t) - o + 1, 0)) AS p FROM hyp, range(1, 5) r(o) GROUP BY o),
  pr AS (SELECT o, (coalesce(m, 0) + 1.0) / (p + 1.0) AS prec FROM ps LEFT JOIN mt USING (o)),
  lens AS (SELECT (SELECT sum(len(t)) FROM hyp) AS tl,
                  (SELECT sum(ml) FROM (SELECT row_id, min(len(t)) AS ml FROM refs GROUP BY row_id) z) AS rl)"""


@query("bleu_corpus", with_views("v_pairs", extra=_CORPUS.strip()) + """
SELECT round(CASE WHEN min(prec) > 0 THEN exp(avg(ln(prec))) ELSE 0 END
             * CASE WHEN any_value(tl) / any_value(rl) > 1 THEN 1.0 ELSE exp(1 - 1 / (any_value(tl) / any_value(rl))) END, 9) AS bleu,
       round(max(CASE WHEN o = 1 THEN prec END), 9) AS p1, round(max(CASE WHEN o = 2 THEN prec END), 9) AS p2,
       round(max(CASE WHEN o = 3 THEN prec END), 9) AS p3, round(max(CASE WHEN o = 4 THEN prec END), 9) AS p4,
       round(CASE WHEN any_value(tl) / any_value(rl) > 1 THEN 1.0 ELSE exp(1 - 1 / (any_value(tl) / any_value(rl))) END, 9) AS bp,
       round(any_value(tl) / any_value(rl), 9) AS ratio,
       CAST(any_value(tl) AS BIGINT) AS translation_length, CAST(any_value(rl) AS BIGINT) AS reference_length
FROM pr, lens""")
def bleu_corpus(spark, sf_dir):
    p = V.v_pairs(spark, sf_dir)
    hyps = p.select("row_id", B.tokens("response").alias("tokens"))
    nxt = p.select((F.col("row_id") - 2).alias("row_id"), B.tokens("response").alias("tokens"))
    refs = (p.select("row_id", F.lit(0).alias("ref_id"), B.tokens("instruction").alias("tokens"))
            .unionByName(nxt.join(p.select("row_id"), "row_id").select("row_id", F.lit(1).alias("ref_id"), "tokens")))
    return B.corpus_bleu(hyps, refs, ["row_id"])


def _sent_pairs(spark, sf_dir):
    c = spread(V.v_corpus(spark, sf_dir).select("row_id", "instruction", "response"), "row_id")
    return c.select("row_id", B.tokens("instruction").alias("hyp"), B.tokens("response").alias("ref"))


_SENT = """
  sp AS (SELECT row_id, regexp_extract_all(instruction, '{word}') AS h, regexp_extract_all(response, '{word}') AS r FROM v_corpus),
  hs AS (SELECT row_id, h AS t FROM sp), rs AS (SELECT row_id, r AS t FROM sp),
  hn AS {hn}, rn AS {rn},
  mm AS (SELECT hn.row_id, hn.o, sum(least(hn.c, coalesce(rn.c, 0))) AS m, sum(hn.c) AS d
         FROM hn LEFT JOIN rn USING (row_id, o, g) GROUP BY hn.row_id, hn.o),
  gr AS (SELECT row_id, o, len(h) AS hl, len(r) AS rl FROM sp, range(1, {top}) x(o)),
  pp AS (SELECT gr.row_id, gr.o, hl, rl, coalesce(m, 0) AS m, greatest(coalesce(d, 0), 1) AS d
         FROM gr LEFT JOIN mm USING (row_id, o))"""
_BP = "CASE WHEN hl > rl THEN 1.0 WHEN hl = 0 THEN 0.0 ELSE exp(1 - rl / hl) END"


@query("bleu_sentence", with_views("v_corpus", extra=_SENT.format(
        hn=_sql_ngrams('hs', 'row_id'), rn=_sql_ngrams('rs', 'row_id'), top=5, word=_WORD).strip()) + f"""
SELECT row_id, round(CASE WHEN sum(CASE WHEN o = 1 THEN m END) = 0 THEN 0.0
                     ELSE any_value({_BP}) * exp(sum(0.25 * ln(CASE WHEN o = 1 THEN m / d ELSE (m + 1.0) / (d + 1.0) END))) END, 9)
       AS bleu
FROM pp GROUP BY row_id""")
def bleu_sentence(spark, sf_dir):
    return B.sentence_bleu(_sent_pairs(spark, sf_dir), ["row_id"])


@query("trigram_bleu", with_views("v_corpus", extra=_SENT.format(
        hn=_sql_ngrams('hs', 'row_id', 3), rn=_sql_ngrams('rs', 'row_id', 3), top=4, word=_WORD).strip() + """,
  w AS (SELECT row_id, any_value(hl) AS hl, any_value(rl) AS rl,
               sum(CASE WHEN o = 1 THEN m END) AS m1, sum(CASE WHEN o = 2 THEN m END) AS m2,
               sum(CASE WHEN o = 3 THEN m END) AS m3, sum(CASE WHEN o = 3 THEN d END) AS d3
        FROM pp GROUP BY row_id)""") + f"""
SELECT row_id, round(CASE WHEN m1 = 0 THEN 0.0 ELSE {_BP} *
         CASE WHEN m3 = 0 AND hl > 1
              THEN (1.0 / (power(2.0, 1 + CASE WHEN m2 = 0 THEN 1 ELSE 0 END) * 5 / ln(hl))) / d3
              WHEN m3 = 0 THEN 1.0 ELSE m3 / d3 END END, 9) AS bleu3
FROM w""")
def trigram_bleu(spark, sf_dir):
    return B.trigram_bleu(_sent_pairs(spark, sf_dir), ["row_id"])


@query("avg_length", with_views("v_pairs") + """
SELECT round(avg(length(instruction)), 9) AS avg_len_instruction FROM v_pairs""")
def avg_length(spark, sf_dir):
    return B.avg_length(V.v_pairs(spark, sf_dir), "instruction")
