"""Registered queries: embedding moments, FID, MAUVE, TF-IDF embeddings,
client quality and the original-vs-synthetic report."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthweave.operators import bleu as B
from synthweave.operators import distance as D
from synthweave.operators import prompts as R
from synthweave.plans import jobs as J
from synthweave.plans.oracle_views import with_views
from synthweave.plans.registry import query
from synthweave.session import stored
from synthweave.sources import fixtures as V


@query("embed_moments", with_views("v_sides", extra="""
  ex AS (SELECT vec_id, side, CAST(e.i AS INTEGER) - 1 AS i, CAST(e.x AS DOUBLE) AS x
         FROM v_sides, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS x) e)""") + """
SELECT a.side, a.i, b.i AS j, round(covar_samp(a.x, b.x), 9) AS cov
FROM ex a JOIN ex b ON a.vec_id = b.vec_id GROUP BY a.side, a.i, b.i""")
def embed_moments(spark, sf_dir):
    _, cov = D.moments(V.v_sides(spark, sf_dir))
    return cov.select("side", "i", "j", "cov")


@query("embed_means", with_views("v_sides", extra="""
  ex AS (SELECT vec_id, side, CAST(e.i AS INTEGER) - 1 AS i, CAST(e.x AS DOUBLE) AS x
         FROM v_sides, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS x) e)""") + """
SELECT side, i, round(avg(x), 9) AS mean FROM ex GROUP BY side, i""")
def embed_means(spark, sf_dir):
    means, _ = D.moments(V.v_sides(spark, sf_dir))
    return means


@query("fid")
def fid(spark, sf_dir):
    return D.fid(V.v_sides(spark, sf_dir))


@query("mauve")
def mauve(spark, sf_dir):
    return D.mauve(V.v_sides(spark, sf_dir))


_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


DIMS = 64


@query("embed_text_tfidf", with_views("v_pairs", extra=f"""
  tx AS (SELECT row_id, '#instruction:' || chr(10) || instruction || chr(10) || '#response:' || chr(10) || response AS text FROM v_pairs),
  tc AS (SELECT row_id, tok, count(*) AS tf FROM (SELECT row_id, unnest({_TOK.format('text')}) AS tok FROM tx) t GROUP BY ALL),
  df AS (SELECT tok, ln(((SELECT count(*) FROM tx) + 1) / (count(*) + 1)) AS idf FROM tc GROUP BY tok),
  sl AS (SELECT tok, idf, ('0x' || substr(h, 1, 8))::BIGINT % {DIMS} AS slot, ('0x' || substr(h, 9, 1))::BIGINT % 2 * 2 - 1 AS sign
         FROM (SELECT tok, idf, md5(tok || ':' || CAST(k AS VARCHAR)) AS h FROM df, range(0, 4) r(k)) x),
  vv AS (SELECT row_id, slot, sum(tf * idf * sign) AS x FROM tc JOIN sl USING (tok) GROUP BY row_id, slot),
  nn AS (SELECT row_id, sqrt(sum(x * x)) AS n FROM vv GROUP BY row_id)""") + f"""
SELECT row_id, CAST(i AS INTEGER) AS i, round(CASE WHEN coalesce(n, 0) > 0 THEN coalesce(x, 0.0) / n ELSE 0.0 END, 6) + 0.0 AS x
FROM tx, range(0, {DIMS}) g(i) LEFT JOIN vv ON vv.row_id = tx.row_id AND vv.slot = g.i LEFT JOIN nn USING (row_id)""".replace("SELECT row_id, CAST", "SELECT tx.row_id, CAST").replace("LEFT JOIN nn USING (row_id)", "LEFT JOIN nn ON nn.row_id = tx.row_id"))
def embed_text_tfidf(spark, sf_dir):
    df = V.v_pairs(spark, sf_dir).select("row_id", R.embed_text_expr().alias("text"))
    return D.tfidf_embed(df, ["row_id"], "text", DIMS).select("row_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6) + 0.0)


def letter_encoder():
    """An encoder small enough for SQL: length and letter counts."""
    return lambda texts: zip(texts.str.len(), *(texts.str.count(c) for c in "aeiou"))


@query("embed_text_user", with_views("v_pairs") + """
SELECT row_id, CAST(i AS INTEGER) AS i, CAST(x AS DOUBLE) AS x FROM (
  SELECT row_id, unnest(range(0, 6)) AS i, unnest([length(response)] || [length(response) - length(replace(response, c, '')) FOR c IN ['a', 'e', 'i', 'o', 'u']]) AS x
  FROM v_pairs) t""")
def embed_text_user(spark, sf_dir):
    """L7 with an encoder of the user's, built once per task."""
    df = V.v_pairs(spark, sf_dir).select("row_id", F.col("response").alias("text"))
    return D.encode(df, letter_encoder, ["row_id"]).select("row_id", F.posexplode("embedding").alias("i", "x"))




@query("client_quality", with_views("v_corpus", "v_pairs", extra=f"""
  rp AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, response FROM v_pairs),
  syn AS (SELECT c.client_id, c.instruction || ' ' || r.response AS text FROM v_corpus c
          JOIN rp r ON r.pos = (('0x' || substr(md5(CAST(c.row_id AS VARCHAR) || ':' || 'gen' || ':' || '13'), 1, 15))::BIGINT
                                % (SELECT count(*) FROM v_pairs))
          WHERE r.response IS NOT NULL AND r.response <> ''),
  org AS (SELECT client_id, instruction || ' ' || response AS text FROM v_corpus),
  ba AS (SELECT client_id, tok, count(*) AS ca FROM (SELECT client_id, unnest({_TOK.format('text')}) AS tok FROM org) x GROUP BY ALL),
  bb AS (SELECT client_id, tok, count(*) AS cb FROM (SELECT client_id, unnest({_TOK.format('text')}) AS tok FROM syn) y GROUP BY ALL),
  j AS (SELECT coalesce(ba.client_id, bb.client_id) AS client_id, coalesce(ca, 0) AS ca, coalesce(cb, 0) AS cb
        FROM ba FULL JOIN bb ON ba.client_id = bb.client_id AND ba.tok = bb.tok),
  agg AS (SELECT client_id, sum(ca * cb) AS d,
                 sum(ca * ca * CASE WHEN ca > 0 AND cb > 0 THEN 1 ELSE (1 + ln(1.5)) * (1 + ln(1.5)) END) AS na,
                 sum(cb * cb * CASE WHEN ca > 0 AND cb > 0 THEN 1 ELSE (1 + ln(1.5)) * (1 + ln(1.5)) END) AS nb
          FROM j GROUP BY client_id)""") + """
SELECT client_id, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE d / (sqrt(na) * sqrt(nb)) END, 9) AS a FROM agg""")
def client_quality(spark, sf_dir):
    corpus = V.v_corpus(spark, sf_dir)
    org = corpus.select("client_id", F.concat_ws(" ", "instruction", "response").alias("text"))
    syn = (J.job_reanswer(spark, sf_dir).join(corpus.select("row_id", "client_id"), "row_id")
           .select("client_id", F.concat_ws(" ", "instruction", "output").alias("text")))
    return D.bag_cosine(org, syn, "client_id")


@query("job_distance")
def job_distance(spark, sf_dir):
    """Original (pairs) vs synthetic (re-answered corpus) -- FID, MAUVE, lengths, BLEU."""
    pairs = stored(V.v_pairs(spark, sf_dir))                                 # both are read by every measure
    synth = stored(J.job_reanswer(spark, sf_dir).withColumnRenamed("output", "response"))
    both = (pairs.select(F.lit(0).alias("side"), "row_id", R.embed_text_expr().alias("text"))
            .unionByName(synth.select(F.lit(1).alias("side"), "row_id", R.embed_text_expr().alias("text"))))
    emb = stored(D.tfidf_embed(both, ["side", "row_id"], "text", DIMS).select("side", "embedding"))  # read by FID and MAUVE
    fid_v = D.fid(emb).first()["fid"]
    mv = D.mauve(emb).first()["mauve"]
    # corpus BLEU of the re-answered responses against the original responses of the same row number
    hyps = synth.select("row_id", B.tokens("response").alias("tokens"))
    refs = V.v_corpus(spark, sf_dir).select("row_id", F.lit(0).alias("ref_id"), B.tokens("response").alias("tokens"))
    bleu_v = B.corpus_bleu(hyps, refs.join(hyps.select("row_id"), "row_id", "left_semi"), ["row_id"]).first()["bleu"]
    len_o = B.avg_length(pairs, "instruction").first()[0]
    len_s = B.avg_length(synth, "instruction").first()[0]
    return spark.createDataFrame([(float(fid_v), float(mv), float(bleu_v), float(len_o), float(len_s))],
                                 "fid double, mauve double, bleu double, avg_len_origin double, avg_len_synthetic double")
