"""Registered queries: preparation, sampling, sharding, parsing, prompting,
generation jobs.  Each has a DuckDB oracle unless marked rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthweave.operators import filters as FL
from synthweave.operators import generate as G
from synthweave.operators import normalize as N
from synthweave.operators import parse as X
from synthweave.operators import prompts as R
from synthweave.operators import sample as M
from synthweave.operators import shard as S
from synthweave.operators import similarity as SIM
from synthweave.plans import jobs as J
from synthweave.plans.oracle_views import md5_key, md5_pos, with_views
from synthweave.plans.registry import query
from synthweave.sources import fixtures as V
from synthweave.sources.tables import load

NL = "chr(10)"


def _sql_strip(x: str) -> str:
    """DuckDB twin of ``functions.text.py_strip``."""
    return rf"regexp_replace({x}, '^[\s\x0b\x1c-\x1f\x85\p{{Z}}]+|[\s\x0b\x1c-\x1f\x85\p{{Z}}]+\z', '', 'g')"


def _sql_alpaca(ins="instruction", inp="input") -> str:
    return f"CASE WHEN {inp} = '' THEN {ins} ELSE {ins} || ' ' || {inp} END"


# ---------------------------------------------------------------- C1 / M / F / P

@query("job_prepare", with_views("v_alpaca") + f"""
SELECT row_id, {_sql_alpaca()} AS instruction, output AS response
FROM (SELECT * FROM v_alpaca WHERE category = 'en'
      ORDER BY {md5_key('row_id', 0)}, row_id LIMIT 50) s""")
def job_prepare(spark, sf_dir):
    return J.job_prepare(V.v_alpaca(spark, sf_dir).where(F.col("category") == "en"), 50, seed=0)


@query("sample_exact", with_views("v_corpus") + f"""
SELECT row_id, client_id, instruction FROM v_corpus
ORDER BY {md5_key('row_id', 7)}, row_id LIMIT 100""")
def sample_exact(spark, sf_dir):
    return M.sample_exact(V.v_corpus(spark, sf_dir), 100, seed=7).select("row_id", "client_id", "instruction")


@query("shuffle_limit", with_views("v_pairs") + f"""
SELECT row_id, instruction, response FROM v_pairs
ORDER BY {md5_key('row_id', 2023)}, row_id LIMIT 500""")
def shuffle_limit(spark, sf_dir):
    return M.shuffle_limit(V.v_pairs(spark, sf_dir), 500, seed=2023).select("row_id", "instruction", "response")


@query("sample_per_file", with_views("v_corpus") + f"""
SELECT client_id, row_id FROM (
  SELECT client_id, row_id, row_number() OVER (PARTITION BY client_id ORDER BY {md5_key('row_id', 1)}, row_id) AS rn
  FROM v_corpus) t WHERE rn <= 20""")
def sample_per_file(spark, sf_dir):
    return M.sample_per_group(V.v_corpus(spark, sf_dir), "client_id", 20, seed=1).select("client_id", "row_id")


@query("client_cached_sample", with_views("v_corpus") + f"""
SELECT client_id, row_id, instruction FROM (
  SELECT client_id, row_id, instruction,
         row_number() OVER (PARTITION BY client_id ORDER BY {md5_key('row_id', 2023)}, row_id) AS rn
  FROM v_corpus) t WHERE rn <= 45""")
def client_cached_sample(spark, sf_dir):
    return (M.sample_per_group(V.v_corpus(spark, sf_dir), "client_id", 45, seed=2023)
            .select("client_id", "row_id", "instruction"))


@query("filter_language", """
SELECT conv_id, count(*) AS n_turns FROM conversations
WHERE role <> 'system' AND conv_id % 4 <> 0 GROUP BY conv_id""")
def filter_language(spark, sf_dir):
    arena = FL.filter_language(V.v_arena(spark, sf_dir), "English")
    return arena.select("conv_id", F.size("conversation_a").cast("bigint").alias("n_turns"))


@query("first_n", with_views("v_corpus") + """
SELECT row_id, instruction FROM v_corpus ORDER BY row_id LIMIT 100""")
def first_n(spark, sf_dir):
    return FL.first_n(V.v_corpus(spark, sf_dir), 100).select("row_id", "instruction")


@query("row_range", with_views("v_corpus") + """
SELECT row_id, category FROM (
  SELECT row_id, category, row_number() OVER (ORDER BY row_id) - 1 AS p FROM v_corpus) t
WHERE p >= 100""")
def row_range(spark, sf_dir):
    return FL.row_range(V.v_corpus(spark, sf_dir), 100, -1).select("row_id", "category")


@query("row_range_bounded", with_views("v_corpus") + """
SELECT row_id, category FROM (
  SELECT row_id, category, row_number() OVER (ORDER BY row_id) - 1 AS p FROM v_corpus) t
WHERE p >= 10 AND p < 150""")
def row_range_bounded(spark, sf_dir):
    return FL.row_range(V.v_corpus(spark, sf_dir), 10, 150).select("row_id", "category")


@query("norm_medical", with_views("v_medical") + """
SELECT row_id, Patient AS instruction, Doctor AS response FROM v_medical""")
def norm_medical(spark, sf_dir):
    return N.norm_medical(V.v_medical(spark, sf_dir)).select("row_id", "instruction", "response")


@query("norm_alpaca_always", with_views("v_alpaca") + """
SELECT row_id, instruction || ' ' || input AS instruction, output AS response FROM v_alpaca""")
def norm_alpaca_always(spark, sf_dir):
    return N.alpaca_always(V.v_alpaca(spark, sf_dir)).select("row_id", "instruction", "response")


_ARENA_SQL = """
  arena AS (SELECT conv_id,
                   list(text ORDER BY turn) AS texts
            FROM conversations WHERE role <> 'system' GROUP BY conv_id)"""


@query("norm_arena", "WITH " + _ARENA_SQL + """
SELECT conv_id, texts[1] AS instruction, texts[2] AS response FROM arena""")
def norm_arena(spark, sf_dir):
    return N.arena_first_turns(V.v_arena(spark, sf_dir)).select("conv_id", "instruction", "response")


@query("norm_alpaca", with_views("v_alpaca") + f"""
SELECT row_id, {_sql_alpaca()} AS instruction, output AS response FROM v_alpaca""")
def norm_alpaca(spark, sf_dir):
    return N.alpaca_format(V.v_alpaca(spark, sf_dir)).select("row_id", "instruction", "response")


@query("norm_generated", with_views("v_alpaca") + f"""
SELECT row_id, client_id, {_sql_alpaca()} AS instruction, output AS response FROM v_alpaca""")
def norm_generated(spark, sf_dir):
    out = N.norm_generated(V.v_alpaca(spark, sf_dir).drop("category"))
    return out.select("row_id", "client_id", "instruction", "response")


@query("norm_dispatch", with_views("v_pairs", "v_alpaca", extra=f"""
  u AS (
    SELECT 'gsm8k' AS dataset, row_id, instruction, response FROM v_pairs
    UNION ALL SELECT 'lighteval/MATH', row_id, instruction, response FROM v_pairs
    UNION ALL SELECT 'medalpaca/medical_meadow_medical_flashcards', row_id, instruction || '?', response FROM v_pairs
    UNION ALL SELECT name, row_id, {_sql_alpaca()}, output
              FROM v_alpaca, (SELECT unnest(['tatsu-lab/alpaca', 'vicgalle/alpaca-gpt4', 'gbharti/finance-alpaca',
                                             'lucasmccabe-lmi/CodeAlpaca-20k', 'yahma/alpaca-cleaned']) AS name) x
    UNION ALL SELECT name, row_id, instruction, response
              FROM v_pairs, (SELECT unnest(['iamtarun/python_code_instructions_18k_alpaca', 'FinGPT/fingpt-sentiment-train',
                                            'TIGER-Lab/MathInstruct', 'new']) AS name) y
    UNION ALL SELECT 'lmsys/chatbot_arena_conversations', conv_id, texts[1], texts[2]
              FROM (SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations WHERE role <> 'system' GROUP BY conv_id) z
    UNION ALL SELECT 'WizardLM/WizardLM_evol_instruct_70k', row_id, instruction, output FROM v_alpaca)""") + f"""
SELECT dataset, row_id, instruction, response FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {md5_key('row_id', 2023)}, row_id) AS rn FROM u) t
WHERE rn <= 150""")
def norm_dispatch(spark, sf_dir):
    return J.normalize_many(spark, sf_dir, n=150)


@query("prepare_shards", with_views("v_corpus") + f"""
SELECT row_id, CAST((rn - 1) // ((SELECT count(*) FROM v_corpus) // 10) AS INTEGER) AS client_id
FROM (SELECT row_id, row_number() OVER (ORDER BY length({_sql_strip('instruction')}), row_id) AS rn
      FROM v_corpus) t""")
def prepare_shards(spark, sf_dir):
    from synthweave.functions.text import py_strip
    prepped = N.prepare(V.v_corpus(spark, sf_dir),
                        lambda d: d.withColumn("instruction", py_strip("instruction")), ["category"])
    return S.shard_length(prepped, 10).select("row_id", "client_id")


@query("shard_iid", with_views("v_corpus") + f"""
SELECT row_id, CAST((rn - 1) % 7 AS INTEGER) AS client_id
FROM (SELECT row_id, row_number() OVER (ORDER BY {md5_key('row_id', 42)}, row_id) AS rn FROM v_corpus) t""")
def shard_iid(spark, sf_dir):
    return S.shard_iid(V.v_corpus(spark, sf_dir), 7, seed=42).select("row_id", "client_id")


_SHARD_LEN_SQL = """
SELECT row_id, CAST((rn - 1) // ((SELECT count(*) FROM v_corpus) // 10) AS INTEGER) AS client_id
FROM (SELECT row_id, row_number() OVER (ORDER BY length(instruction), row_id) AS rn FROM v_corpus) t"""


@query("shard_length", with_views("v_corpus") + _SHARD_LEN_SQL)
def shard_length(spark, sf_dir):
    return S.shard_length(V.v_corpus(spark, sf_dir), 10).select("row_id", "client_id")


@query("shard_skew", with_views("v_corpus", extra="""
  cats AS (SELECT category, count(*) AS len, row_number() OVER (ORDER BY category) - 1 AS idx,
                  count(*) OVER () AS k FROM v_corpus GROUP BY category),
  cs AS (SELECT category, len, CASE WHEN idx < 10 % k THEN 10 // k + 1 ELSE 10 // k END AS shards FROM cats),
  cs2 AS (SELECT category, shards, CASE WHEN shards > 0 THEN len // shards ELSE 0 END AS size,
                 coalesce(sum(shards) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS first FROM cs),
  r AS (SELECT row_id, category, row_number() OVER (PARTITION BY category ORDER BY row_id) AS rn FROM v_corpus)""") + """
SELECT row_id, CAST(first + (rn - 1) // size AS INTEGER) AS client_id
FROM r JOIN cs2 USING (category) WHERE size > 0 AND rn <= size * shards""")
def shard_skew(spark, sf_dir):
    return S.shard_skew(V.v_corpus(spark, sf_dir), 10).select("row_id", "client_id")


@query("shard_sizes", with_views("v_corpus", extra="sl AS (" + _SHARD_LEN_SQL + ")") + """
SELECT client_id, count(*) AS n FROM sl GROUP BY client_id""")
def shard_sizes(spark, sf_dir):
    return S.shard_sizes(S.shard_length(V.v_corpus(spark, sf_dir), 10))


# ---------------------------------------------------------------- X: parsing

def _sql_split(x, d, n):
    return f"split_part({x}, '{d}', {n})"


_SQL_HEAD = _sql_split("text", "###example:", 1)


@query("parse_instruction", with_views("v_raw_gen") + f"""
SELECT round_id, CASE WHEN strpos({_SQL_HEAD}, '##instruction:') > 0
                      THEN {_sql_strip(_sql_split(_SQL_HEAD, '##instruction:', 2))} END AS instruction
FROM v_raw_gen""")
def parse_instruction(spark, sf_dir):
    return X.parse_instruction(V.v_raw_gen(spark, sf_dir)).select("round_id", "instruction")


@query("parse_output", with_views("v_raw_gen") + f"""
SELECT round_id, {_sql_strip(_sql_split(_SQL_HEAD, '##', 1))} AS output FROM v_raw_gen""")
def parse_output(spark, sf_dir):
    return X.parse_output(V.v_raw_gen(spark, sf_dir)).select("round_id", "output")


_PAIR_SQL = f"""
  h AS (SELECT round_id, {_SQL_HEAD} AS head FROM v_raw_gen),
  o AS (SELECT round_id, head,
               {_sql_strip(_sql_split('head', '##output:', 2))} AS out,
               {_sql_split('head', '##output:', 1)} AS pre FROM h),
  parsed AS (SELECT round_id,
       CASE WHEN strpos(head, '##output:') > 0 AND strpos(out, '###example') = 0 AND strpos(out, '### example') = 0
                 AND strpos(pre, '##instruction:') > 0
            THEN {_sql_strip(_sql_split('pre', '##instruction:', 2))} END AS instruction,
       CASE WHEN strpos(head, '##output:') > 0 AND strpos(out, '###example') = 0 AND strpos(out, '### example') = 0
                 AND strpos(pre, '##instruction:') > 0
                 AND strpos(out, '##instruction') = 0 AND strpos(out, '##Instruction') = 0
            THEN out END AS output
     FROM o)"""


@query("parse_pair", with_views("v_raw_gen", extra=_PAIR_SQL) + """
SELECT round_id, instruction, output FROM parsed""")
def parse_pair(spark, sf_dir):
    return X.parse_pair(V.v_raw_gen(spark, sf_dir)).select("round_id", "instruction", "output")


@query("clean_response", with_views("v_raw_gen") + f"""
SELECT round_id, {_sql_split('text', '##', 1)} AS response FROM v_raw_gen""")
def clean_response(spark, sf_dir):
    df = V.v_raw_gen(spark, sf_dir).withColumnRenamed("text", "response")
    return X.clean_response(df).select("round_id", "response")


@query("strip_echo", with_views("v_raw_gen") + f"""
SELECT round_id, split_part(substr(('Q: ' || CAST(round_id AS VARCHAR) || {NL}) || text,
                                   length('Q: ' || CAST(round_id AS VARCHAR) || {NL}) + 1),
                            '###example:', 1) AS output
FROM v_raw_gen""")
def strip_echo(spark, sf_dir):
    df = (V.v_raw_gen(spark, sf_dir)
          .withColumn("prompt", F.concat(F.lit("Q: "), F.col("round_id").cast("string"), F.lit("\n")))
          .withColumn("echoed", F.concat("prompt", "text")))
    return df.select("round_id", X.strip_echo_expr("echoed", "prompt", "###example:").alias("output"))


# ---------------------------------------------------------------- A1 / F5

_TOK = r"[\p{L}\p{N}_]{2,}"
_IDF2 = "(1 + ln(1.5)) * (1 + ln(1.5))"


def _sql_tfidf(pairs_cte: str, key: str) -> str:
    """DuckDB closed-form TF-IDF cosine over CTE ``pairs_cte(key..., text_a, text_b)``."""
    return f"""
  ta AS (SELECT {key}, unnest(regexp_extract_all(lower(text_a), '{_TOK}')) AS tok FROM {pairs_cte}),
  tb AS (SELECT {key}, unnest(regexp_extract_all(lower(text_b), '{_TOK}')) AS tok FROM {pairs_cte}),
  ca AS (SELECT {key}, tok, count(*) AS c FROM ta GROUP BY ALL),
  cb AS (SELECT {key}, tok, count(*) AS c FROM tb GROUP BY ALL),
  na AS (SELECT {key}, sum(ca.c * ca.c * CASE WHEN cb.c IS NOT NULL THEN 1 ELSE {_IDF2} END) AS n2
         FROM ca LEFT JOIN cb USING ({key}, tok) GROUP BY {key}),
  nb AS (SELECT {key}, sum(cb.c * cb.c * CASE WHEN ca.c IS NOT NULL THEN 1 ELSE {_IDF2} END) AS n2
         FROM cb LEFT JOIN ca USING ({key}, tok) GROUP BY {key}),
  dt AS (SELECT {', '.join('ca.' + k for k in key.split(', '))}, sum(ca.c * cb.c) AS d FROM ca JOIN cb USING ({key}, tok) GROUP BY ALL),
  sims AS (SELECT {', '.join('p.' + k for k in key.split(', '))},
                  CASE WHEN na.n2 IS NULL AND nb.n2 IS NULL THEN NULL
                       WHEN na.n2 IS NULL OR nb.n2 IS NULL THEN 0.0
                       ELSE coalesce(dt.d, 0) / (sqrt(na.n2) * sqrt(nb.n2)) END AS sim
           FROM {pairs_cte} p LEFT JOIN na USING ({key}) LEFT JOIN nb USING ({key}) LEFT JOIN dt USING ({key}))"""


@query("tfidf_pair", with_views("v_pairs", extra="pp AS (SELECT row_id, instruction AS text_a, response AS text_b FROM v_pairs),"
                                + _sql_tfidf("pp", "row_id")) + """
SELECT row_id, round(sim, 9) AS sim FROM sims""")
def tfidf_pair(spark, sf_dir):
    p = V.v_pairs(spark, sf_dir).select("row_id", F.col("instruction").alias("text_a"),
                                         F.col("response").alias("text_b"))
    return SIM.tfidf_pair(p, ["row_id"])


# ---------------------------------------------------------------- M4 / R / L1 / C2-C5

def _sql_draw(seed: int, rounds: str = "SELECT row_id AS round_id FROM v_corpus", k: int = 3) -> str:
    n = "(SELECT count(*) FROM v_corpus)"
    draw = [md5_pos(["round_id", str(s)], seed, f"({n} - {s})") for s in range(3)]
    return f"""
  ranked AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, row_id, instruction, response FROM v_corpus),
  rounds{seed} AS ({rounds}),
  one{seed} AS (SELECT round_id, {draw[0]} AS p0, {draw[1]} AS t1, {draw[2]} AS t2 FROM rounds{seed}),
  two{seed} AS (SELECT round_id, p0, t1 + CASE WHEN t1 >= p0 THEN 1 ELSE 0 END AS p1, t2 FROM one{seed}),
  tri{seed} AS (SELECT round_id, p0, p1, t2 + CASE WHEN t2 >= least(p0, p1) THEN 1 ELSE 0 END AS t2 FROM two{seed}),
  pk{seed} AS (SELECT round_id, unnest([0, 1, 2]) AS slot,
                      unnest([p0, p1, t2 + CASE WHEN t2 >= greatest(p0, p1) THEN 1 ELSE 0 END]) AS pos FROM tri{seed}),
  draws{seed} AS (SELECT round_id, CAST(slot AS INTEGER) AS slot, row_id, instruction, response
                  FROM pk{seed} JOIN ranked USING (pos) WHERE slot < {k})"""


@query("fewshot_draw", with_views("v_corpus", extra=_sql_draw(0).lstrip().rstrip(",")) + """
SELECT round_id, slot, row_id FROM draws0""")
def fewshot_draw(spark, sf_dir):
    corpus = V.v_corpus(spark, sf_dir)
    return M.fewshot_draw(corpus, corpus.select(F.col("row_id").alias("round_id")), seed=0) \
        .select("round_id", "slot", "row_id")


_ICL_PIECE = (f"'###example:' || {NL} || {NL} || '##instruction: ' || {NL} || instruction || ' ' || {NL} || "
              f"'##output:' || {NL} || response || {NL} || {NL}")
_ICL_HEAD = ("'Based on the following examples, please generate a new and unique example that is different and "
             "follows the underlying pattern or theme. Try to make your generation as diverse as possible.' || "
             f"{NL} || {NL}")


def _sql_prompt_icl(draws: str) -> str:
    return f"""
  pr AS (SELECT round_id, {_ICL_HEAD} || string_agg({_ICL_PIECE}, '' ORDER BY slot) || '###example:' AS prompt
         FROM {draws} GROUP BY round_id)"""


@query("prompt_icl", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _sql_prompt_icl("draws0")) + """
SELECT round_id, prompt FROM pr""")
def prompt_icl(spark, sf_dir):
    return J.icl_prompts(spark, sf_dir)


@query("prompt_self1", with_views("v_corpus", extra=_sql_draw(0).strip() + f""",
  pr AS (SELECT round_id, string_agg('###example:' || {NL} || {NL} || '##instruction: ' || instruction || {NL}, ''
                                     ORDER BY slot) || '###example:' AS prompt FROM draws0 GROUP BY round_id)""") + """
SELECT round_id, prompt FROM pr""")
def prompt_self1(spark, sf_dir):
    corpus = V.v_corpus(spark, sf_dir)
    draws = M.fewshot_draw(corpus, corpus.select(F.col("row_id").alias("round_id")), seed=0)
    return R.prompt_self1(draws)


_SELF2_HEAD = ("'Come up with examples for the following tasks. Try to generate multiple examples when possible. "
               "If the task doesn''t require additional input, you can generate the output directly.' || " + NL)


@query("prompt_self2", with_views("v_corpus", extra=_sql_draw(5).strip() + f""",
  few AS (SELECT round_id, string_agg('###example:' || {NL} || {NL} || '##instruction: ' || {NL} || instruction || {NL}
                                      || '##output:' || {NL} || response || {NL} || {NL}, '' ORDER BY slot) AS fewshot
          FROM draws5 GROUP BY round_id)""") + f"""
SELECT c.row_id AS round_id,
       substr({_SELF2_HEAD} || coalesce(f.fewshot, '') || {NL} || '###example:' || {NL} || {NL} || '##instruction: '
              || {NL} || c.instruction || ' (new)' || {NL} || '##output:', 1, 4096) AS prompt
FROM v_corpus c LEFT JOIN few f ON f.round_id = c.row_id""")
def prompt_self2(spark, sf_dir):
    corpus = V.v_corpus(spark, sf_dir)
    draws = M.fewshot_draw(corpus, corpus.select(F.col("row_id").alias("round_id")), seed=5)
    new = corpus.select(F.col("row_id").alias("round_id"), F.concat("instruction", F.lit(" (new)")).alias("instruction"))
    return R.prompt_self2(new, draws, icl=True)


@query("prompt_instruct", with_views("v_corpus") + f"""
SELECT row_id, 'Below is an instruction that describes a task, paired with an input that provides further context. '
               || 'Write a response that appropriately completes the request.' || {NL} || {NL} || '### Instruction:'
               || {NL} || instruction || {NL} || {NL} || '### Response:' || {NL} AS prompt FROM v_corpus""")
def prompt_instruct(spark, sf_dir):
    return V.v_corpus(spark, sf_dir).select("row_id", R.instruct_expr().alias("prompt"))


_FIN_SQL = ("'Instruction: What is the sentiment of this news? Please choose an answer from "
            "{negative/neutral/positive}' || " + NL + " || substr(" + _sql_strip("split_part(instruction, '}.', 2)")
            + ", 1, 512) || " + NL + " || 'Answer: '")
_MED_SQL = ("'If you are a doctor, please answer the medical questions based on the patient''s description. ' || "
            + NL + " || " + NL + " || 'Patient: ' || substr(instruction, 94) || " + NL + " || 'ChatDoctor: '")


@query("prompt_fin", with_views("v_corpus") + f"""
SELECT row_id, {_FIN_SQL} AS prompt FROM (SELECT row_id, replace(response, '. ', '}}. ') AS instruction FROM v_corpus) t""")
def prompt_fin(spark, sf_dir):
    df = V.v_corpus(spark, sf_dir).select("row_id", F.replace("response", F.lit(". "), F.lit("}. ")).alias("instruction"))
    return df.select("row_id", R.fin_expr().alias("prompt"))


@query("prompt_med", with_views("v_corpus") + f"""
SELECT row_id, {_MED_SQL} AS prompt FROM (SELECT row_id, response AS instruction FROM v_corpus) t""")
def prompt_med(spark, sf_dir):
    df = V.v_corpus(spark, sf_dir).select("row_id", F.col("response").alias("instruction"))
    return df.select("row_id", R.med_expr().alias("prompt"))


@query("prompt_routed", with_views("v_corpus") + f"""
SELECT row_id, CASE WHEN strpos(dataset, 'Fin') > 0 THEN {_FIN_SQL} ELSE {_MED_SQL} END AS prompt
FROM (SELECT row_id, CASE WHEN category = 'en' THEN 'FinGPT-news' ELSE 'ChatDoctor' END AS dataset,
             replace(response, '. ', '}}. ') AS instruction FROM v_corpus) t""")
def prompt_routed(spark, sf_dir):
    df = V.v_corpus(spark, sf_dir).select(
        "row_id", F.when(F.col("category") == "en", "FinGPT-news").otherwise("ChatDoctor").alias("dataset"),
        F.replace("response", F.lit(". "), F.lit("}. ")).alias("instruction"))
    return df.select("row_id", R.routed_expr().alias("prompt"))


@query("prompt_repeat", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _sql_prompt_icl("draws0")) + """
SELECT round_id, CAST(c.copy AS INTEGER) AS copy, md5(prompt) AS prompt_md5 FROM pr, range(0, 3) c(copy)""")
def prompt_repeat(spark, sf_dir):
    corpus = V.v_corpus(spark, sf_dir)
    draws = M.fewshot_draw(corpus, corpus.select(F.col("row_id").alias("round_id")), seed=0)
    return R.prompt_repeat(draws, 3).select("round_id", F.col("copy").cast("int").alias("copy"),
                                            F.md5("prompt").alias("prompt_md5"))


_GEN_SQL = f"""
  gen AS (SELECT r.round_id, {NL} || '##instruction: ' || {NL} || k.instruction || {NL} || '##output:' || {NL}
                 || k.response || {NL} || {NL} || '###example:' || {NL} AS generation
          FROM (SELECT DISTINCT round_id FROM draws0) r
          JOIN ranked k ON k.pos = {md5_pos(['r.round_id', "'gen'"], 11, '(SELECT count(*) FROM v_corpus)')})"""


@query("generate_replay", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _GEN_SQL) + """
SELECT round_id, md5(generation) AS gen_md5, length(generation) AS gen_len FROM gen""")
def generate_replay(spark, sf_dir):
    gen = J.icl_generations(spark, sf_dir)
    return gen.select("round_id", F.md5("generation").alias("gen_md5"),
                      F.length("generation").cast("bigint").alias("gen_len"))


_GEN_PARSED = _GEN_SQL + "," + _PAIR_SQL.replace("FROM v_raw_gen", "FROM (SELECT round_id, generation AS text FROM gen) g")
_VERDICT_SQL = f"""
  pairs AS (SELECT p.round_id, d.slot, p.instruction AS text_a, d.instruction AS text_b
            FROM parsed p JOIN draws0 d USING (round_id)
            WHERE p.instruction IS NOT NULL AND p.instruction <> '' AND p.output IS NOT NULL AND p.output <> ''),
  {_sql_tfidf('pairs', 'round_id, slot').strip()},
  gate AS (SELECT round_id, max(coalesce(sim, 1.0)) AS max_sim FROM sims GROUP BY round_id),
  verdicts AS (SELECT p.round_id, p.instruction, p.output, g.max_sim,
       CASE WHEN p.instruction IS NULL OR p.instruction = '' OR p.output IS NULL OR p.output = '' THEN 'unparsed'
            WHEN g.max_sim > 0.52 OR length(p.instruction) <= 1 OR length(p.output) <= 1 THEN 'failed'
            ELSE 'kept' END AS verdict
     FROM parsed p LEFT JOIN gate g USING (round_id))"""


@query("job_icl", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _GEN_PARSED + "," + _VERDICT_SQL) + """
SELECT round_id, verdict, instruction, output, round(max_sim, 9) AS max_sim, index_list FROM verdicts
JOIN (SELECT round_id, string_agg(CAST(row_id AS VARCHAR), ',' ORDER BY slot) AS index_list FROM draws0 GROUP BY round_id) il
USING (round_id)""")
def job_icl(spark, sf_dir):
    ids = F.array_join(F.col("index_list").cast("array<string>"), ",").alias("index_list")
    return J.job_icl(spark, sf_dir).select("round_id", "verdict", "instruction", "output", "max_sim", ids)


@query("generation_verdicts", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _GEN_PARSED + "," + _VERDICT_SQL) + """
SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict""")
def generation_verdicts(spark, sf_dir):
    return J.job_icl(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("similarity_gate", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _GEN_PARSED + "," + _VERDICT_SQL) + """
SELECT round_id, round(max_sim, 9) AS max_sim, max_sim > 0.52 AS similar FROM gate""")
def similarity_gate(spark, sf_dir):
    return J.icl_gate(spark, sf_dir).select("round_id", "max_sim", "similar")


@query("answer_nonempty", with_views("v_corpus") + """
SELECT row_id, response AS output FROM v_corpus WHERE response IS NOT NULL AND response <> ''""")
def answer_nonempty(spark, sf_dir):
    return FL.answer_nonempty(V.v_corpus(spark, sf_dir).select("row_id", F.col("response").alias("output")))


@query("generation_coverage", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _GEN_PARSED + "," + _VERDICT_SQL) + """
SELECT c.row_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_outputs,
       CASE WHEN coalesce(g.n, 0) = 0 THEN 'missing' WHEN g.n = 1 THEN 'ok' ELSE 'duplicate' END AS status
FROM v_corpus c LEFT JOIN (SELECT round_id AS row_id, count(*) AS n FROM verdicts
                           WHERE verdict <> 'unparsed' GROUP BY 1) g USING (row_id)""")
def generation_coverage(spark, sf_dir):
    prompts = V.v_corpus(spark, sf_dir).select("row_id")
    outs = (J.job_icl(spark, sf_dir).where(F.col("verdict") != "unparsed")
            .select(F.col("round_id").alias("row_id")))
    return FL.generation_coverage(prompts, outs)


# ---------------------------------------------------------------- C4 / C3 / C5

_STAGE1_SQL = _GEN_SQL + f""",
  p1 AS (SELECT round_id, CASE WHEN strpos({_sql_split('generation', '###example:', 1)}, '##instruction:') > 0
                               THEN {_sql_strip(_sql_split(_sql_split('generation', '###example:', 1), '##instruction:', 2))}
                          END AS instruction FROM gen),
  ok1 AS (SELECT * FROM p1 WHERE instruction IS NOT NULL AND instruction <> ''),
  pairs1 AS (SELECT o.round_id, d.slot, o.instruction AS text_a, d.instruction AS text_b
             FROM ok1 o JOIN draws0 d USING (round_id)),
  {_sql_tfidf('pairs1', 'round_id, slot').strip()},
  gate1 AS (SELECT round_id, max(coalesce(sim, 1.0)) AS max_sim FROM sims GROUP BY round_id),
  kept AS (SELECT o.round_id, o.instruction FROM ok1 o JOIN gate1 g USING (round_id)
           WHERE NOT (g.max_sim > 0.52) AND length(o.instruction) > 1)"""


@query("stage1_filter", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _STAGE1_SQL) + """
SELECT round_id, instruction FROM kept""")
def stage1_filter(spark, sf_dir):
    return J.stage1_filter(spark, sf_dir)


@query("job_self_instruct", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _STAGE1_SQL + f""",
  gen2 AS (SELECT r.round_id, k.response AS generation FROM kept r
           JOIN ranked k ON k.pos = {md5_pos(['r.round_id', "'gen'"], 12, '(SELECT count(*) FROM v_corpus)')}),
  out2 AS (SELECT round_id, {_sql_strip(_sql_split(_sql_split('generation', '###example:', 1), '##', 1))} AS output FROM gen2)""") + """
SELECT k.round_id, k.instruction, o.output FROM kept k JOIN out2 o USING (round_id)
WHERE o.output IS NOT NULL AND o.output <> ''""")
def job_self_instruct(spark, sf_dir):
    return J.job_self_instruct(spark, sf_dir, icl=True)


@query("reanswer", with_views("v_corpus", "v_pairs", extra=f"""
  rp AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS pos, response FROM v_pairs),
  ans AS (SELECT c.row_id, c.instruction, r.response AS output FROM v_corpus c
          JOIN rp r ON r.pos = {md5_pos(['c.row_id', "'gen'"], 13, '(SELECT count(*) FROM v_pairs)')})""") + """
SELECT row_id, instruction, output FROM ans WHERE output IS NOT NULL AND output <> ''""")
def reanswer(spark, sf_dir):
    return J.job_reanswer(spark, sf_dir)


def _tail64(s):
    """A stand-in user model: answers with the last 64 characters of the prompt."""
    return s.str[-64:]


@query("generate_batch", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _sql_prompt_icl("draws0")) + """
SELECT round_id, md5(right(prompt, 64)) AS gen_md5 FROM pr""")
def generate_batch(spark, sf_dir):
    gen = G.generate(J.icl_prompts(spark, sf_dir), key="round_id", factory=lambda: _tail64)
    return gen.select("round_id", F.md5("generation").alias("gen_md5"))


_NGRAM_STEPS, _NGRAM_SEED = 8, 3


def _sql_ngram_steps() -> str:
    """CTEs ``g1``..: the word that each step draws, by the cumulative counts of its history."""
    out = []
    for k in range(_NGRAM_STEPS):
        bits = f"('0x' || substr(md5(CAST(s.round_id AS VARCHAR) || ':' || '{k}' || ':' || '{_NGRAM_SEED}'), 1, 15))::BIGINT"
        out.append(f"""
  t{k} AS (SELECT s.round_id, s.w AS h, CAST(floor(({bits}::DOUBLE + 0.5) / {float(1 << 60)!r}::DOUBLE * tot.ch) AS BIGINT) AS aim FROM g{k} s JOIN tot ON tot.h = s.w),
  g{k + 1} AS MATERIALIZED (SELECT t.round_id, iv.w FROM t{k} t JOIN iv ON iv.h = t.h AND iv.hi - iv.c <= t.aim AND t.aim < iv.hi)""")
    return ",".join(out)


@query("generate_ngram", with_views("v_corpus", extra=_sql_draw(0).strip() + "," + _sql_prompt_icl("draws0") + f""",
  corp AS (SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM documents),
  bg AS (SELECT t[i] AS h, t[i + 1] AS w, count(*) AS c FROM (SELECT t, unnest(generate_series(1, len(t) - 1)) AS i FROM corp WHERE len(t) >= 2) x GROUP BY ALL),
  iv AS MATERIALIZED (SELECT h, w, c, sum(c) OVER (PARTITION BY h ORDER BY substr(md5(w), 1, 2), w ROWS UNBOUNDED PRECEDING) AS hi FROM bg),
  tot AS MATERIALIZED (SELECT h, sum(c) AS ch FROM bg GROUP BY h),
  g0 AS MATERIALIZED (SELECT round_id, list_extract(regexp_extract_all(lower(prompt), '[\\p{{L}}\\p{{N}}_]{{2,}}'), -1) AS w FROM pr),{_sql_ngram_steps()},
  allg AS ({" UNION ALL ".join(f"SELECT round_id, {k} AS step, w FROM g{k}" for k in range(1, _NGRAM_STEPS + 1))})""") + """
SELECT round_id, string_agg(w, ' ' ORDER BY step) AS generation FROM allg GROUP BY round_id""")
def generate_ngram(spark, sf_dir):
    from synthweave.operators.lm import BigramLM
    from synthweave.session import checkpoint_dir
    checkpoint_dir(spark)
    lm = BigramLM(load(spark, sf_dir, "documents"), "text")
    return G.generate_ngram(J.icl_prompts(spark, sf_dir), lm, steps=_NGRAM_STEPS, seed=_NGRAM_SEED)
