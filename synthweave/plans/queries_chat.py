"""Registered queries: chat rendering (15 styles, per-row templates), message
views, edits, preference pairs (HH / UltraFeedback) and the common prefix."""

from __future__ import annotations

from pyspark.sql import functions as F

from synthweave.functions.chat_templates import registry
from synthweave.operators import chat as C
from synthweave.operators import preference as P
from synthweave.plans.oracle_views import md5_key, with_views
from synthweave.plans.registry import query
from synthweave.sources import fixtures as V
from synthweave.sources.tables import load

STYLE_TEMPLATE = {
    "ADD_COLON_SINGLE": "one_shot", "ADD_COLON_TWO": "vicuna_v1.1", "ADD_COLON_SPACE_SINGLE": "billa",
    "ADD_NEW_LINE_SINGLE": "tulu", "NO_COLON_SINGLE": "baize", "NO_COLON_TWO": "cutegpt", "RWKV": "rwkv",
    "LLAMA2": "llama-2", "CHATGLM": "chatglm2", "CHATML": "zephyr", "CHATINTERN": "internlm-chat",
    "DOLLY": "dolly_v2", "PHOENIX": "phoenix", "ROBIN": "Robin", "FALCON_CHAT": "falcon-chat",
}
RENDERABLE = [n for n, t in registry().items() if t["style"] is not None]


def q(s) -> str:
    """SQL string literal (NULL for None)."""
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def _sql_templates(names: list[str]) -> str:
    reg = registry()
    rows = ",\n    ".join(
        f"({i}, {q(n)}, {q(reg[n]['system_template'])}, {q(reg[n]['system_message'])}, {q(reg[n]['roles'][0])}, "
        f"{q(reg[n]['roles'][1])}, {q(reg[n]['style'])}, {q(reg[n]['sep'])}, {q(reg[n]['sep2'])}, "
        f"{len(reg[n]['messages'])})"
        for i, n in enumerate(names))
    pres = [f"({q(n)}, {k}, {q(r)}, {q(m)})" for n in names for k, (r, m) in enumerate(reg[n]["messages"])]
    pre_sql = ("SELECT * FROM (VALUES " + ", ".join(pres) + ") p(name, k, role, text)") if pres else \
        "SELECT NULL::VARCHAR AS name, 0 AS k, NULL::VARCHAR AS role, NULL::VARCHAR AS text WHERE false"
    return f"""
  tpl AS (SELECT * FROM (VALUES
    {rows}) t(idx, name, system_template, system_message, ru, ra, style, sep, sep2, npre)),
  tpre AS ({pre_sql})"""


_SQL_PIECE = """CASE style
      WHEN 'ADD_COLON_SINGLE' THEN CASE WHEN e THEN r || ':' ELSE r || ': ' || m || s1 END
      WHEN 'ADD_COLON_TWO' THEN CASE WHEN e THEN r || ':' ELSE r || ': ' || m || alt END
      WHEN 'ADD_COLON_SPACE_SINGLE' THEN CASE WHEN e THEN r || ': ' ELSE r || ': ' || m || s1 END
      WHEN 'ADD_NEW_LINE_SINGLE' THEN CASE WHEN e THEN r || chr(10) ELSE r || chr(10) || m || s1 END
      WHEN 'NO_COLON_SINGLE' THEN CASE WHEN e THEN r ELSE r || m || s1 END
      WHEN 'NO_COLON_TWO' THEN CASE WHEN e THEN r ELSE r || m || alt END
      WHEN 'RWKV' THEN CASE WHEN e THEN r || ':' ELSE r || ': '
           || replace(replace(m, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10)) || chr(10) || chr(10) END
      WHEN 'LLAMA2' THEN CASE WHEN e THEN tag WHEN i = 0 THEN m || ' ' ELSE tag || ' ' || m || alt END
      WHEN 'CHATGLM' THEN (CASE WHEN i % 2 = 0 THEN '[Round ' || CAST(i // 2 + CASE WHEN name = 'chatglm2' THEN 1 ELSE 0 END AS VARCHAR)
                                || ']' || s1 ELSE '' END)
           || CASE WHEN e THEN r || '：' ELSE r || '：' || m || s1 END
      WHEN 'CHATML' THEN CASE WHEN e THEN r || chr(10) ELSE r || chr(10) || m || s1 || chr(10) END
      WHEN 'CHATINTERN' THEN (CASE WHEN i % 2 = 0 THEN '<s>' ELSE '' END)
           || CASE WHEN e THEN r || ':' ELSE r || ':' || m || alt || chr(10) END
      WHEN 'DOLLY' THEN CASE WHEN e THEN r || ':' || chr(10)
           ELSE r || ':' || chr(10) || m || alt || CASE WHEN i % 2 = 1 THEN chr(10) || chr(10) ELSE '' END END
      WHEN 'PHOENIX' THEN CASE WHEN e THEN r || ': <s>' ELSE r || ': <s>' || m || '</s>' END
      WHEN 'ROBIN' THEN CASE WHEN e THEN r || ':' || chr(10) ELSE r || ':' || chr(10) || m || s1 END
      WHEN 'FALCON_CHAT' THEN CASE WHEN e THEN r || ':' ELSE r || ': ' || m || s1 END
    END"""

_SQL_PREFIX = """CASE
      WHEN style IN ('ADD_COLON_SINGLE', 'ADD_COLON_TWO', 'ADD_COLON_SPACE_SINGLE', 'ROBIN') THEN sp || s1
      WHEN style = 'ADD_NEW_LINE_SINGLE' THEN CASE WHEN sp = '' THEN '' ELSE sp || s1 END
      WHEN style = 'LLAMA2' THEN CASE WHEN sm <> '' THEN sp ELSE '[INST] ' END
      WHEN style = 'CHATGLM' THEN CASE WHEN sp <> '' THEN sp || s1 ELSE '' END
      WHEN style = 'CHATML' THEN CASE WHEN sp = '' THEN '' ELSE sp || s1 || chr(10) END
      WHEN style = 'FALCON_CHAT' THEN CASE WHEN sm <> '' THEN sp || s1 ELSE '' END
      ELSE sp END"""


def sql_render(msgs_cte: str, assign: str) -> str:
    """CTEs rendering ``msgs_cte(conv_id, i, role, text, sys_text)`` with the
    template chosen by ``assign`` (an expression over ``conv_id`` giving ``idx``).
    Defines ``rendered(conv_id, template, prompt)``."""
    return f"""
  mt AS (SELECT m.*, t.* FROM {msgs_cte} m JOIN tpl t ON t.idx = ({assign})),
  allrows AS (
    SELECT conv_id, name, style, system_template, system_message, ru, ra, sep, sep2, sys_text,
           i + npre AS i, CASE WHEN role = 'user' THEN ru ELSE ra END AS r, text AS m FROM mt
    UNION ALL
    SELECT d.conv_id, d.name, d.style, d.system_template, d.system_message, d.ru, d.ra, d.sep, d.sep2, d.sys_text,
           p.k, p.role, p.text
    FROM (SELECT DISTINCT conv_id, name, style, system_template, system_message, ru, ra, sep, sep2, sys_text FROM mt) d
    JOIN tpre p ON p.name = d.name),
  pc AS (SELECT *, {_SQL_PIECE} AS piece FROM (
           SELECT *, (m IS NULL OR m = '') AS e, coalesce(sep, '') AS s1,
                  CASE WHEN i % 2 = 0 THEN coalesce(sep, '') ELSE coalesce(sep2, '') END AS alt,
                  CASE WHEN i % 2 = 0 THEN ru ELSE ra END AS tag FROM allrows) z),
  pf AS (SELECT conv_id, name, style, coalesce(sep, '') AS s1,
                coalesce(any_value(sys_text), any_value(system_message)) AS sm,
                replace(any_value(system_template), '{{system_message}}',
                        coalesce(any_value(sys_text), any_value(system_message))) AS sp,
                string_agg(piece, '' ORDER BY i) AS body
         FROM pc GROUP BY conv_id, name, style, sep),
  rendered AS (SELECT conv_id, name AS template, {_SQL_PREFIX} || coalesce(body, '') AS prompt FROM pf)"""


_SQL_MSGS = """
  sysr AS (SELECT conv_id, text AS sys_text FROM conversations WHERE role = 'system'),
  msgs0 AS (SELECT c.conv_id, c.turn - CASE WHEN s.sys_text IS NULL THEN 0 ELSE 1 END AS i, c.role, c.text, s.sys_text
            FROM conversations c LEFT JOIN sysr s USING (conv_id) WHERE c.role <> 'system'),
  lastm AS (SELECT conv_id, max(i) AS li, arg_max(role, i) AS lr, any_value(sys_text) AS sys_text FROM msgs0 GROUP BY conv_id),
  msgs AS (SELECT * FROM msgs0
           UNION ALL SELECT conv_id, li + 1, 'assistant', NULL, sys_text FROM lastm WHERE lr = 'user')"""


def _style_query(style: str, name: str):
    sql = ("WITH " + _SQL_MSGS.strip() + "," + _sql_templates([name]).rstrip() + "," + sql_render("msgs", "0").rstrip()
           + "\nSELECT conv_id, template, prompt FROM rendered")

    def build(spark, sf_dir):
        return C.render_conversations(load(spark, sf_dir, "conversations"), name)
    query(f"chat_{style.lower()}", sql)(build)


for _style, _name in STYLE_TEMPLATE.items():
    _style_query(_style, _name)


@query("chat_by_template", "WITH " + _SQL_MSGS.strip() + "," + _sql_templates(RENDERABLE).rstrip() + ","
       + sql_render("msgs", f"conv_id % {len(RENDERABLE)}").rstrip() + """
SELECT conv_id, template, prompt FROM rendered""")
def chat_by_template(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations")
    names = spark.createDataFrame([(i, n) for i, n in enumerate(RENDERABLE)], "idx int, template string")
    msgs = C.messages(conv).withColumn("idx", F.pmod("conv_id", F.lit(len(RENDERABLE))).cast("int"))
    # the assignment table has one row per template: a fixed, tiny broadcast
    assigned = msgs.join(F.broadcast(names), "idx").drop("idx")
    return C.render(C.join_templates(assigned, "template").drop("template"))


@query("chat_messages", "WITH " + _SQL_MSGS.strip() + f""",
  sysm AS (SELECT conv_id, 0 AS idx, 'system' AS role,
                  coalesce(any_value(sys_text), {q(registry()['vicuna_v1.1']['system_message'])}) AS content
           FROM msgs GROUP BY conv_id)
SELECT conv_id, CAST(idx AS BIGINT) AS idx, role, content FROM sysm
UNION ALL
SELECT conv_id, i + 1, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END, text FROM msgs
WHERE NOT (i % 2 = 1 AND text IS NULL)""")
def chat_messages(spark, sf_dir):
    out = C.openai_messages(load(spark, sf_dir, "conversations"), "vicuna_v1.1")
    return out.select("conv_id", F.col("idx").cast("bigint").alias("idx"), "role", "content")


@query("chat_pairs", "WITH " + _SQL_MSGS.strip() + """
SELECT u.conv_id, CAST(u.i // 2 AS INTEGER) AS pair, u.text AS user, a.text AS assistant
FROM msgs u LEFT JOIN msgs a ON a.conv_id = u.conv_id AND a.i = u.i + 1
WHERE u.i % 2 = 0""")
def chat_pairs(spark, sf_dir):
    return C.chat_pairs(load(spark, sf_dir, "conversations"))


@query("chat_append", """
WITH ext AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT conv_id, max(turn) + 1, 'assistant', NULL FROM conversations GROUP BY conv_id),
upd AS (SELECT conv_id, turn, role,
               CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'reply to ' || CAST(conv_id AS VARCHAR)
                    ELSE text END AS text FROM ext)
SELECT conv_id, count(*) AS n_turns, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text,
       count(*) FILTER (WHERE role = 'system') AS n_system, arg_min(text, turn) AS first_text
FROM (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 'Be brief.' ELSE text END AS text FROM upd
      UNION ALL SELECT conv_id, min(turn) - 1, 'system', 'Be brief.' FROM upd GROUP BY conv_id
                HAVING count(*) FILTER (WHERE role = 'system') = 0) z
GROUP BY conv_id""")
def chat_append(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations")
    ext = C.append_message(conv, "assistant", None)
    upd = C.update_last_message(ext, F.concat(F.lit("reply to "), F.col("conv_id").cast("string")))
    edited = C.set_system_message(upd, "Be brief.")
    return edited.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.max_by("role", "turn").alias("last_role"),
        F.max_by("text", "turn").alias("last_text"),
        F.count(F.when(F.col("role") == "system", 1)).alias("n_system"), F.min_by("text", "turn").alias("first_text"))


# ---------------------------------------------------------------- X6-X9

_SQL_PREF = """
  prefhh AS (SELECT a.row_id, chr(10) || chr(10) || 'Human: ' || a.instruction || chr(10) || chr(10) || 'Assistant: ' || a.response AS chosen,
                    chr(10) || chr(10) || 'Human: ' || a.instruction || chr(10) || chr(10) || 'Assistant: ' || b.response AS rejected
             FROM v_pairs a JOIN v_pairs b ON b.row_id = a.row_id + 2)"""

_SQL_CP = """
  cp AS (SELECT row_id, chosen, rejected,
                coalesce((SELECT min(k) - 1 FROM range(1, least(length(chosen), length(rejected)) + 1) r(k)
                          WHERE substr(chosen, k, 1) <> substr(rejected, k, 1)),
                         least(length(chosen), length(rejected))) AS n FROM prefhh)"""


@query("common_prefix", with_views("v_pairs", extra=_SQL_PREF.strip() + "," + _SQL_CP) + """
SELECT row_id, CAST(n AS INTEGER) AS prefix_len FROM cp""")
def common_prefix(spark, sf_dir):
    hh = P.v_pref_hh(spark, sf_dir)
    return hh.select("row_id", P.common_prefix_len("chosen", "rejected").alias("prefix_len"))


_A, _H = "chr(10) || chr(10) || 'Assistant: '", "chr(10) || chr(10) || 'Human: '"
_CYCLE = f"'(?s)(.*?)' || {_A} || '(.*?)' || {_H}"
_SQL_HH = f"""
  hh0 AS (SELECT row_id, chosen, rejected, n, substr(substr(chosen, 1, n), 10) AS s FROM cp WHERE n > 0),
  hh1 AS (SELECT row_id, chosen, rejected, n,
                 regexp_extract_all(s, {_CYCLE}, 1) AS us, regexp_extract_all(s, {_CYCLE}, 2) AS as_,
                 regexp_replace(s, '(?s)^(?:.*?' || {_A} || '.*?' || {_H} || ')*', '') AS rest FROM hh0),
  hhm AS (
    SELECT row_id AS conv_id, 2 * k AS i, 'user' AS role, us[k + 1] AS text FROM (SELECT row_id, us, unnest(range(0, len(us))) AS k FROM hh1) a
    UNION ALL SELECT row_id, 2 * k + 1, 'assistant', as_[k + 1] FROM (SELECT row_id, as_, unnest(range(0, len(as_))) AS k FROM hh1) b
    UNION ALL SELECT row_id, 2 * len(us), 'user', split_part(rest, chr(10) || chr(10) || 'Assistant: ', 1) FROM hh1
              WHERE strpos(rest, chr(10) || chr(10) || 'Assistant: ') > 0
    UNION ALL SELECT row_id, 2 * len(us) + CASE WHEN strpos(rest, chr(10) || chr(10) || 'Assistant: ') > 0 THEN 1 ELSE 0 END,
              'assistant', NULL FROM hh1),
  hhmsgs AS (SELECT conv_id, i, role, text, NULL::VARCHAR AS sys_text FROM hhm)"""


@query("pref_hh", with_views("v_pairs", extra=_SQL_PREF.strip() + "," + _SQL_CP + "," + _SQL_HH
                             + "," + _sql_templates(["vicuna_v1.1"]) + "," + sql_render("hhmsgs", "0")) + """
SELECT h.row_id, r.prompt, substr(h.chosen, h.n) AS chosen, substr(h.rejected, h.n) AS rejected
FROM hh1 h JOIN rendered r ON r.conv_id = h.row_id""")
def pref_hh(spark, sf_dir):
    return P.split_hh(P.v_pref_hh(spark, sf_dir), "vicuna_v1.1")


@query("pref_ultra", with_views("v_pairs", extra="""
  ultra AS (SELECT a.row_id, a.instruction AS prompt, a.response AS c2, b.response AS r2
            FROM v_pairs a JOIN v_pairs b ON b.row_id = a.row_id + 2),
  um AS (SELECT row_id AS conv_id, 0 AS i, 'user' AS role, prompt AS text, NULL::VARCHAR AS sys_text FROM ultra
         UNION ALL SELECT row_id, 1, 'assistant', NULL, NULL FROM ultra),""" + _sql_templates(["vicuna_v1.1"]) + ","
                                + sql_render("um", "0")) + """
SELECT u.row_id, r.prompt, ' ' || u.c2 AS chosen, ' ' || u.r2 AS rejected
FROM ultra u JOIN rendered r ON r.conv_id = u.row_id""")
def pref_ultra(spark, sf_dir):
    return P.split_ultrafeedback(P.v_pref_ultra(spark, sf_dir), "vicuna_v1.1")


@query("pref_dpo", with_views("v_pairs", extra=_SQL_PREF.strip() + "," + _SQL_CP + "," + _SQL_HH
                                   + "," + _sql_templates(["vicuna_v1.1"]) + "," + sql_render("hhmsgs", "0")) + f"""
SELECT row_id, prompt, chosen, rejected FROM (
  SELECT h.row_id, r.prompt, substr(h.chosen, h.n) AS chosen, substr(h.rejected, h.n) AS rejected
  FROM hh1 h JOIN rendered r ON r.conv_id = h.row_id) t
ORDER BY {md5_key('row_id', 2023)}, row_id LIMIT 100""")
def pref_dpo(spark, sf_dir):
    return P.process_dpo(P.v_pref_hh(spark, sf_dir), "Anthropic/hh-rlhf", "some/unknown-model", 100)
