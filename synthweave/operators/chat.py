"""Chat rendering (R12-R16) over ``(conv_id, turn, role, text)`` rows.

A conversation's prompt is ``prefix + piece_0 + piece_1 + ...`` where each
piece depends only on its own message, its index and the template, so pieces
are plain column expressions.  Only the final fold gathers a conversation's
pieces (ordered by index) -- one output string per conversation, bounded by
the conversation's own length.

Template columns (``style, role_user, role_assistant, sep, sep2, name,
system_template, system_message, preset_messages``) come either from a
literal template (:func:`with_template`) or from a broadcast join with the
62-row ``chat_templates`` table (:func:`join_templates`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.functions.chat_templates import get_template, templates_df

OPEN_ROLE = "assistant"
_TEMPLATE_COLS = ("name", "system_template", "system_message", "role_user", "role_assistant", "style",
                  "sep", "sep2", "offset", "preset_messages")


def messages(conv: DataFrame, open_turn: bool = True) -> DataFrame:
    """Conversation rows -> messages ``(conv_id, i, role, text, sys_text)``.

    The system turn (turn 0 when present) is removed and becomes ``sys_text``;
    ``i`` counts from 0 after it.  With ``open_turn`` a conversation that ends
    on a user turn gets an open assistant message (text NULL): the model
    speaks next.
    """
    sys = conv.where(F.col("role") == "system").select("conv_id", F.col("text").alias("sys_text"))
    msgs = (conv.where(F.col("role") != "system").join(sys, "conv_id", "left")
            .select("conv_id", (F.col("turn") - F.when(F.col("sys_text").isNotNull(), 1).otherwise(0)).alias("i"),
                    "role", "text", "sys_text"))
    if not open_turn:
        return msgs
    last = (msgs.groupBy("conv_id").agg(F.max("i").alias("_li"), F.max_by("role", "i").alias("_lr"),
                                        F.first("sys_text", ignorenulls=True).alias("sys_text"))
            .where(F.col("_lr") == "user")
            .select("conv_id", (F.col("_li") + 1).alias("i"), F.lit(OPEN_ROLE).alias("role"),
                    F.lit(None).cast("string").alias("text"), "sys_text"))
    return msgs.unionByName(last)


def with_template(df: DataFrame, name: str) -> DataFrame:
    """Attach one template's fields as literal columns."""
    t = get_template(name)
    presets = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(m).alias("text")) for r, m in t["messages"]]) \
        if t["messages"] else F.array().cast("array<struct<role:string,text:string>>")
    lit = lambda v: F.lit(v).cast("string")
    return df.select("*", lit(t["name"]).alias("name"), lit(t["system_template"]).alias("system_template"),
                     lit(t["system_message"]).alias("system_message"), lit(t["roles"][0]).alias("role_user"),
                     lit(t["roles"][1]).alias("role_assistant"), lit(t["style"]).alias("style"),
                     lit(t["sep"]).alias("sep"), lit(t["sep2"]).alias("sep2"),
                     F.lit(int(t["offset"])).alias("offset"), presets.alias("preset_messages"))


def join_templates(df: DataFrame, name_col: str = "template") -> DataFrame:
    """Attach template fields by name from the broadcast ``chat_templates`` table (62 rows)."""
    t = templates_df(df.sparkSession).withColumnRenamed("name", name_col)
    return df.join(F.broadcast(t), name_col).withColumn("name", F.col(name_col))


def _with_presets(msgs: DataFrame) -> DataFrame:
    """Prepend each template's preset messages; shift conversation indexes past them."""
    n_pre = F.size("preset_messages")
    own = (msgs.withColumn("i", F.col("i") + n_pre)
           .withColumn("role_name", F.when(F.col("role") == "user", F.col("role_user"))
                       .otherwise(F.col("role_assistant"))))
    pre_rows = (msgs.select("conv_id", *_TEMPLATE_COLS, "sys_text").dropDuplicates(["conv_id"])
                .select("*", F.posexplode("preset_messages").alias("i", "_p"))
                .select("conv_id", *_TEMPLATE_COLS, "sys_text", "i",
                        F.col("_p.role").alias("role_name"), F.col("_p.text").alias("text")))
    cols = ["conv_id", *_TEMPLATE_COLS, "sys_text", "i", "role_name", "text"]
    return own.select(*cols).unionByName(pre_rows.select(*cols))


def piece_expr() -> Column:
    """Rendered text of one message, by separator style."""
    style, r, m, i = F.col("style"), F.col("role_name"), F.col("text"), F.col("i")
    s1, s2 = F.coalesce(F.col("sep"), F.lit("")), F.coalesce(F.col("sep2"), F.lit(""))
    empty = m.isNull() | (m == "")
    even = (i % 2) == 0
    alt = F.when(even, s1).otherwise(s2)
    tag = F.when(even, F.col("role_user")).otherwise(F.col("role_assistant"))
    c = F.concat
    L = F.lit

    def pick(full, stub):
        return F.when(empty, stub).otherwise(full)

    glm_round = c(L("[Round "), ((i / 2).cast("int") + F.when(F.col("name") == "chatglm2", 1).otherwise(0))
                  .cast("string"), L("]"), s1)
    rwkv_text = F.replace(F.replace(m, L("\r\n"), L("\n")), L("\n\n"), L("\n"))
    return (F.when(style == "ADD_COLON_SINGLE", pick(c(r, L(": "), m, s1), c(r, L(":"))))
            .when(style == "ADD_COLON_TWO", pick(c(r, L(": "), m, alt), c(r, L(":"))))
            .when(style == "ADD_COLON_SPACE_SINGLE", pick(c(r, L(": "), m, s1), c(r, L(": "))))
            .when(style == "ADD_NEW_LINE_SINGLE", pick(c(r, L("\n"), m, s1), c(r, L("\n"))))
            .when(style == "NO_COLON_SINGLE", pick(c(r, m, s1), r))
            .when(style == "NO_COLON_TWO", pick(c(r, m, alt), r))
            .when(style == "RWKV", pick(c(r, L(": "), rwkv_text, L("\n\n")), c(r, L(":"))))
            .when(style == "LLAMA2", pick(F.when(i == 0, c(m, L(" "))).otherwise(c(tag, L(" "), m, alt)), tag))
            .when(style == "CHATGLM", c(F.when(even, glm_round).otherwise(L("")),
                                        pick(c(r, L("："), m, s1), c(r, L("：")))))
            .when(style == "CHATML", pick(c(r, L("\n"), m, s1, L("\n")), c(r, L("\n"))))
            .when(style == "CHATINTERN", c(F.when(even, L("<s>")).otherwise(L("")),
                                           pick(c(r, L(":"), m, alt, L("\n")), c(r, L(":")))))
            .when(style == "DOLLY", pick(c(r, L(":\n"), m, alt, F.when(even, L("")).otherwise(L("\n\n"))),
                                         c(r, L(":\n"))))
            .when(style == "PHOENIX", pick(c(r, L(": <s>"), m, L("</s>")), c(r, L(": <s>"))))
            .when(style == "ROBIN", pick(c(r, L(":\n"), m, s1), c(r, L(":\n"))))
            .when(style == "FALCON_CHAT", pick(c(r, L(": "), m, s1), c(r, L(":"))))
            .otherwise(F.raise_error(c(L("Invalid style: "), F.coalesce(style, L("None"))))))


def prefix_expr() -> Column:
    """System prompt part, by style (system message = the conversation's system turn, else the template's)."""
    sysmsg = F.coalesce(F.col("sys_text"), F.col("system_message"))
    sp = F.replace(F.col("system_template"), F.lit("{system_message}"), sysmsg)
    s1 = F.coalesce(F.col("sep"), F.lit(""))
    style = F.col("style")
    return (F.when(style.isin("ADD_COLON_SINGLE", "ADD_COLON_TWO", "ADD_COLON_SPACE_SINGLE", "ROBIN"), F.concat(sp, s1))
            .when(style == "ADD_NEW_LINE_SINGLE", F.when(sp == "", F.lit("")).otherwise(F.concat(sp, s1)))
            .when(style == "LLAMA2", F.when(sysmsg != "", sp).otherwise(F.lit("[INST] ")))
            .when(style == "CHATGLM", F.when(sp != "", F.concat(sp, s1)).otherwise(F.lit("")))
            .when(style == "CHATML", F.when(sp == "", F.lit("")).otherwise(F.concat(sp, s1, F.lit("\n"))))
            .when(style == "FALCON_CHAT", F.when(sysmsg != "", F.concat(sp, s1)).otherwise(F.lit("")))
            .otherwise(sp))


def render(msgs_with_template: DataFrame) -> DataFrame:
    """``(conv_id, template name, prompt)`` from messages + template columns."""
    rows = _with_presets(msgs_with_template).withColumn("piece", piece_expr()).withColumn("prefix", prefix_expr())
    ordered = F.sort_array(F.collect_list(F.struct("i", "piece")))
    return (rows.groupBy("conv_id", "name")
            .agg(F.first("prefix").alias("prefix"), ordered.alias("_p"))
            .select("conv_id", F.col("name").alias("template"),
                    F.concat("prefix", F.array_join(F.transform("_p", lambda x: x["piece"]), "")).alias("prompt")))


def render_conversations(conv: DataFrame, template: str) -> DataFrame:
    return render(with_template(messages(conv), template))


def openai_messages(conv: DataFrame, template: str) -> DataFrame:
    """R14 as rows ``(conv_id, idx, role, content)``: system first, then user /
    assistant alternating after the template offset; an empty (NULL)
    assistant message is skipped."""
    t = get_template(template)
    msgs = messages(conv)
    sysmsg = (msgs.groupBy("conv_id").agg(F.first("sys_text", ignorenulls=True).alias("sys_text"))
              .select("conv_id", F.lit(0).alias("idx"), F.lit("system").alias("role"),
                      F.coalesce("sys_text", F.lit(t["system_message"])).alias("content")))
    # presets occupy the first ``offset`` messages and are skipped; conversation
    # message i sits at position i + presets - offset of the remainder
    shift = len(t["messages"]) - int(t["offset"])
    body = (msgs.withColumn("j", F.col("i") + shift)
            .where(F.col("j") >= 0)
            .where(~((F.col("j") % 2 == 1) & F.col("text").isNull()))
            .select("conv_id", (F.col("j") + 1).alias("idx"),
                    F.when(F.col("j") % 2 == 0, "user").otherwise("assistant").alias("role"),
                    F.col("text").alias("content")))
    return sysmsg.unionByName(body)


def chat_pairs(conv: DataFrame) -> DataFrame:
    """``(conv_id, pair, user, assistant)``; the last pair may be open (NULL)."""
    msgs = messages(conv)
    users = msgs.where(F.col("i") % 2 == 0).select("conv_id", "i", F.col("text").alias("user"))
    answers = msgs.where(F.col("i") % 2 == 1).select("conv_id", (F.col("i") - 1).alias("i"),
                                                       F.col("text").alias("assistant"))
    return (users.join(answers, ["conv_id", "i"], "left")
            .select("conv_id", (F.col("i") / 2).cast("int").alias("pair"), "user", "assistant"))


def append_message(conv: DataFrame, role: str, text) -> DataFrame:
    """R16 append: one new turn after each conversation's last turn."""
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    t = text if isinstance(text, Column) else F.lit(text).cast("string")
    return conv.unionByName(last.select("conv_id", (F.col("turn") + 1).alias("turn"),
                                        F.lit(role).alias("role"), t.alias("text")))


def update_last_message(conv: DataFrame, text) -> DataFrame:
    """R16 update: replace the text of each conversation's last turn."""
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    t = text if isinstance(text, Column) else F.lit(text).cast("string")
    return (conv.join(last, "conv_id")
            .withColumn("text", F.when(F.col("turn") == F.col("_last"), t).otherwise(F.col("text")))
            .drop("_last"))


def set_system_message(conv: DataFrame, text: str) -> DataFrame:
    """R16 set: every conversation gets one system turn holding ``text``, before its first turn.

    A conversation that has a system turn keeps that turn's number; one
    without gets the number before its first turn.
    """
    is_sys = F.col("role") == "system"
    others = conv.where(~F.coalesce(is_sys, F.lit(False)))
    at = F.coalesce(F.min(F.when(is_sys, F.col("turn"))), F.min("turn") - 1)
    systems = conv.groupBy("conv_id").agg(at.cast(conv.schema["turn"].dataType).alias("turn")).select(
        "conv_id", "turn", F.lit("system").alias("role"), F.lit(text).alias("text"))
    return others.unionByName(systems)
