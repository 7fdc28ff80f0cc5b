"""Golden vectors hand-derived from the reference's rules (FIXTURES.md part C)."""

import math

import pytest
from pyspark.sql import functions as F

from synthweave.operators import bleu as B
from synthweave.operators import chat as C
from synthweave.operators import federated as FD
from synthweave.operators import ifd as I
from synthweave.operators import parse as X
from synthweave.operators import privacy as D
from synthweave.operators import prompts as R
from synthweave.operators import shard as S
from synthweave.operators import similarity as SIM
from synthweave.functions.text import common_prefix_len


def test_c1_parse_pair(spark):
    texts = [
        (0, "\n##instruction: \nA?\n##output:\nB.\n\n###example:\n…", "A?", "B."),
        (1, "##instruction: A", None, None),
        (2, "##instruction: A ##output: B ### example C", None, None),
        (3, "##instruction: A ##output: B ##instruction: C", "A", None),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in texts], "id int, text string")
    got = {r["id"]: (r["instruction"], r["output"]) for r in X.parse_pair(df).collect()}
    for i, _, ins, out in texts:
        assert got[i] == (ins, out)


def test_c2_news_cut(spark):
    df = spark.createDataFrame([("x}. hello }. z",), ("none",), ("a}.",)], "instruction string")
    assert [r[0] for r in df.select(R.news_cut()).collect()] == ["hello", "", ""]


def test_c3_similarity(spark):
    pairs = spark.createDataFrame([
        (0, "a b", "c d"), (1, "foo bar", "!!"), (2, "same words here", "same words here"),
        (3, "Étion dans çouelle, dans a x", "dans le çouelle éeau")], "k int, text_a string, text_b string")
    got = {r["k"]: r["sim"] for r in SIM.tfidf_pair(pairs, ["k"]).collect()}
    assert got[0] is None                      # empty vocabulary -> error -> reject
    assert got[1] == 0.0
    assert got[2] == pytest.approx(1.0)
    assert got[3] == pytest.approx(0.465646219, abs=1e-9)


LLAMA_SYS = "You are a helpful, respectful and honest assistant."


def _demo(spark, system=None):
    turns = ([("system", system)] if system else []) + [("user", "Hello!"), ("assistant", "Hi!"),
                                                        ("user", "How are you?")]
    rows = [(1, t, role, text) for t, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("name,system,expected", [
    ("vicuna_v1.1", None, "{S} USER: Hello! ASSISTANT: Hi!</s>USER: How are you? ASSISTANT:"),
    ("alpaca", None, "{S}\n\n### Instruction: Hello!\n\n### Response: Hi!</s>### Instruction: How are you?\n\n### Response:"),
    ("llama-2", LLAMA_SYS, "[INST] <<SYS>>\n{S}\n<</SYS>>\n\nHello! [/INST] Hi! </s><s>[INST] How are you? [/INST]"),
    ("llama-2", None, "[INST] Hello! [/INST] Hi! </s><s>[INST] How are you? [/INST]"),
])
def test_c4_rendering(spark, name, system, expected):
    from synthweave.functions.chat_templates import get_template
    sysmsg = system or get_template(name)["system_message"]
    out = C.render_conversations(_demo(spark, system), name).first()["prompt"]
    assert out == expected.replace("{S}", sysmsg)


def test_c5_common_prefix(spark):
    df = spark.createDataFrame([("abcdX", "abcYd"), ("abc", "abc"), ("abc", "abcd"), ("", "a")], "a string, b string")
    assert [r[0] for r in df.select(common_prefix_len("a", "b")).collect()] == [3, 3, 3, 0]


def test_c6_shards(spark):
    rows = [(i, "x" * (i + 1), "a") for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, instruction string, category string")
    sizes = sorted(r["n"] for r in S.shard_sizes(S.shard_length(df, 3)).collect())
    assert sizes == [1, 3, 3, 3]
    cats = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(12)], "row_id long, category string")
    skew = {r["client_id"]: r["n"] for r in S.shard_sizes(S.shard_skew(cats, 3)).collect()}
    assert skew == {0: 3, 1: 3, 2: 5}


def _c7(spark):
    up = spark.createDataFrame([(0, 0, "p", 0, 2.0), (0, 1, "p", 0, 4.0)], "round int, client_id int, key string, pos int, value double")
    sizes = spark.createDataFrame([(0, 1), (1, 3)], "client_id int, n long")
    parts = spark.createDataFrame([(0, 0), (0, 1)], "round int, client_id int")
    glob = spark.createDataFrame([("p", 0, 1.0)], "key string, pos int, value double")
    return up, sizes, parts, glob


def test_c7_server_rules(spark):
    up, sizes, parts, glob = _c7(spark)
    assert FD.fed_avg(up, sizes, parts).first()["value"] == pytest.approx(3.5)
    st = FD.init_state(glob)
    r0 = FD.fed_avgm(up, sizes, parts, glob, st, 0).first()
    assert (r0["value"], r0["v"]) == pytest.approx((3.5, 2.5))
    g1 = spark.createDataFrame([("p", 0, r0["value"])], "key string, pos int, value double")
    v1 = spark.createDataFrame([("p", 0, r0["v"])], "key string, pos int, v double")
    r1 = FD.fed_avgm(up, sizes, parts, g1, v1, 1).first()
    assert (r1["value"], r1["v"]) == pytest.approx((4.75, 1.25))
    assert FD.fed_adagrad(up, parts, glob, st).first()["value"] == pytest.approx(1.00999500125, abs=1e-10)
    assert FD.fed_yogi(up, parts, glob, st).first()["value"] == pytest.approx(1.09950124999, abs=1e-10)
    assert FD.fed_adam(up, parts, glob, st).first()["value"] == pytest.approx(1.09950126237, abs=1e-10)
    q = spark.createDataFrame([(0, 1.0), (1, 3.0)], "client_id int, a double")
    assert FD.fed_quality(up, sizes, parts, q).first()["value"] == pytest.approx(2.375)


def test_c8_bleu(spark):
    hyps = spark.createDataFrame([(0, "the cat sat")], "k int, t string").select("k", B.tokens("t").alias("tokens"))
    refs = spark.createDataFrame([(0, 0, "the cat sat down")], "k int, ref_id int, t string") \
        .select("k", "ref_id", B.tokens("t").alias("tokens"))
    r = B.corpus_bleu(hyps, refs, ["k"]).first()
    assert [r["p1"], r["p2"], r["p3"], r["p4"]] == [1.0, 1.0, 1.0, 1.0]
    assert r["ratio"] == pytest.approx(0.75)
    assert r["bleu"] == pytest.approx(math.exp(-1 / 3))
    assert r["bleu"] == pytest.approx(0.716531311, abs=1e-9)


def test_c9_ifd_gate(spark):
    alone = spark.createDataFrame([(0, 3.0), (1, 1.5)], "row_id int, mean1 double")   # [2,4] / [1,2]
    cond = spark.createDataFrame([(0, 1.5), (1, 3.0)], "row_id int, mean2 double")
    got = {r["row_id"]: r["ifd"] for r in I.ratio_gate(alone, cond).collect()}
    assert got == {0: 0.5}


def test_c10_rdp(spark):
    runs = spark.createDataFrame([(0, 0.01, 1.0)], "run int, q double, sigma double")
    r = D.rdp_terms(runs, orders=(8, 8)).first()["rdp"]
    assert r == pytest.approx(0.000893643907606, rel=1e-9)


def test_c3_pair_cosine_agrees(spark):
    texts = [(0, "a b", "c d"), (1, "foo bar", "!!"), (2, "same words here", "same words here"),
             (3, "Étion dans çouelle, dans a x", "dans le çouelle éeau")]
    left = spark.createDataFrame([(k, a) for k, a, _ in texts], "lk int, text string")
    right = spark.createDataFrame([(k, b) for k, _, b in texts], "rk int, text string")
    pairs = spark.createDataFrame([(k, k, k) for k, _, _ in texts], "k int, lk int, rk int")
    got = {r["k"]: r["sim"] for r in SIM.pair_cosine(pairs, ["k"], left, "lk", right, "rk").collect()}
    assert got[0] is None and got[1] == 0.0
    assert got[2] == pytest.approx(1.0)
    assert got[3] == pytest.approx(0.465646219, abs=1e-9)
