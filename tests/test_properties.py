"""Properties from the test strategy: partitions, conservation, identities."""

import pytest
from pyspark.sql import functions as F

from synthweave.operators import bleu as B
from synthweave.operators import distance as D
from synthweave.operators import federated as FD
from synthweave.operators import privacy as P
from synthweave.operators import ranking as RK
from synthweave.operators import shard as S
from synthweave.plans import jobs as J
from synthweave.sources import fixtures as V


def test_shards_partition_the_input(spark, sf):
    corpus = V.v_corpus(spark, sf)
    for sharded in (S.shard_iid(corpus, 7), S.shard_length(corpus, 10)):
        assert sharded.count() == corpus.count()
        assert sharded.select("row_id").distinct().count() == corpus.count()


def test_verdicts_cover_every_prompt(spark, sf):
    out = J.job_icl(spark, sf)
    counts = {r["verdict"]: r["count"] for r in out.groupBy("verdict").count().collect()}
    assert sum(counts.values()) == V.v_corpus(spark, sf).count()
    assert set(counts) <= {"kept", "failed", "unparsed"}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_global_rank_is_partition_independent(spark, sf, parts):
    corpus = V.v_corpus(spark, sf).select("row_id")
    ranked = RK.global_row_number(corpus.repartition(parts), ["row_id"], "rn", partitions=parts)
    got = [(r["row_id"], r["rn"]) for r in ranked.orderBy("rn").collect()]
    ids = sorted(r["row_id"] for r in corpus.collect())
    assert got == [(rid, i + 1) for i, rid in enumerate(ids)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_group_rank_is_partition_independent(spark, sf, parts):
    corpus = V.v_corpus(spark, sf).select("row_id", "category")
    got = {(r["row_id"]): r["rn"] for r in RK.rank_within_groups(corpus.repartition(parts), ["category"],
                                                                    ["row_id"], "rn", partitions=parts).collect()}
    by_cat = {}
    for r in sorted(corpus.collect(), key=lambda r: r["row_id"]):
        by_cat.setdefault(r["category"], []).append(r["row_id"])
    want = {rid: i + 1 for ids in by_cat.values() for i, rid in enumerate(ids)}
    assert got == want


def test_top_n_per_group_with_a_hot_group(spark):
    # one group holds most rows: the salted two-level limit must still be exact
    rows = [(i, "hot" if i % 10 else f"g{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id long, grp string")
    got = RK.top_n_per_group(df, ["grp"], ["row_id"], 5, salt_cols=[F.col("row_id")])
    hot = sorted(r["row_id"] for r in got.where("grp = 'hot'").collect())
    assert hot == [1, 2, 3, 4, 5]
    assert got.count() == 5 + 200


def test_fedavg_of_equal_updates_is_identity(spark):
    up = spark.createDataFrame([(0, c, "k", p, 0.25 * p) for c in range(3) for p in range(4)],
                               "round int, client_id int, key string, pos int, value double")
    sizes = spark.createDataFrame([(c, c + 1) for c in range(3)], "client_id int, n long")
    parts = spark.createDataFrame([(0, c) for c in range(3)], "round int, client_id int")
    got = {r["pos"]: r["value"] for r in FD.fed_avg(up, sizes, parts).collect()}
    assert got == pytest.approx({p: 0.25 * p for p in range(4)})


def test_clip_never_lengthens(spark, sf):
    contrib = V.v_contrib(spark, sf)
    norms = P.clip_sum(contrib, "author", "key", "value", 10.0).agg(F.sum(F.abs("clipped_sum"))).first()[0]
    raw = contrib.groupBy("key").agg(F.sum("value").alias("s")).agg(F.sum(F.abs("s"))).first()[0]
    assert norms <= raw + 1e-9


def test_epsilon_monotone(spark):
    runs = spark.createDataFrame([(0, 0.01, 1.0, 100, 1e-5), (1, 0.01, 1.0, 1000, 1e-5), (2, 0.01, 2.0, 1000, 1e-5)],
                                 "run int, q double, sigma double, steps int, delta double")
    eps = {r["run"]: r["epsilon"] for r in P.rdp_ledger(runs, ["run"]).collect()}
    assert eps[0] < eps[1]          # more steps, more privacy loss
    assert eps[2] < eps[1]          # more noise, less privacy loss


def test_fid_of_a_set_with_itself_is_zero(spark, sf):
    e = V.v_sides(spark, sf).where("side = 0")
    both = e.unionByName(e.withColumn("side", F.lit(1)))
    assert D.fid(both).first()["fid"] == pytest.approx(0.0, abs=1e-6)


def test_bleu_of_identical_text_is_one(spark):
    hyps = spark.createDataFrame([(0, "a b c d e")], "k int, t string").select("k", B.tokens("t").alias("tokens"))
    refs = spark.createDataFrame([(0, 0, "a b c d e")], "k int, ref_id int, t string") \
        .select("k", "ref_id", B.tokens("t").alias("tokens"))
    assert B.corpus_bleu(hyps, refs, ["k"]).first()["bleu"] == pytest.approx(1.0)
    pairs = spark.createDataFrame([(0, "a b c d e", "a b c d e")], "k int, h string, r string") \
        .select("k", B.tokens("h").alias("hyp"), B.tokens("r").alias("ref"))
    assert B.sentence_bleu(pairs, ["k"]).first()["bleu"] == pytest.approx(1.0)


def test_ngram_sampler_follows_bigram_counts(spark):
    from synthweave.operators import generate as G

    class _LM:  # a bigram table with known counts: after 'aa', 'bb' 3 times and 'cc' once
        word_bigrams = spark.createDataFrame([("aa", "bb", 3), ("aa", "cc", 1)], "h string, w string, c long")

    rows = [(i, "xx aa") for i in range(4000)] + [(4000, "!")]   # the last prompt has no word
    prompts = spark.createDataFrame(rows, "round_id long, prompt string")
    out = G.generate_ngram(prompts, _LM(), steps=1, seed=5)
    counts = {r["generation"]: r["count"] for r in out.groupBy("generation").count().collect()}
    assert set(counts) == {"bb", "cc"}
    assert abs(counts["bb"] / 4000 - 0.75) < 0.03


def test_group_rank_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 10 else f"g{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, grp string")
    got = {r["row_id"]: r["rn"] for r in RK.rank_within_groups(df, ["grp"], ["row_id"], "rn", partitions=12).collect()}
    by = {}
    for rid, g in sorted(rows):
        by.setdefault(g, []).append(rid)
    assert got == {rid: i + 1 for ids in by.values() for i, rid in enumerate(ids)}


def test_client_draw_rules(spark):
    from synthweave.operators import sample as M
    clients = spark.createDataFrame([(c,) for c in range(10)], "client_id int")
    local = M.client_draw(clients, 3, 4, fed_alg="local7").collect()
    assert sorted((r["round"], r["client_id"]) for r in local) == [(0, 7), (1, 7), (2, 7)]
    few = M.client_draw(clients.where("client_id < 3"), 2, 5).collect()     # fewer clients than k: all of them
    assert sorted((r["round"], r["client_id"]) for r in few) == [(r, c) for r in range(2) for c in range(3)]
    drawn = M.client_draw(clients, 50, 4)
    per_round = {r["round"]: r["count"] for r in drawn.groupBy("round").count().collect()}
    assert set(per_round.values()) == {4} and len(per_round) == 50
    assert drawn.select("client_id").distinct().count() == 10               # every client gets drawn somewhere


def test_system_message_reaches_every_conversation(spark):
    from synthweave.operators import chat as C
    conv = spark.createDataFrame([(1, 0, "system", "old"), (1, 1, "user", "a"), (2, 0, "user", "b"), (2, 1, "assistant", "c")],
                                 "conv_id long, turn int, role string, text string")
    rows = sorted(tuple(r) for r in C.set_system_message(conv, "new").collect())
    assert rows == [(1, 0, "system", "new"), (1, 1, "user", "a"), (2, -1, "system", "new"), (2, 0, "user", "b"), (2, 1, "assistant", "c")]
    messages = {(r["conv_id"], r["sys_text"]) for r in C.messages(C.set_system_message(conv, "new")).collect()}
    assert messages == {(1, "new"), (2, "new")}


def test_one_token_trigram_bleu_is_the_brevity_penalty(spark):
    import math

    from synthweave.operators import bleu as B
    df = spark.createDataFrame([(1, "a", "a b"), (2, "a", "b"), (3, "a\u00a0b\u3000c", "a b c")], "k long, h string, r string")
    out = {r["k"]: r["bleu3"] for r in B.trigram_bleu(df.select("k", B.tokens("h").alias("hyp"), B.tokens("r").alias("ref")), ["k"]).collect()}
    assert math.isclose(out[1], math.exp(-1)) and out[2] == 0.0 and math.isclose(out[3], 1.0)


def test_moments_do_not_cancel_and_ignore_partitioning(spark):
    import numpy as np

    from synthweave.operators import distance as D
    x = np.random.default_rng(5).normal(size=(500, 3)) + 1e8
    df = spark.createDataFrame([(i % 2, r.tolist()) for i, r in enumerate(x)], "side int, embedding array<double>")
    for parts in (1, 7):
        got = {(r["side"], r["i"], r["j"]): r["cov"] for r in D.moments(df.repartition(parts))[1].collect()}
        for s in (0, 1):
            want = np.cov(x[s::2], rowvar=False)
            assert all(abs(got[s, i, j] - want[i, j]) < 1e-6 for i in range(3) for j in range(3))


def test_model_factory_runs_in_the_task(spark):
    from synthweave.operators import generate as G
    df = spark.range(10).selectExpr("id AS row_id", "concat('p', id) AS prompt")
    out = G.generate(df, factory=lambda: (lambda s: s.str.upper()))
    assert {r["generation"] for r in out.collect()} == {f"P{i}" for i in range(10)}
