"""BLEU matches against brute force, loss tables against rows from scratch, a model of the user's, splits and balanced shards."""

import glob
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from synthweave.operators import bleu as B
from synthweave.operators import ifd as I
from synthweave.operators import lm as L
from synthweave.plans.queries_lm import WordLengthScorer
from synthweave.sources import files as IO


def grams(t, o):
    return Counter(tuple(t[i:i + o]) for i in range(len(t) - o + 1))


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    words = lambda n, k: [rng.choice("abcdef"[:k]) for _ in range(n)]
    return [(i, words(rng.randint(0, 30), rng.randint(1, 6)), words(rng.randint(0, 30), rng.randint(1, 6))) for i in range(60)] + [(90, [], []), (91, ["a"] * 3000, ["a"] * 2000)]


def test_clipped_matches(spark, pairs):
    df = spark.createDataFrame(pairs, "row_id bigint, hyp array<string>, ref array<string>")
    got = {r["row_id"]: r for r in B._sentence_parts(df, ["row_id"], "hyp", "ref", 4).collect()}
    for i, h, r in pairs:
        for o in range(1, 5):
            assert got[i][f"m{o}"] == sum((grams(h, o) & grams(r, o)).values()) and got[i][f"d{o}"] == max(len(h) - o + 1, 1)


def test_corpus_bleu_with_several_references(spark, pairs):
    hyps = spark.createDataFrame([(i, h) for i, h, _ in pairs], "row_id bigint, tokens array<string>")
    refs = [(i, 0, r) for i, _, r in pairs] + [(i, 1, list(reversed(h))) for i, h, _ in pairs if i % 2]
    got = B.corpus_bleu(hyps, spark.createDataFrame(refs, "row_id bigint, ref_id int, tokens array<string>"), ["row_id"]).first()
    for o in range(1, 5):
        best = {i: Counter() for i, _, _ in pairs}
        for i, _, r in refs:
            best[i] |= grams(r, o)
        m = sum(sum((grams(h, o) & best[i]).values()) for i, h, _ in pairs)
        p = sum(max(len(h) - o + 1, 0) for _, h, _ in pairs)
        assert math.isclose(got[f"p{o}"], (m + 1) / (p + 1))


def test_seen_positions(spark):
    rows = [(1, [5, 7, 5, 5, 7, 9], 1, 6), (2, [], 1, 0), (3, [4], 0, 1), (4, [8, 8, 8, 8], 2, 4)]
    got = L.seen_positions(spark.createDataFrame(rows, "row_id bigint, _t array<bigint>, _first int, _last int"), ["row_id"])
    want = [(i, p, t[p - 1], t[p], t[:p].count(t[p])) for i, t, a, b in rows for p in range(max(a, 1), min(b, len(t)))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    words = "river winter garden letter engine silver window market of the and".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 12)), text(rng.randint(0, 30))) for i in range(40)] + [(90, "", ""), (91, "one", "one"), (92, text(80), text(5))]
    return spark.createDataFrame(rows, "row_id bigint, instruction string, response string")


def test_stored_losses_give_the_same_rows(spark, data, tmp_path):
    lm = L.BigramLM(data.select(F.concat_ws(" ", "instruction", "response").alias("text")))
    fresh = {r["row_id"]: r for r in I.ifd_rows(data, lm, "wiz", 64).collect()}
    IO.write_once(I.loss_table(data, lm, "wiz", 64), str(tmp_path / "losses"))
    table = spark.read.parquet(str(tmp_path / "losses"))
    assert [f.dataType.simpleString() for f in table.schema.fields[1:]] == ["array<double>", "array<array<double>>"]
    stored = {r["row_id"]: r for r in I.ifd_from_losses(table, I.span_rows(data, "wiz", 64), 64).collect()}
    assert set(stored) == set(fresh) and len(fresh) > 10
    assert all(math.isclose(stored[i][c], fresh[i][c], rel_tol=1e-9) for i in fresh for c in ("mean_alone", "mean_cond", "ifd"))


def test_user_scorer_runs_once_per_task(spark, data):
    made = spark.sparkContext.accumulator(0)

    def factory():
        made.add(1)
        return WordLengthScorer()

    got = I.scored_losses(data.coalesce(2), factory, "wiz", 64).collect()
    assert len(got) == 43 and made.value <= 2
    one = next(r for r in got if r["row_id"] == 91)
    assert one["token_loss"][0] == [] and one["token_loss"][1] == [math.log1p(12)]


def test_splits_and_configurations(spark, tmp_path):
    for part, n in (("main/train", 3), ("main/test", 2), ("socratic/train", 1)):
        spark.range(n).write.parquet(str(tmp_path / "gsm8k" / part))
    reg = IO.SourceRegistry(spark, str(tmp_path)).register("gsm8k", "gsm8k").register("flat", "gsm8k/main/test")
    counts = [reg.load("gsm8k").count(), reg.load("gsm8k", split="test").count(), reg.load("gsm8k", config="socratic").count(), reg.load("flat").count()]
    assert counts == [3, 2, 1, 2]
    with pytest.raises(FileNotFoundError):
        reg.load("gsm8k", split="validation")
    with pytest.raises(NotImplementedError):
        reg.load("nowhere")


def test_large_shards_are_written_by_many_tasks(spark, tmp_path):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "200k")
    try:
        # rows come from many tasks, as a rebalance splits a shard between the tasks that made it
        rows = spark.range(0, 40_000, 1, 32).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(9)).alias("client_id"),
                                                     F.sha2(F.col("id").cast("string"), 512).alias("text"))
        IO.write_shards(rows, str(tmp_path / "shards"))
    finally:
        spark.conf.set(name, before)
    files = {c: len(glob.glob(os.path.join(tmp_path, "shards", f"client_id={c}", "part-*"))) for c in (0, 1, 9)}
    assert files[9] > 8 and max(files[0], files[1]) <= 2         # a small shard may lie where the large one is split
    assert IO.scan_shards(spark, str(tmp_path / "shards"), "id bigint, text string").count() == 40_000


def test_projection_keeps_unlike_texts_apart(spark):
    from synthweave.operators import distance as D
    rng = random.Random(1)
    texts = [(i, " ".join(f"w{rng.randint(0, 5000)}" for _ in range(60))) for i in range(30)]
    texts += [(100 + i, t + " extra") for i, t in texts[:5]] + [(200, ""), (201, None)]
    got = {r["row_id"]: r["embedding"] for r in D.tfidf_embed(spark.createDataFrame(texts, "row_id bigint, text string"), ["row_id"], dims=128).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert all(abs(cos(a, b)) < 0.5 for a in range(30) for b in range(a)) and abs(sum(cos(a, b) for a in range(30) for b in range(a)) / 435) < 0.05
    assert all(cos(i, 100 + i) > 0.9 for i in range(5)) and not any(got[200]) and not any(got[201])


def test_distances_of_empty_sides(spark):
    from synthweave.operators import distance as D
    for rows in ([], [(0, [1.0, 2.0]), (0, [2.0, 1.0])]):
        df = spark.createDataFrame(rows, "side int, embedding array<double>")
        assert D.fid(df).first()["fid"] is None and D.mauve(df).first()["mauve"] is None


def test_fid_of_independent_dimensions(spark):
    """With diagonal covariances the distance has a closed form."""
    from synthweave.operators import distance as D
    a = [(0, [x, y]) for x in (1.0, 3.0) for y in (0.0, 2.0, 4.0)]
    b = [(1, [x, y]) for x in (2.0, 10.0) for y in (1.0, 2.0, 3.0)]
    var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1)
    want = 0.0
    for i in range(2):
        p, q = [v[i] for _, v in a], [v[i] for _, v in b]
        want += (sum(p) / len(p) - sum(q) / len(q)) ** 2 + var(p) + var(q) - 2 * math.sqrt(var(p) * var(q))
    assert math.isclose(D.fid(spark.createDataFrame(a + b, "side int, embedding array<double>")).first()["fid"], want, rel_tol=1e-9)
