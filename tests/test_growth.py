"""Steps that are to grow no faster than their input: what they shuffle, write and hold."""

import math
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from synthweave.functions.batches import token_slices
from synthweave.operators import similarity as SIM


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gate_shuffles_texts_not_tokens(spark):
    gens = spark.createDataFrame([(1, "red green blue"), (2, "red red"), (3, "?"), (4, None), (5, "aa bb")], "round_id bigint, instruction string")
    few = spark.createDataFrame([(1, 0, 7, "green blue red"), (1, 1, 8, "other words"), (2, 0, 8, "red other"), (3, 0, 9, "!"), (4, 0, 7, "green blue red"),
                                 (5, 0, 10, "cc dd"), (6, 0, 7, "green")], "round_id bigint, slot int, row_id bigint, instruction string")
    gate = SIM.similarity_gate(gens, few)
    assert "Generate" not in plan(gate)                       # the tokens of a text were rows, joined three times for a round's exemplars
    got = {r["round_id"]: (r["max_sim"], r["similar"]) for r in gate.collect()}
    i2 = (1 + math.log(1.5)) ** 2
    assert math.isclose(got[2][0], 2 / (math.sqrt(4) * math.sqrt(1 + i2)))
    assert math.isclose(got[1][0], 1.0) and got[3] == (1.0, True) and got[4] == (0.0, False) and got[5] == (0.0, False) and set(got) == {1, 2, 3, 4, 5}


def test_token_slices():
    lists = [[1] * 5, None, [2] * 9, [], [3]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64()))], ["t"])
    parts = [p.column(0).to_pylist() for p in token_slices(batch, [0], 6)]
    assert sum(parts, []) == lists and len(parts) > 1
    assert not list(token_slices(batch.slice(0, 0), [0]))


def test_bigrams_of_a_row_travel_once(spark):
    """Both texts of a row hold the answer: a bigram was sent for each place in each of them."""
    from synthweave.operators import lm as L
    toks = [5, 7, 5, 7, 9]
    rows = spark.createDataFrame([(1, toks, 1, 5, [3, *toks], 2, 6), (2, [], 1, 0, None, 1, 0), (1, toks, 1, 5, [3], 0, 0)],
                                 "row_id bigint, _t0 array<bigint>, _first0 int, _last0 int, _t1 array<bigint>, _first1 int, _last1 int")
    found = L.bigram_places(rows, ["row_id"], 2)
    assert found.count() == 6                                 # (5, 7), (7, 5), (7, 9) of two rows
    got = sorted(tuple(r) for r in found.select("row_id", "h", "w", F.explode("at").alias("a")).select("row_id", "h", "w", *L.unpacked("a")).collect())
    alone = [(1, 5, 7, 0, 1, 0), (1, 7, 5, 0, 2, 1), (1, 5, 7, 0, 3, 1), (1, 7, 9, 0, 4, 0)]
    assert got == sorted(alone * 2 + [(1, h, w, 1, p + 1, s) for _, h, w, _, p, s in alone])


def test_counts_are_dealt_once(spark):
    """Bigram counts were shuffled to their histories and back before they were written; losses were stored on the way to the unseen ones."""
    from synthweave.operators import lm as L
    lm = L.BigramLM(spark.createDataFrame([("aa bb aa bb cc",), ("aa",), ("?",)], "text string"))
    assert {tuple(r) for r in lm.history.join(spark.createDataFrame([(w,) for w in ("aa", "bb", "cc")], "w string").withColumn("h", F.xxhash64("w")), "h").select("w", "ch").collect()} == {("aa", 2), ("bb", 2), ("cc", 0)}
    assert "Exchange" not in lm.counts.groupBy("h", "w").count()._jdf.queryExecution().executedPlan().toString()
    got = {r["pos"]: r["loss"] for r in L.token_losses(spark.createDataFrame([(1, "aa bb zz aa")], "row_id bigint, text string"), lm).collect()}
    want = {p: -math.log(0.5 * (s + 1) / (p + 3) + 0.5 * (c + 1) / (ch + 3)) for p, s, c, ch in ((1, 0, 2, 2), (2, 0, 0, 2), (3, 1, 0, 0))}
    assert all(math.isclose(got[p], want[p]) for p in want) and len(got) == 3


def test_scorer_meets_few_rows_at_a_time(spark):
    from synthweave.operators import ifd as I
    from synthweave.plans.queries_lm import WordLengthScorer

    most = I.SCORED_ROWS

    class Few(WordLengthScorer):
        def losses(self, texts, limits):
            assert len(texts) <= most
            return super().losses(texts, limits)

    n = 2 * most + 10
    df = spark.range(n).select(F.col("id").alias("row_id"), F.lit("say it").alias("instruction"), F.concat(F.lit("so be it "), F.col("id")).alias("response")).coalesce(1)
    assert I.scored_losses(df, Few, "wiz", 64).select("row_id").distinct().count() == n


def test_sampler_tables_are_dealt_once(spark):
    """Every step shuffled the whole table of successors."""
    from synthweave.operators import generate as G
    counts = spark.createDataFrame([("aa", w, c) for w, c in (("bb", 3), ("cc", 1), ("dd", 200))] + [("bb", "aa", 1)], "h string, w string, c long")
    intervals, totals = G.successor_table(counts)
    for table, keys in ((intervals, ["h", "b"]), (totals, ["h"])):
        assert "Exchange" not in table.groupBy(*keys).count()._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in totals.collect()} == {("aa", 204, 4), ("bb", 1, 1)}
    spans = sorted((r["lo"], r["hi"]) for r in intervals.where("h = 'aa'").select("lo", "hi").distinct().collect())
    assert spans[0][0] == 0 and spans[-1][1] == 204 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and sorted(b - a for a, b in spans) == [1, 3, 200]


def test_clipped_matches_of_long_texts(spark):
    """N-grams were sorted by array functions, once for each order and side."""
    from synthweave.operators import bleu as B
    rng = random.Random(5)
    words = lambda n, k: [str(rng.randrange(k)) for _ in range(n)]
    rows = [(i, words(rng.randrange(60), 4 + i % 30), words(rng.randrange(400), 4 + i % 30)) for i in range(200)] + [(900, None, ["a"]), (901, ["a"], None)]
    parts = B._sentence_parts(spark.createDataFrame(rows, "row_id bigint, hyp array<string>, ref array<string>").coalesce(1), ["row_id"], "hyp", "ref", 4)
    assert "array_intersect" not in plan(parts)
    gram = lambda t, o: Counter(tuple(t[i:i + o]) for i in range(len(t or []) - o + 1))
    got = {r["row_id"]: r for r in parts.collect()}
    for i, h, r in rows:
        for o in range(1, 5):
            assert got[i][f"m{o}"] == sum((gram(h, o) & gram(r, o)).values()) and got[i][f"d{o}"] == max(len(h or []) - o + 1, 1)


def test_replicates_are_dealt_once(spark, tmp_path):
    import glob
    from synthweave.sources import files as IO
    df = spark.createDataFrame([(i, i % 2, f"say {i}", "", f"so {i}") for i in range(20)], "row_id long, client_id int, instruction string, input string, output string")
    IO.write_shards(df, str(tmp_path / "r"), above=["rep"], compression="gzip",
                    derived={"text": F.concat_ws(" ", "instruction", "output"), "rep": F.explode(F.sequence(F.lit(0), F.lit(2)))})
    assert len(glob.glob(str(tmp_path / "r" / "rep=*" / "client_id=*" / "*.json.gz"))) >= 6
    got = IO.merge_replicates(spark, str(tmp_path / "r")).select("file_name", "replicate", "row_id").collect()
    assert sorted(tuple(r) for r in got) == sorted((f"client{i % 2}.json", k, i) for i in range(20) for k in range(3))


def test_shards_are_written_as_rows_come(spark, monkeypatch):
    """Rows were sorted by shard after ``derived`` had multiplied them: at five times check_s that spilled."""
    import os

    from pyspark.sql.readwriter import DataFrameWriter

    from synthweave.sources import files as IO
    name, save, seen = "spark.sql.maxConcurrentOutputFileWriters", DataFrameWriter.save, []

    def spy(self, *args, **kwargs):
        seen.append(int(spark.conf.get(name, "0")))
        return save(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "save", spy)
    before = spark.conf.get(name, "0")
    df = spark.range(200).select("id", (F.col("id") % 7).cast("int").alias("client_id"))
    for files in (IO.OPEN_FILES, 2):                          # fewer shards in a task than files, and more
        monkeypatch.setattr(IO, "OPEN_FILES", files)
        path = os.path.join(IO.scratch(spark, "t_as_come"), "out")
        IO.write_shards(df, path, above=["rep"], derived={"rep": F.explode(F.sequence(F.lit(0), F.lit(2)))})
        got = Counter((r["rep"], r["client_id"], r["id"]) for r in spark.read.json(path).collect())
        assert got == Counter((rep, i % 7, i) for i in range(200) for rep in range(3))
    assert seen == [64, 2] and spark.conf.get(name, "0") == before


def test_mauve_multiplies_blocks(spark, monkeypatch):
    """The row solver took each row's distances to a tenth of the rows one by one."""
    from pyspark.ml.clustering import KMeans

    from synthweave.operators import distance as D
    rng = random.Random(5)
    df = spark.createDataFrame([(i % 2, [rng.random() for _ in range(6)]) for i in range(120)], "side int, embedding array<double>")
    fit, solver, used = KMeans.fit, None, []

    def spy(self, data):
        used.append(self.getSolver())
        return fit(self.setSolver(solver or self.getSolver()), data)

    monkeypatch.setattr(KMeans, "fit", spy)
    got = D.mauve(df).first()
    assert used == ["block"] * 5
    solver = "row"
    assert abs(D.mauve(df).first()["mauve"] - got["mauve"]) < 1e-9 and got["k"] == 6


def test_many_centres_are_those_of_spark(spark, monkeypatch):
    """Spark chose the centres of a start on the driver, among four times as many candidates."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from synthweave.operators import distance as D
    from synthweave.operators import kmeans as K
    x = np.random.default_rng(3).normal(size=(900, 7))
    x[300:340] = x[0]                                         # copies are one candidate
    df = spark.createDataFrame([(i % 2, r.tolist()) for i, r in enumerate(x)], "side int, pc array<double>").repartition(5).cache()
    fit = K.Fit(df, 60, [25, 26], 100, 7)
    for seed, centres, cost, iterations in zip((25, 26), fit.centres, fit.cost, fit.iterations):
        want = KMeans(k=60, seed=seed, maxIter=100, featuresCol="v", solver="block", maxBlockSizeInMB=0.1).fit(df.select(array_to_vector("pc").alias("v")))
        assert np.allclose(np.array(want.clusterCenters()), centres, atol=1e-9)
        assert math.isclose(want.summary.trainingCost, cost, rel_tol=1e-9) and want.summary.numIter == iterations
    assert fit.best == int(fit.cost[1] < fit.cost[0]) and sum(n for _, _, n in fit.histogram()) == 900

    both = df.withColumnRenamed("pc", "embedding")
    want, fits = D.mauve(both, starts=2).first(), []
    monkeypatch.setattr(D, "FEW_CENTRES", 44)
    monkeypatch.setattr(KMeans, "fit", lambda *a: fits.append(a))
    assert D.mauve(both, starts=2).first() == want and want["k"] == 45 and not fits


def test_nearest_centre_of_close_ones(spark):
    """Products in single precision do not decide between centres that they cannot tell apart."""
    import numpy as np

    from synthweave.operators import kmeans as K
    rng = np.random.default_rng(4)
    c = rng.normal(size=(50, 8))
    c = np.concatenate([c, c + 1e-9 * rng.normal(size=c.shape), c[:3]])
    x = c[rng.integers(0, len(c), 400)] + 1e-9 * rng.normal(size=(400, 8))
    exact = ((x[:, None] - c) ** 2).sum(axis=2)
    label, far = K.nearest(x, K.Centres(c))
    assert np.allclose(far, exact.min(axis=1), atol=1e-15) and (label < 100).all()
    lone = K.nearest(x, K.Centres(c[:50]))[0]
    assert (lone == exact[:, :50].argmin(axis=1)).all()


def test_corpus_bleu_of_one_reference_counts_in_arrow(spark):
    """A hypothesis with one reference took array functions over every occurrence of every n-gram."""
    from synthweave.operators import bleu as B
    rng = random.Random(6)
    text = lambda n: [rng.choice("abcd") for _ in range(rng.randint(0, n))]
    hyps = [(i, text(30)) for i in range(60)] + [(0, text(9)), (61, None), (62, [])]
    refs = [(i, 0, text(30)) for i in range(63)] + [(i, 1, text(30)) for i in range(0, 60, 4)]
    df = spark.createDataFrame(hyps, "k bigint, tokens array<string>"), spark.createDataFrame(refs, "k bigint, ref_id int, tokens array<string>")
    alone = df[1].where("ref_id = 0")
    assert "MapInArrow" in B.corpus_bleu(df[0], alone, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    grams = lambda t, o: Counter(tuple(t[i:i + o]) for i in range(len(t) - o + 1))
    for several, r in ((True, df[1]), (False, alone)):
        got = B.corpus_bleu(df[0], r, ["k"]).first()
        for o in range(1, 5):
            m = p = 0
            met = {}
            for i, h in hyps:
                of = [t for j, k, t in refs if j == i and (several or k == 0)]
                own = grams(h or [], o)
                p += sum(own.values())
                hit = own & (grams(of[0], o) | (grams(of[1], o) if len(of) > 1 else Counter()))
                met[i, len(of) > 1] = met.get((i, len(of) > 1), Counter()) | hit if len(of) > 1 else met.get((i, False), Counter()) + hit
            m = sum(sum(c.values()) for c in met.values())
            assert math.isclose(got[f"p{o}"], (m + 1) / (p + 1)), (several, o)
