"""Selections by threshold and fixed-bound positions against plain sorting: ties, hot values, negative and wide ranges."""

import random

import pytest
from pyspark.sql import functions as F

from synthweave.functions.keys import hash_key, hash_order
from synthweave.operators import filters as FL
from synthweave.operators import ranking as RK
from synthweave.operators import sample as M
from synthweave.operators import shard as S

N = 700


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    data = [(i * 7 - 900 if i % 3 else (1 << 50) + i, rng.choice([0, 0, 0, 5, 9]), rng.choice([-2.5, 0.0, 0.25, 1e9]), f"text {i}") for i in range(N)]
    return data, spark.createDataFrame(data, "row_id bigint, len bigint, score double, text string")


@pytest.fixture(autouse=True)
def small_limits(monkeypatch):
    """Few rows are looked at one by one, so histograms do the work."""
    monkeypatch.setattr(RK, "FEW", 5)
    monkeypatch.setattr(RK, "BINS", 16)


@pytest.mark.parametrize("n", [0, 1, 4, 6, 233, N - 1, N, N + 1])
def test_first_n_by_any_numbers(rows, n):
    data, df = rows
    got = RK.select_first(df, n, [F.col("score"), -F.col("len"), F.col("row_id")])
    want = sorted((s, -k, i) for i, k, s, _ in data)[:n]
    assert sorted((r["score"], -r["len"], r["row_id"]) for r in got.collect()) == want


def test_samples_are_the_smallest_draws(rows):
    data, df = rows
    draws = {r["row_id"]: r["k"] for r in df.select("row_id", hash_key("row_id", seed=3).alias("k")).collect()}
    order = sorted(draws, key=lambda i: (draws[i], i))
    assert {r["row_id"] for r in M.sample_exact(df, 40, seed=3).collect()} == set(order[:40])
    assert {r["row_id"] for r in M.shuffle_limit(df, N + 9, seed=3).collect()} == set(order)
    with pytest.raises(ValueError):
        M.sample_exact(df, N + 1, seed=3)
    numbers = df.select("row_id", F.struct(*hash_order("row_id", seed=3)).alias("o")).collect()
    assert [r["row_id"] for r in sorted(numbers, key=lambda r: tuple(r["o"]))] == order


@pytest.mark.parametrize("start,end", [(0, 5), (3, 3), (10, -1), (0, -1), (690, 900), (900, -1)])
def test_row_range(rows, start, end):
    data, df = rows
    want = sorted(r[0] for r in data)[start:None if end == -1 else end]
    assert sorted(r["row_id"] for r in FL.row_range(df, start, end).collect()) == want


@pytest.mark.parametrize("crowd", [3, 50, None])
def test_positions_with_hot_values(rows, crowd):
    data, df = rows
    got = RK.positions(df, "row_id", [F.col("len"), F.col("row_id")], crowd=crowd)
    want = {i: at + 1 for at, (_, i) in enumerate(sorted((k, i) for i, k, _, _ in data))}
    assert {r["row_id"]: r["rn"] for r in got.collect()} == want


def test_positions_carry_no_text(rows):
    _, df = rows
    plan = M.position_index(df)._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Analyzed Logical Plan ==")[1]
    assert S.shard_iid(df, 7).columns == [*df.columns, "client_id"] or set(S.shard_iid(df, 7).columns) == {*df.columns, "client_id"}


def test_empty_tables(rows):
    _, df = rows
    none = df.limit(0)
    assert RK.select_first(none, 3, [F.col("row_id")]).count() == 0 and M.position_index(none).count() == 0
    assert S.shard_iid(none, 3).count() == 0


def test_fixed_index_list(spark):
    corpus = spark.createDataFrame([(10 * i, f"q{i}", f"a{i}") for i in range(6)], "row_id bigint, instruction string, response string")
    rounds = spark.range(3).withColumnRenamed("id", "round_id")
    got = M.fewshot_draw(corpus, rounds, index_list=[4, 0, 2]).orderBy("round_id", "slot").collect()
    assert [(r["round_id"], r["slot"], r["row_id"]) for r in got] == [(r, s, 10 * p) for r in range(3) for s, p in enumerate([4, 0, 2])]
    with pytest.raises(Exception, match="outside the corpus"):
        M.fewshot_draw(corpus, rounds, index_list=[6]).collect()
