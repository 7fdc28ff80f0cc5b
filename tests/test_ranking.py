"""Positions must be right when the rows are wide and many: range bounds are sampled per execution."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from synthweave.operators.ranking import global_row_number, rank_within_groups
from synthweave.operators.sample import fewshot_draw

SF = "/root/testdata/sf0.1"
ROWS = 200_000


@pytest.fixture(scope="module")
def wide(spark):
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(str(i))), 256) for i in range(3)])
    return spark.range(ROWS).select(F.col("id").alias("row_id"), F.md5(F.col("id").cast("string")).alias("k"),
                                    (F.col("id") % 7).alias("g"), text.alias("text"))


def test_global_positions(wide):
    got = global_row_number(wide, ["k", "row_id"], partitions=16).where(F.length("text") > 0)
    assert got.agg(F.count_distinct("rn"), F.min("rn"), F.max("rn"), F.count(F.lit(1))).first()[:] == (ROWS, 1, ROWS, ROWS)


def test_group_positions(wide):
    got = rank_within_groups(wide, ["g"], ["k"], partitions=16).where(F.length("text") > 0)
    bad = got.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rn").alias("d"), F.max("rn").alias("m"))
    assert bad.where("n <> d or n <> m").count() == 0


def test_draw_from_three_rows(spark):
    corpus = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(3)], "row_id bigint, instruction string, response string")
    drawn = fewshot_draw(corpus, spark.range(2000).withColumnRenamed("id", "round_id"))
    per = drawn.groupBy("round_id").agg(F.count_distinct("row_id").alias("n"))
    assert per.where("n = 3").count() == 2000


@pytest.mark.parametrize("key,column", [("job_icl", "round_id"), ("stage1_filter", "round_id"), ("generate_replay", "round_id")])
def test_one_row_per_round_at_bench_size(spark, key, column):
    n, distinct = E.queries()[key](spark, SF).agg(F.count(F.lit(1)), F.count_distinct(column)).first()
    assert n == distinct
    if key != "stage1_filter":
        assert n == 10_000
