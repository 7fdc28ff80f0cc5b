"""Sources, sinks and the streaming runner."""

import json
import os

import pytest
from pyspark.sql import functions as F

from synthweave.operators import parse as X
from synthweave.operators import privacy as P
from synthweave.sources import files as IO
from synthweave.sources import fixtures as V
from synthweave.streaming import ledger as LG
from synthweave.streaming import rowwise as ST


def test_shard_ids_are_numeric(spark):
    path = IO.scratch(spark, "t_shards")
    df = spark.createDataFrame([(i, i % 12) for i in range(48)], "row_id long, client_id int")
    IO.write_shards(df, path)
    back = IO.scan_shards(spark, path, "row_id long")
    ids = [r["shard_id"] for r in back.select("shard_id").distinct().orderBy("shard_id").collect()]
    assert ids == list(range(12))          # client10 sorts after client2
    assert back.count() == 48


def test_write_once_refuses_overwrite(spark):
    path = os.path.join(IO.scratch(spark, "t_once"), "out")
    df = spark.range(3)
    IO.write_once(df, path)
    with pytest.raises(Exception):
        IO.write_once(df, path)


def test_mixed_json_keeps_bad_lines(spark):
    root = IO.scratch(spark, "t_mixed")
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, "a.json"), "w") as f:
        f.write('{"row_id": 1, "instruction": "x"}\n')
        f.write('[{"row_id": 2, "instruction": "y"}, {"row_id": 3, "instruction": "z"}]\n')
        f.write('{"row_id": 4, "instr\n')
    df = IO.scan_mixed_json(spark, root, "row_id long, instruction string")
    rows = df.collect()   # Spark refuses queries that read only the corrupt-record column
    assert sorted(r["row_id"] for r in rows if r["_corrupt_record"] is None) == [1, 2, 3]
    assert sum(r["_corrupt_record"] is not None for r in rows) == 1


def test_read_dataset_by_extension(spark):
    path = os.path.join(IO.scratch(spark, "t_ext"), "rows.jsonl")
    spark.createDataFrame([(1, "a")], "row_id long, text string").write.json(path)
    assert IO.read_dataset(spark, path).count() == 1


def test_stream_matches_batch(spark, sf):
    root = IO.scratch(spark, "t_stream")
    raw = V.v_raw_gen(spark, sf)
    raw.write.json(os.path.join(root, "in"))
    src = ST.read_json_stream(spark, os.path.join(root, "in"), "round_id long, text string")
    q = ST.run_rowwise(spark, src, lambda d: X.parse_pair(d).select("round_id", "instruction", "output"),
                       os.path.join(root, "out"), name="t_stream_" + os.path.basename(root))
    q.awaitTermination()
    streamed = spark.read.parquet(os.path.join(root, "out"))
    batch = X.parse_pair(raw).select("round_id", "instruction", "output")
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_indented_arrays_round_trip(spark):
    root = IO.scratch(spark, "t_arrays")
    df = spark.range(25).selectExpr("id AS row_id", "concat('line ', id, '\\n\"x\"') AS instruction").repartition(3)
    IO.write_json_arrays(df, os.path.join(root, "arrays"))
    df.selectExpr("row_id + 100 AS row_id", "instruction").write.json(os.path.join(root, "lines"))
    for name in os.listdir(os.path.join(root, "arrays")):
        if name.startswith("part-"):
            with open(os.path.join(root, "arrays", name)) as f:
                assert isinstance(json.load(f), list)
    back = IO.scan_mixed_json(spark, root, "row_id long, instruction string").cache()
    assert back.where("_corrupt_record IS NOT NULL").count() == 0
    assert {r["row_id"] for r in back.collect()} == {*range(25), *range(100, 125)}


def test_long_conversations_and_replicates_keep_distinct_keys(spark, tmp_path):
    turns = spark.range(300).selectExpr("id DIV 150 AS conv_id", "CAST(id % 150 AS INT) AS turn",
                                        "if(id % 2 = 0, 'user', 'assistant') AS role", "'t' AS text")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    pairs = V.v_pairs(spark, str(tmp_path))
    assert pairs.count() == pairs.select("row_id").distinct().count() == 150


def test_one_indented_array_is_read_by_many_tasks(spark):
    root = IO.scratch(spark, "t_one_array")
    os.makedirs(os.path.join(root, "in"))
    rows = [{"id": i, "text": f'a {{"b"}},\n    {{ {i}', "more": [{"x": i}, {"x": None}], "o": {} if i % 2 else {"x": 1}} for i in range(4000)]
    with open(os.path.join(root, "in", "a.json"), "w") as f:
        json.dump(rows, f, indent=4)
    with open(os.path.join(root, "in", "b.json"), "w", newline="") as f:       # tabs, other line ends, records of one line and of several
        f.write('[\r\n\t{"id": 5000},\r\n\t{\r\n\t\t"id": 5001,\r\n\t\t"more": [\r\n\t\t\t{"x": 3}\r\n\t\t]\r\n\t},\r\n\t  {"id": 5002}, {"id": 5003},\r\n\t{"id": oops},\r\n\t{"id": 5004}\r\n]\r\n')
    with open(os.path.join(root, "in", "c.jsonl"), "w") as f:
        f.write('{"id": 6000}\n[{"id": 6001}, {"id": 6002}]\n')
    with open(os.path.join(root, "in", "d.json"), "w") as f:
        f.write("[\n]\n")
    with open(os.path.join(root, "in", "e.json"), "w") as f:
        json.dump([{"id": 7000}, {"id": 7001}], f, indent=0)
    schema = "id long, text string, more array<struct<x:long>>, o struct<x:long>"
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        assert IO.array_files(spark, os.path.join(root, "in")).keys() == {"    ", "\t", None}
        big = IO.array_records(spark, [os.path.join(root, "in", "a.json")], "    ")
        assert big.rdd.getNumPartitions() > 10
        for how in (schema, None):
            df = IO.scan_mixed_json(spark, os.path.join(root, "in"), how)
            good = df.where("_corrupt_record is null and id is not null")
            assert sorted(r["id"] for r in good.select("id").collect()) == [*range(4000), *range(5000, 5005), *range(6000, 6003), 7000, 7001]
            assert [r["_corrupt_record"] for r in df.collect() if r["_corrupt_record"]] == ['{"id": oops}']
            got = {r["id"]: (r["text"], [x["x"] for x in r["more"]], r["o"]["x"]) for r in good.where("id < 4000").collect()}
            assert got == {r["id"]: (r["text"], [r["id"], None], r["o"].get("x")) for r in rows}
            assert good.where("id = 5001").first()["more"][0]["x"] == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_running_budget(spark):
    root = IO.scratch(spark, "t_budget")
    rows = [(run, entry, 0.02 if run != 2 else 0.0, 0.8, 50, 1e-5) for run in (1, 2) for entry in range(1, 9)]
    rows += [(1, 9, None, 0.8, 50, 1e-5), (1, 10, 0.02, 0.8, 0, 1e-5), (3, 1, 1.0, 0.5, 3, 1e-5), (4, 1, 0.02, 0.8, 7, None)]
    schema = "run int, entry long, q double, sigma double, steps long, delta double"
    df = spark.createDataFrame(rows, schema)
    name = "t_budget_" + os.path.basename(root)
    for part in ("entry > 20", "entry <= 3", "entry > 3"):
        df.where(part).repartition(3).write.mode("append").json(os.path.join(root, "in"))
        src = ST.read_json_stream(spark, os.path.join(root, "in"), schema)
        LG.run_budget(spark, src, ["run"], 1.0, os.path.join(root, "out"), name).awaitTermination()
    got = {(r["run"], r["steps"]): (r["epsilon"], r["first"]) for r in spark.read.parquet(os.path.join(root, "out")).collect()}
    checks = df.where("steps > 0 and q is not null and delta is not null").withColumn("steps", F.col("entry") * F.col("steps"))
    want = {(r["run"], r["steps"]): r["epsilon"] for r in P.rdp_ledger(checks.drop("entry"), ["run", "steps"]).where("epsilon > 1").collect()}
    assert got.keys() == want.keys() and len({k[0] for k in got}) == 2
    assert all(abs(got[k][0] - want[k]) < 1e-9 for k in want)
    assert [k for k, v in got.items() if v[1]] and all(v[1] == (k[1] == min(s for r, s in got if r == k[0])) for k, v in got.items())
