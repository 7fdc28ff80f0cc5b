"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill
in settings that are unset, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  Applied with ``setIfMissing``
# semantics: an existing value (cluster defaults, spark-submit flags) is kept.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "synthweave",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SW_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and lineage-cutting tables.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a
    single-JVM session (``local[...]``: tests, bench) gets a scratch folder of
    its own; a cluster session fails, because a folder of one machine is not
    seen by the others.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith(("local[", "local ")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), f"synthweave-{sc.applicationId}")
        spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path


def materialize(df):
    """Write ``df`` once to the checkpoint folder and continue from there.

    For results that are costly, may be non-deterministic (a real model's
    output) or are read several times; a reliable checkpoint also survives
    the loss of the executors that produced it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df):
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage as ``materialize`` does; a reader prunes columns, small files
    share a task, and the planner knows the table's size.  Column names must
    differ and have types.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SPREAD_BYTES = 64 << 20


def spread(df, *keys):
    """Deal the rows of a small input to all task slots by key.

    A small file is one row group, so one task reads it, and what follows in
    that stage runs in one slot.  An input with ``SPREAD_BYTES`` for every
    slot (by the planner's size) is left as it is scanned: no shuffle there.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= slots * SPREAD_BYTES:
        return df
    return df.repartition(max(slots, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def dealt(df, *keys):
    """Rows dealt by key to as many tasks as the session shuffles to, however few bytes they have: for costly work on each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bucketed(df, *keys, buckets=None, deal=True):
    """Write ``df`` once as a table bucketed and sorted by ``keys`` and read it back.

    Joins on exactly these keys shuffle and sort the other side only.  The
    files lie in the shared checkpoint folder; ``buckets`` defaults to the
    session's shuffle partitions, so both sides of such joins agree.  Rows
    that an aggregation or window by ``keys`` has just dealt need no second
    shuffle (``deal=False``).
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"synthweave_{uuid.uuid4().hex}"
    ((df.repartition(n, *keys) if deal else df).write.bucketBy(n, *keys).sortBy(*keys)
     .option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)
