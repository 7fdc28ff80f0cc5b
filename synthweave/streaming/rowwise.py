"""Row-local operators on Structured Streaming inputs.

Normalisers, parsers, prompt builders and length filters are plain column
expressions, so the same functions apply unchanged to a ``readStream``
DataFrame.  Whole-table operators (samplers, sharding, ranks, similarity
gates, MAUVE) stay batch-only.

The sink is exactly-once through the checkpoint location, which lives under
the session's ``spark.checkpoint.dir`` (shared storage on a cluster), so a
restarted query -- or a lost executor -- resumes where it stopped.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from synthweave.session import checkpoint_dir


def read_json_stream(spark: SparkSession, path: str, schema: str, max_files: int = 64) -> DataFrame:
    """A file stream of JSON lines with an explicit schema (no inference on streams)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def run_rowwise(spark: SparkSession, source: DataFrame, transform: Callable[[DataFrame], DataFrame],
                out_path: str, name: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Apply ``transform`` to a stream and append the result to ``out_path``.

    ``available_now`` processes everything present and stops (batch-like
    backfill); otherwise the query keeps running with the default trigger.
    """
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    writer = (transform(source).writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", ckpt).option("path", out_path))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
