"""File sources and sinks.

Shards are a ``client_id`` column on the way in and a ``partitionBy`` on the
way out; the shard id is recovered from the file path through the
``_metadata`` column, so listing, ordering and reading stay inside Spark.
Scratch output of registered queries goes under the session's
``spark.checkpoint.dir`` (a shared, durable folder on a cluster).
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthweave.session import checkpoint_dir

# File extension -> reader format.
EXT_FORMAT = {"jsonl": "json", "json": "json", "parquet": "parquet", "csv": "csv", "txt": "text"}
SHARD_RE = r"client(?:_id=)?(\d+)"
OPEN_FILES = 64         # shard files that a task writes at once


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "synthweave-io", tag, uuid.uuid4().hex)


def _format_of(spark: SparkSession, path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in os.path.basename(path.rstrip("/")) else ""
    if ext in EXT_FORMAT:
        return EXT_FORMAT[ext]
    # a folder: take the format of the first data file Spark lists in it
    first = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path").where(~F.col("path").rlike(r"/[._][^/]*$")).limit(1).collect())
    if not first:
        raise FileNotFoundError(path)
    return EXT_FORMAT.get(first[0]["path"].rsplit(".", 1)[-1].lower(), "json")


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                 fmt: str | None = None, **options) -> DataFrame:
    """Read a file or folder; the reader follows the extension (``jsonl`` -> json)."""
    fmt = fmt or _format_of(spark, path)
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def scan_shards(spark: SparkSession, path: str, schema=None, fmt: str = "json") -> DataFrame:
    """All shard files of a folder with a numeric ``client_id`` from the file path.

    Numeric, so ``client10`` sorts after ``client2`` (the reference's
    lexicographic order is not reproduced).
    """
    df = read_dataset(spark, path, schema, fmt, recursiveFileLookup="true")
    return (df.withColumn("file_path", F.col("_metadata.file_path"))
            .withColumn("shard_id", F.regexp_extract("file_path", SHARD_RE, 1).try_cast("int")))


def array_files(spark: SparkSession, path: str) -> dict[str | None, list[str]]:
    """The indented JSON arrays of a folder by the indentation of their records.

    An indented array opens with ``[`` on a line of its own; its records open
    with ``{`` at the least indentation of such lines.  ``None``: arrays
    without an indented record (empty, of other values, or not indented).
    The result is bounded by the file listing that the driver holds anyway.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    pad = F.regexp_extract("value", r"^([ \t]+)\{", 1)
    rows = (lines.groupBy(F.col("_metadata.file_path").alias("p"))
            .agg(F.max(F.trim(F.regexp_replace("value", "[\r\ufeff]", "")) == "[").alias("opens"),
                 F.min_by(pad, F.when(pad != "", F.length(pad))).alias("pad"))
            .where("opens").collect())
    out: dict[str | None, list[str]] = {}
    for r in rows:
        out.setdefault(r["pad"], []).append(r["p"])
    return out


def array_records(spark: SparkSession, paths: list[str], pad: str) -> DataFrame:
    """``(value, file_path)``: the records of indented JSON arrays, as texts.

    A line break, the indentation and ``{`` open a record and occur nowhere
    else (strings hold no line breaks), so they serve as the line separator
    of the text source and Spark splits one file into as many tasks as its
    bytes ask for.  Records that open elsewhere follow another one in its
    piece and are told apart there.
    """
    text = spark.read.option("lineSep", f"\n{pad}{{").text(paths)
    body = F.concat(F.lit("{"), F.regexp_replace("value", r"[\s,\]]+$", ""))
    pieces = (text.select(body.alias("value"), F.col("_metadata.file_path").alias("file_path"))
              .where(~F.col("value").rlike("^\\{[\\s\ufeff]*\\[?$")))                     # what stands before the first record
    several = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")
    found = F.when(F.col("value").rlike(r"\}\s*,\s*\{"), several)
    return pieces.select(F.explode(F.coalesce(F.when(F.size(found) > 1, found), F.array("value"))).alias("value"), "file_path")


def scan_mixed_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON lines and JSON arrays in one folder.

    A line may hold one object or an array of objects (every element is a
    row); a file that opens with ``[`` on a line of its own is an indented
    array, read by as many tasks as its bytes ask for (:func:`array_records`;
    one without indented records is read whole by one task).  Malformed
    records are kept as ``_corrupt_record`` instead of being dropped
    silently, so a caller can count them; in an indented array the records
    around them are read.
    """
    arrays = array_files(spark, path)
    records = [array_records(spark, paths, pad) for pad, paths in sorted(arrays.items(), key=str) if pad]
    listed = [p for paths in arrays.values() for p in paths]
    whole = arrays.get(None, [])
    if schema is not None:
        schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    else:
        texts = spark.read.option("recursiveFileLookup", "true").text(path)
        texts = texts.where(~F.col("_metadata.file_path").isin(listed)) if listed else texts
        for r in records:
            texts = texts.select("value").union(r.select("value"))
        schema = spark.read.json(texts.rdd.map(lambda r: r[0])).schema
        if whole:
            known = set(schema.names)
            more = spark.read.option("multiLine", "true").json(whole).schema
            schema = T.StructType(schema.fields + [x for x in more.fields if x.name not in known])
        schema = T.StructType([x for x in schema.fields if x.name != "_corrupt_record"])
    schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    reader = spark.read.schema(schema).options(**options).option("recursiveFileLookup", "true")
    out = reader.json(path)
    if listed:
        out = out.where(~F.col("_metadata.file_path").isin(listed))
    for r in records:
        out = out.unionByName(r.select(F.from_json("value", schema, options).alias("r")).select("r.*"))
    return out.unionByName(reader.option("multiLine", "true").json(whole)) if whole else out


def write_json_arrays(df: DataFrame, path: str, indent: int = 4) -> None:
    """Every output file is one indented JSON array; rows stream through, one record ahead of the writer."""
    pad = " " * indent

    def to_lines(batches):
        last = None
        yield pd.DataFrame({"value": ["["]})
        for pdf in batches:
            rows = pdf["value"].tolist()
            if last is not None and rows:
                rows.insert(0, last)
            if rows:
                last = rows.pop()
                yield pd.DataFrame({"value": [f"{pad}{r}," for r in rows]}, dtype="object")
        yield pd.DataFrame({"value": [f"{pad}{last}", "]"] if last is not None else ["]"]})

    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    rows.mapInPandas(to_lines, "value string").write.mode("errorifexists").text(path)


def write_shards(df: DataFrame, path: str, by: str = "client_id", fmt: str = "json", mode: str = "errorifexists",
                 derived: dict[str, Column] | None = None, above: list[str] | None = None, **options) -> None:
    """One folder per shard value (``partitionBy``), written by as many tasks as its bytes ask for.

    Rows are dealt by shard, then rebalanced at run time by the bytes that
    the exchange has seen: a large shard is split into tasks of about
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, small shards share
    one, and no shard gets a file from every task.  ``derived`` columns are
    computed by the writers, past the exchange; those named ``above`` are
    folders above the shards.  ``options`` go to the writer.

    A task keeps up to ``OPEN_FILES`` shard files open and appends to them as
    rows come, so rows (and what ``derived`` makes of them) are not sorted by
    shard, which spills where a task's rows outgrow its memory; rows of
    further shards in the same task are sorted.
    """
    rows = df.hint("rebalance", F.col(f"`{by}`")).select("*", *[c.alias(n) for n, c in (derived or {}).items()])
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    unset = conf.get(name, "0") == "0"                                     # a number that the session names stays
    if unset:
        conf.set(name, str(OPEN_FILES))
    try:
        rows.write.mode(mode).options(**options).partitionBy(*(above or []), by).format(fmt).save(path)
    finally:
        if unset:
            conf.unset(name)


def write_once(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write, refusing to overwrite an existing output."""
    w = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# Dataset name -> (split, config) of the reference's source registry.
SOURCES = {
    "gsm8k": ("train", "main"),
    "lighteval/MATH": ("train", "all"),
    "HuggingFaceH4/ultrafeedback_binarized": ("train_sft", None),
    "FinGPT/fingpt-sentiment-train": ("train", None),
}


class SourceRegistry:
    """Dataset name -> (path, format, normaliser), with its splits and configurations.

    A dataset's folder may hold a folder per configuration, and that (or the
    dataset itself) a folder or a file per split.  ``load`` reads the split
    and configuration that it is asked for, by default those that the dataset
    is published with; a dataset without such parts is read whole.  Names
    become temp views.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root, self.entries, self.splits = spark, root, {}, {}

    def register(self, name: str, path: str, fmt: str | None = None, normaliser=None, view: str | None = None,
                 split: str | None = None, config: str | None = None):
        full = os.path.join(self.root, path) if self.root and "://" not in path and not path.startswith("/") else path
        self.entries[name] = (full, fmt, normaliser)
        own = SOURCES.get(name, ("train", None))
        self.splits[name] = (split or own[0], config or own[1])
        if view:
            self.load(name).createOrReplaceTempView(view)
        return self

    def _listed(self, path: str) -> dict[str, str]:
        """Names in a folder (without extension) and their paths, through Spark's own file system."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
            return {}
        names = [str(x.getPath().getName()) for x in fs.listStatus(at)]
        return {n.split(".")[0]: f"{path.rstrip('/')}/{n}" for n in sorted(names) if not n.startswith(("_", "."))}

    def path_of(self, name: str, split: str | None = None, config: str | None = None) -> str:
        """The file or folder of a split; asking for one by name that does not exist is an error."""
        if name not in self.entries:
            raise NotImplementedError(f"no dataset is registered as {name!r}")
        path = self.entries[name][0]
        for asked, usual in ((config, self.splits[name][1]), (split, self.splits[name][0])):
            found = self._listed(path).get(asked or usual) if asked or usual else None
            if asked and not found:
                raise FileNotFoundError(f"{name} has no {asked!r} in {path}")
            path = found or path
        return path

    def load(self, name: str, split: str | None = None, config: str | None = None) -> DataFrame:
        path = self.path_of(name, split, config)
        _, fmt, norm = self.entries[name]
        df = read_dataset(self.spark, path, fmt=fmt)
        return norm(df) if norm else df


def merge_replicates(spark: SparkSession, root: str, fmt: str = "json") -> DataFrame:
    """Bag union of every replicate folder under ``root``, keyed by shard file name.

    Each row keeps ``file_name`` (the shard it belongs to, e.g. ``client3.json``)
    and ``replicate`` (its folder); rows are normalised with P5.
    """
    from synthweave.operators.normalize import norm_generated
    df = read_dataset(spark, root, fmt=fmt, recursiveFileLookup="true")
    path = F.col("_metadata.file_path")
    out = (df.withColumn("file_name", F.concat(F.lit("client"), F.regexp_extract(path, SHARD_RE, 1), F.lit(".json")))
           .withColumn("replicate", F.regexp_extract(path, r"/rep=?(\d+)/", 1).try_cast("int")))
    return norm_generated(out)
