"""Secret scans with corpus-wide ownership.

One pass over the whole texts finds candidate spans; the hashes of their
values are aggregated over the corpus by distinct repositories and owners.
A value that several owners hold is a widely copied example; a value of
fewer owners that looks random is a live credential.  Base kinds are always
reported; tokens of the wider kinds are added only where they are live.

Offsets are code points, ends exclusive.  A null or empty text has no spans.
Null owners and repositories count as one owner and one repository of their
own.  Repeated rows are scanned alike.  Empty tables give empty results.
Texts are scanned whole; the work grows with their length, also where one
holds thousands of tokens.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.llm.arrow_words import _large, _offsets, pieces, small_batches
from synthweave.session import materialize

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE = ("assign", "access", "hex")

# Wider kinds: provider prefixes, signed web tokens, and random-looking runs.
WIDER = {
    "provider": re.compile(r"(?:gh[posu]_|sk[-_]|pk[-_]|xox[abp]-)[A-Za-z0-9_-]{16,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "random": re.compile(r"[A-Za-z0-9+/_=-]{20,}"),
}
KINDS = (*BASE, *WIDER)
PREFIXED = ("provider", "jwt")      # named by a prefix: the entropy alone tells
EXAMPLE_OWNERS = 3      # a value held by as many owners is a copied example
MIN_ENTROPY = 3.5       # bits per character of a live-looking value

_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True
_SHORTEST_RUN = 19
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_SPAN = "array<struct<kind:string,start:int,end:int,hash:string,live:boolean>>"


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Digits, upper and lower case together, and a high entropy."""
    return (entropy(value) >= MIN_ENTROPY and any(c.isdigit() for c in value)
            and any(c.islower() for c in value) and any(c.isupper() for c in value))


def find_spans(text: str, runs: bool = True) -> list[tuple[str, int, int, str, bool]]:
    """Candidate spans ``(kind, start, end, value, looks live)`` of one text; ``runs``: it may hold long token runs."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                out.append(("assign", m.start(), m.end(), m[2], entropy(m[2]) >= 2.5))
    if not runs:
        return out
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0], True) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    for m in re.finditer(f"[0-9a-f]{{{LEAST['hex']},}}", text):
        out.append(("hex", m.start(), m.end(), m[0], entropy(m[0]) >= 3.0))
    taken = Taken((s, e) for _, s, e, _, _ in out)
    for kind, pattern in WIDER.items():
        for m in pattern.finditer(text):
            prefixed = kind in PREFIXED and not text[max(m.start() - 1, 0):m.start()].isalnum()      # not risk-, task-
            random = entropy(m[0]) >= MIN_ENTROPY if prefixed else looks_random(m[0])
            if random and taken.take(m.start(), m.end()):
                out.append((kind, m.start(), m.end(), m[0], True))
    return out


class Taken:
    """Disjoint stretches of a text, in order: the union of spans."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def take(self, start: int, end: int) -> bool:
        """Add a span if it overlaps none."""
        at = bisect.bisect_right(self.ends, start)
        if at < len(self.starts) and self.starts[at] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def _texts_with_runs(texts: pa.Array) -> np.ndarray:
    """Which texts hold a run of at least 19 token characters (every kind but ``assign`` needs one)."""
    texts = _large(texts)
    offs, data = _offsets(texts), texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _RUN[buf]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - start >= _SHORTEST_RUN
    mark = np.zeros(len(texts) + 1, np.int64)              # a run may cross a border of texts: it counts for each
    np.add.at(mark, np.searchsorted(offs, start[long], side="right") - 1, 1)
    np.add.at(mark, np.searchsorted(offs, end[long] - 1, side="right"), -1)
    return np.cumsum(mark)[:-1] > 0


def candidates(df: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    """Replace the text by ``out``: its candidate spans with the hash of each value."""
    kept = [c for c in df.columns if c not in (text, out)]
    rows = small_batches(df).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(text))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("live", pa.bool_())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            texts = piece.column(piece.schema.names.index(text))
            has = _texts_with_runs(texts)
            found = [[{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(), "live": live}
                      for k, s, e, v, live in find_spans(t, r)] if t else [] for t, r in zip(texts.to_pylist(), has)]
            yield pa.RecordBatch.from_arrays([*[piece.column(piece.schema.names.index(c)) for c in kept], pa.array(found, kind)], [*kept, out])

    schema = rows.drop(text).withColumn(out, F.lit(None).cast(_SPAN)).schema
    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame, owner: Column, repo: Column, spans: str = "found") -> DataFrame:
    """``(hash, owners, repos)`` for every candidate value: distinct holders over the corpus.

    Pairs are made distinct first (partial aggregates before each shuffle),
    so a value copied into a third of all rows arrives as one row per task.
    """
    one = found.select(F.explode(F.array_distinct(F.col(f"{spans}.hash"))).alias("hash"),
                       F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"))
    owners = one.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repos = one.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("repos"))
    return owners.join(repos, "hash")


def scan(df: DataFrame, key: str = "doc_id", owner: str = "source", repo: str | None = None, text: str = "text",
         example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per input row: its key and ``spans``, sorted by start, with ``owners``, ``repos`` and ``verdict``.

    ``verdict`` is ``example`` (held by ``example_owners`` or more), ``live``
    (fewer owners, looks random) or ``unclear``.  Base spans are all kept;
    those of the wider kinds only if live.  Without a repository column each
    key is a repository.
    """
    cols = list(dict.fromkeys([key, owner, *([repo] if repo else []), text]))
    found = materialize(candidates(df.select(*cols), text).withColumn("rid", F.monotonically_increasing_id()))
    stats = ownership(found, F.col(f"`{owner}`"), F.col(f"`{repo or key}`"))
    one = found.select("rid", F.explode("found").alias("s"), F.col("s.hash").alias("hash"))
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("s.live"), "live").otherwise("unclear")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("s.kind")).cast("int")
    told = (one.join(stats, "hash").withColumn("verdict", verdict)
            .where(F.col("s.kind").isin(*BASE) | (F.col("verdict") == "live"))
            .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(
                F.col("s.start").alias("start"), order.alias("rank"), F.col("s.end").alias("end"),
                F.col("s.kind").alias("kind"), "owners", "repos", "verdict"))).alias("spans")))
    none = F.array().cast(told.schema["spans"].dataType)
    return found.drop("found").join(told, "rid", "left").select(
        F.col(f"`{key}`"), "rid", F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column, kinds: tuple | None = None) -> Column:
    """``kind:start:end`` of the spans (of ``kinds`` only), joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: Iterable[tuple[int, int]], mask: str = "[secret]") -> str:
    """The text with the (sorted) spans masked, left to right; a span that begins inside an earlier one joins it."""
    parts, at = [], 0
    for start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(df: DataFrame, key: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """The rows with every span masked but those of widely copied examples; other columns as they were, whatever their names.

    Rows are matched by the hash of key and text, so null and repeated keys
    are safe (equal rows have equal spans).
    """
    col = lambda c: F.col(f"`{c}`")
    sid = F.md5(F.concat_ws("\u0000", F.coalesce(col(key).cast("string"), F.lit("")), F.coalesce(col(text), F.lit(""))))
    others = [c for c in df.columns if c != text]
    # fields by number: rows may have columns of any name
    tagged = df.select(F.struct(F.lit(0).alias("none"), *[col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), col(text).alias("text"),
                       col(key).alias("key"), col(owner).alias("owner"), sid.alias("sid"))
    found = scan(tagged.select("sid", "owner", "key", "text"), "sid", "owner", "key", "text")
    masks = (found.select("sid", F.transform(F.filter("spans", lambda s: s["verdict"] != "example"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
             .where(F.size("spans") > 0).dropDuplicates(["sid"]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            hit = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist()
            if hit:
                out, spans = texts.to_pylist(), batch.column(2)
                for i in hit:
                    out[i] = redact(out[i], [(s["start"], s["end"]) for s in spans[i].as_py()])
                texts = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "text"])

    rows = tagged.join(masks, "sid", "left").select("row", "text", "spans")
    masked = small_batches(rows).mapInArrow(run, rows.drop("spans").schema)
    return masked.select(*[F.col("text").alias(c) if c == text else F.col(f"row.c{others.index(c)}").alias(c) for c in df.columns])
