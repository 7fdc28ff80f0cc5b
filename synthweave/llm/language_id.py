"""Language identification of pages by Bayesian evidence fusion.

Four kinds of evidence are combined as log probabilities of each language:

* the text: naive Bayes over hashed byte trigrams, tempered because
  neighbouring trigrams repeat each other;
* the language that the markup declares and the suffix of the address: how
  often each value goes with each language over all pages (by text alone);
* the host: shares of languages among its other pages, smoothed towards its
  domain, the domain towards the suffix and the suffix towards all pages.

The trigram model is fitted on a bounded sample of labelled documents
(about ``TRAIN_DOCS`` rows, chosen by the hash of their ids; more only where
many rows share an id); every other count is a grouped aggregation over all
pages.  A page never counts towards its own prior.

Null or empty markup has no text evidence and is decided by the rest; a null
url has the empty host.  Repeated rows are judged alike.  An empty table of
pages gives an empty result; without labelled documents every page is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.llm.arrow_words import _large, _offsets, pieces, small_batches
from synthweave.llm.url_filter import host_and_path
from synthweave.session import materialize

TRAIN_DOCS = 8_000
BUCKETS = 1 << 14
TEMPER = 30.0          # a text speaks with the weight of so many trigrams at most
PRIOR_WEIGHT = 5.0     # pages that a parent's share counts for
# an element that is never closed reaches to the end, so no opening is searched for its end twice
_TAGS = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)


def _trigrams(buf: np.ndarray) -> np.ndarray:
    """Hash bucket of every byte trigram (letters lower-cased, digits and blanks as one blank)."""
    low = _FOLD[buf].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64)
    x = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0, 48), *range(48, 65)]] = 32


def fit_text_model(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                   docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigram buckets, from about ``docs`` hashed rows."""
    total = labelled.count()
    share = min(1.0, docs / max(total, 1))
    picked = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1_000_000)) < int(share * 1_000_000)
    rows = labelled.where(picked & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for piece in pieces(batches, "text"):
            texts = _large(piece.column(1))
            offs, data = _offsets(texts), texts.buffers()[2]
            for i, name in enumerate(piece.column(0).to_pylist()):
                part = np.frombuffer(data, np.uint8)[offs[i]:offs[i + 1]] if data is not None else np.zeros(0, np.uint8)
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                sums[name] += np.bincount(_trigrams(part), minlength=BUCKETS)
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counted})            # at most languages x BUCKETS rows
    table = np.ones((len(langs), BUCKETS))
    for r in counted:
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, langs: list[str], model: np.ndarray, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, host, domain, suffix, declared, loglik)`` of every page; ``loglik`` is tempered, one entry per language."""
    host = host_and_path(F.col(f"`{url}`"))[0]
    rows = small_batches(pages).select(F.col(f"`{key}`").alias("id"), host.alias("host"), F.col(f"`{html}`").alias("html"))
    sent = pages.sparkSession.sparkContext.broadcast(model)   # languages x BUCKETS doubles

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = sent.value
        for piece in pieces(batches, "html"):
            declared, rowsout = [], []
            for page in piece.column(2).to_pylist():
                tag = re.search(r"<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", page or "", re.I)
                declared.append(tag[1].lower() if tag else None)
                grams = _trigrams(np.frombuffer(_TAGS.sub(" ", page or "").encode(), np.uint8))
                weight = min(1.0, TEMPER / len(grams)) if len(grams) else 0.0
                rowsout.append((logp[:, grams].sum(axis=1) * weight).tolist())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(declared, pa.string()), pa.array(rowsout, pa.list_(pa.float64()))],
                ["id", "host", "declared", "loglik"])

    found = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, host string, declared string, loglik array<double>")
    parts = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    return found.select("id", "host", F.array_join(F.slice(F.reverse(F.slice(F.reverse(parts), 1, 2)), 1, 2), ".").alias("domain"),
                        F.element_at(parts, -1).alias("suffix"), "declared", "loglik")


def _argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _counts(votes: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """Votes for each language by group, as one array of ``n`` counts."""
    sums = [F.sum(F.when(F.col("vote") == i, 1).otherwise(0)).cast("double") for i in range(n)]
    return votes.groupBy(*by).agg(F.array(*sums).alias(name))


def identify(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(key, host, lang, probability, text_lang, declared)`` for every page."""
    langs, model = fit_text_model(labelled)
    n = len(langs)
    if not n:
        host = host_and_path(F.col(f"`{url}`"))[0]
        none = F.lit(None).cast("string")
        return pages.select(F.col(f"`{key}`"), host.alias("host"), none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"))
    rows = materialize(text_evidence(pages, langs, model, key, url, html)
                       .withColumn("vote", F.when(F.array_max("loglik") > F.array_min("loglik"), _argmax(F.col("loglik"))))
                       .withColumn("said", F.coalesce("declared", F.lit(""))))
    votes = rows.where("vote is not null")
    none = F.array(*[F.lit(0.0)] * n)
    out = rows
    for by, name in ((["host"], "c_host"), (["domain"], "c_domain"), (["suffix"], "c_suffix"), (["said"], "c_said")):
        counts = _counts(votes, by, n, name)
        out = out.join(counts, by, "left").withColumn(name, F.coalesce(name, none))
    whole = votes.groupBy().agg(F.array(*[F.sum(F.when(F.col("vote") == i, 1).otherwise(0)).cast("double") for i in range(n)]).alias("c_all"))
    whole = whole.select(F.coalesce("c_all", none).alias("c_all"))
    everything = whole.first()["c_all"]                        # one number per language
    everything = F.array(*[F.lit(float(x or 0)) for x in everything])
    at = lambda c, i: F.get(c if isinstance(c, Column) else F.col(c), F.lit(i))

    def own(i):
        return F.when(F.col("vote") == i, 1.0).otherwise(0.0)

    def size(c):
        total = sum((at(c, j) for j in range(n)), F.lit(0.0))
        return total - F.when(F.col("vote").isNull(), 0.0).otherwise(1.0)

    def smooth(c, parent, i):
        return (at(c, i) - own(i) + F.lit(PRIOR_WEIGHT) * parent) / (size(c) + PRIOR_WEIGHT)

    scores = []
    for i in range(n):
        base = (at(everything, i) - own(i) + 1.0) / (size(everything) + float(n))
        by_suffix = smooth("c_suffix", base, i)
        prior = smooth("c_host", smooth("c_domain", by_suffix, i), i)
        # P(declared = d | lang) up to a factor that all languages share: P(lang | d) / P(lang), smoothed
        said = F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(F.log(smooth("c_said", base, i)) - F.log(base))
        scores.append(F.log(prior) + said + at("loglik", i))
    out = out.withColumn("posterior", F.array(*scores))
    out = out.withColumn("top", F.array_max("posterior"))
    norm = F.aggregate("posterior", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in langs])
    return out.select(F.col("id").alias(key), "host", F.get(names, _argmax(F.col("posterior"))).alias("lang"),
                      (F.lit(1.0) / norm).alias("probability"), F.get(names, F.col("vote")).alias("text_lang"), "declared")
