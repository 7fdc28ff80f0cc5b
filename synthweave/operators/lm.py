"""Token-level scoring (L2-L6) with a model Spark can count: an add-one
smoothed bigram language model interpolated with an in-text cache model.

    loss(w | h) = -ln(0.5 (c(h, w) + 1) / (c(h) + V) + 0.5 (seen(w) + 1) / (pos + V))

``c`` are bigram / history counts over a training table and ``V`` its
vocabulary size.  The training table is tokenised once; its counts are
written once, bucketed by their join keys, so scoring shuffles places but
never the counts, and any number of jobs can read them.  A bigram that stands
several times in a key's texts travels once, with the list of its places, and
once more to its history's count.  Cache counts are row-local: the occurrence
number of every token in its text, counted over Arrow batches.  Losses stay in long form ``(row_id, pos,
loss)`` until a loss table (S10) is asked for.

IFD computed from this model is a different number from an LLM's; the
pipeline shape (spans, gates, ratio) is what carries over.  A user's model
takes its place through :class:`Scorer` (see ``operators.ifd``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.functions.batches import token_slices
from synthweave.functions.text import word_tokens
from synthweave.operators.ranking import global_row_number
from synthweave.session import bucketed, spread, stored

IGNORE = -100  # fixed value: label of masked positions
CACHE_WEIGHT = 0.5  # interpolation weight of the in-text cache model
_POS_BITS = 31      # a place in a text


def tokens(text) -> Column:
    """Model tokens of a text (lower-cased word tokens)."""
    return word_tokens(text)


def hashed(toks) -> Column:
    """Tokens as 64-bit hashes: shuffles and joins move longs, not strings."""
    return F.transform(toks, lambda x: F.xxhash64(x))


def _pairs(df: DataFrame, toks: str) -> DataFrame:
    """``(h, w)`` for every token and the one after it; ``w`` is null for a text's last."""
    # texts without tokens give an empty array here; a row filter on the token
    # count would be pushed into the scan and run the tokenizer twice
    pairs = F.expr(f"transform(filter(sequence(1, greatest(size(`{toks}`), 1)), i -> i <= size(`{toks}`)), "
                   f"i -> named_struct('h', `{toks}`[i - 1], 'w', get(`{toks}`, i)))")
    return (df.select(F.explode(pairs).alias("_b"))
            .select(F.col("_b.h").alias("h"), F.col("_b.w").alias("w")))


class BigramLM:
    """Counts of a training table over hashed tokens, each table written when first used.

    ``counts (h, w, c)`` holds every seen bigram and, with a null ``w``, the
    texts' last tokens, bucketed by ``(h, w)`` by the tasks that count.
    ``history (h, ch)`` has every token of the vocabulary and how often
    another one follows it.
    """

    def __init__(self, train: DataFrame, text: str = "text"):
        self._words = spread(train.select(F.col(text).alias("_text")), "_text").select(tokens("_text").alias("_w"))

    @cached_property
    def counts(self) -> DataFrame:
        rows = self._words.select(hashed("_w").alias("_t"))
        return bucketed(_pairs(rows, "_t").groupBy("h", "w").agg(F.count(F.lit(1)).alias("c")), "h", "w", deal=False)

    @cached_property
    def history(self) -> DataFrame:
        return stored(self.counts.groupBy("h").agg(F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col("c"))), F.lit(0)).alias("ch")))

    @property
    def vocab_size(self) -> Column:
        return self.history.where("h is not null").select(F.count(F.lit(1))).scalar()

    @cached_property
    def unigrams(self) -> DataFrame:
        return self._words.select(F.explode("_w").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))

    @cached_property
    def word_bigrams(self) -> DataFrame:
        """Word-level counts for samplers that emit words."""
        return _pairs(self._words, "_w").where("w is not null").groupBy("h", "w").agg(F.count(F.lit(1)).alias("c"))


def _places(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, ...]:
    """``row, pos, h, w, seen`` of the places ``first..last - 1`` (columns ``at + 1`` and ``at + 2``) of a batch's token arrays.

    ``seen`` is how often the token occurred before in its own text, counted
    for all rows by one sort; only the span's places come back.
    """
    t = batch.column(at)
    value, size = t.flatten().to_numpy(zero_copy_only=False), t.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), size)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    order = np.lexsort((value, row))                              # stable: equal tokens keep their order
    new = np.ones(len(row), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (value[order][1:] != value[order][:-1])
    head = np.flatnonzero(new)
    seen = np.empty(len(row), np.int64)
    seen[order] = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
    first, last = (batch.column(at + i).to_numpy(zero_copy_only=False) for i in (1, 2))
    mine = np.flatnonzero((pos >= np.maximum(first, 1)[row]) & (pos < last[row]))
    return row[mine], pos[mine], value[mine - 1], value[mine], seen[mine]


def seen_positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, pos, h, w, seen)`` for the places ``_first.._last - 1`` of every array of hashed tokens ``_t``; see :func:`_places`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in token_slices(batch, [len(keys)]):
                row, pos, h, w, seen = _places(piece, len(keys))
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(piece.column(i).take(of) for i in range(len(keys))), pa.array(pos.astype(np.int32)),
                                                  pa.array(h), pa.array(w), pa.array(seen)], [*keys, "pos", "h", "w", "seen"])

    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, "_t", "_first", "_last").mapInArrow(run, f"{own}, pos int, h bigint, w bigint, seen bigint")


def bigram_places(df: DataFrame, keys: list[str], texts: int) -> DataFrame:
    """``(keys, h, w, at)``: the places of :func:`seen_positions` in ``_t0``, ``_t1``, ... (``texts`` at most 2), one row for each bigram of a row.

    ``at`` lists where it stands: the text's number, ``pos`` and ``seen``
    packed into a long (:func:`unpacked`).  The bigrams that a row's texts
    share meet here, not in a shuffle.
    """
    n = len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in token_slices(batch, [n + 3 * i for i in range(texts)]):
                found = [_places(piece, n + 3 * i) for i in range(texts)]
                row, h, w = (np.concatenate([x[j] for x in found]) for j in (0, 2, 3))
                packed = np.concatenate([(((i << _POS_BITS) | pos) << _POS_BITS) | seen for i, (_, pos, _, _, seen) in enumerate(found)])
                order = np.lexsort((w, h, row))
                new = np.zeros(len(order), bool)
                new[:1] = True
                for x in (row[order], h[order], w[order]):
                    new[1:] |= x[1:] != x[:-1]
                head = np.flatnonzero(new)
                of = pa.array(row[order[head]])
                at = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)).astype(np.int32)), pa.array(packed[order]))
                yield pa.RecordBatch.from_arrays([*(piece.column(i).take(of) for i in range(n)), pa.array(h[order[head]]), pa.array(w[order[head]]), at], [*keys, "h", "w", "at"])

    own = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    spans = [f"{c}{i}" for i in range(texts) for c in ("_t", "_first", "_last")]
    return df.select(*keys, *spans).mapInArrow(run, f"{own}, h bigint, w bigint, at array<bigint>")


def unpacked(at: str) -> list[Column]:
    """``text``, ``pos`` and ``seen`` of a packed place."""
    low = (1 << _POS_BITS) - 1
    return [F.shiftright(at, 2 * _POS_BITS).cast("int").alias("text"), F.shiftright(at, _POS_BITS).bitwiseAND(low).cast("int").alias("pos"),
            F.col(at).bitwiseAND(low).alias("seen")]


def place_losses(rows: DataFrame, lm: BigramLM, keys: list[str], texts: int) -> DataFrame:
    """``(keys, text, pos, loss)`` of the places that :func:`bigram_places` finds in ``rows``."""
    v = lm.vocab_size.cast("double")
    # the count tables grow with the training corpus: merged, never broadcast
    # (a compressed size can look small while the hash table is not)
    looked = bigram_places(rows, keys, texts).join(lm.counts.hint("merge"), ["h", "w"], "left").select(*keys, "h", "c", "at")
    scored = (looked.join(lm.history.hint("merge"), "h", "left").select(*keys, "c", "ch", F.explode("at").alias("_at"))
              .select(*keys, "c", "ch", *unpacked("_at")))
    p_bi = (F.coalesce("c", F.lit(0)) + 1.0) / (F.coalesce("ch", F.lit(0)) + v)
    p_cache = (F.col("seen") + 1.0) / (F.col("pos") + v)
    return scored.select(*keys, "text", "pos", (-F.log(CACHE_WEIGHT * p_cache + (1 - CACHE_WEIGHT) * p_bi)).alias("loss"))


def token_losses(df: DataFrame, lm: BigramLM, key="row_id", text: str = "text",
                 max_length: int | None = None) -> DataFrame:
    """L2: per-token losses ``(key, pos, loss)`` for positions 1..n-1 (n = truncated length).

    ``p = lambda * p_bigram(w | h) + (1 - lambda) * p_cache(w)`` where the
    cache part counts ``w`` among the earlier tokens of the same text (a cache
    language model): context such as an instruction lowers the loss of the
    answer tokens it shares words with.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.select(*keys, hashed(tokens(text) if max_length is None else F.slice(tokens(text), 1, max_length)).alias("_t0"))
    return place_losses(rows.select(*keys, "_t0", F.lit(1).alias("_first0"), F.size("_t0").alias("_last0")), lm, keys, 1).drop("text")


class Scorer(Protocol):
    """A user's model, built once per task by a factory that loads it there."""

    def lengths(self, texts: pd.Series) -> pd.Series:
        """Number of tokens of every text."""

    def losses(self, texts: pd.Series, limits: pd.Series) -> pd.Series:
        """For every text, cut to ``limits`` tokens: the losses of its tokens but the first, as lists."""


def perplexity(losses: DataFrame, key: str = "row_id") -> DataFrame:
    """L3: ``exp(mean loss)`` per row."""
    return losses.groupBy(key).agg(F.exp(F.avg("loss")).alias("ppl"))


def last_index_sql(text: str, target: str) -> str:
    """SQL for Python ``text.rfind(target)`` over two column names (0-based;
    ``len(text)`` for an empty target, -1 when absent)."""
    t, s = f"`{text}`", f"`{target}`"
    return (f"CASE WHEN length({s}) = 0 THEN length({t}) WHEN locate(reverse({s}), reverse({t})) = 0 THEN -1 "
            f"ELSE length({t}) - locate(reverse({s}), reverse({t})) - length({s}) + 1 END")


def last_index(text: str, target: str) -> Column:
    return F.expr(last_index_sql(text, target))


def answer_loss(df: DataFrame, lm: BigramLM, key: str, text: str, answer: str,
                max_length: int | None = None) -> DataFrame:
    """L4: mean loss of the answer span (last occurrence of the answer), earlier tokens masked."""
    base = df.select(key, F.col(text).alias("_sw_text"), F.col(answer).alias("_sw_ans"))
    base = base.withColumn("_sw_idx", last_index("_sw_text", "_sw_ans"))
    base = base.withColumn("start", F.size(tokens(F.expr("substring(_sw_text, 1, greatest(_sw_idx, 0))"))))
    losses = token_losses(base.withColumnRenamed("_sw_text", "text"), lm, key, "text", max_length)
    return (losses.join(base.select(key, "start"), key)
            .where(F.col("pos") >= F.col("start"))
            .groupBy(key).agg(F.avg("loss").alias("answer_loss"), F.count(F.lit(1)).alias("n_answer_tokens")))


def vocab(lm: BigramLM) -> DataFrame:
    """Token ids by frequency rank (count desc, token asc), 0-based, distributed rank."""
    return (global_row_number(lm.unigrams.withColumn("_neg", -F.col("cnt")), ["_neg", "token"], "id")
            .select("token", (F.col("id") - 1).alias("id")))


def tokenize_truncate(df: DataFrame, voc: DataFrame, key: str = "row_id", text: str = "text",
                      seq_length: int = 512) -> DataFrame:
    """``(key, pos, input_id, label)`` of the first ``seq_length`` tokens; labels copy ids.

    Unknown tokens get id -1.  The vocabulary joins on the token with a
    shuffle (sort-merge) join: it grows with the corpus.
    """
    pos = (df.select(key, F.posexplode(F.slice(tokens(text), 1, seq_length)).alias("pos", "token")))
    ids = (pos.join(voc.hint("merge"), "token", "left")   # the vocabulary grows with the corpus
           .select(key, "pos", F.coalesce("id", F.lit(-1)).cast("bigint").alias("input_id")))
    return ids.withColumn("label", F.col("input_id"))


def completion_mask(df: DataFrame, voc: DataFrame, marker: str, key: str = "row_id", text: str = "text",
                    seq_length: int = 512) -> DataFrame:
    """Labels are ``-100`` up to and including the response marker's tokens."""
    start = F.size(tokens(F.when(F.instr(text, marker) > 0,
                                 F.expr(f"substring(`{text}`, 1, instr(`{text}`, '{marker_sql(marker)}') + {len(marker) - 1})"))
                          .otherwise(F.col(text))))
    marked = df.select(key, text, start.alias("_start"))
    ids = tokenize_truncate(marked, voc, key, text, seq_length)
    return (ids.join(marked.select(key, "_start"), key)
            .withColumn("label", F.when(F.col("pos") < F.col("_start"), F.lit(IGNORE).cast("bigint"))
                        .otherwise(F.col("input_id")))
            .drop("_start"))


def marker_sql(marker: str) -> str:
    return marker.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
