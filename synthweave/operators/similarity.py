"""Pairwise TF-IDF cosine (A1) and the similarity gate.

The vectoriser of the reference is fitted on just the two texts of a pair,
which has a closed form: token weight = count x idf, idf = 1 when the token
occurs in both texts and ``1 + ln 1.5`` when it occurs in one; rows are
L2-normalised.  A pair where neither text has a token is an error (NULL
here); a pair with one empty side scores 0.

:func:`tfidf_pair` runs as explode + two aggregations; :func:`pair_cosine` and
the gate bring the two texts of a pair into one row and count its tokens there,
so cost is linear in the tokens of the pairs and no token is shuffled.  Each
generation meets only its own exemplars: pairs are never widened to all-vs-all.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthweave.functions.batches import flat_list, token_slices
from synthweave.functions.templates import SIMILARITY_CUT
from synthweave.functions.text import word_tokens

IDF_ONE_SIDE = 1.0 + math.log(1.5)


def tfidf_pair(pairs: DataFrame, key: list[str], left: str = "text_a", right: str = "text_b",
               out: str = "sim") -> DataFrame:
    """Cosine of the two texts of each pair; one output row per input key."""
    # one pass over the pairs: both sides' tokens, tagged, in a single explode
    tagged = F.concat(F.transform(word_tokens(left), lambda t: F.struct(t.alias("tok"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
                      F.transform(word_tokens(right), lambda t: F.struct(t.alias("tok"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    sides = pairs.select(*key, F.explode(tagged).alias("_x"))
    per_token = sides.groupBy(*key, F.col("_x.tok").alias("_tok")).agg(F.sum("_x.a").alias("ca"), F.sum("_x.b").alias("cb"))
    both = (F.col("ca") > 0) & (F.col("cb") > 0)
    idf2 = F.when(both, F.lit(1.0)).otherwise(F.lit(IDF_ONE_SIDE * IDF_ONE_SIDE))
    agg = (per_token.groupBy(*key).agg(
        F.sum(F.when(both, F.col("ca") * F.col("cb")).otherwise(0)).cast("double").alias("_dot"),
        F.sum(F.col("ca") * F.col("ca") * idf2).alias("_na"),
        F.sum(F.col("cb") * F.col("cb") * idf2).alias("_nb")))
    sim = (F.when((F.col("_na") == 0) | (F.col("_nb") == 0), F.lit(0.0))
           .otherwise(F.col("_dot") / (F.sqrt("_na") * F.sqrt("_nb"))))
    scored = agg.select(*key, sim.alias(out))
    # pairs with no token at all produce no aggregate row -> NULL (error)
    return pairs.select(*key).join(scored, key, "left")


def _one_text(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """``(key, out, out_n)``: the texts of a key, a line each (repeated keys make one bag), and how many they are."""
    return df.groupBy(key).agg(F.concat_ws("\n", F.collect_list(text)).alias(out), F.count(F.lit(1)).alias(f"{out}_n"))


def bag_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _m, _sa, _sb, _dot, _qa, _qb)`` of rows ``(keys, _m, _a, _b)``, two texts each.

    Squared token counts of either text, products over the shared tokens, and
    the squares of those.  Tokens are counted for slices of Arrow batches by
    one sort and never leave their row.
    """
    names = ["_sa", "_sb", "_dot", "_qa", "_qb"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keys) + 1
        for batch in batches:
            for piece in token_slices(batch, [at, at + 1]):
                (va, ra), (vb, rb) = flat_list(piece.column(at)), flat_list(piece.column(at + 1))
                value, row = np.concatenate([va, vb]).astype(np.int64), np.concatenate([ra, rb])
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
                head = np.flatnonzero(new)
                left = np.cumsum(np.append(0, order < len(va)))
                ends = np.append(head[1:], len(row))
                ca = left[ends] - left[head] if len(head) else head
                cb = ends - head - ca if len(head) else head
                shared = (ca > 0) & (cb > 0)
                total = lambda x: pa.array(np.bincount(row[head], x, minlength=piece.num_rows).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(at)), total(ca * ca), total(cb * cb), total(ca * cb),
                                                  total(ca * ca * shared), total(cb * cb * shared)], [*keys, "_m", *names])

    own = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    hashes = lambda text: F.transform(word_tokens(text), lambda x: F.xxhash64(x))
    return (rows.select(*keys, F.col("_m").cast("bigint").alias("_m"), hashes("_a").alias("_a"), hashes("_b").alias("_b"))
            .mapInArrow(run, f"{own}, _m bigint, " + ", ".join(f"{n} bigint" for n in names)))


def _cosine(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``(keys, out)`` of rows ``(keys, _m, _a, _b)``; a pair that is listed ``_m`` times counts its shared tokens as often."""
    i2 = IDF_ONE_SIDE * IDF_ONE_SIDE
    na = F.col("_sa") * i2 - (i2 - 1) * (F.col("_qa") * F.col("_m"))
    nb = F.col("_sb") * i2 - (i2 - 1) * (F.col("_qb") * F.col("_m"))
    sim = (F.when((F.col("_sa") == 0) & (F.col("_sb") == 0), F.lit(None).cast("double"))
           .when((F.col("_sa") == 0) | (F.col("_sb") == 0), F.lit(0.0))
           .otherwise((F.col("_dot") * F.col("_m")).cast("double") / (F.sqrt(na) * F.sqrt(nb))))
    return bag_sums(rows, keys).select(*keys, sim.alias(out))


def pair_cosine(pairs: DataFrame, pair_key: list[str], left: DataFrame, lkey: str,
                right: DataFrame, rkey: str, text: str = "text", out: str = "sim") -> DataFrame:
    """A1 for many pairs over shared texts: ``pairs (pair_key..., lkey, rkey)``.

    The two texts meet in the pair's row, where their tokens are counted:
    no token is shuffled.  The norms come from per-text totals, corrected for
    the shared tokens (whose idf is 1 instead of ``1 + ln 1.5``):
    ``|a|^2 = i^2 * sum c_a^2 - (i^2 - 1) * sum_shared c_a^2``.
    """
    rows = (pairs.select(*pair_key, lkey, rkey, F.lit(1).alias("_m"))
            .join(_one_text(left, lkey, text, "_a"), lkey, "left").join(_one_text(right, rkey, text, "_b"), rkey, "left"))
    return _cosine(rows.select(*pair_key, "_m", "_a", "_b"), pair_key, out)


def similarity_gate(generations: DataFrame, exemplars: DataFrame, round_col: str = "round_id",
                    threshold: float = SIMILARITY_CUT) -> DataFrame:
    """per round, reject when the parsed instruction is too close to any exemplar.

    ``generations``: ``(round_id, instruction)``; ``exemplars``:
    ``(round_id, slot, row_id, instruction)``.  A round's few texts meet once,
    by round; nothing but texts is shuffled.  An error (empty vocabulary)
    rejects.  Output: ``(round_id, max_sim, similar)``.
    """
    gens = _one_text(generations.select(round_col, "instruction"), round_col, "instruction", "_a")
    slots = (exemplars.select(round_col, "slot", "instruction").repartition(round_col).groupBy(round_col, "slot")
             .agg(F.first("instruction").alias("_b"), F.count(F.lit(1)).alias("_b_n")))
    rows = slots.join(gens, round_col).select(round_col, "slot", (F.col("_a_n") * F.col("_b_n")).alias("_m"), "_a", "_b")
    sims = _cosine(rows, [round_col, "slot"], "sim")
    return (sims.groupBy(round_col)
            .agg(F.max(F.coalesce(F.col("sim"), F.lit(1.0))).alias("max_sim"))
            .withColumn("similar", F.col("max_sim") > threshold))
