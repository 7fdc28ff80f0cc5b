"""Near-duplicate classes by improved consistent weighted sampling.

A text is a weighted set of five-word shingles, weight = term frequency x a
smooth inverse document frequency.  Each of ``SAMPLES`` hash functions draws
one (shingle, level) pair so that two texts draw the same pair with a
probability equal to their weighted Jaccard similarity (improved consistent
weighted sampling).  Samples are banded; texts that share a band are compared
exactly, and pairs of similarity ``THRESHOLD`` or more are links.  Classes
are the connected components of the links.

No bucket is expanded into all pairs.  Each bucket elects a head, the text
that shares most buckets with most others (in a group of copies of one
original that is the original or its closest copy), and every member is
compared with it.  Members of the head's component then leave the bucket;
the rest elect a head of their own, round by round, until a round adds no
link anywhere.  After the first round only members, texts and components that
the round concerns are read or joined.  A round costs one comparison per member, so
thousands of copies cost thousands of comparisons.

Rounds only thin the work out.  The texts of every bucket that then still
holds two components or more are searched once again, exactly: by a weighted
prefix filter on their rarest shingles (``prefixes``, ``crossing_pairs``),
which drops no link between two components, and the check of one-bit samples
that the rounds use, too (``MOST_UNLIKE_BITS``).

Document frequencies are summed over all documents in ``2 ** DF_BITS`` hash
buckets -- a fixed size, so the table can be broadcast; shingles that share
a bucket share a frequency.  Texts are identified by a 64-bit hash (equal
texts are one node).  Texts of fewer than five words are one shingle; null
texts and texts without words are each a class of their own.  Repeated rows
share a class; null ids are allowed; an empty table gives an empty result.
Texts are worked on whole, one at a time if long; columns but key and text
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.llm.arrow_words import Words, mix, packed_pieces, packed_texts, pieces, rolling, small_batches, unpack, word_hashes, words
from synthweave.session import stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
DF_BITS = 18
IDF_STRENGTH = 0.5      # weights run from 1 (in every document) to 1.5 (in one)
MOST_UNLIKE_BITS = 22   # of SAMPLES one-bit samples; a pair at 0.8 differs in 6.4 on average (deviation 2.4)
SLACK = 1e-7            # of bounds on sums of weights, for rounding
LIST_PART = 1000        # entries of one shingle that a task pairs with the whole list
_U = np.uint64
_TABLE_BITS = 16


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a run of texts: text number, hash and frequency, sorted by text, then hash."""
    h = word_hashes(w)
    grams = rolling(h, size)
    at = np.arange(len(grams))
    whole = at + size <= w.doc_end[:len(grams)]
    doc, value = [w.doc[:len(grams)][whole]], [grams[whole]]
    for n in range(1, size):                              # texts shorter than a shingle
        short = np.flatnonzero(w.counts == n)
        if len(short):
            doc.append(short)
            value.append(rolling(h, n)[w.first[short]])
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return doc[first], value[first], np.diff(np.append(first, len(doc)))


def document_frequencies(df: DataFrame, text: str = "text", bits: int = DF_BITS) -> tuple[np.ndarray, int]:
    """How many documents hold a shingle of each hash bucket, and the number of documents with words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, docs = np.zeros(1 << bits, np.int64), 0
        for piece in pieces(batches, text):
            w = words(piece.column(0))
            _, value, _ = shingles(w)
            sums += np.bincount((value >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
            docs += int((w.counts > 0).sum())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(sums[at], docs), pa.int64())], ["bucket", "n"])

    rows = (df.select(F.col(f"`{text}`").alias(text)).mapInArrow(count, "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())      # at most 2 ** bits + 1 rows
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    table = np.zeros(1 << bits, np.int64)
    table[bucket[bucket >= 0]] = n[bucket >= 0]
    return table, int(n[bucket < 0].sum())


class Weights:
    """Shingle weights under one table of document frequencies."""

    def __init__(self, table: np.ndarray, docs: int, strength: float = IDF_STRENGTH):
        self.shift = _U(64 - int(math.log2(len(table))))
        rare = np.log((docs + 1) / (np.minimum(table, docs) + 1.0))
        self.idf = 1.0 + strength * rare / max(math.log(docs + 1), 1e-9)

    def of(self, value: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.idf[(value >> self.shift).astype(np.int64)]


class Sampler:
    """Consistent weighted samples; gamma and uniform variates come from a seeded table indexed by hash bits."""

    def __init__(self, samples: int = SAMPLES, seed: int = 99):
        rng = np.random.default_rng(seed)
        n = 1 << _TABLE_BITS
        r = rng.gamma(2.0, 1.0, n)
        self.r, self.per_r = r.astype(np.float32), (1.0 / r).astype(np.float32)
        self.beta = rng.random(n).astype(np.float32)
        self.ln_c = (np.log(rng.gamma(2.0, 1.0, n)) + 256.0).astype(np.float32)   # kept positive: bits then sort as values
        self.salts = rng.integers(0, 1 << 63, samples, dtype=np.uint64) | _U(1)

    def draw(self, value: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each sample and each text (shingles ``first[i]`` on): 32 bits naming the drawn (shingle, level)."""
        ln_w = np.log(weight).astype(np.float32)
        out = np.empty((len(self.salts), len(first)), np.uint32)
        for j, salt in enumerate(self.salts):
            spread = value * salt
            at = (spread >> _U(64 - _TABLE_BITS)).astype(np.int64)
            r, beta = self.r[at], self.beta[at]
            level = np.floor(ln_w * self.per_r[at] + beta)
            ln_a = self.ln_c[at] - r * (level - beta + np.float32(1))
            name = ((spread >> _U(16)) ^ (level.astype(np.int64).astype(np.uint64) * _U(0x9E3779B1))).astype(np.uint32)
            key = (np.maximum(ln_a, 0).view(np.uint32).astype(np.uint64) << _U(32)) | name
            out[j] = np.minimum.reduceat(key, first).astype(np.uint32)
        return out


def signatures(df: DataFrame, table: np.ndarray, docs: int, text: str = "text") -> DataFrame:
    """Replace the text by ``bands`` (one hash per band), ``bits`` (one bit per sample) and ``weight``; null bands without words."""
    sent = df.sparkSession.sparkContext.broadcast((table, docs))          # 2 ** DF_BITS counts
    kept = [c for c in df.columns if c != text]

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sampler = Weights(*sent.value), Sampler()
        for piece in pieces(batches, text):
            w = words(piece.column(piece.schema.names.index(text)))
            n = piece.num_rows
            doc, value, tf = shingles(w)
            weight = weights.of(value, tf)
            have, first = np.unique(doc, return_index=True)
            bands, bits, total = np.zeros((n, BANDS), np.int64), np.zeros(n, np.int64), np.zeros(n)
            if len(have):
                drawn = sampler.draw(value, weight, first)
                for b in range(BANDS):
                    h = np.full(len(have), b + 1, np.uint64)
                    for x in drawn[b * ROWS:(b + 1) * ROWS]:
                        h = mix(h ^ x.astype(np.uint64)) + x
                    bands[have, b] = h.view(np.int64)
                one = np.zeros(len(have), np.uint64)
                for j, x in enumerate(drawn):
                    one |= (mix(x.astype(np.uint64)) & _U(1)) << _U(j)
                bits[have] = one.view(np.int64)
                total[have] = np.add.reduceat(weight, first)
            has = w.counts > 0
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32), pa.array(bands[has].ravel()))
            yield pa.RecordBatch.from_arrays([*[piece.column(piece.schema.names.index(c)) for c in kept], lists, pa.array(bits), pa.array(total)],
                                             [*kept, "bands", "bits", "weight"])

    schema = (df.drop(text).withColumn("bands", F.lit(None).cast("array<bigint>"))
              .withColumn("bits", F.lit(None).cast("bigint")).withColumn("weight", F.lit(None).cast("double")).schema)
    return df.mapInArrow(sign, schema)


def similar_pairs(pairs: DataFrame, texts: DataFrame, table: np.ndarray, docs: int, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b, similarity)`` for the pairs (texts packed by node) whose exact weighted Jaccard similarity reaches the threshold."""
    sent = texts.sparkSession.sparkContext.broadcast((table, docs))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*sent.value)
        for piece in packed_pieces(batches, "text_a", "text_b"):
            sides = []
            for name in ("text_a", "text_b"):
                doc, value, tf = shingles(words(unpack(piece.column(piece.schema.names.index(name)))))
                sides.append((doc, value, weights.of(value, tf)))
            doc, value, weight = (np.concatenate(x) for x in zip(*sides))
            order = np.lexsort((value, doc))
            doc, value, weight = doc[order], value[order], weight[order]
            both = np.flatnonzero((doc[1:] == doc[:-1]) & (value[1:] == value[:-1]))
            n = piece.num_rows
            shared = np.bincount(doc[both], weights=np.minimum(weight[both], weight[both + 1]), minlength=n)
            total = np.bincount(doc, weights=weight, minlength=n)
            like = shared / np.maximum(total - shared, 1e-12)
            hit = pa.array(like >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([piece.column(0).filter(hit), piece.column(1).filter(hit), pa.array(like).filter(hit)], ["a", "b", "similarity"])

    left, right = texts.select(F.col("node").alias("a"), F.col("packed").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("packed").alias("text_b"))
    # packed texts look small to the planner: merged at every size, never broadcast
    return pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a bigint, b bigint, similarity double")


def prefixes(active: DataFrame, table: np.ndarray, docs: int, threshold: float = THRESHOLD) -> DataFrame:
    """``(shingle, node, component, bits, weight, rest)`` for the rarest shingles of ``(node, component, bits, packed)``.

    Shingles are ordered by document frequency, then hash; ``rest`` is the
    text's weight from the shingle on.  Two texts share at most the ``rest``
    of their first common shingle, and must share ``threshold`` times the
    heavier one's weight, so later shingles are left out.
    """
    sent = active.sparkSession.sparkContext.broadcast((table, docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*sent.value)
        for piece in packed_pieces(batches, "packed"):
            doc, value, tf = shingles(words(unpack(piece.column(3))))
            weight = weights.of(value, tf)
            total = np.bincount(doc, weights=weight, minlength=piece.num_rows)
            order = np.lexsort((value, sent.value[0][(value >> weights.shift).astype(np.int64)], doc))
            doc, value, weight = doc[order], value[order], weight[order]
            before = np.cumsum(weight) - weight
            first = np.searchsorted(doc, np.arange(piece.num_rows))
            rest = total[doc] - (before - before[first[doc]])
            keep = rest >= total[doc] * threshold * (1 - SLACK)
            of = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), *(piece.column(i).take(of) for i in range(3)),
                                              pa.array(total[doc[keep]]), pa.array(rest[keep])], ["shingle", "node", "component", "bits", "weight", "rest"])

    return (active.select("node", "component", "bits", "packed")
            .mapInArrow(run, "shingle bigint, node bigint, component bigint, bits bigint, weight double, rest double"))


def crossing_pairs(entries: DataFrame, threshold: float = THRESHOLD, group: int = LIST_PART) -> DataFrame:
    """``(a, b, component_a, component_b)``: all pairs from two components that may reach the threshold.

    A pair needs ``threshold / (1 + threshold)`` of both weights together in
    common, and so as much ``rest`` at its first common shingle, on either
    side: the lighter text within its first ninth (at 0.8), the heavier within
    its first fifth.  Texts of one component are never paired: a shingle's
    list is joined as one row for each component, scale of weight and part of
    the list, and the parts of long lists are spread over tasks.  The bits are
    checked as in the rounds.
    """
    most = F.col("rest") * ((1 + threshold) / threshold * (1 + SLACK)) - F.col("weight")      # of the other text's weight
    light = F.max(F.col("most") >= F.col("weight"))
    scale = F.floor(F.log("weight") / (math.log(1 / threshold) * (1 + 1e-3))).cast("int")     # a pair's differ by one at most
    entries = entries.withColumn("most", most)
    lists = (entries.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), light.alias("light"), F.count(F.lit(1)).alias("n"))
             .where("low <> high and light").select("shingle", F.ceil(F.col("n") / group).cast("int").alias("parts")))
    rows = (entries.join(lists, "shingle").withColumns({"part": F.expr("cast(pmod(xxhash64(node), parts) as int)"), "scale": scale})
            .groupBy("shingle", "part", "scale", "component").agg(F.first("parts").alias("parts"), light.alias("light"),
                                                                  F.collect_list(F.struct("weight", "node", "most", "bits")).alias("texts")))
    rows = stored(rows)
    one = rows.where("light").select("shingle", "part", "scale", F.col("component").alias("c"),
                                     F.filter("texts", lambda t: t["most"] >= t["weight"]).alias("lighter"))
    other = (rows.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "scale", F.col("component").alias("d"), F.col("texts").alias("heavier"))
             .select("shingle", "part", F.explode(F.array("scale", F.col("scale") - 1)).alias("scale"), "d", "heavier"))

    def may_be_like(x: Column, y: Column) -> Column:
        order = (x["weight"] < y["weight"]) | ((x["weight"] == y["weight"]) & (x["node"] < y["node"]))
        return order & (y["weight"] <= x["most"]) & (x["weight"] <= y["most"]) & (F.bit_count(x["bits"].bitwiseXOR(y["bits"])) <= MOST_UNLIKE_BITS)

    met = (one.hint("merge").join(other, ["shingle", "part", "scale"]).where("c <> d")
           .select("c", "d", F.explode(F.flatten(F.transform("lighter", lambda x: F.transform(
               F.filter("heavier", lambda y: may_be_like(x, y)), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("pair"))
           .select("c", "d", "pair.x", "pair.y"))
    first = F.col("x.node") < F.col("y.node")
    return (met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
                       F.when(first, F.col("c")).otherwise(F.col("d")).alias("component_a"), F.when(first, F.col("d")).otherwise(F.col("c")).alias("component_b"))
            .dropDuplicates(["a", "b"]))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every linked node: the least node that it reaches.

    Each round takes the least label among neighbours, then jumps to the
    label's own label, so long chains shrink geometrically.  Rounds are cut
    by stored tables and end when no label changes.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = stored(step.join(up, "component").select("node", "old", F.least("component", "up").alias("component")))
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels


def relabelled(df: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """``df`` with the components of ``column`` replaced where ``moved`` (old as ``node``, new as ``component``) has them."""
    to = moved.select(F.col("node").alias(column), F.col("component").alias("moved_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("moved_to", column)).drop("moved_to")


def with_links(found: DataFrame, pairs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` with the components of linked pairs joined, and the components that moved."""
    merged = pairs.join(links.select("a", "b"), ["a", "b"]).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    moved = components(merged)                                            # of old components
    return stored(relabelled(found, "component", moved).unionByName(moved.join(found, "node", "left_anti"))), moved


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, node, class_id, class_size, kept)`` of every row.

    ``class_id`` is the least key of the class (null where all keys are);
    ``kept`` marks the row that represents the class, and rows equal to it in
    key and text.  ``node`` is the hash of the row's text.
    """
    base = small_batches(df).select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("node"), F.col(f"`{text}`").alias("text"))
    table, docs = document_frequencies(base)
    rows = stored(signatures(base, table, docs))
    nodes = rows.where(F.size("bands") > 0).groupBy("node").agg(*[F.first(c).alias(c) for c in ("bands", "bits", "weight")])
    members = nodes.select(F.explode("bands").alias("bucket"), "node", "bits", "weight")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = members.join(sizes, "bucket")
    shared = crowded.groupBy("node").agg(F.sum("n").alias("score"))
    left = stored(crowded.drop("n").join(shared, "node").withColumn("component", F.col("node")))      # members of buckets with company
    texts = stored(packed_texts(base, left.select("node").distinct()))
    met = left.select("bucket", "node", "bits")

    ratio = F.least("weight", "head.weight") >= threshold * F.greatest("weight", "head.weight") * (1 - 1e-9)
    may_be_like = ratio & (F.bit_count(F.col("bits").bitwiseXOR(F.col("head.bits"))) <= MOST_UNLIKE_BITS)
    side = lambda pick: pick(F.struct("node", "component"), F.struct("head.node", F.col("head_component").alias("component")))
    found = df.sparkSession.createDataFrame([], "node bigint, component bigint")
    compared = None
    while True:
        heads = (left.groupBy("bucket").agg(F.max(F.struct("score", "node", "bits", "weight", "component")).alias("head"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").select("bucket", "head", F.col("head.component").alias("head_component")))
        led = stored(left.join(heads, "bucket").where("component <> head_component"))
        pairs = (led.where(may_be_like).select(side(F.least).alias("x"), side(F.greatest).alias("y"))
                 .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.component").alias("component_a"), F.col("y.component").alias("component_b"))
                 .dropDuplicates(["a", "b"]))
        pairs = stored(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        if compared is not None:                                          # a few texts only, after the first round
            nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
            near = stored(texts.join(nodes, "node", "left_semi"))
        else:
            near = texts
        links = stored(similar_pairs(pairs, near, table, docs, threshold))
        if links.isEmpty():
            break
        found, moved = with_links(found, pairs, links)
        compared = pairs.select("a", "b") if compared is None else compared.union(pairs.select("a", "b"))
        left = stored(relabelled(relabelled(led, "component", moved), "head_component", moved).where("component <> head_component")
                      .select("bucket", "node", "bits", "weight", "score", "component"))
    # every pair that shares a bucket and is not in one component by now: searched exactly
    met = met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = met.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    active = stored(met.join(mixed, "bucket").select("node", "component", "bits").distinct())
    entries = stored(prefixes(texts.join(active, "node"), table, docs, threshold))
    pairs = stored(crossing_pairs(entries, threshold))
    if not pairs.isEmpty():
        links = stored(similar_pairs(pairs, texts, table, docs, threshold))
        if not links.isEmpty():
            found, _ = with_links(found, pairs, links)
    tagged = (rows.select("id", "node", (F.col("weight") > 0).alias("has_words")).join(found, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    classes = (tagged.where("has_words").groupBy("component")
               .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best"), F.count(F.lit(1)).cast("bigint").alias("class_size")))
    alone = ~F.col("has_words")
    return (tagged.join(classes, "component", "left").select(
        F.col("id").alias(key), "node",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
        (alone | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node")))).alias("kept")))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with one of each class left; all columns kept, whatever their names.

    Rows equal in key and text are one row; texts without words all stay.
    """
    ident = F.struct(F.col(f"`{key}`").alias("key"))                       # null ids are equal inside a struct
    classes = (near_duplicates(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "key", "text").where("kept")
               .select(F.col("node").alias("own"), F.struct("key").alias("ident")))
    worded = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    tagged = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(F.col(f"`{text}`")).alias("own"), ident.alias("ident"), worded.alias("worded"))
    # grouped as joined: texts are shuffled once
    once = tagged.where("worded").join(classes, ["own", "ident"], "left_semi").dropDuplicates(["own", "ident"])
    return once.select("row.*").unionByName(tagged.where(~F.col("worded")).select("row.*"))
