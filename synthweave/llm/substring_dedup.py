"""Exact substring dedup with prefix-partitioned suffix trees.

Every run of ``window`` words that starts at two or more places of the corpus
is repeated; the words that repeated runs cover are removed.  Windows are
judged on the input, so removal never changes a verdict.

Suffixes are grouped by a prefix and each group is sorted into a subtree on
its own.  Neighbours' common prefixes give the subtree's internal nodes; a
leaf's deepest node, if it is as deep as the window, is the longest repeat
that starts there, and those that no repeat to the left takes in are the
maximal repeats.  Three things keep this small:

* Sparse suffixes.  Of the ``GRAM``-word runs inside a window the one with
  the least hash (the leftmost of equals) is the window's anchor.  Equal
  windows have equal anchors at equal offsets, so windows that share an
  anchor travel together as one row, keyed by the anchor's words: the prefix.
* Prefixes that occur once are dropped before any words are sent: no window
  around them can be repeated.
* Equal rows of a large prefix.  Where a prefix has more than ``GROUP`` rows,
  rows with the same words are one row found several times: all their windows
  are repeated, and one of them stands for the others in what follows.
* Variable-length prefixes.  The suffixes of a prefix with more than
  ``GROUP`` different rows are told apart by longer and longer beginnings
  (``LEVELS`` steps up to the window) until each group fits; only suffixes of
  a beginning that is still too large take the next step, and beginnings that
  occur once are dropped on the way.  A group that is still too large at full
  length holds equal windows only: it is one node, and its leaves need no
  subtree.

A row holds the words around one anchor, so a repeat longer than those is
traced by several rows; its places overlap and are joined at the removal.

Words travel as 32-bit hashes in subtrees and texts are identified by a
64-bit hash; equal texts are one text found several times.  A null or empty
text has no words.  Repeated rows repeat each other's windows.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthweave.llm.arrow_words import (Words, joined_words, mix, packed_pieces, packed_texts, pieces, rolling, sliding_argmin, small_batches, unpack,
                                        word_hashes, words)
from synthweave.session import materialize

WINDOW = 35
GRAM = 12
GROUP = 4_096           # suffixes of a prefix that one subtree takes
LEVELS = 4              # lengths, up to the window, that a larger prefix is split at
_PART_ROWS = 4_096      # anchors sorted together in a task, unless one group holds more
_U = np.uint64


def anchors(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of a run of texts.

    Returns for each anchor its word position, prefix hash, first window and
    number of windows (consecutive by construction), and all word hashes.
    """
    h = word_hashes(w)
    grams = rolling(h, gram)
    at = sliding_argmin(grams, window - gram + 1)
    start = np.flatnonzero(np.arange(len(at)) + window <= w.doc_end[:len(at)])
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, h
    anchor = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return anchor[first], grams[anchor[first]], start[first], np.diff(np.append(first, len(start))), h


def _tally(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each text's equal keys, and how many there are."""
    order = np.lexsort((key, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def prefix_counts(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``(prefix, node, n)``: how often each text holds each anchor prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w = words(piece.column(1))
            at, prefix, _, _, _ = anchors(w, window, gram)
            doc = np.searchsorted(w.first, at, side="right") - 1
            pick, n = _tally(doc, prefix)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix[pick].view(np.int64)), piece.column(0).take(pa.array(doc[pick])), pa.array(n, pa.int64())], ["prefix", "node", "n"])

    return texts.mapInArrow(run, "prefix bigint, node bigint, n bigint")


def _marked(known: pa.Array, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``hashes`` (of text ``doc``) are among their text's listed ones, and at which place of the flat list."""
    owner = np.repeat(np.arange(len(known)), known.value_lengths().to_numpy(zero_copy_only=False))
    flat = known.flatten()
    flat = (flat.field("key") if pa.types.is_struct(flat.type) else flat).to_numpy(zero_copy_only=False)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = mix(flat.view(np.uint64) ^ mix(owner.astype(np.uint64)))
    order = np.argsort(marks)
    mine = mix(hashes ^ mix(doc.astype(np.uint64)))
    slot = np.minimum(np.searchsorted(marks[order], mine), len(marks) - 1)
    take = np.flatnonzero(marks[order][slot] == mine)
    return take, order[slot[take]]


def _word_lists(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Runs of ``size`` words from ``start``, as 32-bit hashes."""
    end = np.cumsum(size)
    flat = (h >> _U(32)).astype(np.uint32)[np.repeat(start - (end - size), size) + np.arange(int(end[-1]))]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], end * 4]).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def suffix_rows(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per anchor whose prefix is in ``marks``: the words of all its windows, keyed by the prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in packed_pieces(batches, "packed"):
            w = words(unpack(piece.column(1)))
            at, prefix, start, n, h = anchors(w, window, gram)
            doc = np.searchsorted(w.first, at, side="right") - 1
            take, _ = _marked(piece.column(2), prefix, doc)
            if len(take):
                doc, start = doc[take], start[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix[take].view(np.int64)), piece.column(0).take(pa.array(doc)), pa.array((start - w.first[doc]).astype(np.int64)),
                     _word_lists(h, start, n[take] + window - 1)], ["prefix", "node", "start", "words"])

    return marked.mapInArrow(run, "prefix bigint, node bigint, start bigint, words binary")


def levels(window: int, gram: int) -> list[int]:
    """The lengths at which the suffixes of a large prefix are told apart."""
    return sorted({gram + -(-(window - gram) * i // LEVELS) for i in range(1, LEVELS + 1)})


def _large_rows(w: Words, marks: pa.Array, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the marked prefixes: text, word position, prefix, first window, number of windows, hash of all their words; and all word hashes."""
    at, prefix, start, n, h = anchors(w, window, gram)
    doc = np.searchsorted(w.first, at, side="right") - 1
    take, _ = _marked(marks, prefix, doc)
    doc, at, prefix, start, n = (x[take] for x in (doc, at, prefix, start, n))
    whole = rolling(h, window)          # the first and the last window hold all words of a row
    key = mix(mix(whole[start]) + whole[start + n - 1] + n.astype(np.uint64)) if len(take) else prefix
    return doc, at, prefix, start, n, key, h


def row_counts(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """``(node, prefix, key, n)``: how often each text holds each row of a marked prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in packed_pieces(batches, "packed"):
            doc, _, prefix, _, _, key, _ = _large_rows(words(unpack(piece.column(1))), piece.column(2), window, gram)
            pick, n = _tally(doc, key)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(doc[pick])), pa.array(prefix[pick].view(np.int64)), pa.array(key[pick].view(np.int64)), pa.array(n, pa.int64())],
                ["node", "prefix", "key", "n"])

    return marked.mapInArrow(run, "node bigint, prefix bigint, key bigint, n bigint")


def _standing(same: pa.Array, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have equals, and which stand for a row: those without equals and one of the equals."""
    take, mark = _marked(same, key, doc)
    again, stand = np.zeros(len(key), bool), np.ones(len(key), bool)
    again[take], stand[take] = True, False
    lead = np.unique(mark, return_index=True)[1]            # the first of the text's equals
    stand[take[lead]] = same.flatten().field("first").to_numpy(zero_copy_only=False)[mark[lead]]
    return again, stand


def _joined_runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, in ascending ``first..last``, where runs that follow on each other within a text begin and end."""
    new = np.ones(len(doc), bool)
    new[1:] = (first[1:] != last[:-1] + 1) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], len(doc))[:len(begin)] - 1


_ROWS = "prefix bigint, node bigint, start bigint, last bigint, words binary, whole boolean"


def distinct_rows(told: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows of the marked prefixes: one for each run of windows in rows that have equals (``whole``: all repeated), and one, with
    its words, for each different row of a prefix that is not in ``over``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in packed_pieces(batches, "packed"):
            w = words(unpack(piece.column(1)))
            doc, _, prefix, start, n, key, h = _large_rows(w, piece.column(2), window, gram)
            again, stand = _standing(piece.column(3), key, doc)
            stand[_marked(piece.column(4), prefix, doc)[0]] = False
            one, runs, end = np.flatnonzero(stand), np.flatnonzero(again), start + n - 1
            begin, to = _joined_runs(doc[runs], start[runs], end[runs])
            pick, last = np.concatenate([one, runs[begin]]), np.concatenate([end[one], end[runs[to]]])
            if len(pick):
                sure = np.arange(len(pick)) >= len(one)
                base = w.first[doc[pick]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix[pick].view(np.int64)), piece.column(0).take(pa.array(doc[pick])), pa.array((start[pick] - base).astype(np.int64)),
                     pa.array((last - base).astype(np.int64)), _word_lists(h, start[pick], np.where(sure, 0, n[pick] + window - 1)), pa.array(sure)],
                    ["prefix", "node", "start", "last", "words", "whole"])

    return told.mapInArrow(run, _ROWS)


def _beginnings(w: Words, marks: pa.Array, same: pa.Array, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """All windows of the different rows of marked prefixes: text, position and, for each level, the hash of their first words (and anchor's place)."""
    doc, at, prefix, start, n, key, h = _large_rows(w, marks, window, gram)
    take = np.flatnonzero(_standing(same, key, doc)[1])
    if not len(take):
        return take, take, h, [np.zeros(0, np.uint64) for _ in levels(window, gram)]
    at, prefix, start, n = at[take], prefix[take], start[take], n[take]
    own = np.repeat(np.arange(len(n)), n)
    place = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    root = mix(prefix[own] + (at[own] - place).astype(np.uint64))
    return np.searchsorted(w.first, place, side="right") - 1, place, h, [mix(rolling(h, k)[place] ^ root) for k in levels(window, gram)]


def beginning_counts(marked: DataFrame, level: int, window: int, gram: int) -> DataFrame:
    """``(node, key, n)``: how often each text holds each beginning, at one level, of the suffixes of a marked prefix's different rows.

    Past the first level only suffixes whose shorter beginning is among the text's ``known`` ones are told apart.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in packed_pieces(batches, "packed"):
            doc, _, _, keys = _beginnings(words(unpack(piece.column(1))), piece.column(2), piece.column(3), window, gram)
            key = keys[level]
            if level and len(doc):
                take, _ = _marked(piece.column(4), keys[level - 1], doc)
                doc, key = doc[take], key[take]
            pick, n = _tally(doc, key)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(doc[pick])), pa.array(key[pick].view(np.int64)), pa.array(n, pa.int64())], ["node", "key", "n"])

    return marked.mapInArrow(run, "node bigint, key bigint, n bigint")


def beginning_rows(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """Windows with a listed beginning: one row for each run of those known to be repeated, one keyed by its beginning, with words, for each other.

    A run is ``start..last`` and has no words: its beginnings are whole windows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in packed_pieces(batches, "packed"):
            w = words(unpack(piece.column(1)))
            doc, place, h, keys = _beginnings(w, piece.column(2), piece.column(3), window, gram)
            whole = piece.column(4).flatten().field("whole").to_numpy(zero_copy_only=False)
            for key in keys if len(doc) else []:
                take, mark = _marked(piece.column(4), key, doc)
                sure = whole[mark]
                one = take[~sure]
                runs = take[sure][np.argsort(place[take[sure]], kind="stable")]
                begin, to = _joined_runs(doc[runs], place[runs], place[runs])
                pick, last = np.concatenate([one, runs[begin]]), np.concatenate([one, runs[to]])
                if len(pick):
                    sure = np.arange(len(pick)) >= len(one)
                    base = w.first[doc[pick]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[pick].view(np.int64)), piece.column(0).take(pa.array(doc[pick])), pa.array((place[pick] - base).astype(np.int64)),
                         pa.array((place[last] - base).astype(np.int64)), _word_lists(h, place[pick], np.where(sure, 0, window)), pa.array(sure)],
                        ["prefix", "node", "start", "last", "words", "whole"])

    return marked.mapInArrow(run, _ROWS)


def _subtree(key: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes group by group; return the order and each one's common prefix with the one before."""
    n, width = suffixes.shape
    wide = suffixes if width % 2 == 0 else np.concatenate([suffixes, np.zeros((n, 1), np.uint32)], axis=1)
    wide = np.ascontiguousarray(wide).view(np.uint64)
    order = np.lexsort((*(wide[:, i] for i in range(wide.shape[1] - 1, -1, -1)), key))
    common = np.zeros(n, np.int64)
    if n > 1:
        unlike = suffixes[order[1:]] != suffixes[order[:-1]]
        common[1:] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
        common[1:][key[order[1:]] != key[order[:-1]]] = 0
    return order, common


def deepest_nodes(key: np.ndarray, suffixes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Depth of every leaf's deepest internal node: the longest prefix that it shares with another suffix of its group.

    In sorted order that is the longer of the common prefixes with the two
    neighbours; ``length`` are the suffixes' own lengths (the rest is padding).
    """
    order, common = _subtree(key, suffixes)
    common[1:] = np.minimum(common[1:], np.minimum(length[order[1:]], length[order[:-1]]))
    depth = np.empty(len(order), np.int64)
    depth[order] = np.maximum(common, np.append(common[1:], 0))
    return depth


def subtrees(rows: DataFrame, window: int) -> DataFrame:
    """Build the subtrees of rows ``(prefix, node, start, words)``.

    Gives their maximal repeats as ``(node, first, last)``: the windows that
    start at ``first..last`` of the text lie within one repeat.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        prefix, node, start = (table.column(c).to_numpy() for c in ("prefix", "node", "start"))
        raw = table.column("words").combine_chunks()
        if isinstance(raw, pa.ChunkedArray):
            raw = raw.chunk(0)
        offs = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
        flat = np.frombuffer(raw.buffers()[2], np.uint8)[offs[0]:offs[-1]].view(np.uint32)
        base = (offs - offs[0]) // 4
        count = np.diff(base) - window + 1
        row = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        new = np.ones(len(prefix), bool)
        new[1:] = prefix[1:] != prefix[:-1]
        group = np.cumsum(new)[row]
        at = base[row] + step
        # leaves under a node as deep as the window ...
        order, common = _subtree(group, flat[at[:, None] + np.arange(window)])
        deep = common == window
        deep[:-1] |= deep[1:]
        leaf = np.sort(order[deep])
        row, step, at = row[leaf], step[leaf], at[leaf]
        # ... and the depth of the last one above each
        length = base[row + 1] - at
        reach = np.arange(int(length.max()) if len(leaf) else window)
        whole = np.where(reach < length[:, None], flat[np.minimum(at[:, None] + reach, max(len(flat) - 1, 0))], 0).astype(np.uint32)
        end = step + deepest_nodes(group[leaf], whole, length)
        # a repeat that one from further left takes in is not maximal
        far = row * (int(end.max(initial=0)) + 1) + end
        keep = np.ones(len(leaf), bool)
        keep[1:] = far[1:] > np.maximum.accumulate(far)[:-1]
        row, step, end = row[keep], step[keep], end[keep]
        return pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(start[row] + step), pa.array(start[row] + end - window)], ["node", "first", "last"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= _PART_ROWS:
                prefix = held.column("prefix").to_numpy()
                border = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
                if not len(border):
                    break                                   # one group so far: wait for its end
                cut = border[border <= _PART_ROWS]
                to = int(cut[-1]) if len(cut) else int(border[0])
                yield solve(held.slice(0, to).combine_chunks())
                held = held.slice(to)
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return rows.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "node bigint, first bigint, last bigint")


def _marks(held: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(node, marks)``: the prefixes among ``prefixes`` that each text holds."""
    return held.join(prefixes.select("prefix"), "prefix").select("node", "prefix").distinct().groupBy("node").agg(F.collect_list("prefix").alias("marks"))


def _repeats(rows: DataFrame, window: int) -> DataFrame:
    """``(node, first, last)`` of rows with words, by their subtrees, and of those known to be repeated."""
    rows = materialize(rows)
    return (subtrees(rows.where("not whole").drop("whole", "last"), window)
            .union(rows.where("whole").select("node", F.col("start").alias("first"), "last")))


def split_repeats(texts: DataFrame, marks: DataFrame, window: int, gram: int, group: int) -> DataFrame:
    """``(node, first, last)`` of prefixes with more than ``group`` rows: equal rows meet once; longer beginnings where that leaves too many."""
    marked = materialize(packed_texts(texts, marks).join(marks, "node").select("node", "packed", "marks"))
    counts = materialize(row_counts(marked, window, gram))
    totals = materialize(counts.groupBy("key").agg(F.first("prefix").alias("prefix"), F.sum("n").alias("total"), F.min("node").alias("first")))
    over = materialize(totals.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > group).select("prefix"))
    same = (counts.join(totals.where("total > 1").select("key", "first"), "key")
            .groupBy("node").agg(F.collect_list(F.struct("key", (F.col("node") == F.col("first")).alias("first"))).alias("same")))
    told = marked.join(same, "node", "left").join(_marks(counts, over).withColumnRenamed("marks", "over"), "node", "left").select(
        "node", "packed", "marks", F.coalesce("same", F.array().cast("array<struct<key:bigint,first:boolean>>")).alias("same"),
        F.coalesce("over", F.array().cast("array<bigint>")).alias("over"))
    found = _repeats(distinct_rows(told, window, gram), window)
    if over.isEmpty():
        return found
    large = materialize(told.where(F.size("over") > 0).select("node", "packed", F.col("over").alias("marks"), "same"))
    return found.union(_split_rows(large, window, gram, group))


def _split_rows(marked: DataFrame, window: int, gram: int, group: int) -> DataFrame:
    """``(node, first, last)`` of prefixes with more than ``group`` different rows, by longer beginnings."""
    last, listed, part = len(levels(window, gram)) - 1, None, marked
    for level in range(last + 1):
        counts = materialize(beginning_counts(part, level, window, gram))
        totals = materialize(counts.groupBy("key").agg(F.sum("n").alias("total")).where("total > 1"))
        fits = totals if level == last else totals.where(F.col("total") <= group)
        found = counts.join(fits, "key").select("node", F.struct("key", (F.col("total") > group).alias("whole")).alias("key"))
        listed = found if listed is None else listed.union(found)
        over = totals.where(F.col("total") > group)
        if level == last or over.isEmpty():
            break
        # longer beginnings only where these do not tell enough suffixes apart
        known = counts.join(over.select("key"), "key").groupBy("node").agg(F.collect_list("key").alias("known"))
        part = materialize(marked.join(known, "node").select("node", "packed", "marks", "same", "known"))
    listed = listed.groupBy("node").agg(F.collect_list("key").alias("keys"))
    return _repeats(beginning_rows(marked.join(listed, "node").select("node", "packed", "marks", "same", "keys"), window, gram), window)


def repeated_windows(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``(node, first, last)``: runs of window starts that are repeated among distinct texts ``(node, text)``."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and the window")
    held = prefix_counts(texts, window, gram)
    often = materialize(held.groupBy("prefix").agg(F.sum("n").alias("total")).where("total > 1"))
    marks = _marks(held, often.where(F.col("total") <= group))
    found = subtrees(suffix_rows(packed_texts(texts).join(marks, "node").select("node", "packed", "marks"), window, gram), window)
    large = often.where(F.col("total") > group)
    if large.isEmpty():
        return found
    return found.union(split_repeats(texts, materialize(_marks(held, large)), window, gram, group))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(key, n_words, n_removed, kept)`` of every row; ``kept``: the words left, joined by one space.

    Only texts that lose some, but not all words are shuffled a second time.
    """
    return _results(df, key, text, window, False)


def remove_repeats_digest(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """As :func:`remove_repeats`, with ``kept_sha256`` in place of the words."""
    return _results(df, key, text, window, True)


def _results(df: DataFrame, key: str, text: str, window: int, digest: bool) -> DataFrame:
    base = small_batches(df).select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("node"), F.col(f"`{text}`").alias("text"))
    texts = base.select("node", "text")
    out = "kept_sha256" if digest else "kept"
    kind = pa.string()

    def shown(value: bytes) -> str:
        return hashlib.sha256(value).hexdigest() if digest else value.decode()

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            w = words(piece.column(2))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(w.counts.astype(np.int64)), pa.array([shown(joined_words(w, i)) for i in range(piece.num_rows)], kind)],
                ["id", "node", "n_words", "all_words"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                w = words(unpack(row.column(1)))
                spans = row.column(2)[0].values
                lo, hi = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
                edge = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi + window, -1)
                keep = np.cumsum(edge)[:-1] == 0
                yield pa.RecordBatch.from_arrays(
                    [row.column(0), pa.array([int((~keep).sum())], pa.int64()), pa.array([shown(joined_words(w, 0, keep))], kind)], ["node", "n_removed", "left_words"])

    id_type = base.schema["id"].dataType.simpleString()
    rows = base.mapInArrow(whole, f"id {id_type}, node bigint, n_words bigint, all_words string")
    rows = rows if not digest else materialize(rows)
    copies = (rows if digest else base).groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    spans = repeated_windows(texts, window).groupBy("node").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    # copies of one text repeat every window of it; the others lose what their spans cover
    partly = spans.join(copies, "node", "left_anti")
    lost = packed_texts(texts).join(partly, "node").select("node", "packed", "spans").mapInArrow(cut, "node bigint, n_removed bigint, left_words string")
    gone = F.col("copies").isNotNull() & (F.col("n_words") >= window)
    return (rows.join(lost, "node", "left").join(copies, "node", "left").select(
        F.col("id").alias(key), "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, F.lit(shown(b""))).otherwise(F.coalesce("left_words", "all_words")).alias(out)))
