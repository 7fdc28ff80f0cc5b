"""Exact byte-level dedup by a depth-limited radix sort of suffixes.

Every ``window``-byte string that starts at two or more places is repeated.
Each byte that such a string covers is removed, but for the string's earliest
place: the smallest id, in one text the earliest start.  Strings are judged
on the input, so removal never changes a verdict; matches never cross texts.

Suffixes are ordered only through ``window`` bytes, most significant digit
first, and a suffix leaves as soon as its group has no other member, so the
groups that are left at full depth are exactly the repeated windows:

* First digit, over the cluster: of the ``GRAM``-byte strings in a window the
  one of least hash (the leftmost of equals) is its anchor.  Equal windows
  have equal anchors at equal offsets, so the windows of one anchor travel as
  one suffix, and anchors that occur once are dropped unsent.
* Second digit, over the cluster: the hash of all bytes that the anchor's
  windows cover.  Of equal ones the earliest stays as their representative;
  the others are repeats as a whole.  This is aggregated before anything is
  joined, so a passage that a third of all texts hold is one row a task.
* Remaining digits, in tasks: where one anchor has several contents, their
  windows are sorted by eight bytes at a time (``radix_groups``).

An anchor with over ``GROUP`` contents is dealt to parts; each part passes on
the first of its equal windows, and these are matched by one more aggregate.

Distinct texts are stored once, compressed and bucketed by their 64-bit hash,
so later steps join narrow tables to them without shuffling a text again.
Contents in the second digit, and windows of dealt anchors, are compared by
hash (64 bits, within one 64-bit anchor hash), all else byte by byte.

A null or empty text has no bytes.  Ids must be integers; null ids come last,
equal ids are ordered by the text's hash, and of equal rows one is the first.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.llm.arrow_words import _large, _offsets, mix, packed_pieces, pieces, small_batches
from synthweave.session import checkpoint_dir, stored

WINDOW = 100
GRAM = 32
GROUP = 2_048           # contents of an anchor that one task sorts together
PART_ROWS = 8_192       # contents sorted together in a task, unless one group holds more
BLOCK = 1 << 18         # bytes hashed at a time: the arrays stay in cache
LAST = (1 << 63) - 1
_U = np.uint64


def _eight_bytes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number."""
    return np.ndarray((max(len(buf) - 7, 0),), "<u8", buffer=buf, strides=(1,)).copy() if len(buf) > 7 else np.zeros(0, np.uint64)


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position."""
    total = len(buf) - gram + 1
    if gram < 8:
        h = np.zeros(total, np.uint64)
        for k in range(gram):
            h = (h << _U(8)) | buf[k:k + total]
        return mix(h * _U(0x9E3779B97F4A7C15))
    x = _eight_bytes(buf)
    h = x[:total] * _U(0x9E3779B97F4A7C15)
    for k in range(8, gram, 8):
        at = min(k, gram - 8)
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h += x[at:at + total]
    return mix(h)


def _least_positions(value: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value (by its upper 32 bits) in every run of ``width``: prefix and suffix minima of blocks."""
    total = len(value) - width + 1
    own = (value & _U(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
    rest = -len(value) % width
    blocks = np.concatenate([own, np.full(rest, LAST * 2 + 1, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:total], before[width - 1:width - 1 + total]) & _U(0xFFFFFFFF)).astype(np.int64)


def anchors(buf: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of the texts ``buf[offs[i]:offs[i+1]]``: position, hash, first window, number of windows."""
    at, value, start = [], [], []
    last = len(buf) - window                       # the last window's start, whatever the text
    for lo in range(0, last + 1, BLOCK):
        hi = min(lo + BLOCK, last + 1)             # window starts lo..hi-1
        h = _gram_hashes(buf[lo:hi + window - 1], gram)
        pos = _least_positions(h, window - gram + 1)
        text = np.searchsorted(offs, np.arange(lo, hi, window // 2 or 1), side="right") - 1
        ends = offs[1:][text[0]:text[-1] + 2]
        own = np.arange(lo, hi)
        inside = own + window <= ends[np.minimum(np.searchsorted(ends, own, side="right"), len(ends) - 1)]
        own, pos = own[inside], pos[inside]
        new = np.ones(len(own), bool)
        new[1:] = (pos[1:] != pos[:-1]) | (own[1:] != own[:-1] + 1)
        first = np.flatnonzero(new)
        at.append(pos[first] + lo)
        value.append(h[pos[first]])
        start.append(np.stack([own[first], np.diff(np.append(first, len(own)))]))
    if not at:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    at, value, start = np.concatenate(at), np.concatenate(value), np.concatenate(start, axis=1)
    joined = np.zeros(len(at), bool)               # one anchor's windows cut by a block border
    joined[1:] = (at[1:] == at[:-1]) & (start[0, 1:] == start[0, :-1] + start[1, :-1])
    head = np.flatnonzero(~joined)
    return at[head], value[head], start[0, head], np.add.reduceat(start[1], head) if len(head) else start[1]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs, data = _offsets(texts), texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None and len(offs) > 1 else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of packed texts, and where each text begins and ends."""
    codec = pa.Codec("zstd")
    raw = [codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True) for p in packed.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])


def bucketed_texts(base: DataFrame, least: int) -> DataFrame:
    """Distinct texts of ``(id, node, text)`` with at least ``least`` bytes: ``(node, head, packed)``, bucketed by ``node``.

    ``head`` is the least id of the text.  The table lies in the shared
    folder; joins by ``node`` shuffle the other side only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for piece in pieces(batches, "text"):
            raw = [(t or "").encode() for t in piece.column(2).to_pylist()]
            keep = np.flatnonzero([len(r) >= least for r in raw])
            packed = [len(raw[i]).to_bytes(8, "little") + codec.compress(raw[i], asbytes=True) for i in keep]
            of = pa.array(keep)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(of), piece.column(1).take(of), pa.array(packed, pa.binary())], ["head", "node", "packed"])

    spark = base.sparkSession
    name = f"synthweave_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = (base.select(F.coalesce(F.col("id").cast("bigint"), F.lit(LAST)).alias("id"), "node", "text").mapInArrow(run, "head bigint, node bigint, packed binary")
            .groupBy("node").agg(F.min("head").alias("head"), F.first("packed").alias("packed")))
    (once.repartition(buckets, "node").write.bucketBy(buckets, "node").option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def prefix_counts(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``(prefix, node, n)``: how often each text holds each anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in packed_pieces(batches, "packed"):
            buf, offs = _unpacked(piece.column(1))
            at, prefix, _, _ = anchors(buf, offs, window, gram)
            doc = np.searchsorted(offs, at, side="right") - 1
            order = np.lexsort((prefix, doc))
            doc, prefix = doc[order], prefix[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (prefix[1:] != prefix[:-1])
            first = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(prefix[first].view(np.int64)), piece.column(0).take(pa.array(doc[first])),
                                              pa.array(np.diff(np.append(first, len(doc))).astype(np.int32))], ["prefix", "node", "n"])

    return texts.select("node", "packed").mapInArrow(run, "prefix bigint, node bigint, n int")


def content_rows(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """``(prefix, content, head, node, start, n)`` of the marked anchors of ``(node, head, packed, marks)``.

    ``content`` hashes the bytes that the anchor's ``n`` windows cover and
    where the anchor lies in them.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in packed_pieces(batches, "packed"):
            buf, offs = _unpacked(piece.column(2))
            at, prefix, start, n = anchors(buf, offs, window, gram)
            doc = np.searchsorted(offs, at, side="right") - 1
            lists = piece.column(3)
            owner = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            known = np.sort(mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ mix(owner.astype(np.uint64))))
            mine = mix(prefix ^ mix(doc.astype(np.uint64)))
            take = np.flatnonzero(known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine) if len(known) else np.zeros(0, np.int64)
            at, prefix, start, n, doc = at[take], prefix[take], start[take], n[take], doc[take]
            raw = buf.tobytes()
            told = [hashlib.blake2b(raw[s:s + k + window - 1], digest_size=8, salt=(a - s).to_bytes(8, "little")).digest()
                    for s, k, a in zip(start.tolist(), n.tolist(), at.tolist())]
            content = np.frombuffer(b"".join(told), np.int64)
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix.view(np.int64)), pa.array(content), piece.column(1).take(of), piece.column(0).take(of),
                 pa.array(start - offs[doc]), pa.array(n.astype(np.int32)), pa.array((at - start).astype(np.int32))],
                ["prefix", "content", "head", "node", "start", "n", "depth"])

    return marked.select("node", "head", "packed", "marks").mapInArrow(
        run, "prefix bigint, content bigint, head bigint, node bigint, start bigint, n int, depth int")


def content_bytes(wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of contents listed as ``wanted`` in ``(node, head, packed, wanted)``: one row each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in packed_pieces(batches, "packed"):
            buf, offs = _unpacked(piece.column(2))
            lists = piece.column(3)
            doc = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
            raw = buf.tobytes()
            lo = offs[doc] + start
            data = pa.array([raw[s:e] for s, e in zip(lo.tolist(), (lo + n + window - 1).tolist())], pa.binary())
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("prefix", "part", "parts")), piece.column(1).take(of), piece.column(0).take(of),
                                              *(flat.field(c) for c in ("start", "n", "depth")), data],
                                             ["prefix", "part", "parts", "head", "node", "start", "n", "depth", "bytes"])

    return wanted.select("node", "head", "packed", "wanted").mapInArrow(
        run, "prefix bigint, part int, parts int, head bigint, node bigint, start bigint, n int, depth int, bytes binary")


def radix_groups(key: np.ndarray, place: np.ndarray, buf: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal windows among those with equal ``key``; window ``i`` is ``buf[place[i]:place[i] + window]``.

    Passes take eight bytes each, the most significant first, down to the
    window's depth.  Members of groups of one leave; groups whose members
    agree in a digit stay as they are, only mixed ones are sorted by it.
    Returns the members of the groups left, group by group, and their groups.
    """
    words = _eight_bytes(np.concatenate([buf, np.zeros(8, np.uint8)]))
    order = np.argsort(key, kind="stable")
    group = np.cumsum(np.append(True, key[order][1:] != key[order][:-1])[:len(order)]) - 1
    for depth in range(0, window, 8):
        size = np.bincount(group)
        keep = size[group] > 1
        order, group = order[keep], group[keep]
        if not len(order):
            break
        digit = words[place[order] + depth]
        if window - depth < 8:
            digit = digit & _U((1 << 8 * (window - depth)) - 1)          # little-endian: the first bytes are the low ones
        new = np.append(True, group[1:] != group[:-1])
        head = np.flatnonzero(new)
        mixed = np.add.reduceat(digit != digit[np.repeat(head, np.diff(np.append(head, len(group))))], head) > 0
        number = np.cumsum(new) - 1
        odd = np.flatnonzero(mixed[number])
        if len(odd):
            again = odd[np.lexsort((digit[odd], number[odd]))]
            order[odd], digit[odd] = order[again], digit[again]
        group = np.cumsum(new | np.append(True, digit[1:] != digit[:-1])) - 1
    if len(order):
        keep = np.bincount(group)[group] > 1
        order, group = order[keep], group[keep]
    return order, group


def repeats_in_parts(rows: DataFrame, window: int) -> DataFrame:
    """``(head, node, first, last, name)`` from the contents of each (prefix, part).

    ``name`` 0: the windows starting at ``first..last`` occur earlier in the
    same part.  Otherwise one window that is the first of its kind in a part
    of a dealt prefix, to be matched with the other parts' by its name.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        col = {c: table.column(c).to_numpy() for c in ("prefix", "part", "parts", "head", "node", "start", "n", "depth")}
        raw = table.column("bytes").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        offs = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4).astype(np.int64)
        buf = np.frombuffer(raw.buffers()[2], np.uint8)[offs[0]:offs[-1]]
        # places in order: a window's rank among equals is that of its anchor's text and position
        order = np.lexsort((col["start"] + col["depth"], col["node"], col["head"]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n = col["n"].astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        border = np.ones(len(n), bool)
        border[1:] = (col["prefix"][1:] != col["prefix"][:-1]) | (col["part"][1:] != col["part"][:-1])
        offset = col["depth"][row].astype(np.int64) - step               # of the anchor: equal in equal windows
        place = (offs[:-1] - offs[0])[row] + step
        member, group = radix_groups(np.cumsum(border)[row] * (window + 1) + offset, place, buf, window)
        by = np.lexsort((rank[row[member]], group))
        first = np.append(True, group[1:] != group[:-1])[:len(by)]       # groups are contiguous, before and after
        later = np.zeros(len(row), bool)
        later[member[by[~first]]] = True
        at = np.flatnonzero(later)
        brk = np.ones(len(at), bool)
        brk[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
        lo, hi = at[brk], at[np.append(np.flatnonzero(brk)[1:], len(at)) - 1] if len(at) else at
        dealt = np.flatnonzero(~later & (col["parts"][row] > 1))
        text = buf.tobytes()
        told = [hashlib.blake2b(text[p:p + window], digest_size=8, salt=o.to_bytes(8, "little"), person=k.to_bytes(8, "little", signed=True)).digest()
                for p, o, k in zip(place[dealt].tolist(), offset[dealt].tolist(), col["prefix"][row[dealt]].tolist())]
        name = np.frombuffer(b"".join(told), np.int64) | 1
        all_rows = np.concatenate([lo, dealt])
        return pa.RecordBatch.from_arrays(
            [pa.array(col["head"][row[all_rows]]), pa.array(col["node"][row[all_rows]]), pa.array(col["start"][row[all_rows]] + step[all_rows]),
             pa.array(np.concatenate([col["start"][row[hi]] + step[hi], col["start"][row[dealt]] + step[dealt]])),
             pa.array(np.concatenate([np.zeros(len(lo), np.int64), name]))], ["head", "node", "first", "last", "name"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= PART_ROWS:
                prefix, part = held.column("prefix").to_numpy(), held.column("part").to_numpy()
                border = np.flatnonzero((prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])) + 1
                if not len(border):
                    break                                   # one group so far: wait for its end
                cut = border[border <= PART_ROWS]
                to = int(cut[-1]) if len(cut) else int(border[0])
                yield solve(held.slice(0, to).combine_chunks())
                held = held.slice(to)
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return (rows.repartition("prefix", "part").sortWithinPartitions("prefix", "part")
            .mapInArrow(run, "head bigint, node bigint, first bigint, last bigint, name bigint"))


def later_windows(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``(node, first, last)``: runs of window starts in ``(node, head, packed)`` whose window starts earlier elsewhere."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and the window")
    place = F.struct("head", "node", "start")
    held = prefix_counts(texts, window, gram)
    often = held.groupBy("prefix").agg(F.sum("n").alias("total")).where("total > 1").select("prefix")
    marks = held.select("prefix", "node").join(often, "prefix").groupBy("node").agg(F.collect_list("prefix").alias("marks"))
    rows = stored(content_rows(texts.join(marks, "node"), window, gram))
    leads = stored(rows.groupBy("prefix", "content").agg(F.min(place).alias("lead"), F.first("n").alias("n"), F.first("depth").alias("depth")))
    whole = (rows.join(leads.select("prefix", "content", "lead"), ["prefix", "content"]).where(place != F.col("lead"))
             .select("node", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")))
    several = (leads.groupBy("prefix").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
               .select("prefix", F.ceil(F.col("contents") / group).cast("int").alias("parts")))
    wanted = (leads.join(several, "prefix").withColumn("part", F.expr("cast(pmod(xxhash64(content), parts) as int)"))
              .groupBy(F.col("lead.node").alias("node"))
              .agg(F.collect_list(F.struct("prefix", "part", "parts", F.col("lead.start").alias("start"), "n", "depth")).alias("wanted")))
    found = stored(repeats_in_parts(content_bytes(texts.join(wanted, "node"), window), window))
    own = F.struct("head", "node", "first")
    firsts = found.where("name <> 0").groupBy("name").agg(F.min(own).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "lead")
    across = found.where("name <> 0").join(firsts, "name").where(own != F.col("lead"))
    return whole.union(found.where("name = 0").select("node", "first", "last")).union(across.select("node", "first", "last"))


def remove_later(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(key, n_bytes, n_removed, n_spans, kept)`` of every row; ``kept``: the bytes left (a cut may split a character)."""
    return _results(df, key, text, window, False)


def remove_later_digest(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """As :func:`remove_later`, with ``kept_sha256`` in place of the bytes."""
    return _results(df, key, text, window, True)


def _results(df: DataFrame, key: str, text: str, window: int, digest: bool, gram: int = GRAM) -> DataFrame:
    whole: Column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = small_batches(df).select(F.col(f"`{key}`").alias("id"), F.xxhash64(whole).alias("node"), whole.alias("text"))
    if base.schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("the key must be an integer column: it says which text comes first")
    out = "kept_sha256" if digest else "kept"
    gram = min(gram, window)

    def shown(value: bytes) -> str | bytes:
        return hashlib.sha256(value).hexdigest() if digest else value

    kind = pa.string() if digest else pa.binary()
    empty = F.lit(shown(b""))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                buf, _ = _unpacked(row.column(1))
                spans = row.column(2)[0].values
                lo, hi = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
                edge = np.zeros(len(buf) + 1, np.int32)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([int(gone.sum())], pa.int64()), pa.array([runs], pa.int64()),
                                                  pa.array([shown(buf[~gone].tobytes())], kind)], ["node", "n_removed", "n_spans", "left"])

    # one row for each distinct (id, text), with its number of copies; nothing wide is shuffled
    full = F.sha2("text", 256) if digest else F.encode("text", "UTF-8")
    rows = base.select("id", "node", F.octet_length("text").cast("bigint").alias("n_bytes"), full.alias("full"))
    rows = rows.groupBy("id", "node").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("full").alias("full"))
    texts = bucketed_texts(base, window)
    spans = later_windows(texts, window, gram).groupBy("node").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    lost = (texts.join(spans, "node").select("node", "packed", "spans")
            .mapInArrow(cut, f"node bigint, n_removed bigint, n_spans bigint, left {'string' if digest else 'binary'}"))
    told = rows.join(texts.select("node", "head"), "node", "left").join(lost, "node", "left")
    told = told.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    first = (F.col("copy") == 1) & (F.coalesce(F.col("id").cast("bigint"), F.lit(LAST)) == F.col("head"))
    again = (F.col("n_bytes") >= window) & ~first
    return told.select(
        F.col("id").alias(key), "n_bytes",
        F.when(again, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(again, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(again, empty).otherwise(F.coalesce("left", "full")).alias(out))
