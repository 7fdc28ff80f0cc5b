"""Words of whole texts as NumPy arrays, straight from Arrow buffers.

A word is a maximal run of characters other than space and ``\\t \\n \\v \\f \\r``.
Batches are cut into pieces of about a megabyte of text, so a task's memory
follows its longest single text and never the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = b"\t\n\x0b\x0c\r "
PIECE_BYTES = 1 << 20

_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
_U = np.uint64
_MULT = 0x9E3779B97F4A7C13          # 3 mod 8: powers of it differ in their low bits
_MULT_INV = pow(_MULT, -1, 1 << 64)
_BYTE = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64)


BATCH_ROWS = "1000"


def small_batches(df: DataFrame) -> DataFrame:
    """Long texts: fewer rows per Arrow batch than the default, unless the session names a number of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name, "10000") == "10000":
        conf.set(name, BATCH_ROWS)
    return df


@dataclass
class Words:
    """Words of a run of texts: byte spans in ``buf``; text ``i`` owns words ``first[i]:first[i+1]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def doc_end(self) -> np.ndarray:
        """For every word, the position after the last word of its text."""
        return np.repeat(self.first[1:], self.counts)


def pieces(batches: Iterable[pa.RecordBatch], *columns: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` bytes of the named text columns, one row at least."""
    for batch in batches:
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for name in columns:
            size += np.diff(_offsets(_large(batch.column(batch.schema.names.index(name)))))
        total = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def _large(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_string()).fill_null("")


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)


def words(texts: pa.Array) -> Words:
    """Split every text (null: no words)."""
    texts = _large(texts)
    offs = _offsets(texts)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    inside = ~_IS_WHITE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    edge[-1:] = True
    before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Words(buf, start, end, np.searchsorted(start, offs))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, m in enumerate((_MULT, _MULT_INV)):
            steps = np.full(n, m, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def word_hashes(w: Words, block: int = PIECE_BYTES) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums over the bytes, block by block."""
    out = np.empty(len(w.start), np.uint64)
    at = 0
    while at < len(out):
        lo = int(w.start[at])
        to = max(at + 1, int(np.searchsorted(w.end, lo + block, side="right")))
        part = w.buf[lo:int(w.end[to - 1])]
        up, down = _powers(len(part) + 1) if len(part) <= block else _long_powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:len(part)], out=sums[1:])
        s, e = w.start[at:to] - lo, w.end[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s])
        at = to
    return out


def _long_powers(n: int) -> list[np.ndarray]:
    """Powers for one word longer than a block; not kept (only position 0 of the inverse is used)."""
    steps = np.full(n, _MULT, np.uint64)
    steps[0] = 1
    return [np.cumprod(steps), np.ones(n, np.uint64)]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``k`` consecutive values from every position; ``len(h) - k + 1`` values."""
    total = len(h) - k + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    done, have, run, size = None, 0, h, 1
    while True:
        if k & size:
            if done is None:
                done, have = run, size
            else:
                n = len(h) - have - size + 1
                done, have = done[:n] * _U(pow(_MULT, size, 1 << 64)) + run[have:have + n], have + size
        if have == k:
            return mix(done[:total] + _U(k))
        n = len(h) - 2 * size + 1
        run, size = run[:n] * _U(pow(_MULT, size, 1 << 64)) + run[size:size + n], 2 * size


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in every run of ``width`` values."""
    total = len(v) - width + 1
    if total <= 0:
        return np.zeros(0, np.int64)

    def better(a, b):
        return np.where(v[b] < v[a], b, a)

    done, have, run, size = None, 0, np.arange(len(v)), 1
    while True:
        if width & size:
            if done is None:
                done, have = run, size
            else:
                n = len(v) - have - size + 1
                done, have = better(done[:n], run[have:have + n]), have + size
        if have == width:
            return done[:total]
        n = len(v) - 2 * size + 1
        run, size = better(run[:n], run[size:size + n]), 2 * size


def joined_words(w: Words, i: int, keep: np.ndarray | None = None) -> bytes:
    """The words of text ``i`` (those flagged in ``keep``, indexed as ``w.start``) joined by one space."""
    lo, hi = int(w.first[i]), int(w.first[i + 1])
    if lo == hi:
        return b""
    base = int(w.start[lo])
    found = w.buf[base:int(w.end[hi - 1])].tobytes().split()
    if keep is not None:
        found = [x for x, k in zip(found, keep[lo:hi].tolist()) if k]
    return b" ".join(found)


def packed_texts(texts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Distinct texts of ``(node, text)`` as ``(node, packed)``, compressed before they are shuffled, once; of the nodes in ``only``, if given."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for piece in pieces(batches, "text"):
            raw = [(t or "").encode() for t in piece.column(1).to_pylist()]
            packed = [len(r).to_bytes(8, "little") + codec.compress(r, asbytes=True) for r in raw]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(packed, pa.binary())], ["node", "packed"])

    packed = texts.select("node", "text").mapInArrow(run, "node bigint, packed binary")
    if only is not None:
        packed = packed.join(only.select("node").hint("merge"), "node", "left_semi")
    return packed.groupBy("node").agg(F.first("packed").alias("packed"))


def packed_pieces(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Slices whose packed texts in the named columns hold about a megabyte together, one row at least."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for name in columns:
            size += [int.from_bytes(p[:8], "little") for p in batch.column(batch.schema.names.index(name)).to_pylist()]
        total = np.concatenate([[0], np.cumsum(size)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + PIECE_BYTES, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def unpack(packed: pa.Array) -> pa.Array:
    """The texts of packed values."""
    codec = pa.Codec("zstd")
    return pa.array([codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True).decode() for p in packed.to_pylist()], pa.large_string())
