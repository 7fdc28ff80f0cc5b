"""Byte-level BPE encoding and decoding over NumPy matrices.

Texts are cut by the tokenizer's pattern; the distinct pieces of a megabyte
of text are encoded together.  Pieces of like length share a padded matrix of
token ids; in every round each row merges its leftmost pair of least rank
(ranks come from an open-addressing hash table over id pairs), the row closes
up, and rows without a pair left leave the matrix.  A piece longer than
``LONG_PIECE`` bytes would need as many rounds as bytes; it is merged with a
heap over a linked list, which does the same merges in the same order.

A null or empty text has no tokens.  Repeated rows encode alike; an empty
table gives an empty result; columns other than the text pass through, and an
input column named like the output is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthweave.llm.arrow_words import pieces, small_batches

LONG_PIECE = 1024
CACHE_PIECES = 150_000
_MATRIX_CELLS = 1 << 19
_NONE = np.int32(2**31 - 1)
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing table from (left id, right id) to the merged id; -1 for an absent pair."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 2 - 1).bit_length() + 1) if len(left) else 4
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, -1, np.int32)
        keys = self._key(left, right)
        slot, rest, self.probes = self._home(keys), np.arange(len(keys)), 1
        while len(rest):
            free = rest[self.values[slot[rest]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], merged[put]
            rest = np.setdiff1d(rest, put, assume_unique=True)
            if len(rest):
                slot[rest] = (slot[rest] + 1) & self.mask
                self.probes += 1

    @staticmethod
    def _key(left, right):
        return (left.astype(np.uint64) << _U(32)) | right.astype(np.uint64)

    def _home(self, keys):
        return ((keys * _ODD) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of every pair; the largest int32 where it is absent or a side is padding (-1)."""
        out = np.full(left.shape, _NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left[at], right[at])
        slot = self._home(keys)
        for _ in range(self.probes):
            found = self.keys[slot] == keys
            out[at[found]] = self.values[slot[found]]
            go_on = ~found & (self.values[slot] >= 0)
            if not go_on.any():
                break
            at, keys, slot = at[go_on], keys[go_on], (slot[go_on] + 1) & self.mask
        return out


class Vocabulary:
    """Ranks of a tiktoken file: token bytes <-> ids, and the table of mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        trio = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*trio)))
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.offsets[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode_pieces(self, found: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list[list[int] | None] = [None] * len(found)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(found):
            whole = self.ranks.get(p)
            if whole is not None or not p:
                out[i] = [] if whole is None else [whole]
            elif len(p) > LONG_PIECE:
                out[i] = self._merge_long(p)
            else:
                buckets.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, _MATRIX_CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                for i, ids in zip(part, self._merge_rows([found[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, rows: list[bytes], width: int) -> list[list[int]]:
        size = np.array([len(r) for r in rows])
        ids = np.full((len(rows), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < size[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        rank = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width)
        done: list[list[int] | None] = [None] * len(rows)
        row = np.arange(len(rows))
        while len(row):
            at = rank.argmin(axis=1)                      # the leftmost of the least
            best = rank[np.arange(len(row)), at]
            over = best == _NONE
            if over.any():
                for i, r, n in zip(row[over].tolist(), ids[over], size[over]):
                    done[i] = r[:n].tolist()
                go = ~over
                row, ids, rank, size, at, best = row[go], ids[go], rank[go], size[go], at[go], best[go]
                if not len(row):
                    break
                most = int(size.max())
                ids, rank = ids[:, :most + 1], rank[:, :most]
            me = np.arange(len(row))
            ids[me, at] = best
            shift = np.arange(ids.shape[1] - 1)
            ids[:, :-1] = np.take_along_axis(ids, shift + (shift > at[:, None]), axis=1)
            ids[:, -1] = -1
            size -= 1
            shift = np.arange(rank.shape[1] - 1)
            rank[:, :-1] = np.take_along_axis(rank, shift + (shift > at[:, None]), axis=1)
            rank[:, -1] = _NONE
            rank[me, at] = self.pairs.ranks(ids[me, at], ids[me, at + 1])
            left = at > 0
            rank[me[left], at[left] - 1] = self.pairs.ranks(ids[me[left], at[left] - 1], ids[me[left], at[left]])
        return done

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)]
        first = self.pairs.ranks(ids[:-1], ids[1:]).tolist()
        ids, n = ids.tolist(), len(piece)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)

        def look(i):
            if i >= 0 and right[i] >= 0:
                r = int(self.pairs.ranks(np.array([ids[i]], np.int32), np.array([ids[right[i]]], np.int32))[0])
                if r != _NONE:
                    now[i] = r
                    heapq.heappush(heap, (r, i))
                    return
            now.pop(i, None)

        now = dict((i, r) for r, i in heap)               # the valid entry of each place
        while heap:
            r, i = heapq.heappop(heap)
            if now.get(i) != r:
                continue
            j = right[i]
            now.pop(j, None)
            ids[i], ids[j], right[i] = r, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            look(i)
            look(left[i])
        return [x for x in ids if x is not None]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pass_on(batch: pa.RecordBatch, schema: list[str], **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else batch.column(batch.schema.names.index(c)) for c in schema], schema)


def _encoded(batches: Iterable[pa.RecordBatch], path: str, pattern: str, text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Pieces of the batches with the ids of each row."""
    vocab, split = vocabulary(path), regex.compile(pattern).findall
    known: dict[str, list[int]] = {}
    for piece in pieces(batches, text):
        cut = [split(t) if t else [] for t in piece.column(piece.schema.names.index(text)).to_pylist()]
        if len(known) > CACHE_PIECES:
            known.clear()
        new = list(set(chain.from_iterable(cut)).difference(known))
        known.update(zip(new, vocab.encode_pieces([p.encode() for p in new])))
        yield piece, [np.fromiter(chain.from_iterable(map(known.__getitem__, c)), np.int32) for c in cut]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _without(df: DataFrame, *names: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in names]


_IDS = T.ArrayType(T.IntegerType(), False)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """Replace the text column by ``out``: the token ids as ``array<int>``."""
    fields = [*_without(df, text, out), T.StructField(out, _IDS)]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, ids in _encoded(batches, path, pattern, text):
            yield _pass_on(piece, names, **{out: _lists(ids)})

    return small_batches(df).select(*[F.col(f"`{c}`") for c in df.columns if c != out or c == text]).mapInArrow(run, T.StructType(fields))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", tokens: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """Replace the text column by its ids and the bytes that the ids decode to, in one pass of one worker."""
    fields = [*_without(df, text, tokens, decoded), T.StructField(tokens, _IDS), T.StructField(decoded, T.BinaryType())]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for piece, ids in _encoded(batches, path, pattern, text):
            back = pa.array([vocab.decode(x).tobytes() for x in ids], pa.binary())
            yield _pass_on(piece, names, **{tokens: _lists(ids), decoded: back})

    return small_batches(df).select(*[F.col(f"`{c}`") for c in df.columns if c not in (tokens, decoded) or c == text]).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, path: str, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """Replace the ids column by ``out``: the bytes they stand for."""
    fields = [f for f in df.schema.fields if f.name not in (tokens, out)] + [T.StructField(out, T.BinaryType())]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lists = batch.column(batch.schema.names.index(tokens))
            for at in range(0, len(lists), 256):
                part = lists.slice(at, 256)
                values = [vocab.decode(x.values.to_numpy(zero_copy_only=False)).tobytes() if x.is_valid and len(x) else b"" for x in part]
                yield _pass_on(batch.slice(at, 256), names, **{out: pa.array(values, pa.binary())})

    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != out or c == tokens]).mapInArrow(run, T.StructType(fields))
