"""Phrase collocation mining with broadcast double-array tries.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line breaks
and into words at spaces and tabs.  A phrase of two or three words that
occurs ``LEAST`` times or more in pieces of one language is a candidate.

1. Words are counted for every language (``word_counts``).
2. Apriori-safe candidates.  A phrase can only be frequent if its parts are.
   A first pass adds up hashed counts of word pairs in a table of bounded size
   (``sieve``): a pair whose slot stays under ``LEAST`` is rare for certain.
   A second pass does so for triples whose two pairs pass.  Slots that
   phrases share let some rare ones through, never drop a frequent one.  A
   third pass lists what passes, with how often it was met, dealt by range of
   phrase hashes (``windows``): the texts are read no more after it.  Windows
   met ``LEAST`` times that consist of frequent words are ``candidates``.
3. Candidates are dealt by the same ranges to tries of at most ``TRIE``
   phrases, built in tasks as double arrays over the base-256 digits of word
   numbers (``double_array``) and broadcast ``ROUND`` at a time, so what is
   broadcast has a fixed bound however many candidates there are.  Tasks read
   the windows of those tries' ranges only, move their states at once, digit
   by digit, with NumPy, and count accepting states (``occurrences``); counts
   are added over all shards of the windows.
4. Cuts, scores, containment and ranks are joins of the counted phrases.

A word is identified by a 64-bit hash of language and word.  A null text has
no words, a null language is ``und``.  Repeated rows count as often as they
occur; ties in score and frequency are ordered by the phrase's bytes.  Very
long texts are worked on whole, one at a time.  An empty table gives an
empty result; columns but the two named are ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.llm.arrow_words import Words, _large, _offsets, mix, pieces, small_batches, word_hashes
from synthweave.operators.ranking import top_n_per_group
from synthweave.session import checkpoint_dir, stored

LEAST = 10
MOST = 2000
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
PIECE_BYTES = 6 << 20
SIEVE_BITS = 16, 28     # slots of a sieve: about one per word of the corpus, 2 ** 28 (a broadcast of 32 MB) at most
RANGES = 1 << 8         # ranges of slots: one row of a piece's counts for each
CHUNK = 1 << 12         # counters that travel as one row
TRIE = 1 << 18          # phrases of one trie
ROUND = 4               # tries broadcast together
HELD = 1 << 19          # windows that a task gathers before it sends them
RANGE_WORDS = 1 << 20   # words of the corpus to a range of phrase hashes; 32 ranges at least
SLICE = 1 << 15         # windows of one row
WINDOWS = "size int, data binary, part int"
_U = np.uint64

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Pieces:
    """Words of a run of texts: their language-bound hashes, and how many words each has from itself to its piece's end."""

    words: Words
    symbol: np.ndarray
    left: np.ndarray


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def split(texts: pa.Array, langs: pa.Array) -> Pieces:
    """Words and pieces of every text."""
    texts = _large(texts)
    offs, data = _offsets(texts), texts.buffers()[2]
    buf = _LOWER[np.frombuffer(data, np.uint8)[offs[0]:offs[-1]]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    kind = _KIND[buf]
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = kind == 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    w = Words(buf, start, end, np.searchsorted(start, offs))
    coded = langs.dictionary_encode()
    salt = np.array([_language_hash(x) for x in coded.dictionary.to_pylist()], np.uint64)
    of_text = salt[coded.indices.to_numpy(zero_copy_only=False)] if len(salt) else np.zeros(0, np.uint64)
    symbol = mix(word_hashes(w) ^ of_text[w.doc])
    breaks = np.flatnonzero(kind == 2)
    before = np.searchsorted(breaks, start)
    new = np.ones(len(start), bool)
    new[1:] = before[1:] != before[:-1]
    new[w.first[:-1][w.counts > 0]] = True
    head = np.append(np.flatnonzero(new), len(start))
    left = np.repeat(head[1:], np.diff(head)) - np.arange(len(start))
    return Pieces(w, symbol, left)


def _gathered(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of ``(text, lang)`` joined to about ``limit`` bytes of text."""
    held, size = [], 0
    for piece in pieces(batches, "text", limit=limit // 2):
        held.append(piece)
        size += int(np.diff(_offsets(_large(piece.column(0)))[[0, -1]])[0])
        if size >= limit // 2:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _split_all(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Pieces, pa.RecordBatch]]:
    for piece in _gathered(batches):
        yield split(piece.column(0), piece.column(1)), piece


def _groups(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one of each distinct value, and how often it occurs."""
    order = np.argsort(value)
    head = np.flatnonzero(np.append(True, value[order][1:] != value[order][:-1])[:len(order)])
    return order[head], np.diff(np.append(head, len(order)))


def word_counts(texts: DataFrame) -> DataFrame:
    """``(symbol, lang, word, n)`` over all texts ``(text, lang)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, piece in _split_all(batches):
            one, n = _groups(p.symbol)
            size = p.words.end[one] - p.words.start[one]
            stop = np.cumsum(size)
            flat = p.words.buf[np.repeat(p.words.start[one] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
            word = pa.Array.from_buffers(pa.string(), len(one), [None, pa.py_buffer(np.append(0, stop).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            lang = piece.column(1).take(pa.array(p.words.doc[one]))
            yield pa.RecordBatch.from_arrays([pa.array(p.symbol[one].view(np.int64)), lang, word, pa.array(n)], ["symbol", "lang", "word", "n"])

    return (texts.mapInArrow(run, "symbol bigint, lang string, word string, n bigint")
            .groupBy("symbol", "lang", "word").agg(F.sum("n").alias("n")))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9E3779B97F4A7C15) + b)


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """Slots of hashes in a table of ``2 ** bits``."""
    return (h >> _U(64 - bits)).astype(np.int64)


def _encoded(values: np.ndarray) -> bytes:
    """One chunk of counters, as numbers or as places and numbers, whichever is shorter."""
    at = np.flatnonzero(values)
    dense, sparse = values.astype("<i8").tobytes(), at.astype("<u2").tobytes() + values[at].astype("<i8").tobytes()
    return b"d" + dense if len(dense) <= len(sparse) else b"s" + sparse


def _add(total: np.ndarray, data: bytes) -> None:
    if data[:1] == b"d":
        values = np.frombuffer(data, "<i8", offset=1)
        total[:len(values)] += values
    else:
        n = (len(data) - 1) // 10
        total[np.frombuffer(data, "<u2", n, 1)] += np.frombuffer(data, "<i8", n, 1 + 2 * n)


class Sieve:
    """One bit per slot: whether phrases of that hash slot may be frequent."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def passes(self, h: np.ndarray) -> np.ndarray:
        slot = _slots(h, self.bits)
        return (self.packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def phrase_hashes(p: Pieces, size: int, passed: Sieve | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all phrases of ``size`` words; of triples only those whose pairs pass the sieve ``passed``."""
    at = np.flatnonzero(p.left >= 2)
    pair = _pair_hash(p.symbol[at], p.symbol[at + 1])
    if size == 2:
        return at, pair
    good = passed.passes(pair)
    fine = np.zeros(len(p.symbol) + 1, bool)
    fine[at[good]] = True
    keep = good & fine[at + 1] & (p.left[at] >= 3)
    at, pair = at[keep], pair[keep]
    return at, _pair_hash(pair, p.symbol[at + 2])


def sieve(texts: DataFrame, size: int, bits: int, least: int = LEAST, passed: Sieve | None = None) -> Sieve:
    """Which of ``2 ** bits`` slots hold ``least`` phrases or more, over all texts.

    Tasks send the slots they met, with counts clipped at ``least`` (100 at
    most), which lets nothing frequent go; sums are made slot range by slot
    range.
    """
    least = min(least, 100)
    width = max((1 << bits) // RANGES, 8)                                 # slots of a range
    sent = texts.sparkSession.sparkContext.broadcast(passed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, _ in _split_all(batches):
            _, h = phrase_hashes(p, size, sent.value)
            slot = np.sort(_slots(h, bits))
            head = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[:len(slot)])
            slot, n = slot[head], np.minimum(np.diff(np.append(head, len(slot))), least).astype(np.uint8)
            cut = np.searchsorted(slot, np.arange(0, (1 << bits) + 1, width))
            low = (slot % width).astype("<u4")
            used = np.flatnonzero(np.diff(cut))
            data = [low[cut[c]:cut[c + 1]].tobytes() + n[cut[c]:cut[c + 1]].tobytes() for c in used.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(data, pa.binary())], ["part", "data"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = held.setdefault(c, np.zeros(width, np.uint8))
                m = len(data) // 5
                at = np.frombuffer(data, "<u4", m)
                total[at] = np.minimum(total[at] + np.frombuffer(data, np.uint8, m, 4 * m), least)     # under 256: each is clipped
        for c, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["part", "data"])

    schema = "part int, data binary"
    rows = texts.mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).toArrow()         # 2 ** bits / 8 bytes at most
    out = np.zeros((1 << bits) // 8, np.uint8)
    for c, data in zip(rows.column("part").to_pylist(), rows.column("data").to_pylist()):
        out[c * width // 8:(c + 1) * width // 8] = np.frombuffer(data, np.uint8)
    sent.unpersist()
    return Sieve(bits, out)


def _added(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their rows, last columns added up."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])[:len(h)])
    out = rows[order[head]]
    if len(head):
        out[:, -1] = np.add.reduceat(rows[order, -1], head)
    return h[head], out


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """Hashes of windows ``(s1, s2[, s3], n)``, as ``phrase_hashes`` has them."""
    h = _pair_hash(rows[:, 0], rows[:, 1])
    return h if rows.shape[1] == 3 else _pair_hash(h, rows[:, 2])


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.uint64).reshape(-1, size + 1)


def windows(texts: DataFrame, two: Sieve, three: Sieve, ranges: int) -> DataFrame:
    """All windows of two and three words that pass the sieves, ``(size, data, part)``: packed rows ``s1, s2[, s3], n`` of one range of phrase hashes.

    One pass over the texts.  Each task sends what it met packed by range;
    equal windows of a range meet and their numbers are added.  The table is
    written by range, so that a reader of some ranges opens no others.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((two, three))
    starts = np.arange(ranges, dtype=np.uint64) * _U((1 << 64) // ranges)

    def dealt(held: dict) -> Iterator[pa.RecordBatch]:
        for size, found in held.items():
            if found:
                h, rows = _added(*(np.concatenate(x) for x in zip(*found)))
                cut = np.append(np.searchsorted(h, starts), len(h))
                used = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), size, np.int32)), pa.array([rows[cut[c]:cut[c + 1]].tobytes() for c in used.tolist()], pa.binary()),
                                                  pa.array(used.astype(np.int32))], ["size", "data", "part"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, triples = sent.value
        held, count = {2: [], 3: []}, 0
        for p, _ in _split_all(batches):
            for size, kept, known in ((2, pairs, None), (3, triples, pairs)):
                at, h = phrase_hashes(p, size, known)
                take = kept.passes(h)
                at, h = at[take], h[take]
                one, n = _groups(h)
                at = at[one]
                held[size].append((h[one], np.stack([*(p.symbol[at + i] for i in range(size)), n.astype(np.uint64)], axis=1)))
                count += len(one)
            if count >= HELD:
                yield from dealt(held)
                held, count = {2: [], 3: []}, 0
        yield from dealt(held)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(key: tuple, found: list) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(found)
            _, rows = _added(_row_hashes(rows), rows)
            cut = [rows[i:i + SLICE].tobytes() for i in range(0, len(rows), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(cut), pa.int32()), pa.array(cut, pa.binary()), pa.array([key[0]] * len(cut), pa.int32())], ["size", "data", "part"])

        key, held = None, []
        for batch in batches:
            for size, data, part in zip(*(x.to_pylist() for x in batch.columns)):
                if held and key != (part, size):
                    yield from merged(key, held)
                    held = []
                key = part, size
                held.append(_unpacked(data, size))
        if held:
            yield from merged(key, held)

    path = f"{checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}"
    (texts.mapInArrow(run, WINDOWS).repartition("part").sortWithinPartitions("part", "size").mapInArrow(add, WINDOWS)
     .write.partitionBy("part").parquet(path))
    sent.unpersist()
    return spark.read.schema(WINDOWS).parquet(path)


def sieved(texts: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """The ``windows`` of the texts that can be frequent, in as many ranges as their number of words asks."""
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = min(max(total.bit_length(), SIEVE_BITS[0]), SIEVE_BITS[1])
    two = sieve(texts, 2, bits, least)
    three = sieve(texts, 3, bits, least, two)
    return windows(texts, two, three, max(32, 1 << (total // RANGE_WORDS).bit_length()))


def candidates(met: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """``(s1, s2, s3, part)``, ``s3`` null for pairs: a superset of all phrases that occur ``least`` times, made of ``words``."""
    frequent = words.where(F.col("n") >= least).select("symbol")

    def listed(size: int) -> DataFrame:
        names = [f"s{i + 1}" for i in range(size)]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data, part in zip(*(x.to_pylist() for x in batch.columns)):
                    rows = _unpacked(data, size)
                    rows = rows[rows[:, -1] >= least].view(np.int64)
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(size)), pa.array(np.full(len(rows), part, np.int32))], [*names, "part"])

        return met.where(F.col("size") == size).select("data", "part").mapInArrow(run, ", ".join(f"{c} bigint" for c in names) + ", part int")

    pairs = listed(2)
    for c in ("s1", "s2"):
        pairs = pairs.join(frequent.withColumnRenamed("symbol", c), c, "left_semi")
    pairs = stored(pairs.select("s1", "s2", "part"))
    triples = (listed(3).join(pairs, ["s1", "s2"], "left_semi")
               .join(pairs.select(F.col("s1").alias("s2"), F.col("s2").alias("s3")), ["s2", "s3"], "left_semi"))
    return stored(pairs.select("s1", "s2", F.lit(None).cast("bigint").alias("s3"), "part").unionByName(triples.select("s1", "s2", "s3", "part")))


def double_array(sequences: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays ``base``, ``check`` and ``accept`` of the trie of digit ``sequences[i, :length[i]]``.

    From state ``s`` the digit ``c`` leads to ``base[s] + c`` if ``check``
    there is ``s``; ``accept`` is the number of the sequence that ends in a
    state, else -1.  The root is state 0.  Nodes with many children are
    placed first, those with one child fill what is left.
    """
    node, known = np.zeros(len(sequences), np.int64), 1
    parents, digits = [], []
    ends = np.zeros(len(sequences), np.int64)
    live = np.arange(len(sequences))
    for depth in range(sequences.shape[1]):
        live = live[length[live] > depth]
        key, back = np.unique(node[live] * 256 + sequences[live, depth], return_inverse=True)
        parents.append(key // 256)
        digits.append(key % 256)
        node[live] = known + back
        known += len(key)
        done = live[length[live] == depth + 1]
        ends[done] = node[done]
    parent, digit = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, digits))   # of nodes 1, 2, ...; sorted by parent
    inner, first, count = np.unique(parent, return_index=True, return_counts=True)
    rng = np.random.default_rng(len(parent))
    top = 512 + 2 * known                         # slots from 256 on are used, so that no base is negative
    used = np.zeros(top + 512, bool)
    used[:256] = True                             # the root's own slot, and the pad
    begin = np.zeros(len(inner), np.int64)
    for i in np.argsort(-count, kind="stable")[:int((count > 1).sum())]:
        c = digit[first[i]:first[i] + count[i]]
        for tries in (16, 64, 256, 1024):
            b = rng.integers(256, top - 256, tries)
            free = np.flatnonzero(~used[b[:, None] + c].any(axis=1))
            if len(free):
                begin[i] = b[free[0]]
                break
        else:                                     # no gap found: new slots at the end
            begin[i] = top
            used = np.append(used, np.zeros(256, bool))
            top += 256
        used[begin[i] + c] = True
    single = np.flatnonzero(count == 1)
    room = np.flatnonzero(~used[256:top]) + 256
    if len(room) < len(single):
        room = np.append(room, np.arange(top, top + len(single) - len(room)))
    begin[single] = room[:len(single)] - digit[first[single]]
    slot = np.zeros(known, np.int64)
    base_of = np.zeros(known, np.int64)
    base_of[inner] = begin
    slot[1:] = base_of[parent] + digit
    size = int(slot.max(initial=0)) + 257
    base, check, accept = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[slot] = base_of
    check[slot[1:]] = slot[parent]
    check[0] = -1
    accept[slot[ends]] = np.arange(len(sequences))
    return base, check, accept


@dataclass
class Trie:
    """A double array over word numbers; ``vocabulary`` holds the sorted word hashes, ``phrases`` the word numbers of each phrase."""

    vocabulary: np.ndarray
    phrases: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray

    @staticmethod
    def of(symbols: np.ndarray, size: np.ndarray) -> Trie:
        """Trie of the phrases ``symbols[i, :size[i]]``."""
        used = np.arange(symbols.shape[1]) < size[:, None]
        vocabulary = np.unique(symbols[used])
        phrases = np.where(used, np.searchsorted(vocabulary, symbols), -1).astype(np.int32)
        per = Trie.digits_of(len(vocabulary))
        shifts = 8 * np.arange(per)[::-1]
        digits = ((phrases[:, :, None] >> shifts) & 255).reshape(len(phrases), -1)
        return Trie(vocabulary, phrases, *double_array(digits, size * per))

    @staticmethod
    def digits_of(words: int) -> int:
        return max(1, (max(words - 1, 1).bit_length() + 7) // 8)

    def _moved(self, at: np.ndarray, state: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and states after one more word, digit by digit; those without a way are left out."""
        for shift in range(8 * (Trie.digits_of(len(self.vocabulary)) - 1), -1, -8):
            to = self.base[state] + ((number >> shift) & 255).astype(np.int32)
            go = self.check[to] == state
            at, state, number = at[go], to[go], number[go]
        return at, state

    def _numbers(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = np.minimum(np.searchsorted(self.vocabulary, symbol), len(self.vocabulary) - 1)
        return number, self.vocabulary[number] == symbol

    def count(self, p: Pieces) -> np.ndarray:
        """How often each phrase occurs: the states of all positions move together, one digit at a time."""
        out = np.zeros(len(self.phrases), np.int64)
        if not len(p.symbol) or not len(out):
            return out
        number, known = self._numbers(p.symbol)
        at = np.flatnonzero(known & (p.left >= 2))
        state = np.zeros(len(at), np.int32)
        for word in range(self.phrases.shape[1]):
            if word:
                go = (p.left[at] > word) & known[np.minimum(at + word, len(known) - 1)]
                at, state = at[go], state[go]
            at, state = self._moved(at, state, number[at + word])
            told = self.accept[state]
            out += np.bincount(told[told >= 0], minlength=len(out))
        return out

    def count_windows(self, rows: np.ndarray) -> np.ndarray:
        """How often each phrase was met in windows ``(s1, s2[, s3], n)``, each one phrase."""
        out = np.zeros(len(self.phrases), np.int64)
        if not len(rows) or not len(out):
            return out
        at, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
        for word in range(rows.shape[1] - 1):
            number, known = self._numbers(rows[at, word])
            at, state = self._moved(at[known], state[known], number[known])
        told = self.accept[state]
        np.add.at(out, told[told >= 0], rows[at[told >= 0], -1].view(np.int64))
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Trie:
        return Trie(**np.load(io.BytesIO(data)))


def dealt(phrases: DataFrame, most: int = TRIE) -> list[tuple[int, int, int]]:
    """``(part, trie, split)``: the trie of each range's phrases, about ``most`` to a trie.

    Small ranges share one; a larger range than that takes ``split`` tries, numbered on.
    """
    out, trie, room = [], -1, 0
    for part, n in sorted(tuple(r) for r in phrases.groupBy("part").count().collect()):
        if n > room:
            trie, room = trie + 1, most
        split = -(-n // most)
        out.append((part, trie, split))
        trie, room = trie + split - 1, max(room - n, 0)
    return out


def tries(phrases: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """``(trie, data)``: the phrases dealt to tries as ``ranges`` says, each built in a task."""

    def build(table: pa.Table) -> pa.Table:
        rest = table.column("s3")
        size = np.where(rest.is_null().to_numpy(zero_copy_only=False), 2, 3)
        symbols = np.stack([table.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("s1", "s2", "s3")], axis=1)
        return pa.table({"trie": table.column("trie")[:1], "data": pa.array([Trie.of(symbols, size).to_bytes()], pa.binary())})

    table = phrases.sparkSession.createDataFrame(ranges, "part int, trie int, split int")
    return (phrases.join(table.hint("broadcast"), "part").withColumn("trie", F.expr("trie + cast(pmod(xxhash64(s1, s2, s3), split) as int)"))
            .select("trie", "s1", "s2", "s3").groupBy("trie").applyInArrow(build, "trie int, data binary"))


def occurrences(met: DataFrame, phrases: DataFrame, least: int = LEAST, trie: int = TRIE, together: int = ROUND) -> DataFrame:
    """``(s1, s2, s3, a)`` of the phrases that occur ``least`` times or more; ``together`` tries read the windows of their ranges."""
    spark = met.sparkSession
    ranges = dealt(phrases, trie)
    built = stored(tries(phrases, ranges))
    schema = "s1 bigint, s2 bigint, s3 bigint, a bigint"
    out = spark.createDataFrame([], schema)
    for lo in range(0, max((first + split for _, first, split in ranges), default=0), together):
        hi = lo + together
        chosen = built.where((F.col("trie") >= lo) & (F.col("trie") < hi)).toArrow()
        own = {part: range(max(first, lo), min(first + split, hi)) for part, first, split in ranges if first < hi and first + split > lo}
        sent = spark.sparkContext.broadcast((list(zip(chosen.column("trie").to_pylist(), chosen.column("data").to_pylist())), own))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {i: Trie.from_bytes(x) for i, x in sent.value[0]}
            totals = {i: np.zeros(len(t.phrases), np.int64) for i, t in held.items()}
            for batch in batches:
                for size, data, part in zip(*(x.to_pylist() for x in batch.columns)):
                    rows = _unpacked(data, size)
                    for i in sent.value[1].get(part, ()):
                        if i in held:
                            totals[i] += held[i].count_windows(rows)
            for i, total in totals.items():
                parts = [total[at:at + CHUNK] for at in range(0, len(total), CHUNK)]
                used = [c for c, x in enumerate(parts) if x.any()]
                if used:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(used), pa.int32()), pa.array(used, pa.int32()),
                                                      pa.array([_encoded(parts[c]) for c in used], pa.binary())], ["trie", "chunk", "data"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for i, c, data in zip(*(x.to_pylist() for x in batch.columns)):
                    _add(held.setdefault((i, c), np.zeros(CHUNK, np.int64)), data)
            known = {i: x for i, x in sent.value[0] if any(k[0] == i for k in held)}
            for i, data in known.items():
                t = Trie.from_bytes(data)
                for (k, c), total in held.items():
                    if k == i:
                        hit = np.flatnonzero(total >= least)
                        ids = t.phrases[hit + c * CHUNK]
                        s = t.vocabulary[np.maximum(ids, 0)].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(s[:, 2], mask=ids[:, 2] < 0), pa.array(total[hit])],
                                                         ["s1", "s2", "s3", "a"])

        counted = (met.where(F.col("part").between(min(own), max(own))).select("size", "data", "part")
                   .mapInArrow(run, "trie int, chunk int, data binary").repartition("trie", "chunk").mapInArrow(add, schema))
        out = out.union(stored(counted))
        sent.unpersist()
    return out


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), in exact decimals; at most 1000000."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right)).cast("bigint")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int = MOST) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``most`` best phrases.

    Frequencies must stay under 10 ** 16; beyond, the cast to decimals fails.
    """
    texts = small_batches(df).select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))
    words = stored(word_counts(texts))
    met = sieved(texts, words, least)
    found = stored(occurrences(met, candidates(met, words, least), least))
    frequent = words.where(F.col("n") >= least)
    one = lambda s, f: frequent.select(F.col("symbol").alias(s), F.col("n").alias(f))
    pairs = found.where("s3 is null").drop("s3")
    triples = found.where("s3 is not null")
    two = lambda x, y, f: pairs.select(F.col("s1").alias(x), F.col("s2").alias(y), F.col("a").alias(f))
    # a pair inside a triple that is half as frequent goes
    inside = (triples.select(F.explode(F.array(F.struct("s1", "s2"), F.struct(F.col("s2").alias("s1"), F.col("s3").alias("s2")))).alias("p"), "a")
              .groupBy("p.s1", "p.s2").agg(F.max("a").alias("longer")))
    pairs_left = pairs.join(inside, ["s1", "s2"], "left").where("longer is null or 100 * longer < 50 * a").drop("longer")
    cut_pairs = (pairs_left.join(one("s1", "l"), "s1").join(one("s2", "r"), "s2")
                 .select("s1", "s2", F.lit(None).cast("bigint").alias("s3"), "a", F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), F.lit(1).alias("k"), "l", "r").alias("cut")))
    cut_triples = (triples.join(one("s1", "l1"), "s1").join(two("s2", "s3", "r1"), ["s2", "s3"]).join(two("s1", "s2", "l2"), ["s1", "s2"]).join(one("s3", "r2"), "s3")
                   .select("s1", "s2", "s3", "a", F.least(*[F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                                                                     F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]).alias("cut")))
    named = cut_pairs.unionByName(cut_triples)
    for i in (1, 2, 3):
        spelt = frequent.select(F.col("symbol").alias(f"s{i}"), F.col("word").alias(f"w{i}"), *([F.col("lang")] if i == 1 else []))
        named = named.join(spelt, f"s{i}", "inner" if i < 3 else "left")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    scored = named.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = top_n_per_group(scored, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], most, out="rank")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, most: int = MOST) -> str:
    """The query's rows in DuckDB."""
    sums = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS phrase FROM spots WHERE i + {k - 1} <= len(w)" for k in (1, 2, 3))
    cut = lambda k, left, right: (
        f"SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, {k} AS cut, 1000000 * c.a::hugeint * c.a // (l.a::hugeint * r.a) AS score "
        f"FROM c JOIN f l ON l.lang = c.lang AND l.phrase = {left} JOIN f r ON r.lang = c.lang AND r.phrase = {right}")
    word = lambda i: f"split_part(c.phrase, ' ', {i})"
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM ({sums}) GROUP BY ALL),
n AS (SELECT lang, sum(a)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= {least}),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([{word(1)} || ' ' || {word(2)}, {word(2)} || ' ' || {word(3)}]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
cuts AS ({cut(1, word(1), word(2))} WHERE c.k = 2
         UNION ALL {cut(1, word(1), f"{word(2)} || ' ' || {word(3)}")} WHERE c.k = 3
         UNION ALL {cut(2, f"{word(1)} || ' ' || {word(2)}", word(3))} WHERE c.k = 3),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
good AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * low.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::bigint AS score
FROM good JOIN n USING (lang) QUALIFY rank <= {most}"""
