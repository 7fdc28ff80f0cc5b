"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become integers, ``floor(64 * c) + 1000000``, so sums, means and
deviations are exact.  The leading eigenvectors of the covariance come from a
block of directions much narrower than the vectors:

1. A filter damps the unwanted part of the spectrum: the Chebyshev polynomial
   of degree ``DEGREE`` over the interval from a lower bound (a short Lanczos
   run) to the block's least Ritz value, applied by its recurrence.  Every
   step is one distributed pass that adds up ``Z' (Z Q)`` over the centred
   rows ``Z``; no covariance matrix is ever formed.
2. QR and Rayleigh-Ritz give the block's best eigenpairs.
3. The residuals ``V q - e q`` certify them.  The block grows when a few
   rounds do not suffice (equal or nearly equal eigenvalues at its border);
   a block as wide as the vectors is exact.

The driver holds the block (dimensions x components), whatever the number of
rows.  Tasks add up their own rows first and pass on one block each; ``ADDERS``
tasks sum those one by one, in order of partitions, and the driver adds their
few results.

Rows whose vector is null, empty, or holds null or non-finite entries are
dropped, and so are those of another length than most (of lengths equally
frequent, the longest counts).  Repeated rows count as often as they occur;
null ids stay.  Directions without variance (up to rounding) have no
component, so equal vectors, one vector or an empty table give an empty
result.  Columns but the two named are ignored.  Entries must stay under
2 ** 40 in magnitude, and deviations under 2 ** 63; beyond, the job fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthweave.llm.arrow_words import small_batches
from synthweave.session import stored

COMPONENTS = 32
GUARD = 16              # directions that the block has besides the wanted ones
DEGREE = 8
LANCZOS = 8
ROUNDS = 6              # before the block grows
CERTIFIED = 1e-13       # residual norm, of the largest eigenvalue
GOOD = 1e-10            # residuals that no longer shrink are accepted under this
FLAT = 1e-12            # eigenvalues under this, of the largest, are no variance
ADDERS = 4              # tasks that add up the blocks of all others


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(id, x)``: the rows that take part, entries as exact integers."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = (small_batches(df).select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
            .where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
            .select("id", F.transform("v", lambda c: F.floor(c * 64).cast("bigint") + F.lit(1_000_000).cast("bigint")).alias("x")))
    length = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).select("m.d").scalar()
    return stored(rows.where(F.size("x") == length))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.schema.names.index("x"))
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], adders: int = ADDERS) -> np.ndarray | None:
    """The sum of ``part(x)`` (a float array of fixed shape) over blocks ``x`` of all rows, flat; None without rows.

    One row for each task is shuffled, one for each adder collected.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = None
        for batch in batches:
            if batch.num_rows:
                one = part(_matrix(batch))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], ["task", "data"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = None, None
        for batch in batches:
            for task, data in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(data)
                total, least = (values.copy(), task) if total is None else (total + values, least)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "data"])

    schema = "task int, data binary"
    out = rows.select("x").mapInArrow(run, schema).repartition(adders).sortWithinPartitions("task").mapInArrow(add, schema).toArrow()
    if not out.num_rows:
        return None
    return np.sum([np.frombuffer(d) for _, d in sorted(zip(out.column("task").to_pylist(), out.column("data").to_pylist()))], axis=0)


@dataclass
class Centre:
    """Number of rows and exact sums of every dimension."""

    n: int
    sums: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: 64-bit integers, Python's where those could overflow."""
        wide = self.n * max(int(np.abs(x).max(initial=0)), 1) >= 1 << 62
        return x.astype(object) * self.n - np.array(self.sums, object) if wide else x * self.n - np.array(self.sums, np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Centred rows, rounded once."""
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        z = self.scaled(x)
        if z.dtype == object or float(np.abs(z).max(initial=0)) ** 2 * z.shape[1] >= 2.0 ** 62:
            total = (z.astype(object) ** 2).sum(axis=1)
            if max(total, default=0) >= 1 << 63:
                raise OverflowError("a deviation passes 64 bits")
            return total.astype(np.int64)
        return (z * z).sum(axis=1)


def centre(rows: DataFrame) -> Centre:
    """Exact column sums: each task adds its own rows, the cluster adds one row for each task and dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                one = _matrix(batch).sum(axis=0, dtype=np.int64)
                total, n = one if total is None else total + one, n + batch.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.append(n, total))], ["dim", "total"])

    sums = rows.select("x").mapInArrow(run, "dim int, total bigint").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()
    of = {r["dim"]: int(r["s"]) for r in sums}
    return Centre(of.pop(-1, 0), [of[i] for i in range(len(of))])


class Covariance:
    """Products of the covariance with narrow blocks, one distributed pass each."""

    def __init__(self, rows: DataFrame, at: Centre):
        self.rows, self.at, self.dims, self.passes = rows, at, len(at.sums), 0

    def times(self, block: np.ndarray) -> np.ndarray:
        at = self.at
        sent = self.rows.sparkSession.sparkContext.broadcast(block)       # dimensions x block, whatever the rows

        def part(x: np.ndarray) -> np.ndarray:
            z = at.rows(x)
            return z.T @ (z @ sent.value)

        out = added(self.rows, part).reshape(block.shape) / at.n
        sent.unpersist()
        self.passes += 1
        return out

    def trace(self) -> float:
        at = self.at
        return float(added(self.rows, lambda x: (at.rows(x) ** 2).sum(axis=0)).sum()) / at.n


def lanczos_lower_bound(v: Covariance, steps: int, rng: np.random.Generator) -> float:
    """A lower bound of the spectrum for all practical purposes: the least Ritz value of a short run, less its residual."""
    q = rng.normal(size=(v.dims, 1))
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, v.dims)):
        w = v.times(basis[-1])
        alpha.append(float((basis[-1].T @ w)[0, 0]))
        held = np.concatenate(basis, axis=1)
        for _ in range(2):
            w = w - held @ (held.T @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-14 * max(map(abs, alpha)):
            break
        basis.append(w / beta[-1])
    t = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1) + np.diag(beta[:len(alpha) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beta[-1])


def chebyshev(v: Covariance, block: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The block filtered by the polynomial that stays small on ``low..cut`` and grows above, scaled to 1 at ``top``."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = half / (top - middle)
    tau = 2 / sigma
    before, now = block, (v.times(block) - middle * block) * (sigma / half)
    for _ in range(degree - 1):
        nxt = 1 / (tau - sigma)
        before, now = now, (v.times(now) - middle * now) * (2 * nxt / half) - (sigma * nxt) * before
        sigma = nxt
    return now


def rayleigh_ritz(v: Covariance, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors and residual norms of the block's span."""
    q, _ = np.linalg.qr(block)
    w = v.times(q)
    small = q.T @ w
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, w = q @ turn, w @ turn
    return values, q, np.linalg.norm(w - q * values, axis=0)


def leading(v: Covariance, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Certified eigenvalues (falling), unit eigenvectors and residual norms: ``wanted`` at most, none without variance."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, v.dims)
    block = rng.normal(size=(v.dims, min(v.dims, wanted + guard)))
    values, q, rest = rayleigh_ritz(v, block)
    if values[0] <= 0:
        return values[:0], q[:, :0], rest[:0]
    floor = lanczos_lower_bound(v, LANCZOS, rng)
    last, rounds = np.inf, 0
    while True:
        k = int((values[:wanted] > FLAT * values[0]).sum())
        worst = float(rest[:k].max()) / values[0]
        full = q.shape[1] == v.dims                                       # the whole space: Rayleigh-Ritz is exact
        if worst <= CERTIFIED or (worst <= GOOD and worst > last / 2) or full and rounds:
            return values[:k], q[:, :k], rest[:k]
        if rounds >= ROUNDS or full:
            more = v.dims if full else min(v.dims, 2 * q.shape[1])
            q = np.concatenate([q, rng.normal(size=(v.dims, more - q.shape[1]))], axis=1)
            rounds, last = 0, np.inf
            if more == v.dims:
                rounds = 1
                values, q, rest = rayleigh_ritz(v, np.linalg.qr(q)[0])
                continue
        cut = max(float(values[-1]), 1e-6 * values[0])
        low = floor if floor < 0.999 * cut else 0.0
        last, rounds = worst, rounds + 1
        top = max(values[0], 1.001 * cut)
        values, q, rest = rayleigh_ritz(v, chebyshev(v, q, degree, low, cut, top))


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: one row for each vector and component."""
    spark = df.sparkSession
    rows = integer_vectors(df, key, vector)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"`{key}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    at = centre(rows)
    if not at.n:
        return spark.createDataFrame([], schema)
    v = Covariance(rows, at)
    values, vectors, _ = leading(v, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    explained = values / v.trace()
    onto = vectors / np.sqrt(values)
    mean = added(rows, lambda x: (at.rows(x) @ onto).sum(axis=0)) / at.n
    spread = added(rows, lambda x: (lambda w: w.T @ w)(at.rows(x) @ onto - mean)).reshape(k, k) / at.n
    error = float(np.abs(spread - np.eye(k)).max())
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                x = _matrix(batch)
                of = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, at.n, np.int64)),
                     pa.array(np.repeat(at.deviations(x), k)), pa.array((at.rows(x) @ onto).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names)

    return rows.select("id", "x").mapInArrow(run, schema)
