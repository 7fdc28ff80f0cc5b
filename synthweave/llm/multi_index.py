"""Approximate nearest neighbours with an inverted multi-index.

Vectors are cut in two halves and each half is quantised by its own k-means
codebook, which divides the space into ``k * k`` cells.  A query walks the
pairs of centroids in order of summed distance with a heap until the cells
visited hold enough vectors; those are reranked by exact Euclidean distance.
Reranking runs in blocks: about ``BLOCK`` queries against about ``BLOCK``
entries of one first-half centroid, as one matrix product each.  Queries
share a block with those of the same and of neighbouring first-half
centroids, and an entry is sent to a block only if one of its queries visits
the entry's cell, so what is shuffled grows with the visits.

Codebooks are fitted on a bounded sample (``SAMPLE`` vectors, chosen by
hash); every vector is indexed.  Equal vectors are one entry of the index:
only their smallest ``n + 1`` ids can be among any query's nearest ``n``, so
only those are kept -- an exact reduction that also splits the largest cells.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do vectors of another dimension than the longest-standing one (the
most frequent, ties to the smaller).  Ties go to the smaller id; repeated
rows of one id count once, and of an id with several vectors the smallest
asks while all can be found; empty tables give empty results.  Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthweave.session import materialize

SAMPLE = 20_000
CODEBOOK = 64           # centroids of each half
VISIT = 1_500           # distinct vectors that the visited cells hold at least,
SHARE = 0.42            # or this share of the index: vectors without clusters need it for a recall of 0.9
BLOCK = 4_096
ROUNDS = 12


def valid(vector: Column) -> Column:
    """Usable vectors: no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm on the fitting sample; empty clusters keep their centroid."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(points, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit(vectors: DataFrame, codebook: int = CODEBOOK, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The two codebooks, from at most about ``sample`` vectors."""
    share = min(1.0, sample / max(vectors.count(), 1))
    picked = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * sample)
    points = np.array([r["vector"] for r in picked.orderBy("id").select("vector").collect()], np.float64)
    half = points.shape[1] // 2 if len(points) else 0
    return kmeans(points[:, :half], codebook), kmeans(points[:, half:], codebook)


def walk(first: np.ndarray, second: np.ndarray, sizes: dict[int, int], visit: int) -> list[int]:
    """Cells in order of ``first[i] + second[j]`` until they hold ``visit`` vectors (or all cells are seen).

    The classic traversal: a heap of frontier pairs, each popped pair
    pushing its right and lower neighbour once both predecessors are out.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a], second[b]
    heap, pushed, cells, held = [(da[0] + db[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < visit:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(b) + int(b[j])
        if cell in sizes:
            cells.append(cell)
            held += sizes[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (da[x] + db[y], x, y))
    return cells


def query_blocks(first: np.ndarray, asked: dict[int, int], size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every first-half centroid's queries.

    Centroids are taken along their main axis and share a block until it
    holds ``size`` queries; a centroid with more gets blocks of its own.
    """
    centred = first - first.mean(axis=0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0]
    base, parts = np.zeros(len(first), np.int64), np.ones(len(first), np.int64)
    block = held = 0
    for line in np.argsort(centred @ axis, kind="stable").tolist():
        n = asked.get(line, 0)
        if held and held + n > size:
            block, held = block + 1, 0
        base[line], parts[line] = block, max(1, -(-n // size))
        if n > size:
            block, held = block + int(parts[line]), 0
        else:
            held += n
    return base, parts


def search(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", n: int = 10,
           codebook: int = CODEBOOK, visit: int = VISIT, share: float = SHARE, size: int = BLOCK) -> DataFrame:
    """``(query_id, rank, <key>, score)``: the ``n`` nearest found of every row for which ``queries`` holds."""
    spark = df.sparkSession
    base = (df.where(valid(F.col(f"`{vector}`")) & F.col(f"`{key}`").isNotNull())
            .select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), queries.alias("asks")))
    dims = sorted(base.groupBy(F.size("vector").alias("d")).count().collect(), key=lambda r: (-r["count"], r["d"]))
    schema = f"query_id bigint, rank int, `{key}` bigint, score double"
    if not dims or dims[0]["d"] < 1:
        return spark.createDataFrame([], schema)
    dim = dims[0]["d"]
    base = base.where(F.size("vector") == dim)
    if dim == 1:                                           # a second half that is 0 everywhere changes no distance
        dim, base = 2, base.withColumn("vector", F.concat("vector", F.array(F.lit(0.0))))
    # equal vectors: the n + 1 smallest ids stand for all
    digest = F.sha2(F.to_json(F.struct("vector")), 256)
    kept = (base.withColumn("same", digest).dropDuplicates(["id", "same"])
            .withColumn("r", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("r") <= n + 1))
    first, second = fit(base, codebook)
    half, books = dim // 2, spark.sparkContext.broadcast((first, second))   # 2 x codebook x dim / 2 doubles

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = _distances(x[:, :half], one).argmin(1) * len(two) + _distances(x[:, half:], two).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["id", "vector", "r", "cell"])

    index = materialize(kept.select("id", "vector", "r").mapInArrow(place, "id bigint, vector array<double>, r int, cell int"))
    sizes = {r["cell"]: r["count"] for r in index.where("r = 1").groupBy("cell").count().collect()}   # at most codebook^2
    row = len(second)
    lines: dict[int, int] = {}
    for cell, count in sizes.items():
        lines[cell // row] = lines.get(cell // row, 0) + count
    held = spark.sparkContext.broadcast((sizes, lines))
    goal = max(visit, int(share * sum(sizes.values())))
    asked = base.where(F.col("asks")).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = materialize(asked.select("id", "vector", F.lit(1).alias("r")).mapInArrow(place, "id bigint, vector array<double>, r int, cell int"))
    by_line = asked.groupBy((F.col("cell") / row).cast("int").alias("line")).count().collect()         # at most codebook
    blocks = spark.sparkContext.broadcast(query_blocks(first, {r["line"]: r["count"] for r in by_line}, size))

    def visit_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's block and the cells it visits."""
        one, two = books.value
        base, split = blocks.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x = _matrix(part.column(1))
                cells = [walk(a, b, held.value[0], goal) for a, b in zip(_distances(x[:, :half], one), _distances(x[:, half:], two))]
                line = part.column(2).to_numpy() // row
                block = base[line] + part.column(3).to_numpy() % split[line]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(block, pa.int64()), pa.array(cells, pa.list_(pa.int32()))],
                                                 ["query_id", "query", "asked", "cells"])

    walked = materialize(asked.select("id", "vector", "cell", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h"))
                         .mapInArrow(visit_cells, "query_id bigint, query array<double>, asked bigint, cells array<int>"))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each query, line (first-half centroid) and part of the line that it visits."""
        lines = held.value[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, line, salt, cells = [], [], [], []
                for i, seen in enumerate(part.column(3).to_pylist()):
                    of_line: dict[int, list[int]] = {}
                    for cell in seen:
                        of_line.setdefault(cell // row, []).append(cell)
                    for k, cs in of_line.items():
                        for s in range(-(-lines[k] // size)):
                            rows.append(i), line.append(k), salt.append(s), cells.append(cs)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in range(3)), pa.array(line, pa.int32()), pa.array(salt, pa.int32()),
                                                  pa.array(cells, pa.list_(pa.int32()))], ["query_id", "query", "asked", "line", "salt", "cells"])

    routed = walked.mapInArrow(route, "query_id bigint, query array<double>, asked bigint, line int, salt int, cells array<int>")
    line = (F.col("cell") / row).cast("int")
    parts = F.greatest(F.get(F.array(*[F.lit(-(-lines.get(i, 0) // size)) for i in range(len(first))]), line), F.lit(1))
    # a block's visited cells, once for each part of their line: a cell of many vectors is spread over the parts
    visited = (walked.select("asked", F.explode("cells").alias("cell")).distinct()
               .select("asked", "cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt")))
    entries = (index.withColumn("line", line).withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int"))
               .join(visited, ["cell", "salt"]))

    def rerank(asks: pa.Table, found: pa.Table) -> pa.Table:
        """Exact distances of a block's entries; per query the best ``n`` of the cells it visits."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asks.num_rows and found.num_rows:
            x, ids, cell = _matrix(found.column("vector").combine_chunks()), found.column("id").to_numpy(), found.column("cell").to_numpy()
            norm = (x * x).sum(1)
            where = {int(c): np.flatnonzero(cell == c) for c in np.unique(cell)}
            for at in range(0, asks.num_rows, 256):
                part = asks.slice(at, 256)
                q = _matrix(part.column("query").combine_chunks())
                rough = norm[None] - 2 * q @ x.T
                for i, (me, cells) in enumerate(zip(part.column("query_id").to_pylist(), part.column("cells").to_pylist())):
                    near = [where[c] for c in cells if c in where]
                    near = np.concatenate(near) if near else np.zeros(0, np.int64)
                    near = near[ids[near] != me]
                    if len(near) > n:
                        r = rough[i, near]
                        near = near[r <= np.partition(r, n - 1)[n - 1] + 1e-9 * (1 + norm.max() + (q[i] ** 2).sum())]
                    gap = x[near] - q[i]
                    d = np.sqrt((gap * gap).sum(1))
                    best = np.lexsort((ids[near], d))[:n]
                    out.append((np.full(len(best), me, np.int64), ids[near][best], d[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "id", "score"])

    on = ["asked", "line", "salt"]
    scored = (routed.groupBy(*on).cogroup(entries.select(*on, "id", "vector", "cell").groupBy(*on))
              .applyInArrow(rerank, "query_id bigint, id bigint, score double"))
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return (scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score"))
