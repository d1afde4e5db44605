"""Approximate nearest neighbours: an inverted multi-index.

Vectors are cut into two halves, each quantised by a codebook of its own; an entry
lives in the cell of its two centroids.  A query sorts the centroids of each half by
distance and walks the pairs by summed distance with a heap, until the cells seen
hold enough entries; those are reranked by exact inner product.  Inner products turn
into distances by one more coordinate, sqrt(M^2 - |x|^2), in the second half.

Codebooks grow with the table, to about ``per_cell`` entries in a cell.  They are fit on
at most ``sample`` vectors (smallest hash of their id); every vector is indexed.  How
much of the table a query visits is measured, not set: on the sample, the share of
entries in cells as near as those of the true neighbours, at the quantile ``recall``.  A
sample of S of N vectors stands for them by its S / N part of the nearest, so the share
falls as the table grows, and clustered tables need little of it.

Cells lie side by side in blocks of entries; a cell that is larger than a block is cut.
A query goes once to each block that holds cells it visits, with those cells marked, so
what is shuffled follows blocks, not cells; blocks grow with the table up to
``block_most`` entries, then their number does.  Equal vectors tie, so of each distinct
vector only the ``neighbours`` + 1 smallest ids can be in a result and only those are
indexed.

Defined results: vectors that are null, zero or hold null or non-finite components
take no part, nor do those whose length isn't that of most; scores are computed in
double precision on the original vectors; ties go to the smaller id; repeated ids
are entries of their own, and a query never finds its own id; columns other than
vec_id and embedding are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column, stash


@dataclass(frozen=True)
class MultiIndex:
    neighbours: int = 20
    every: int = 20  # queries: ids divisible by this
    recall: float = 0.96  # of the sample's neighbours, to measure how much a query visits
    per_cell: int = 8
    centroids_most: int = 512  # of each half: the cells' counts are held by the driver and the tasks
    sample: int = 20_000
    trials: int = 256  # queries of the sample that measure the share to visit
    rounds: int = 10
    blocks: int = 16  # that small tables are cut into
    block_least: int = 1024
    block_most: int = 65_536
    chunk: int = 256  # queries that travel together
    seed: int = 11


def _clean(vectors: DataFrame) -> DataFrame:
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)
    most = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1)
    return v.join(F.broadcast(most.select("dim")), F.size("v") == F.col("dim")).select("id", "v")


def _augment(x: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))
    return x[:, :half], np.column_stack([x[:, half:], rest])


def _query_halves(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = q.shape[1] // 2
    return q[:, :half], np.column_stack([q[:, half:], np.zeros(len(q))])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T


def _codebook(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    """Lloyd's rounds from k distinct rows."""
    x0 = np.unique(x, axis=0)
    c = x0[rng.permutation(len(x0))[:k]].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        order = np.argsort(near, kind="stable")
        some, at = np.unique(near[order], return_index=True)
        c[some] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.append(at, len(x)))[:, None]
    return c


def _share(x: np.ndarray, halves: tuple[np.ndarray, np.ndarray], cell: tuple[np.ndarray, np.ndarray], books, total: int, p: MultiIndex) -> float:
    """The share of entries to visit, so that ``recall`` of the neighbours are met: measured on the sample ``x``."""
    if p.recall >= 1:
        return 1.0
    wanted = max(1, round(p.neighbours * len(x) / max(total, len(x))))
    trial = np.arange(0, len(x), max(1, len(x) // p.trials))
    q1, q2 = _query_halves(x[trial])
    d = _distances(q1, books[0])[:, cell[0]] + _distances(q2, books[1])[:, cell[1]]
    near = x[trial] @ x.T
    near[np.arange(len(trial)), trial] = -np.inf
    n = min(wanted, len(x) - 1)
    if n < 1:
        return 1.0
    best = np.argpartition(-near, n - 1, axis=1)[:, :n]
    need = [(np.sort(d[i]).searchsorted(np.sort(d[i][best[i]]), "right")) / len(x) for i in range(len(trial))]
    return float(np.quantile(np.concatenate(need), p.recall))


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return column(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64, copy=False)


@dataclass
class Index:
    entries: DataFrame  # block, ids, cells, vectors
    books: tuple[np.ndarray, np.ndarray]
    share: float
    total: int  # entries
    dim: int
    counts: np.ndarray  # entries of each cell
    block: np.ndarray  # the first block of each cell
    parts: np.ndarray  # blocks that each cell is cut into (1 for all but very full ones)
    kind: str  # of the vectors


def build(v: DataFrame, p: MultiIndex) -> Index | None:
    alike = Window.partitionBy("v").orderBy("id")
    v = stash(v.withColumn("r", F.row_number().over(alike)).where(F.col("r") <= p.neighbours + 1).select("id", "v"), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    sample = v.orderBy(F.xxhash64("id"), "id").limit(p.sample).collect()  # bounded by the parameter
    if not sample:
        return None
    total, top = v.agg(F.count("*"), F.max(norm)).first()
    x = np.array([r.v for r in sample], np.float64)
    dim, kind = x.shape[1], v.schema["v"].dataType.simpleString()
    halves = _augment(x, top)
    rng = np.random.default_rng(p.seed)
    wide = int(min(max(round((total / p.per_cell) ** 0.5), 1), p.centroids_most, max(len(x) // 8, 1)))
    books = (_codebook(halves[0], wide, p.rounds, rng), _codebook(halves[1], wide, p.rounds, rng))
    placed = tuple(_distances(h, b).argmin(1) for h, b in zip(halves, books, strict=True))
    share = _share(x, halves, placed, books, total, p)
    wide = len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _augment(_matrix(batch, "v", dim), top)
            cell = _distances(a, books[0]).argmin(1) * wide + _distances(b, books[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), column(batch, "id"), column(batch, "v")], names=["cell", "id", "v"])

    cells = stash(v.mapInArrow(assign, f"cell int, id long, v {kind}"), "cells")
    counts = np.zeros(len(books[0]) * wide, np.int64)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect():  # one row for each cell
        counts[r.cell] = r.n
    size = int(min(max(total // p.blocks, p.block_least), p.block_most))
    parts = np.maximum(-(-counts // size), 1)
    # Cells in order fill the blocks; one that is cut has blocks of its own.
    block, at, held = np.zeros(len(counts), np.int64), 0, 0
    for k, (n, m) in enumerate(zip(counts.tolist(), parts.tolist(), strict=True)):
        if held and (held + n > size or m > 1):
            at, held = at + 1, 0
        block[k] = at
        held += n
        if m > 1:
            at, held = at + m, 0

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, ids = column(batch, "cell").to_numpy(), column(batch, "id").to_numpy()
            salt = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(block[cell] + salt), *batch.columns], names=["block", "cell", "id", "v"])

    rows = cells.mapInArrow(locate, f"block long, cell int, id long, v {kind}")
    blocks = rows.groupBy("block").agg(F.collect_list("id").alias("ids"), F.collect_list("cell").alias("cells"), F.flatten(F.collect_list("v")).alias("vectors"))
    return Index(blocks, books, share, total, dim, counts, block, parts, kind)


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by summed distance of their centroids, until they hold ``enough`` entries."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    n = counts.reshape(len(d1), len(d2))[o1][:, o2].tolist()
    o1, o2, wide = o1.tolist(), o2.tolist(), len(d2)
    heap, out, seen = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and seen < enough:
        _, i, j = heap[0]
        if n[i][j]:
            out.append(o1[i] * wide + o2[j])
            seen += n[i][j]
        if j + 1 < len(s2):
            heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def _visits(index: Index, p: MultiIndex):
    """The queries of each batch by the blocks that hold cells they visit, with a bit for each such cell."""
    books, dim, counts, first, parts = index.books, index.dim, index.counts, index.block, index.parts
    enough = max(p.neighbours + 1, int(np.ceil(index.share * counts.sum())))
    full = np.flatnonzero(counts)
    kind = pa.float32() if index.kind == "array<float>" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, p.chunk):
                batch = whole.slice(lo, p.chunk)
                q, ids = _matrix(batch, "v", dim), column(batch, "id").to_numpy()
                h1, h2 = _query_halves(q)
                d1, d2 = _distances(h1, books[0]), _distances(h2, books[1])
                marked = np.zeros((len(q), len(counts)), bool)
                for i in range(len(q)):
                    marked[i, traverse(d1[i], d2[i], counts, enough)] = True
                cuts = np.append(np.flatnonzero(np.diff(first[full], prepend=-1)), len(full))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    held = full[a:b]
                    bits = marked[:, held]
                    at = np.flatnonzero(bits.any(1))
                    if not len(at):
                        continue
                    for k in range(int(parts[held[0]])):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([first[held[0]] + k]), pa.array([ids[at]]), pa.array([q[at].ravel()], pa.list_(kind)), pa.array([held.astype(np.int32)]), pa.array([np.packbits(bits[at], axis=1).tobytes()], pa.binary())],
                            names=["block", "queries", "q_vectors", "held", "bits"],
                        )

    return run


def _rerank(dim: int, k: int, room: int = 400_000, cell_room: int = 4_000_000):
    """The k best of each query among the entries of each block whose cells it visits."""

    def best(q, i, s):
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        return q[keep], i[keep], s[keep]

    def out(parts):
        q, i, s = best(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                qi, qv, held, ei, ec, ev = (column(batch, n)[r].values.to_numpy(zero_copy_only=False) for n in ("queries", "q_vectors", "held", "ids", "cells", "vectors"))
                qv, ev = qv.reshape(-1, dim).astype(np.float64, copy=False), ev.reshape(-1, dim).astype(np.float64, copy=False)
                bits = np.unpackbits(np.frombuffer(column(batch, "bits")[r].as_py(), np.uint8).reshape(len(qi), -1), axis=1, count=len(held)).astype(bool)
                place = np.searchsorted(held, ec)
                step = max(1, cell_room // len(ei))
                for lo in range(0, len(qi), step):
                    some = bits[lo : lo + step]
                    use = np.flatnonzero(some.any(0)[place])  # entries that a query of these visits
                    near = qv[lo : lo + step] @ ev[use].T
                    near[~some[:, place[use]] | (qi[lo : lo + step, None] == ei[use])] = -np.inf
                    n = min(k, len(use))
                    # The product may round one pair differently at two places of the matrix, so the
                    # best are taken with some slack and scored again, each pair by itself.
                    least = np.partition(near, len(use) - n, axis=1)[:, len(use) - n]
                    a, b = np.nonzero((near >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & np.isfinite(near))
                    parts.append((qi[lo + a], ei[use[b]], (qv[lo + a] * ev[use[b]]).sum(1)))
                    rows += len(a)
                if rows > room:
                    yield out(parts)
                    parts, rows = [], 0
        if parts:
            yield out(parts)

    return run


def search(vectors: DataFrame, params: MultiIndex = MultiIndex()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query."""
    p = params
    v = _clean(vectors)
    index = build(v, p)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = v.where(F.col("id") % p.every == 0).repartition(max(1, -(-index.total // (p.every * p.chunk))), "id").dropDuplicates(["id", "v"])
    visits = f"block long, queries array<long>, q_vectors {index.kind}, held array<int>, bits binary"
    pairs = queries.mapInArrow(_visits(index, p), visits).join(index.entries.hint("merge"), "block").drop("block")
    found = pairs.mapInArrow(_rerank(index.dim, p.neighbours), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.neighbours).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
