"""Near-duplicate documents: MinHash with tensored banding, verified candidates.

Two collections of m half keys (r minhashes each) take 2 m r hash functions, and
every pair (A_i, B_j) keys one of m * m tables: the work of hashing is about the
square root of what m * m independent tables of 2 r rows would need.  With the
defaults a pair at Jaccard 0.8 shares no table with a chance of about 4e-4.

Plan: one Python pass over the texts makes set size, set fingerprint and half
keys; documents with one fingerprint are one node.  Half keys that only one node
has are dropped before table keys are formed.  Each node is first verified
against the smallest node it shares a table with; then only tables whose members
are still in different components give further pairs, first with a pivot of each
such table, last by an exact prefix filter.  All links are confirmed on full sets.

Defined results: a null or empty text has no shingles and links with nothing; a
text shorter than the shingle is one shingle; rows with a null id take part in no
link and are kept; rows that repeat an id share a component; extra columns are
ignored by ``near_duplicates`` and passed through by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import binary_list, column, components, stash
from .textkit import CHUNK_BYTES, Chunk, chunks, mix, ngram_hashes, signed, windows_inside


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    percent: int = 80  # links need 100 * |A and B| >= percent * |A or B|
    half_keys: int = 12  # m
    rows: int = 3  # r
    seed: int = 7


_SIG = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])


def shingle_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the sorted distinct shingles of document i are hashes[bounds[i]:bounds[i + 1]]."""
    w = c.word_hashes(lower=True)
    g, inside = ngram_hashes(w, k), windows_inside(c.word_from, k)
    short = np.flatnonzero((c.n_words > 0) & (c.n_words < k))
    h, d = [g[inside]], [c.doc_of_word()[: len(g)][inside]]
    for n in range(1, k):
        at = short[c.n_words[short] == n]
        if len(at):  # the whole sequence is its one shingle
            h.append(mix(ngram_hashes(w, n)[c.word_from[at]] + np.uint64(n)))
            d.append(at)
    h, d = np.concatenate(h), np.concatenate(d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return np.searchsorted(d, np.arange(c.n_docs + 1)), h


def _signatures(p: NearDup):
    rng = np.random.Generator(np.random.PCG64(p.seed))
    count = 2 * p.half_keys * p.rows
    salt, odd = rng.integers(0, 2**63, count, dtype=np.uint64), rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "id")
            for c in chunks(binary_list(batch, "text")):
                n_docs, (bound, h) = c.n_docs, shingle_sets(c, p.shingle)
                n = np.diff(bound)
                full = np.flatnonzero(n)
                keys = np.zeros((n_docs, 2 * p.half_keys), np.uint64)
                prints = np.zeros((n_docs, 2), np.uint64)
                if len(full):
                    at = bound[full]
                    low = np.empty((count, len(full)), np.uint64)
                    for i in range(count):  # (h ^ salt) * odd: the high bits are well mixed
                        low[i] = np.minimum.reduceat((h ^ salt[i]) * odd[i], at)
                    low = mix(low).reshape(2 * p.half_keys, p.rows, len(full))
                    key = np.zeros((2 * p.half_keys, len(full)), np.uint64)
                    for r in range(p.rows):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
                    keys[full] = key.T
                    prints[full, 0] = np.add.reduceat(mix(h + np.uint64(1)), at)
                    prints[full, 1] = np.add.reduceat(mix(h + np.uint64(2)), at)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(c.first, n_docs),
                        pa.array(n, pa.int64()),
                        pa.array(signed(np.ascontiguousarray(prints[:, 0]))),
                        pa.array(signed(np.ascontiguousarray(prints[:, 1]))),
                        *(pa.ListArray.from_arrays(pa.array(np.arange(0, (n_docs + 1) * p.half_keys, p.half_keys, dtype=np.int32)), pa.array(signed(np.ascontiguousarray(keys[:, s])).ravel())) for s in (slice(0, p.half_keys), slice(p.half_keys, None))),
                    ],
                    schema=_SIG,
                )

    return run


def _verifier(p: NearDup):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = binary_list(batch, "text_a"), binary_list(batch, "text_b")
            linked = np.zeros(len(a), bool)
            for lo, hi in _runs([len(x or b"") + len(y or b"") for x, y in zip(a, b, strict=True)]):
                (c,) = chunks([t for pair in zip(a[lo:hi], b[lo:hi], strict=True) for t in pair], 1 << 62)
                bound, h = shingle_sets(c, p.shingle)
                n = np.diff(bound)
                pair = np.repeat(np.arange(c.n_docs) // 2, n)
                order = np.lexsort((h, pair))
                h, pair = h[order], pair[order]
                same = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=hi - lo)
                either = n[0::2] + n[1::2] - same
                linked[lo:hi] = (100 * same >= p.percent * either) & (either > 0)
            mask = pa.array(linked)
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(mask), column(batch, "b").filter(mask)], schema=schema)

    return run


def _runs(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _confirmed(pairs: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, by their full sets."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verifier(p), "a long, b long")


def _size_ok(p: NearDup):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDup = NearDup()) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable), kept."""
    p = params
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    sig = stash(base.mapInArrow(_signatures(p), "id long, n long, f1 long, f2 long, a array<long>, b array<long>"), "sig")

    # One node for each distinct set: the smallest id that has it.
    sets = sig.where("n > 0 and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("a").alias("a"), F.min("b").alias("b"))
    nodes = stash(sets, "nodes")

    tables = stash(_tables(nodes, p), "tables")  # key, id, n
    found = components(_link(base, tables, p))
    of_set = nodes.join(found, nodes.id == found.node, "left").select("f1", "f2", F.coalesce("component", "id").alias("component"))
    out = sig.join(of_set, ["f1", "f2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _tables(nodes: DataFrame, p: NearDup) -> DataFrame:
    """(key, id, n) of the tables with two or more nodes."""

    def shared(side: str) -> DataFrame:
        one = nodes.select("id", "n", F.posexplode(side).alias("i", "h"))
        several = one.groupBy("i", "h").agg(F.count("*").alias("k")).where("k > 1").select("i", "h")
        return one.join(several, ["i", "h"]).groupBy("id", "n").agg(F.collect_list(F.struct("i", "h")).alias(side))

    both = shared("a").join(shared("b"), ["id", "n"])
    keyed = both.select("id", "n", F.explode("a").alias("x"), "b").select("id", "n", "x", F.explode("b").alias("y"))
    keyed = keyed.select(F.xxhash64("x.i", "x.h", "y.i", "y.h").alias("key"), "id", "n")
    several = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "least")
    return keyed.join(several, "key").select("key", "id", "n", "least")


def _link(base: DataFrame, tables: DataFrame, p: NearDup) -> DataFrame:
    """Confirmed links whose components are those of all linked pairs that share a table."""
    sizes = tables.select("id", "n").distinct()
    texts = stash(base.join(sizes.select("id").distinct(), "id", "left_semi"), "texts")
    pairs = tables.groupBy("id", "n").agg(F.min("least").alias("a")).where("a < id")
    pairs = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").select("a", F.col("id").alias("b"), "n_a", F.col("n").alias("n_b"))
    done = stash(pairs.where(_size_ok(p)).select("a", "b").distinct(), "pairs")
    links = stash(_confirmed(done, texts, p), "links")
    for last in (False, True):
        label = components(links)
        member = tables.select("key", "id", "n").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        member = stash(member.join(mixed, "key"), "mixed")
        pairs = _by_prefix(member.select("id", "n", "component").distinct(), texts, p) if last else _by_pivot(member)
        fresh = stash(pairs.where(_size_ok(p)).select("a", "b").distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        links = stash(links.unionByName(_confirmed(fresh, texts, p)), "links")
        done = done.unionByName(fresh)
    return links


def _by_pivot(member: DataFrame) -> DataFrame:
    """Every member of a mixed table with some member of its smallest component."""
    pivot = member.groupBy("key", "component").agg(F.min_by(F.struct("id", "n"), F.xxhash64("id", "key")).alias("p"))
    pivot = pivot.groupBy("key").agg(F.min_by("p", "component").alias("p"), F.min("component").alias("other"))
    pairs = member.join(pivot, "key").where("component <> other")
    return pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), F.col("n").alias("n_a"), F.col("p.n").alias("n_b"))


def _shingle_rows(p: NearDup):
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "id").to_numpy(zero_copy_only=False)
            for c in chunks(binary_list(batch, "text")):
                bound, h = shingle_sets(c, p.shingle)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[c.first : c.first + c.n_docs], np.diff(bound))), pa.array(signed(h))], schema=schema)

    return run


def _by_prefix(member: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """Pairs of unlike components that can still link, without forming all pairs of a table.

    Prefix filtering: with the shingles of every set in one order, rarest first, two
    sets at the threshold share one of the first n - ceil(percent * n / 100) + 1.
    Members that differ by shingles of their own use up that prefix on them.  The
    positional bound of a shared shingle then shortens the prefix for each pair: what
    follows it on either side must still reach the overlap that their sizes ask for.
    """
    rows = texts.join(member, "id").select("id", "text").mapInArrow(_shingle_rows(p), "id long, h long").distinct()
    several = rows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    by_id = Window.partitionBy("id")
    rows = rows.join(several, "h").withColumn("rank", F.row_number().over(by_id.orderBy("k", "h"))).withColumn("common", F.count("*").over(by_id))
    left = F.col("common") - F.col("rank") + 1  # this shingle and those after it
    rows = rows.join(member, "id").where(left >= F.ceil(F.col("n") * p.percent / 100)).select("h", "id", "n", left.alias("left"), "component")
    rows = stash(rows, "prefix")
    # A partner of a row has at least percent of its shingles, and no fewer than any row here.
    here = rows.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("low")).where("lo < hi").select("h", "lo", "low")
    partner = F.greatest("low", F.ceil(F.col("n") * p.percent / 100))
    rows = rows.join(here, "h").where(F.col("left") * (100 + p.percent) >= (F.col("n") + partner) * p.percent)
    # Every pair of unlike components has a side outside the first component of its shingle.
    x = rows.select("h", F.col("id").alias("i"), F.col("n").alias("n_i"), F.col("left").alias("l_i"), F.col("component").alias("c_i"), (F.col("component") == F.col("lo")).alias("of_first"))
    y = rows.where("component <> lo").select("h", F.col("id").alias("j"), F.col("n").alias("n_j"), F.col("left").alias("l_j"), F.col("component").alias("c_j"))
    overlap = F.least("l_i", "l_j") * (100 + p.percent) >= (F.col("n_i") + F.col("n_j")) * p.percent
    first = F.col("i") < F.col("j")
    pairs = x.join(y, "h").where("c_i <> c_j").where(F.col("of_first") | first).where(overlap)
    return pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.when(first, F.col("n_i")).otherwise(F.col("n_j")).alias("n_a"), F.when(first, F.col("n_j")).otherwise(F.col("n_i")).alias("n_b"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearDup = NearDup()) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; the columns stay.

    Of rows that repeat an id and lie in a component, all stay or none.  Only the ids
    that go are shuffled to the texts.
    """
    gone = near_duplicates(docs, id_col, text_col, params).where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
