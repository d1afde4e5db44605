"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, bigrams and one-gap skip-grams of a whole text,
lower-cased (A-Z) and without ASCII punctuation, hashed to 2**bits coordinates.
FTRL-proximal keeps a learning rate for each coordinate and its L1 term leaves most
weights at zero, so what is broadcast for scoring is small: at most 2**bits
numbers, whatever the corpus is.

The fit takes at most ``max_rows`` labelled rows (those with the smallest hash of
their id, so reruns agree); scores cover every row.

Defined results: null and empty texts score as the bias alone; labels that are null
are not used; an id labelled more than once is toxic if any of its labels is; rows
that repeat an id are scored each; where no labelled document is left to learn from,
every score is about 0, so nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_list, column, stash, unused
from .textkit import Chunk, chunks, mix


@dataclass(frozen=True)
class Ftrl:
    bits: int = 18
    max_rows: int = 20_000
    epochs: int = 5
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1


_PUNCTUATION = bytes(b if chr(b).isalnum() or b >= 128 else 0x20 for b in range(256))


def _features(c: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document in the chunk, coordinate) of every n-gram, repeats included."""
    w, doc = c.word_hashes(lower=True), c.doc_of_word()
    shift = np.uint64(64 - bits)
    idx, docs = [w >> shift], [doc]
    for gap, a, b in ((1, 0x9FB21C651E98DF25, 0xD1342543DE82EF95), (2, 0xA24BAED4963EE407, 0x8CB92BA72F3D8DD7)):
        same = doc[:-gap] == doc[gap:] if len(doc) > gap else np.zeros(0, bool)
        pair = mix(w[: len(same)] * np.uint64(a) + w[gap:] * np.uint64(b))[same] if len(same) else np.zeros(0, np.uint64)
        idx.append(pair >> shift)
        docs.append(doc[: len(same)][same])
    return np.concatenate(docs), np.concatenate(idx).astype(np.int64)


def _distinct(doc: np.ndarray, idx: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc.astype(np.int64) << bits) | idx)
    return key >> bits, key & ((1 << bits) - 1)


def _plain(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").translate(_PUNCTUATION) for t in binary_list(batch, "text")]


def _featurise(p: Ftrl):
    schema = pa.schema([("ord", pa.int64()), ("y", pa.int32()), ("idx", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(_plain(batch)):
                doc, idx = _distinct(*_features(c, p.bits), p.bits)
                bound = np.searchsorted(doc, np.arange(c.n_docs + 1)).astype(np.int32)
                part = batch.slice(c.first, c.n_docs)
                yield pa.RecordBatch.from_arrays([column(part, "ord"), column(part, "y"), pa.ListArray.from_arrays(pa.array(bound), pa.array(idx.astype(np.int32)))], schema=schema)

    return run


def _train(p: Ftrl):
    schema = pa.schema([("idx", pa.int32()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            y, idx = column(batch, "y").to_pylist(), column(batch, "idx")
            flat, at = idx.flatten().to_numpy(), idx.offsets.to_numpy() - idx.offsets[0].as_py()
            rows += [(y[i], flat[at[i] : at[i + 1]]) for i in range(len(y))]
        bias = 1 << p.bits
        z, n = np.zeros(bias + 1), np.zeros(bias + 1)

        def weights(i):
            return np.where(np.abs(z[i]) <= p.l1 * (i != bias), 0.0, (np.sign(z[i]) * p.l1 * (i != bias) - z[i]) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

        for _ in range(p.epochs):
            for y, i in rows:
                i = np.append(i, bias)
                w = weights(i)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
                n[i] += g * g
        w = weights(np.arange(bias + 1))
        keep = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(w[keep])], schema=schema)

    return run


def held_out(id_col):
    """Whether crc32 of the id as text is 0 modulo 5; such rows, and rows without an id, teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> dict[int, float]:
    """Weights by coordinate (2**bits is the bias), from rows of ``labels`` (doc_id, toxic) that are not held out."""
    p = params
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y")).withColumn("ord", F.xxhash64("id"))
    rows = rows.orderBy("ord", "id").limit(p.max_rows)  # so its size is bounded, and it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    feats = texts.join(F.broadcast(rows), "id").select("ord", "y", "text").mapInArrow(_featurise(p), "ord long, y int, idx array<int>")
    # Written first, so the corpus is read in parallel and only the bounded rows meet in a task.
    model = stash(feats, "features").coalesce(1).sortWithinPartitions("ord", F.xxhash64("idx")).mapInArrow(_train(p), "idx int, weight double")
    return {r.idx: r.weight for r in model.collect()} or {1 << p.bits: -35.0}


def score(docs: DataFrame, weights: dict[int, float], params: Ftrl = Ftrl(), name: str = "toxic_score") -> DataFrame:
    """``docs`` with a column ``name`` (0 to 1) more, which must not be one of theirs; other columns pass through."""
    p = params
    if name != unused(docs.columns, name):
        raise ValueError(f"there is a column {name} already")
    table = np.zeros((1 << p.bits) + 1)
    for i, w in weights.items():
        table[i] = w
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            total = np.full(batch.num_rows, w[-1])
            texts = [(t or b"").translate(_PUNCTUATION) for t in batch.column(batch.num_columns - 1).to_pylist()]
            for c in chunks(texts):
                doc, idx = _features(c, p.bits)
                hit = w[idx] != 0
                doc, idx = _distinct(doc[hit], idx[hit], p.bits)
                np.add.at(total, doc + c.first, w[idx])
            s = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], names=[*batch.schema.names[:-1], name])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{name}` double"])
    return docs.select(*[docs[c] for c in docs.columns], docs["text"].cast("binary").alias(unused(docs.columns, "_text"))).mapInArrow(run, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels, params), params)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl()) -> DataFrame:
    """The rows of ``docs`` that score below 0.5; the columns stay."""
    name = unused(docs.columns, "toxic_score")
    return score(docs, fit(docs, labels, params), params, name).where(F.col(name) < 0.5).drop(name)
