"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Words, bigrams and runs of three bytes of every text are hashed to 2**bits buckets.  Two
multinomials over the buckets are counted: the raw corpus (every document) and the trusted
target (all documents labelled of good quality).  A document's score is its mean
log(target / raw) per n-gram, against the counts of all other documents: its own are taken
out of the raw corpus, and out of the target if it is trusted.  In each bucket the target is
shrunk towards the raw corpus by ``smoothing`` n-grams, so what nobody else has tells nothing.
The threshold comes from the trusted documents, scored in the same way: the score that all
but a share ``lost`` of those past the base rules reach.  So verdicts don't follow the size of
the table, and reruns agree.

Defined results: null and empty texts have no words and fail the base rules; labels
that are null don't count as trusted; rows that repeat an id are judged each, and are
trusted alike; where no trusted document passes the base rules, all that pass them are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import binary_list, column, stash
from .textkit import _P, Chunk, _power_tables, chunks, mix, ngram_hashes, windows_inside


@dataclass(frozen=True)
class Quality:
    bits: int = 17
    letters: int = 3  # bytes of the shortest n-grams
    smoothing: float = 4.0  # n-grams of the raw corpus, in each bucket
    lost: float = 0.01  # share of trusted documents that the threshold may reject
    step: float = 1 / 1024  # scores are compared at this resolution, so a table of their counts is small
    least_words: int = 10
    repeat_percent: int = 20
    repeat_window: int = 5


_rng = np.random.Generator(np.random.PCG64(97))
_EVERY_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _buckets(c: Chunk, w: np.ndarray, p: Quality) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each word, bigram and run of bytes (the space after a document included)."""
    doc, shift = c.doc_of_word(), np.uint64(64 - p.bits)
    two = ngram_hashes(w, 2)
    inside = windows_inside(c.word_from, 2)
    m = max(len(c.buf) - p.letters + 1, 0)
    run = np.zeros(m, np.uint64)
    for i in range(p.letters):
        run = run << np.uint64(8) | c.buf[i : i + m]
    whole = windows_inside(c.doc_start, p.letters)
    doc_of_run = np.repeat(np.arange(c.n_docs), np.diff(c.doc_start))[:m]
    docs = [doc, doc[: len(two)][inside], doc_of_run[whole]]
    found = [w >> shift, two[inside] >> shift, run[whole] * np.uint64(_P) >> shift]
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def _count(p: Quality):
    schema = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("trusted", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(1 << p.bits, np.int64), np.zeros(1 << p.bits, np.int64)
        for batch in batches:
            trusted = column(batch, "trusted").to_numpy(zero_copy_only=False).astype(bool)
            for c in chunks(binary_list(batch, "text")):
                doc, b = _buckets(c, c.word_hashes(), p)
                raw += np.bincount(b, minlength=1 << p.bits)
                good += np.bincount(b[trusted[c.first + doc]], minlength=1 << p.bits)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], schema=schema)

    return run


def _trusted(rows: DataFrame, labels: DataFrame, noise: Column) -> DataFrame:
    """``rows`` with a boolean ``trusted``; rows without an id match nothing and are spread by ``noise``."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.withColumn("t", F.lit(True)).withColumn("salt", F.lit(0))
    salted = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), noise % 1024).otherwise(0).cast("int"))
    # One kind of join at every size, and never a broadcast of all labels.
    joined = salted.join(good.hint("merge"), ["doc_id", "salt"], "left")
    return joined.select(*rows.columns, F.coalesce("t", F.lit(False)).alias("trusted"))


def counts(docs: DataFrame, labels: DataFrame, params: Quality = Quality()) -> np.ndarray:
    """n-grams of each bucket in the raw corpus and in the trusted target: 2 rows of 2**bits numbers, whatever the corpus is."""
    p = params
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    flagged = _trusted(texts, labels, F.crc32("text")).select("text", "trusted")
    found = flagged.mapInArrow(_count(p), "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    out = np.zeros((2, 1 << p.bits), np.int64)
    for r in found.collect():  # 2**bits rows at most
        out[:, r.bucket] = r.raw, r.trusted
    return out


def _scores(doc: np.ndarray, b: np.ndarray, n_docs: int, both: np.ndarray, p: Quality) -> list[np.ndarray]:
    """Mean log ratios of the documents against all others: as if not trusted, and as if trusted."""
    key, times = np.unique(doc << p.bits | b, return_counts=True)
    doc, b = key >> p.bits, key & (1 << p.bits) - 1
    own = np.bincount(doc, times, n_docs)
    raw, good = both.sum(axis=1)
    rest = np.maximum(raw - own, 1)
    out = []
    for mine in (0, 1):
        share = np.maximum(good - mine * own, 0) / rest
        known = share > 0  # without other trusted texts there is nothing to tell
        prior = p.smoothing * np.where(known, share, 1)[doc]
        target = np.maximum(both[1][b] - mine * times, 0) + prior
        score = np.log(target / (np.maximum(both[0][b] - times, 0) + p.smoothing) * p.smoothing / prior)
        out.append(np.where(known, np.bincount(doc, score * times, n_docs) / np.maximum(own, 1), 0))
    return out


def _line_repeats(c: Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    buf = c.buf
    last = c.doc_start[1:] - 1  # the space after each document ends its last line
    ends = np.union1d(np.flatnonzero(buf == 10), last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    up, down = _power_tables(_P, len(buf) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_EVERY_BYTE[buf] * up[:-1])])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    full = np.searchsorted(c.start, ends) > np.searchsorted(c.start, starts)
    doc = np.searchsorted(c.doc_start, starts, "right") - 1
    h, doc = h[full], doc[full]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    return np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=c.n_docs)


def _repeat_words(c: Chunk, w: np.ndarray, n: int) -> np.ndarray:
    """Words covered by n-word windows that the document has more than once."""
    inside = np.flatnonzero(windows_inside(c.word_from, n))
    if not len(inside):
        return np.zeros(c.n_docs, np.int64)
    doc = c.doc_of_word()
    h, d = ngram_hashes(w, n)[inside], doc[inside]
    order = np.lexsort((h, d))
    same = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    step = np.zeros(len(w) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=c.n_docs)


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, both: np.ndarray, params: Quality = Quality()) -> DataFrame:
    """doc_id, the base counts, base_failed, and the scores as not trusted (llr_out) and as trusted (llr_in) of every row."""
    p = params
    shared = docs.sparkSession.sparkContext.broadcast(both)  # 2 * 2**bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for c in chunks(binary_list(batch, "text")):
                w = c.word_hashes()
                n = c.n_words
                at = c.doc_start
                space = (c.buf == 32) | ((c.buf >= 9) & (c.buf <= 13))
                chars = np.add.reduceat(~space & ((c.buf & 0xC0) != 0x80), at[:-1], dtype=np.int64)
                symbols = np.add.reduceat(_SYMBOL[c.buf], at[:-1], dtype=np.int64)
                repeats = _repeat_words(c, w, p.repeat_window)
                failed = (n < p.least_words) | (100 * repeats > p.repeat_percent * n)
                numbers = [n, chars, symbols, _line_repeats(c), repeats]
                scores = _scores(*_buckets(c, w, p), c.n_docs, shared.value, p)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(c.first, c.n_docs), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(failed), *map(pa.array, scores)],
                    names=["doc_id", *NUMBERS, "base_failed", "llr_out", "llr_in"],
                )

    schema = ", ".join(["doc_id long", *(f"{x} long" for x in NUMBERS), "base_failed boolean", "llr_out double", "llr_in double"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def threshold(scored: DataFrame, params: Quality = Quality()) -> int | None:
    """The step that all but a share ``lost`` of the trusted rows past the base rules reach; None without any.

    Mean log ratios lie within some 40 of 0, so their steps are a short table.
    """
    steps = scored.where("trusted and not base_failed").groupBy("step").count().orderBy("step").collect()
    may = params.lost * sum(r["count"] for r in steps)
    found, below = None, 0
    for r in steps:
        if below > may:
            break
        found, below = r.step, below + r["count"]
    return found


def quality_digest(docs: DataFrame, labels: DataFrame, params: Quality = Quality()) -> DataFrame:
    """doc_id, the base counts, base_failed, trusted, llr (mean per n-gram, against all others) and kept of every row."""
    measured = measure(docs, counts(docs, labels, params), params)
    known = _trusted(measured, labels, F.abs(F.xxhash64(*NUMBERS, "llr_out") % 1024))
    llr = F.when(F.col("trusted"), F.col("llr_in")).otherwise(F.col("llr_out"))
    scored = known.select("doc_id", *NUMBERS, "base_failed", "trusted", llr.alias("llr"), F.floor(llr / params.step).alias("step"))
    scored = stash(scored, "quality")  # a few numbers for each document
    least = threshold(scored, params)
    good = F.lit(True) if least is None else F.col("step") >= least
    return scored.withColumn("kept", ~F.col("base_failed") & good).drop("step")
