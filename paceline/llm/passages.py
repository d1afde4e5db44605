"""Substring dedup: repeated passages across documents, by difference-cover anchors.

A set D of residues is a difference cover of the period v if every difference
modulo v is one of two of its members.  Then for any two positions some shift
below v brings both onto residues in D.  So two documents that share a window of
``window`` words also share an anchor: a run of window - v + 1 words that starts
at a position with a residue in D in both.  Only |D| / v of the positions are
hashed and shuffled.  Where an anchor occurs in two unlike contents, the windows
that hold it are formed on both sides, and the match extends over all windows
that agree.

Plan: (1) one pass hashes contents and anchors; (2) anchors of two contents or
more come from a grouped min and max, joined back; (3) the texts that hold such
anchors (and only those) form their candidate windows; (4) the smallest document
of every window, again by a grouped min and a join; (5) the words covered are
cut.  Documents with one content are treated once, as that content.

Defined results: null text has no words; a null id counts as larger than any
other, and rows with one id don't cut each other; empty texts and texts shorter
than a window lose nothing; a passage that repeats only inside a document stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_list, column, stash, unused
from .textkit import Chunk, chunks, mix, ngram_hashes, signed, windows_inside

LAST = 2**63 - 1


@dataclass(frozen=True)
class Passages:
    window: int = 50
    period: int = 31
    cover: tuple[int, ...] = (1, 5, 11, 24, 25, 27)

    def __post_init__(self):
        if {(a - b) % self.period for a in self.cover for b in self.cover} != set(range(self.period)):
            raise ValueError(f"{self.cover} is not a difference cover modulo {self.period}")
        if self.window < self.period:
            raise ValueError("the window must be as long as the period at least")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1


def _anchors(c: Chunk, w: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Word positions in the chunk that are anchors, and their hashes."""
    h = ngram_hashes(w, p.anchor)
    at = np.flatnonzero(windows_inside(c.word_from, p.anchor))
    offset = at - np.repeat(c.word_from[:-1], c.n_words)[at]
    at = at[np.isin(offset % p.period, p.cover)]
    # Documents too short for a window can't take part in a match.
    at = at[np.repeat(c.n_words >= p.window, c.n_words)[at]]
    return at, h[at]


def _words(c: Chunk, i: int) -> bytes:
    return b" ".join(c.buf[c.doc_start[i] : c.doc_start[i + 1]].tobytes().split())


def _profile(p: Passages):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("c", pa.int64()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "id")
            for c in chunks(binary_list(batch, "text")):
                sha = [hashlib.sha256(_words(c, i)).digest() for i in range(c.n_docs)]
                at, h = _anchors(c, c.word_hashes(), p)
                bound = np.searchsorted(at, c.word_from).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(c.first, c.n_docs),
                        pa.array(c.n_words.astype(np.int64)),
                        pa.array(sha, pa.binary()),
                        pa.array(np.frombuffer(b"".join(x[:8] for x in sha), np.int64)),
                        pa.ListArray.from_arrays(pa.array(bound), pa.array(signed(h))),
                    ],
                    schema=schema,
                )

    return run


def _windows(p: Passages):
    """(h1, h2, ord, c, starts) of candidate windows: those that hold an anchor of several contents."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ord", pa.int64()), ("c", pa.int64()), ("starts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = binary_list(batch, "text"), column(batch, "hashes")
            order, content = column(batch, "ord").to_numpy(), column(batch, "c").to_numpy()
            for ch in chunks(texts):
                w = ch.word_hashes()
                at, h = _anchors(ch, w, p)
                doc = ch.doc_of_word()
                some = known.slice(ch.first, ch.n_docs)
                shared = some.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                owner = np.repeat(np.arange(ch.n_docs), np.diff(some.offsets.to_numpy()))
                hit = np.isin(mix(h) + doc[at].astype(np.uint64), mix(shared) + owner.astype(np.uint64))
                at = at[hit]
                inside = windows_inside(ch.word_from, p.window)
                if not len(at) or not len(inside):
                    continue
                step = np.zeros(len(w) + 1, np.int64)
                np.add.at(step, np.maximum(at - (p.window - p.anchor), ch.word_from[doc[at]]), 1)
                np.add.at(step, at + 1, -1)
                start = np.flatnonzero((np.cumsum(step)[: len(inside)] > 0) & inside)
                h1, h2 = ngram_hashes(w, p.window)[start], ngram_hashes(w, p.window, fold=1)[start]
                d = doc[start]
                o = np.lexsort((start, h2, h1, d))
                start, h1, h2, d = start[o], h1[o], h2[o], d[o]
                new = np.ones(len(o), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (d[1:] != d[:-1])
                bound = np.append(np.flatnonzero(new), len(o)).astype(np.int32)
                rel = (start - ch.word_from[d]).astype(np.int32)
                one = new.nonzero()[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h1[one])), pa.array(signed(h2[one])), pa.array(order[ch.first + d[one]]), pa.array(content[ch.first + d[one]]), pa.ListArray.from_arrays(pa.array(bound), pa.array(rel))],
                    schema=schema,
                )

    return run


def _cut(p: Passages):
    schema = pa.schema([("c", pa.int64()), ("n_removed", pa.int64()), ("kept_sha", pa.binary()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, n, sha, out = column(batch, "c").to_pylist(), [], [], []
            for text, runs in zip(binary_list(batch, "text"), column(batch, "runs"), strict=True):
                words = (text or b"").split()
                starts = np.concatenate([np.asarray(r.values) for r in runs.values]) if len(runs.values) else np.zeros(0, int)
                step = np.zeros(len(words) + p.window + 1, np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + p.window, -1)
                gone = np.cumsum(step)[: len(words)] > 0
                kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).digest())
                out.append(kept.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(out, pa.string())], schema=schema)

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Passages = Passages()) -> tuple[DataFrame, DataFrame]:
    """(profile, cuts).

    profile: id, n_words, sha (of the words joined by one space), c, owner (the
    smallest id with this content) of every row; cuts: c, n_removed, kept_sha and
    kept_text of each content that loses words to another content.  A row whose id
    is larger than owner and that holds a window loses all its words.
    """
    p = params
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = stash(base.mapInArrow(_profile(p), "id long, n_words long, sha binary, c long, anchors array<long>"), "profile")
    order = F.coalesce("id", F.lit(LAST))
    owners = rows.groupBy("c", "sha").agg(F.min(order).alias("owner"))

    anchors = rows.where(F.size("anchors") > 0).select("c", F.explode("anchors").alias("h"))
    several = anchors.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("h")
    several = stash(several, "anchors")
    hits = stash(anchors.join(several, "h").groupBy("c").agg(F.collect_set("h").alias("hashes")), "hits")

    wanted = hits.join(owners.select("c", "owner"), "c").select("c", F.col("owner").alias("ord"), "hashes")
    texts = base.join(wanted, F.coalesce("id", F.lit(LAST)) == F.col("ord")).select("c", "ord", "text", "hashes")
    texts = stash(texts.mapInArrow(_same_content, "c long, ord long, text binary, hashes array<long>"), "texts")

    windows = texts.mapInArrow(_windows(p), "h1 long, h2 long, ord long, c long, starts array<int>")
    least = windows.groupBy("h1", "h2").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most").select("h1", "h2", "least")
    least = stash(least, "windows")
    runs = windows.join(least, ["h1", "h2"]).where("ord > least").groupBy("c").agg(F.collect_list("starts").alias("runs"))
    cuts = texts.select("c", "text").join(runs, "c").mapInArrow(_cut(p), "c long, n_removed long, kept_sha binary, kept_text string")
    cuts = stash(cuts.dropDuplicates(["c"]), "cuts")
    return rows.drop("anchors").join(owners, ["c", "sha"]), cuts


def _same_content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops rows that share an id with the content but not its words."""
    for batch in batches:
        same = [hashlib.sha256(b" ".join((t or b"").split())).digest()[:8] == c.to_bytes(8, "little", signed=True) for t, c in zip(binary_list(batch, "text"), column(batch, "c").to_pylist(), strict=True)]
        yield batch.filter(pa.array(same, pa.bool_()))


def passage_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Passages = Passages()) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every row."""
    rows, cuts = repeated_passages(docs, id_col, text_col, params)
    copy = (F.coalesce("id", F.lit(LAST)) > F.col("owner")) & (F.col("n_words") >= params.window)
    out = rows.join(cuts.drop("kept_text"), "c", "left")
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept_sha", "sha"))))
    return out.select(F.col("id").alias(id_col), "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Passages = Passages()) -> DataFrame:
    """``docs`` with the repeated words gone from its texts; other columns stay.

    A text that loses no word is left as it is; one that does comes back as its kept
    words joined by one space.
    """
    rows, cuts = repeated_passages(docs, id_col, text_col, params)
    order = F.coalesce(F.col("id"), F.lit(LAST))
    copy = (order > F.col("owner")) & (F.col("n_words") >= params.window)
    changed = rows.join(cuts, "c", "left").where(copy | (F.coalesce("n_removed", F.lit(0)) > 0))
    key, sha, kept = (unused(docs.columns, c) for c in ("_key", "_sha", "_kept"))
    changed = changed.select(order.alias(key), F.col("sha").alias(sha), F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias(kept)).dropDuplicates([key, sha])
    keyed = docs.withColumn(key, F.coalesce(docs[id_col].cast("long"), F.lit(LAST))).withColumn(sha, F.unhex(F.sha2(_joined(docs[text_col]), 256)))
    out = keyed.join(changed, [key, sha], "left")
    return out.select(*[F.coalesce(F.col(kept), docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])


def _joined(text):
    """The words of a text joined by one space."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), F.lit(""))
