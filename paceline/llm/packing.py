"""Packing: concatenate and cut, by prefix sums over partition token totals.

All documents' token ids, each ended by ``end_id``, form one stream that is cut
every ``length`` ids.  Pass one tokenises (once) and writes ids with the task's
number and the offset inside it; the totals of the tasks, summed up in order, then
place every document in the stream; pass two cuts at the window boundaries.  Only
the last sequence can be short.  A piece that continues in the next sequence, or
comes from the one before, says so: those are the boundary records.

The totals are as many rows as there were tasks.  They are read from the written
table, so tasks that ran twice count once.

Defined results: null and empty texts are the end id alone; repeated rows are packed
each; a document longer than a sequence has as many pieces as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, stash


@dataclass(frozen=True)
class Packing:
    length: int = 2048
    end_id: int = 1
    tokenizer: str | None = None  # path of a tokenizers file; by default that of byte_bpe_50k.json


class _Encoder:
    """Token ids as ``tokenizers`` gives them, as little-endian 32-bit numbers.

    For the default vocabulary, texts of ASCII and Latin letters go through tiktoken,
    which has the same vocabulary as ranks and the same splitting pattern and is four
    times as fast; the character classes of both engines agree there.  All other
    texts, those that hold the special token, and other vocabularies use tokenizers.
    """

    def __init__(self, path: str | None):
        import base64
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.plain = None
        if path is None:
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            encoding = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.plain = encoding.encode_ordinary
            self.alike = re.compile(r"[\t-\r\x20-\x7e\xa1-\u024f]*").fullmatch

    def __call__(self, texts: list[str]) -> list[bytes]:
        quick = [self.plain is not None and "<|endoftext|>" not in t and self.alike(t) is not None for t in texts]
        slow = iter(self.model.encode_batch([t for t, q in zip(texts, quick, strict=True) if not q], add_special_tokens=False))
        return [np.array(self.plain(t) if q else next(slow).ids, "<u4").tobytes() for t, q in zip(texts, quick, strict=True)]


def _tokens(p: Packing):
    schema = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    end = np.array([p.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = _Encoder(p.tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids = [x + end for x in encode([t or "" for t in column(some, "text").to_pylist()])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([column(some, "id"), pa.array(np.full(len(n), part, np.int32)), pa.array(start), pa.array(n), pa.array([_narrow(x) for x in ids], pa.binary())], schema=schema)

    return run


def _narrow(ids: bytes) -> bytes:
    """16 bits an id where all fit: a flag byte, then the ids."""
    a = np.frombuffer(ids, "<u4")
    return b"\x02" + a.astype("<u2").tobytes() if a.max() < 65536 else b"\x04" + ids


def _wide(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2" if stored[0] == 2 else "<u4", offset=1).astype("<u4")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continues boolean, continued boolean, ids array<int>"


def _pieces(p: Packing, with_ids: bool):
    names = [x.split()[0] for x in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, at, stored in zip(column(batch, "id").to_pylist(), column(batch, "at").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                ids = _wide(stored)
                n = len(ids)
                cut = 0
                while cut < n:
                    sequence, offset = divmod(at + cut, p.length)
                    take = min(p.length - offset, n - cut)
                    piece = ids[cut : cut + take]
                    rows.append((doc, cut, take, zlib.crc32(piece.tobytes()), n, sequence, offset, cut > 0, cut + take < n, piece.tolist() if with_ids else None))
                    cut += take
                    held += take
                    if held > 2_000_000:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Packing = Packing(), with_ids: bool = True) -> DataFrame:
    """One row per piece; ``ids`` is null unless asked for."""
    p = params
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tokens = stash(base.mapInArrow(_tokens(p), "id long, part int, start long, n long, ids binary"), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = stash(totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("first")), "totals")
    # As many rows as the first pass had tasks, of two numbers each.
    placed = tokens.join(F.broadcast(first), "part").select("id", (F.col("first") + F.col("start")).alias("at"), "ids")
    return placed.mapInArrow(_pieces(p, with_ids), PIECE)


def pack_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Packing = Packing()) -> DataFrame:
    return pack(docs, id_col, text_col, params, with_ids=False).drop("ids").withColumnRenamed("doc_id", id_col)
