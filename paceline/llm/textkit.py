"""Vectorised word handling shared by the corpus operators.

Texts reach the tasks as UTF-8 bytes (Spark ``binary``), so malformed strings
cannot fail a decode.  A word is a maximal run of bytes outside the ASCII white
space set ``\\x20 \\x09-\\x0D``.  Every function works on whole texts: several
small documents are joined into one buffer of about ``CHUNK_BYTES``; a document
larger than that is a buffer of its own, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 2_000_000

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[[0x20, *range(0x09, 0x0E)]] = 0
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept per process)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = (out[0], out[1])
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@dataclass
class Chunk:
    """Some documents of a batch, as one buffer of bytes."""

    first: int  # index of its first document in the batch
    n_docs: int
    buf: np.ndarray  # uint8; one space after every document
    doc_start: np.ndarray  # byte offset of each document, and of the end
    start: np.ndarray  # byte offsets of words
    end: np.ndarray
    word_from: np.ndarray  # words of document i: word_from[i] .. word_from[i + 1]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_from)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z lower-cased on request)."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        buf = LOWER[self.buf] if lower else self.buf
        up, down = _power_tables(_P, len(buf))
        h = np.add.reduceat(_BYTE[buf] * up, self.start) * down[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64) * _U(0xA0761D6478BD642F))


def chunks(texts: Iterable[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Groups documents, in order, into buffers of about ``limit`` bytes; null is empty."""
    group: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        t = t or b""
        if group and size + len(t) > limit:
            yield _chunk(first, group)
            group, first, size = [], i, 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield _chunk(first, group)


def _chunk(first: int, group: list[bytes]) -> Chunk:
    buf = np.frombuffer(b" ".join(group) + b" ", np.uint8)
    doc_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in group])])
    gap = SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    return Chunk(first, len(group), buf, doc_start, start, end, np.searchsorted(start, doc_start))


def ngram_hashes(words: np.ndarray, n: int, fold: int = 0) -> np.ndarray:
    """Hash of the n consecutive words that begin at each word (len(words) - n + 1 of them).

    A polynomial over mixed word hashes from prefix sums: one pass whatever n is.
    Windows may run across documents; callers keep those that do not.  ``fold``
    selects an independent hash function.
    """
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(_Q, len(words))
    w = words if not fold else mix(words + _U(fold * 0x9E3779B97F4A7C15 % 2**64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up)])
    return mix((total[n:] - total[:-n]) * down[:m])


def windows_inside(word_from: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each word on lie in one document (for len - n + 1 words)."""
    total = int(word_from[-1])
    m = max(total - n + 1, 0)
    last = np.repeat(word_from[1:], np.diff(word_from))[:m]
    return np.arange(m) + n <= last


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64) if h.dtype == np.uint64 else h.astype(np.int64)
