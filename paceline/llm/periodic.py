"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of words with smallest period q and a length of at least
max(``least``, ``times`` * q) that no neighbouring word extends.  Within such a run
each word occurs ``times`` times or more, so a word that occurs fewer times in its
segment can lie in no run of that segment: it splits the segment, and the parts are
counted anew until no word splits any more.  Runs lie whole inside one surviving
segment.

The lag scan of a segment takes each lag q up to a ``times``-th of its length, but
looks at the words q, 2q, 3q, .. only: the stretch of a run in which words equal those
q later holds two or more whole cells of that grid, which prefix sums of word hashes
compare at once.  A segment of m words so costs about m log m comparisons.  Hits are
widened to the run's ends by the same sums, and of runs over the same words that with
the smallest period stays.

One pass over the documents, nothing is shuffled; memory follows the longest text.
Defined results: a null or empty text has no words and no run; a null id is not
folded (see ``folded_words``); rows that repeat are worked on one by one; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_list, column
from .textkit import chunks, mix


@dataclass(frozen=True)
class Runs:
    least: int = 6  # words of a run, at least
    times: int = 4  # periods in a run, at least


def split_by_frequency(codes: np.ndarray, bounds: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the segments in which every word occurs ``times`` times or more.

    ``codes`` are word hashes, ``bounds`` the first segments' ends (documents).  Only
    segments that were split in the last round are counted again.
    """
    starts, ends = bounds[:-1].astype(np.int64), bounds[1:].astype(np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(starts):
        long = ends - starts >= times
        starts, ends = starts[long], ends[long]
        size = ends - starts
        if not len(starts):
            break
        segment = np.repeat(np.arange(len(starts)), size)
        at = np.arange(size.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        word = codes[at]
        order = np.lexsort((word, segment))
        s, w = segment[order], word[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(first) - 1
        rare = np.zeros(len(s), bool)
        rare[order] = np.bincount(group)[group] < times
        cut = np.zeros(len(starts), bool)
        cut[segment[rare]] = True
        done.append((starts[~cut], ends[~cut]))
        # Stretches without a rare word, within the segments that hold one.
        live = ~rare & cut[segment]
        opens, closes = live.copy(), live.copy()
        opens[1:] &= ~live[:-1] | (segment[1:] != segment[:-1])
        closes[:-1] &= ~live[1:] | (segment[1:] != segment[:-1])
        starts, ends = at[opens], at[closes] + 1
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])


class _Sums:
    """Hashes of stretches of words from prefix sums."""

    _ODD = 0x9E3779B97F4A7C15

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        power = np.full(n + 1, self._ODD, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes) * self.power[:n])])

    def same(self, a: np.ndarray, lag: int, n: np.ndarray | int) -> np.ndarray:
        """Whether the n words from a on equal those ``lag`` words later."""
        return (self.total[a + n] - self.total[a]) * self.power[lag] == self.total[a + lag + n] - self.total[a + lag]

    def ahead(self, a: np.ndarray, lag: int, most: np.ndarray) -> np.ndarray:
        """How many words from a on equal those ``lag`` later (``most`` or fewer)."""
        lo, hi = np.zeros_like(most), most.copy()
        while np.any(lo < hi):
            mid = (lo + hi + 1) // 2
            ok = self.same(a, lag, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    def behind(self, a: np.ndarray, lag: int, most: np.ndarray) -> np.ndarray:
        """How many words before a equal those ``lag`` later (``most`` or fewer)."""
        lo, hi = np.zeros_like(most), most.copy()
        while np.any(lo < hi):
            mid = (lo + hi + 1) // 2
            ok = self.same(a - mid, lag, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo


def scan_lags(codes: np.ndarray, p: Runs) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment, by start, then period."""
    m = len(codes)
    if m < p.least:
        return []
    sums = _Sums(codes)
    found: dict[tuple[int, int], int] = {}
    long: list[tuple[int, int, int]] = []  # runs that hold two cells of a later lag, or more
    for q in range(1, m // p.times + 1):
        grid = np.arange(0, m - 2 * q + 1, q)
        grid = grid[codes[grid] == codes[grid + q]]
        if not len(grid):
            continue
        grid = grid[sums.same(grid, q, q)]
        long = [r for r in long if r[1] - r[0] >= 2 * q]
        for a, b, p0 in long:
            if q % p0 == 0:  # over these words a multiple of the period finds the same run again
                grid = grid[(grid < a) | (grid + 2 * q > b)]
        if not len(grid):
            continue
        new = np.ones(len(grid), bool)
        new[1:] = np.diff(grid) != q  # cells side by side belong to one run
        opens = grid[new]
        closes = grid[np.concatenate([new[1:], [True]])] + q
        start = opens - sums.behind(opens, q, np.minimum(opens, q))
        end = closes + sums.ahead(closes, q, np.minimum(m - q - closes, q)) + q
        fit = end - start >= max(p.least, p.times * q)
        for a, b in zip(start[fit].tolist(), end[fit].tolist(), strict=True):
            if (a, b) not in found:  # lags rise: the smallest period comes first
                found[a, b] = q
                if b - a >= 4 * q:
                    long.append((a, b, q))
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs_of(codes: np.ndarray, bounds: np.ndarray, p: Runs) -> list[list[tuple[int, int, int]]]:
    """The runs of each document of ``bounds``; starts are counted from the document's first word."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    starts, ends = split_by_frequency(codes, bounds, p.times)
    for a, b, d in zip(starts.tolist(), ends.tolist(), (np.searchsorted(bounds, starts, "right") - 1).tolist(), strict=True):
        base = a - int(bounds[d])
        out[d] += [(base + s, n, q) for s, n, q in scan_lags(codes[a:b], p)]
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def folded_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place once every tenth document, by crc32 of its id, is folded.

    Null: the text stays as it is.  From word a on, the first ``p`` words repeat.
    """
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of ties the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that lie in no run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) == 0


_FIELDS = [("id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())]
_DIGEST = pa.schema([*_FIELDS, ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_TEXTS = pa.schema([("id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])

Fold = Callable[[int | None, int], "np.ndarray | None"]


def _documents(batch: pa.RecordBatch, p: Runs, fold: Fold | None) -> Iterator[tuple[int | None, list[tuple[int, int, int]], list[bytes]]]:
    """(id, runs, kept words) of each row."""
    ids = column(batch, "id").to_pylist()
    for c in chunks(binary_list(batch, "text")):
        raw, n = c.word_hashes(), c.n_words.tolist()
        source = np.arange(len(raw))
        if fold:
            for d in range(c.n_docs):
                order = fold(ids[c.first + d], n[d])
                if order is not None:
                    source[c.word_from[d] : c.word_from[d + 1]] = c.word_from[d] + order
        data = c.buf.tobytes()
        for d, runs in enumerate(runs_of(raw[source], c.word_from, p)):
            mine = source[c.word_from[d] : c.word_from[d + 1]]
            mine = mine[collapsed(n[d], runs)] if runs else mine
            yield ids[c.first + d], runs, [data[a:b] for a, b in zip(c.start[mine].tolist(), c.end[mine].tolist(), strict=True)]


def _digests(p: Runs, fold: Fold | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, runs, kept in _documents(batch, p, fold):
                best = strongest(runs)
                top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                rows.append((doc_id, len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * len(_DIGEST)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _DIGEST, strict=True)], schema=_DIGEST)

    return run


def _texts(p: Runs, fold: Fold | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(kept)) for i, runs, kept in _documents(batch, p, fold)]
            cols = list(zip(*rows, strict=True)) or [()] * len(_TEXTS)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _TEXTS, strict=True)], schema=_TEXTS)

    return run


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Runs = Runs()) -> DataFrame:
    """(id, runs, text) of each row: its runs by start and period, and the text with one period of each left."""
    out = _base(docs, id_col, text_col).mapInArrow(_texts(params, None), "id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias(text_col))


def run_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Runs = Runs(), fold: Fold | None = folded_words) -> DataFrame:
    """Per row: id, n_runs, the strongest run and digests of all runs and of the collapsed text; texts are folded first."""
    schema = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _base(docs, id_col, text_col).mapInArrow(_digests(params, fold), schema).withColumnRenamed("id", id_col)
