"""Periodic runs against a plain scan of every lag."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paceline.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")
P = periodic.Runs()


def plain_runs(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.sampled_from([1, 1, 3, 4, 5, 9])), max_size=5))
def test_runs_of_one_document(parts):
    w = [x for block, k in parts for x in block * k]
    assert periodic.runs_of(np.array(w, np.uint64), np.array([0, len(w)]), P)[0] == plain_runs(w)


def test_segments_hold_frequent_words_only():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 40, 4000).astype(np.uint64)
    bounds = np.array([0, 0, 700, 1900, 1903, 4000])
    starts, ends = periodic.split_by_frequency(codes, bounds, 4)
    assert all(np.unique(codes[a:b], return_counts=True)[1].min() >= 4 for a, b in zip(starts, ends, strict=True))
    assert all(np.searchsorted(bounds, a, "right") == np.searchsorted(bounds, b, "left") for a, b in zip(starts, ends, strict=True))


def test_a_long_even_text_takes_few_steps():
    for w in (np.zeros(200_000, np.uint64), np.tile(np.arange(900, dtype=np.uint64), 220), np.random.default_rng(0).integers(0, 2, 100_000).astype(np.uint64)):
        runs = periodic.runs_of(w, np.array([0, len(w)]), P)[0]
        assert runs and all(n >= max(6, 4 * q) for _, n, q in runs)
    assert periodic.runs_of(np.tile(np.arange(900, dtype=np.uint64), 220), np.array([0, 198_000]), P)[0] == [(0, 198_000, 900)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(120)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \t\r\n\x0b\x0c "), (None, "a b c " * 9), (1003, "x " * 12 + "a b " * 8), (1003, "x " * 12 + "a b " * 8), (1004, "A a " * 6 + "é é é é " * 5), (-17, "one two " * 40), (1005, "z " * 5), (1006, "z " * 6), (2, "q " * 7)]
    return rows, spark.createDataFrame([(*r, "7") for r in rows], "doc_id long, text string, start string").repartition(3)


def test_digest(docs):
    rows, d = docs
    got = [tuple(r) for r in periodic.run_digest(d).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted((plain_digest(*r) for r in rows), key=key)
    assert any(r[1] for r in got) and periodic.run_digest(d.limit(0)).count() == 0


def test_runs_and_texts(docs):
    rows, d = docs
    for r in periodic.collapse_runs(d).where("doc_id >= 1000").collect():
        w = WORD.findall(dict((a, b) for a, b in rows)[r.doc_id] or "")
        assert [tuple(x) for x in r.runs] == plain_runs(w)
        assert r.text == " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in plain_runs(w)))


def test_given_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    short = [tuple(r) for r in d.collect() if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in periodic.run_digest(d).collect()}
    assert all(got[r[0]] == plain_digest(*r) for r in short)
