"""Clashing and extra columns, empty tables, very long texts, and the whole pipeline against plain versions."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from paceline.llm import mixing, neardup, neighbours, packing, passages, quality, toxicity, warc
from tests.llm.test_operators import WORD, corpus, words  # noqa: F401

CLASHES = ["sha", "_sha", "_key", "_kept", "toxic_score", "_text", "_h", "_nth", "_size", "_row", "_gone", "_ord", "h", "id", "size", "rank", "start", "n", "c", "owner", "spans", "turn", "component_id"]


@pytest.fixture(scope="module")
def odd(spark, corpus):  # noqa: F811
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *(f"{c}{k}" for c in CLASHES)) for k, r in enumerate(corpus)], schema).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")


def test_clashing_columns(odd, labels):
    n = odd.count()
    for out in (toxicity.reject_toxic(odd, labels), neardup.keep_first(odd), passages.remove_passages(odd), mixing.mix_documents(odd, params=mixing.Mix(block=16))):
        assert out.columns == odd.columns
        rows = out.collect()
        assert 0 < len(rows) <= 2 * n
        assert all(r[c] == f"{c}{r['sha'][3:]}" for r in rows for c in CLASHES)  # each row keeps its own values
    for out in (neardup.near_duplicates(odd), passages.passage_digest(odd), mixing.mix_digest(odd), packing.pack_digest(odd), quality.quality_digest(odd, labels), toxicity.toxicity_digest(odd, labels)):
        assert out.count() >= n


def test_empty_tables(spark, odd, labels):
    d, none = odd.limit(0), labels.limit(0)
    assert toxicity.reject_toxic(d, labels).count() == neardup.keep_first(d).count() == passages.remove_passages(d).count() == mixing.mix_documents(d).count() == packing.pack(d).count() == 0
    assert toxicity.reject_toxic(odd, none).columns == odd.columns
    assert neighbours.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_all_null(spark, labels):
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert neardup.keep_first(d).count() == passages.remove_passages(d).count() == toxicity.reject_toxic(d, labels).count() == 3
    assert mixing.mix_documents(d).count() == 0 and [r.taken for r in mixing.mix_digest(d).collect()] == [0] * 3
    assert packing.pack_digest(d).count() == 3


def test_very_long_texts(spark, labels):
    long = " ".join(f"w{i % 70_000}" for i in range(700_000))  # 4.7 MB, more than a chunk
    rows = [(101, long), (102, long + " end"), (103, "short one"), (104, "x" * 3_000_000)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = {r.doc_id: r for r in neardup.near_duplicates(d).collect()}
    assert near[102].component_id == 101 and near[101].n_shingles == 70_000 and near[104].n_shingles == 1
    cut = {r.doc_id: r for r in passages.passage_digest(d).collect()}
    assert (cut[102].n_removed, cut[102].n_words, cut[101].n_removed) == (700_000, 700_001, 0)
    mix = {r.doc_id: r for r in mixing.mix_digest(d).collect()}
    assert mix[101]["size"] == 700_000 and 0 < mix[101].taken <= 1_400_000
    packed = collections.Counter()
    for r in packing.pack_digest(d).collect():
        packed[r.doc_id] += r.length
        assert r.length <= 2048
    assert packed[101] > 700_000
    q = {r.doc_id: r for r in quality.quality_digest(d, labels).collect()}
    assert q[101].n_words == 700_000 and q[101].n_repeat_words == 700_000 and q[104].word_chars == 3_000_000
    assert toxicity.toxicity_digest(d, labels).count() == 4
    page = spark.createDataFrame([(1, "u", long), (2, "v", long)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.warc_digest(page).collect()) == [(1, len(long), "response"), (2, len(long), "revisit")]


def test_pipeline_by_plain_versions(spark, corpus, tmp_path):  # noqa: F811
    """Each stage on what its predecessor kept, against plain Python; mixing by what it may take."""
    rows = [r for r in corpus if r[0] is not None] + [(3000 + i, f"vile words, number {i} of them, and more vile words {i * 7}", "en", "s1", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame([(r[0], 1, int("vile" in (r[1] or ""))) for r in rows], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    d, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path)).cache()
        out[name] = d.collect()
    kept = [r for r in rows if "vile" not in (r[1] or "")]
    assert collections.Counter(r[0] for r in kept) == collections.Counter(r.doc_id for r in out["toxicity"])

    sets = [(r[0], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())) for r in kept for w in [words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))]]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    first = [r for r in kept if find(r[0]) == r[0]]
    assert collections.Counter(r[0] for r in first) == collections.Counter(r.doc_id for r in out["minhash_near_dedup"])

    own = {}
    for r in first:
        w = words(r[1])
        for i in range(len(w) - 49):
            own[tuple(w[i : i + 50])] = min(own.get(tuple(w[i : i + 50]), 1 << 62), r[0])
    left = []
    for r in first:
        w = words(r[1])
        gone = {k for i in range(len(w) - 49) if own[tuple(w[i : i + 50])] < r[0] for k in range(i, i + 50)}
        left.append((r[0], [x for i, x in enumerate(w) if i not in gone]))
    assert collections.Counter((a, *w) for a, w in left) == collections.Counter((r.doc_id, *words(r.text)) for r in out["substring_dedup"])

    have = collections.defaultdict(collections.Counter)
    for a, w in left:
        for x in w:
            have[a][x] += 1
    took = collections.defaultdict(collections.Counter)
    for r in out["source_mixing"]:
        took[r.doc_id].update(words(r.text))
    assert all(n <= 2 * have[a][x] for a, c in took.items() for x, n in c.items())
    digest = mixing.mix_digest(spark.createDataFrame(out["substring_dedup"], docs.schema))
    assert {r.doc_id: r.n for r in digest.groupBy("doc_id").agg({"taken": "sum"}).toDF("doc_id", "n").collect() if r.n} == {a: sum(c.values()) for a, c in took.items()}

    encode = packing._Encoder(None)
    want = collections.Counter(x for r in out["source_mixing"] for x in [*encode.model.encode(r.text or "", add_special_tokens=False).ids, 1])
    pieces = out["packing"]
    assert collections.Counter(x for r in pieces for x in r.ids) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)
