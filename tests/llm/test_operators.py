"""The corpus operators against brute force, round trips and edge cases, on small fixtures."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from paceline.llm import chat, html_text, mixing, neardup, neighbours, packing, passages, quality, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=70)
    rows = []
    for i in range(60):
        base = rng.choices(vocabulary, k=rng.choice([3, 40, 120, 200]))
        if i % 5 == 0:
            base = base[:20] + passage[i % 9 :] + base[20:]
        rows.append(base)
    for i in range(25):  # near copies
        copy = list(rows[i % 4 + 10])
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append(copy)
    texts = [" ".join(x) if k % 3 else "\n\t".join(x) for k, x in enumerate(rows)]
    texts += [None, "", "  ", "one two", "ONE two", texts[10], "a b c", "the " * 300]
    return [(100 + 7 * k % 997, t, "en", None if k % 11 == 0 else f"s{k % 4}", 0) for k, t in enumerate(texts)] + [(None, texts[10], "en", "s1", 0), (100, texts[0], "en", "s1", 0)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, corpus, k):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t, *_ in corpus]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    want = collections.Counter((d, len(s), None if d is None else find(d) if s else d) for d, s in sets)
    out = neardup.near_duplicates(docs, params=neardup.NearDup(shingle=k)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_passages(docs, corpus):
    own = {}
    big = 2**63
    for d, t, *_ in corpus:
        w = words(t)
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            own[key] = min(own.get(key, big), big - 1 if d is None else d)
    want = collections.Counter()
    for d, t, *_ in corpus:
        w, gone = words(t), set()
        for i in range(len(w) - 49):
            if own[tuple(w[i : i + 50])] < (big - 1 if d is None else d):
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = collections.Counter(tuple(r) for r in passages.passage_digest(docs).collect())
    assert got == want and sum(k[2] for k in want) > 100
    cut = passages.remove_passages(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert collections.Counter(len(words(r.text)) for r in cut.collect()) == collections.Counter(k[1] - k[2] for k in want.elements())


def test_cover_is_checked():
    with pytest.raises(ValueError):
        passages.Passages(cover=(1, 2, 3))


def test_mixing(docs, corpus):
    out = mixing.mix_digest(docs, params=mixing.Mix(block=16)).collect()
    assert collections.Counter((r.doc_id, r["size"]) for r in out) == collections.Counter((d, len(words(t))) for d, t, *_ in corpus)
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        s = by.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r.taken
        s[1] += r["size"]
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * n + 1e-9 and abs(s[0] - t) <= 48 for (n, t), s in by.items())
    mixed = mixing.mix_documents(docs, params=mixing.Mix(block=16))
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in out)


def test_packing(docs, corpus):
    encode = packing._Encoder(None)
    ids = {t: [*encode.model.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in corpus}
    out = packing.pack(docs, params=packing.Packing(length=64)).collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        assert r.continues == (r.start > 0) and r.continued == (r.start + r.length < r.doc_tokens)
        got[r.sequence_id].append(r)
    last = max(got)
    for k, rows in got.items():
        assert [r.offset for r in rows] == list(np.cumsum([0, *(r.length for r in rows[:-1])]))
        assert k == last or sum(r.length for r in rows) == 64
    stream = [x for k in sorted(got) for r in got[k] for x in r.ids]
    assert collections.Counter(stream) == collections.Counter(x for _, t, *_ in corpus for x in ids[t])
    for t in ["a  b", " é à b ", "<|endoftext|> x", "日本 語", "it's 12 #", "", "\x1c a"]:
        assert np.frombuffer(encode([t])[0], "<u4").tolist() == encode.model.encode(t, add_special_tokens=False).ids


def test_quality(spark, docs, corpus):
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in corpus[:20]] + [(None, 1, 0), (101, None, 0)], "doc_id long, quality int, toxic int")

    def brute(t):
        w = words(t)
        count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        seen, repeats = set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                repeats += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), repeats, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)

    out = quality.quality_digest(docs, labels).collect()
    want = collections.Counter((d, *brute(t)) for d, t, *_ in corpus)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert all(not (r.kept and r.base_failed) for r in out)


def test_toxicity(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=30) + (["Vile,"] if i % 4 == 0 else []))) for i in range(800)]
    docs = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_digest(docs, labels).collect()
    assert len(out) == 802 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 800]
    assert len(held) > 100 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == ["doc_id", "text"] and 590 <= kept.count() <= 612


def brute_repair(roles, p):
    """Least cost over all labellings."""
    via = chat._paths(p)
    best = {0: 0.0}
    for r in roles:
        nxt = {}
        for s, c in best.items():
            for to in (1, 2, 3):
                k = c + (0 if chat._role(r) == to else p.relabel)
                for more in ([p.merge] if s == to else []) + ([p.insert * len(via[s, to])] if (s, to) in via else []):
                    nxt[to] = min(nxt.get(to, 1e9), k + more)
        best = nxt
    end = chat._end_cost(p)
    return min(c + end[s] for s, c in best.items())


def test_chat(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant", " User ", "tool", None]), rng.choice([f"x{t}", None])) for c in [None, *range(40)] for t in range(rng.randrange(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    p = chat.Repair()
    whole, cut = (chat.repair(turns, q).collect() for q in (p, chat.Repair(block=2)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r[2])
    for out in (whole, cut):
        got = collections.defaultdict(list)
        for r in sorted(out, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn_no)):
            got[r.conv_id].append(r)
        assert set(got) == set(by)
        for c, parts in got.items():
            assert abs(parts[0].cost - brute_repair(by[c], p)) < 1e-9
            states = [0, *(chat.ROLES.index(x.role) for x in parts)]
            assert all((a, b) in chat.LEGAL for a, b in zip(states, states[1:])) and states[-1] == 3
            assert [x.turn_no for x in parts] == list(range(len(parts)))
            assert abs(sum(p.merge * x.merged + p.relabel * x.relabelled + p.insert * x.inserted for x in parts) - parts[0].cost) < 1e-9
    assert chat.repair(empty(spark, "conv_id long, turn long, role string, text string")).count() == 0


def test_html(spark):
    page = "<html><head><title>T</title><script>if (a<b) {}</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head &amp; more</h1><p>First,  long\n text.<br>Here.<p>Second &eacute;, one.</p><div class='ad'>Buy!</div></article><div id=comments><p>A comment, long enough.</p></div><footer>c</footer>"
    out = {r.page_id: r for r in html_text.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string")).collect()}
    assert out[1].text == "Head & more\nFirst, long text. Here.\nSecond é, one." and out[1].n_chars == len(out[1].text)
    assert out[2].text == out[None].text == ""


def test_warc(spark):
    rows = [(3, "u\r\n3", "same"), (1, "u1", "same"), (2, None, None), (7, "u7", ""), (9, "u9", "é" * 5000), (None, "n", "same"), (None, "m", "alone"), (1, "u1", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = collections.Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and f != p
        want[p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None] += 1
    assert collections.Counter(tuple(r) for r in warc.warc_digest(pages).collect()) == want
    index, root = warc.write_archives(pages)
    some = warc.read_records(index.where("page_id = 9"), root).collect()
    assert [bytes(r.payload).decode() for r in some] == ["é" * 5000]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 9)).astype("float32")
    x[100:180] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 9), (1040, [float("nan")] * 9), (1060, [1.0, None] + [0.0] * 7), (1080, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    whole = neighbours.search(v, neighbours.MultiIndex(recall=1.0, block_least=64)).collect()
    got = collections.defaultdict(list)
    for r in sorted(whole, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    x = x.astype(float)
    assert sorted(got) == list(range(0, 600, 20))
    for q, rows in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        assert [r.vec_id for r in rows] == np.lexsort((np.arange(600), -s))[:20].tolist()
        assert np.allclose([r.score for r in rows], s[[r.vec_id for r in rows]], rtol=1e-12)
    assert neighbours.search(empty(spark, "vec_id long, embedding array<float>")).count() == 0


def test_empty_tables(spark):
    d = empty(spark, DOCS)
    labels = empty(spark, "doc_id long, quality int, toxic int")
    assert neardup.near_duplicates(d).count() == 0 and passages.passage_digest(d).count() == 0
    assert mixing.mix_digest(d).count() == 0 and packing.pack_digest(d).count() == 0
    assert quality.quality_digest(d, labels).count() == 0 and toxicity.toxicity_digest(d, labels).count() == 0
    pages = empty(spark, "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0 and warc.warc_digest(pages).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    pieces = corpus_pipeline.run(spark, d).collect()
    assert len(pieces) > 0 and all(r.length == len(r.ids) for r in pieces)
