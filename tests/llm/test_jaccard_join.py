"""The Jaccard join against all pairs, with classes of singles, pairs and triples."""

import random
import re

import numpy as np
import pytest

from paceline.llm import jaccard_join
from paceline.llm.jaccard_join import JaccardJoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def token_set(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain(rows, k, percent):
    sets = [token_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(x), d if d is None else least[find(i)]) for i, ((d, _), x) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, common):
    """Near copies around the threshold of a few long texts, with a passage that most texts share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=common)
    rows = []
    for g in range(12):
        base = passage + rng.choices(vocabulary, k=rng.choice([6, 9, 14, 40, 150, 400])) + passage[: common // 2]
        for _ in range(rng.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 22))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], rng.choice(vocabulary)]])
            rows.append(" ".join(copy))
    rows += [None, "", "\t ", "one", "ONE", "a b", "a b c", "A b c", "the " * 90, rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return [(7 * i % 1009, t) for i, t in enumerate(rows)] + [(None, rows[0]), (14, rows[3]), (14, rows[3])]


@pytest.mark.parametrize(
    ("p", "common"),
    [(JaccardJoin(), 120), (JaccardJoin(pairs_above=1, triples_above=3), 120), (JaccardJoin(percent=80, pairs_above=1, triples_above=2), 0), (JaccardJoin(percent=60, shingle=1, pairs_above=1, triples_above=5), 0)],
    ids=str,
)
def test_against_all_pairs(spark, p, common):
    rows = corpus(common + p.percent, common)
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n long, key string").repartition(3)
    got = [tuple(r) for r in jaccard_join.jaccard_components(d, params=p).collect()]
    want = plain(rows, p.shingle, p.percent)
    assert sorted(got, key=str) == want
    assert len({r[2] for r in want}) < len(want) - 10


def test_prefixes_share_a_combination(spark):
    """Every linked pair has a key in common, whatever the frequencies."""
    p = JaccardJoin(shingle=1, percent=80, pairs_above=1, triples_above=3)
    rng = np.random.default_rng(4)
    weight = 1 / np.arange(1, 301)
    sets = {}
    for i in range(160):
        have = set(sets[rng.integers(i)]) if i % 2 and i else set(rng.choice(300, rng.choice([5, 8, 20, 60, 120]), False, weight / weight.sum()).tolist())
        have = set(list(have)[int(rng.integers(0, len(have) // 9 + 1)) :]) | {int(x) for x in rng.integers(0, 300, rng.integers(0, len(have) // 9 + 1))}
        sets[i] = have
    texts = spark.createDataFrame([(i, " ".join(f"t{x}" for x in s).encode()) for i, s in sets.items()], "id long, text binary")
    of = {}
    for r in jaccard_join.candidate_keys(texts, p)[0].collect():
        of.setdefault(r.id, set()).add(r.key)
    linked = [(a, b) for a in sets for b in range(a) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(linked) > 20 and all(of[a] & of[b] for a, b in linked)


def test_classes_leave_enough_cover():
    for percent in (60, 80, 90, 95):
        p = JaccardJoin(percent=percent)
        for n in range(1, 5000):
            band = int(np.floor(np.log2(n)))
            for b in {band, int(np.floor(np.log2(100 * n // percent)))}:
                pairs, triples = p.classes(b)
                assert n - pairs - 2 * triples >= p.spare(n) + 1


def test_texts_of_one_template_are_not_paired_with_one_another(spark, monkeypatch):
    """300 texts, each with a few words of its own, are too far apart; the few that link are found."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(2, 148), 4):
            w[at] = f"own{i}_{at}"
        rows.append((i, " ".join(w)))
    near = rows[7][1].split()
    near[75] = "x"
    rows += [(1000, " ".join(near)), (1001, rows[9][1].replace("w70 ", "y "))]
    asked = []
    confirmed = jaccard_join._confirmed
    monkeypatch.setattr(jaccard_join, "_confirmed", lambda pairs, *more: (asked.append(pairs.count()), confirmed(pairs, *more))[1])
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == plain(rows, 3, 90) and len({r[2] for r in got}) == 300
    assert sum(asked) < 10


def test_empty_and_long(spark):
    d = spark.createDataFrame([], DOCS)
    assert jaccard_join.jaccard_components(d).count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(5, long), (3, long + " end"), (4, long[: len(long) * 8 // 10]), (9, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[5] == (199_998, 3) and got[3] == (199_999, 3) and got[4][1] == 4 and got[9] == (0, 9)
