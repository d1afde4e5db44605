"""Pruned products, counted ranks, linkage by components and the merge tree against plain forms."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import identity, linking, pairs, sweeps


def clustered(seed, n=400, dim=8, lumps=12, noise=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(lumps, dim))
    v = centres[rng.integers(0, lumps, n)] + noise * rng.normal(size=(n, dim))
    v[5] = v[6] = v[7]
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_similar_is_exact_and_multiplies_fewer_blocks_as_the_threshold_rises(spark):
    v = clustered(1)
    scene = np.arange(len(v)) % 2
    d = spark.createDataFrame([(int(scene[i]), i, v[i].tolist()) for i in range(len(v))], "scene long, id long, v array<double>")
    shares = []
    for least in (0.2, 0.9, 0.99):
        s = v @ v.T
        want = {(int(scene[a]), a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if scene[a] == scene[b] and s[a, b] >= least}
        got = {(r.scene, r.a, r.b): r.score for r in pairs.similar(d, least, size=16).collect()}
        assert set(got) == want and all(abs(got[k] - s[k[1], k[2]]) < 1e-12 for k in got)
        r = pairs.block_share(d, least, size=16).first()
        shares.append(r.formed / r["all"])
    assert shares[0] > shares[1] >= shares[2] and shares[2] < 0.35
    assert pairs.similar(d, 1.5).count() == 0 and pairs.similar(d.limit(0), 0.5).count() == 0


def test_ranks_of_matches_without_pairs(spark):
    v = clustered(2, 300, lumps=6, noise=0.6)
    rng = np.random.default_rng(0)
    rows = [(i, int(i % 2), int(rng.integers(3)), int(rng.integers(9)), v[i].tolist()) for i in range(300)]
    d = spark.createDataFrame(rows, "vec_id long, scene long, cam_id long, person_id long, v array<double>").repartition(5)
    got = {(r.query_id, r.vec_id): r["rank"] for r in pairs.ranked_matches(d.where("vec_id % 3 = 0"), d).collect()}
    want, ap = {}, {}
    for i, s, c, p, _ in rows:
        if i % 3 == 0:
            others = [r for r in rows if r[1] == s and r[2] != c]
            order = sorted(others, key=lambda r: (-np.rint(float(v[i] @ v[r[0]]) * 1e9), r[0]))
            hits = [k for k, r in enumerate(order, 1) if r[3] == p]
            want |= {(i, order[k - 1][0]): k for k in hits}
            if hits:
                ap[i] = (int(hits[0] == 1), np.mean([(n + 1) / k for n, k in enumerate(hits)]))
    assert got == want
    r = {x.query_id: (x.hit, x.ap) for x in linking.retrieval(d, d.where("vec_id % 3 = 0")).collect()}
    assert r.keys() == ap.keys() and all(r[k][0] == ap[k][0] and abs(r[k][1] - ap[k][1]) < 1e-12 for k in ap)


def dense_linkage(v, far):
    """Average linkage by all pairs of clusters; the nearest two merge first."""
    sets = [[i] for i in range(len(v))]
    d = np.clip(1 - v @ v.T, 0, 2)
    while len(sets) > 1:
        m = np.array([[d[np.ix_(a, b)].mean() if a is not b else np.inf for b in sets] for a in sets])
        i, j = np.unravel_index(m.argmin(), m.shape)
        if m[i, j] > far:
            break
        i, j = min(i, j), max(i, j)
        sets[i] = sorted(sets[i] + sets.pop(j))
    return sets


@pytest.mark.parametrize("seed", [3, 4])
def test_linkage_by_components(spark, seed):
    rows, want = [], {}
    for scene in (0, 1):
        v = clustered(seed + 10 * scene, 60, lumps=9, noise=0.35)
        v[5:8] = clustered(99 + scene, 8)[:3]  # no ties
        n = np.random.default_rng(seed).integers(1, 12, 60)
        rows += [(scene, i, v[i].tolist(), int(n[i])) for i in range(60)]
        sets = dense_linkage(v, 0.3)
        label = {i: k for k, s in enumerate(sets) for i in s}
        enough = [i for i in range(60) if n[i] >= 4]
        final = {i: label[i] if n[i] >= 4 else label[max(enough, key=lambda j: v[i] @ v[j])] for i in range(60)}
        order = {k: p for p, k in enumerate(dict.fromkeys(final[i] for i in range(60)), 1)}
        want |= {(scene, i): order[final[i]] for i in range(60)}
    d = spark.createDataFrame(rows, "scene long, global_id long, v array<double>, n long").repartition(3)
    got = {(r.scene, r.global_id): r.label for r in linking.cosine_merge(d, 0.3, 4).collect()}
    assert got == want and 4 < len(set(want.values())) < 60


def test_forest_is_minimal_and_spans(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b), float(rng.integers(0, 30))) for a, b in rng.integers(0, 60, (140, 2))]
    got = sweeps.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    root, total, n = list(range(60)), 0.0, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            root[find(a)], total, n = find(b), total + w, n + 1
    assert len(got) == n and sum(r.w for r in got) == total
    assert sweeps.spanning_forest(spark.createDataFrame([], "a long, b long, w double")).count() == 0


def test_sweep_scores_as_one_run_for_each_threshold(spark):
    rng = np.random.default_rng(5)
    box = "cam_id int, frame_no long, {} long, det_id long, left double, top double, width double, height double"
    gt = [(c, f, p, 0, 40.0 * p + f, 0.0, 30.0, 60.0) for c in (0, 1) for f in range(40) for p in range(5) if rng.random() < 0.8]
    gt = [(*r[:3], k, *r[4:]) for k, r in enumerate(gt)]
    pred = [(c, f, 100 * c + 10 * p + f // 10, k, x + float(rng.integers(-3, 4)), y, w, h) for k, (c, f, p, _, x, y, w, h) in enumerate(gt) if rng.random() < 0.9]
    gt, pred = spark.createDataFrame(gt, box.format("person_id")), spark.createDataFrame(pred, box.format("global_id"))
    nodes = sorted({r.global_id for r in pred.collect()})
    far = [(a, b, abs(a % 100 - b % 100) / 2 + float(rng.random() * 8)) for i, a in enumerate(nodes) for b in nodes[:i] if rng.random() < 0.4]
    far = spark.createDataFrame(far, "a long, b long, distance double")
    hits = identity.frame_matches(gt, pred).groupBy("person_id", F.col("global_id").alias("node")).agg(F.count("*").alias("n"))
    n = lambda d: d.agg(F.count("*").alias("n"))
    steps = [0.5, 2.0, 5.0, 30.0]
    got = {r.setting: (r.threshold, r.ids, r.idtp, r.idf1) for r in sweeps.threshold_scores(far, hits, pred.select(F.col("global_id").alias("node")), n(gt), n(pred), steps).collect()}
    for k, t in enumerate(steps):
        of = identity.components(far.where(F.col("distance") <= t).select("a", "b"))
        linked = pred.join(of.toDF("global_id", "to"), "global_id", "left").withColumn("global_id", F.coalesce("to", "global_id"))
        one = identity.global_idf1(gt, linked).first()
        assert got[k] == (t, linked.select("global_id").distinct().count(), one.idtp, one.idf1)
    assert len({x[2] for x in got.values()}) > 2


def test_ranks_hold_over_blocks_of_queries_and_parts_of_the_gallery(spark):
    """Few and many matches, equal scores, persons that share a block and one that has several; no row for a query and a vector."""
    rng = np.random.default_rng(3)
    v = clustered(5, 400, lumps=5, noise=0.5)[rng.integers(0, 250, 400)]  # copies, so scores tie
    who = [int(rng.integers(40)) if i % 3 else 99 for i in range(400)]
    rows = [(i, int(rng.integers(2)), int(rng.integers(3)), who[i], v[i].tolist()) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, scene long, cam_id long, person_id long, v array<double>").repartition(3)
    want = {}
    for i, s, c, p, _ in rows:
        order = sorted((r for r in rows if r[1] == s and r[2] != c), key=lambda r: (-np.rint(float(v[i] @ v[r[0]]) * 1e9), r[0]))
        hits = [k for k, r in enumerate(order, 1) if r[3] == p]
        if hits:
            want[i] = hits
    for size in (50, 20_000):
        got = pairs.match_ranks(d, d, lambda q, ids, ranks: ([q], [ranks.tolist()]), "query_id long, ranks array<long>", size)
        assert {r.query_id: r.ranks for r in got.collect()} == want


def test_linkage_holds_no_matrix():
    """Average linkage of 12,000 vectors within 100 MB (their distances are 1,152 MB), and the same clusters as by all pairs."""
    tracemalloc.start()
    v = clustered(7, 12_000, lumps=400, noise=0.05)
    label = linking.average_linkage(v, 0.2)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert len(np.unique(label)) < 1200 and (label <= np.arange(len(v))).all()
    for seed, far in ((1, 0.3), (2, 0.8), (3, 1.1)):
        v = clustered(seed, 70, lumps=6, noise=0.5)
        v = np.concatenate([v, v[:20]])
        want = {tuple(sorted(x)) for x in dense_linkage(v, far)}
        got = linking.average_linkage(v, far)
        assert {tuple(np.flatnonzero(got == k).tolist()) for k in np.unique(got)} == want


def test_linked_pairs_have_the_components_of_all(spark):
    v = clustered(11, 300, lumps=30, noise=0.1)
    d = spark.createDataFrame([(i % 2, i, v[i].tolist()) for i in range(300)], "scene long, id long, v array<double>")
    every, few = pairs.similar(d, 0.95, size=64), pairs.linked(d, 0.95, size=64)
    assert few.count() < every.count()
    of = lambda e: {(r.node, r.component) for r in identity.components(e.select("a", "b"), d.select(d.id.alias("node"))).collect()}
    assert of(few) == of(every)
