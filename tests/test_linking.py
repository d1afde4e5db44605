"""Kernels of linking against plain versions, and small cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import grids, linking, paths
from paceline.plans.registry import QUERIES

DIR = "/root/testdata/sf0.001"


def test_ward_merges_least_variance():
    rng = np.random.default_rng(3)
    for n, k in [(1, 1), (2, 1), (7, 3), (12, 4)]:
        x = rng.normal(size=(n, 3))
        held = [[i] for i in range(n)]
        spread = lambda rows: ((x[rows] - x[rows].mean(0)) ** 2).sum()
        while len(held) > k:
            a, b = min(itertools.combinations(held, 2), key=lambda p: spread(p[0] + p[1]) - spread(p[0]) - spread(p[1]))
            held = [h for h in held if h not in (a, b)] + [a + b]
        label = linking.ward(x, k)
        assert {frozenset(np.flatnonzero(label == c)) for c in set(label)} == {frozenset(h) for h in held}


def plain_clusters(edges, apart, least, mean):
    held = sorted({frozenset([n]) for e in edges for n in e[:2]}, key=min)
    while True:
        best = []
        for a, b in itertools.combinations(held, 2):
            w = sum(w for x, y, w in edges if (x in a and y in b) or (x in b and y in a))
            met = any((x in a and y in b) or (x in b and y in a) for x, y, _ in edges)
            foes = any((x in a and y in b) or (x in b and y in a) for x, y in apart)
            if met and not foes and w / (len(a) * len(b) if mean else 1) >= least:
                best.append((w / (len(a) * len(b) if mean else 1), -min(min(a), min(b)), -max(min(a), min(b)), a, b))
        if not best:
            return {n: min(h) for h in held for n in h}
        *_, a, b = max(best, key=lambda t: t[:3])
        held = [h for h in held if h not in (a, b)] + [a | b]


@pytest.mark.parametrize("mean", [False, True])
def test_constrained_clusters(spark, mean):
    rng = np.random.default_rng(5)
    edges, apart, want = [], [], {}
    for scene in range(4):
        e = [(int(a), int(b), float(rng.integers(1, 1000)) / 64) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.5]
        c = [(int(a), int(b)) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.15]
        edges += [(scene, *x) for x in e]
        apart += [(scene, *x) for x in c]
        want |= {(scene, n): k for n, k in plain_clusters(e, c, 3.0, mean).items()}
    got = linking.constrained_clusters(spark.createDataFrame(edges, "scene long, a long, b long, weight double"), spark.createDataFrame(apart, "scene long, a long, b long"), 3.0, mean)
    assert {(r.scene, r.node): r.cluster for r in got.collect()} == want


def test_frame_clusters_take_one_box_of_a_camera(spark):
    rows = [(1, 0, 0, 0.0, 0.0), (2, 0, 1, 50.0, 0.0), (3, 0, 1, 60.0, 0.0), (4, 0, 2, 900.0, 0.0), (5, 1, 1, 0.0, 0.0), (6, 0, 3, None, 0.0)]
    p = spark.createDataFrame(rows, "det_id long, frame_no long, cam_id int, x double, y double")
    assert {tuple(r) for r in linking.cluster_frames(p, 100.0).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    got = {r.det_id: r.instance for r in QUERIES["frame_clusters"](spark, DIR).collect()}
    boxes = {r.event_id: (r.event_id // 8, r.event_id % 4) for r in spark.read.parquet(f"{DIR}/events.parquet").collect()}
    assert got and len({(i, boxes[d][1]) for d, i in got.items()}) == len(got)
    assert all(boxes[d][0] == boxes[i][0] for d, i in got.items())


def test_buffered_ids_follow_persons(spark):
    """Three persons of distinct looks in two cameras keep an id over all windows."""
    rng = np.random.default_rng(1)
    looks = np.eye(8)[:3]
    rows = []
    for f in range(60):
        for cam in (0, 1):
            for p in range(3):
                if p == 2 and 20 <= f < 40:
                    continue
                v = looks[p] + rng.normal(scale=0.05, size=8)
                rows.append((0, cam, f, len(rows), (v / np.linalg.norm(v)).tolist(), p))
    d = spark.createDataFrame(rows, "group long, cam_id int, frame_no long, det_id long, v array<double>, person long")
    got = linking.buffered_ids(d.drop("person"), 20, 0.5).join(d, "det_id")
    pairs = {(r.global_id, r.person) for r in got.select("global_id", "person").distinct().collect()}
    assert len(pairs) == 3 == len({g for g, _ in pairs}) and got.count() == len(rows)


def test_rolling_windows_and_votes(spark):
    """A chunk without a person's anchor is clustered with the chunk before; a stray box follows its track."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(0, 0, f, 2 * f, 1, a) for f in range(40)] + [(0, 0, f, 2 * f + 1, 2, b if f != 13 else a) for f in range(40)]
    rows += [(1, 0, 5, 900, 1, a)]
    d = spark.createDataFrame(rows, "group long, cam_id int, frame_no long, det_id long, local_track_id long, v array<double>")
    c = linking.window_clusters(d, 10, chunks=2, vote=5).collect()
    per = {w: sum(r.group == 0 and r.window == w for r in c) for w in range(5)}
    assert per == {0: 20, 1: 40, 2: 40, 3: 40, 4: 0}
    assert {w: sum(r.current for r in c if r.group == 0 and r.window == w) for w in range(4)} == dict.fromkeys(range(4), 20)
    got = {r.det_id: r.global_id for r in linking.buffered_ids(d, 10, 0.5, chunks=2, vote=5).collect()}
    assert len(got) == len(rows)
    assert len({got[2 * f] for f in range(40)}) == 1 == len({got[2 * f + 1] for f in range(40)}) and got[0] != got[1]


def test_stitched_persons_age_out(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    centres = spark.createDataFrame([(0, 0, 0, a), (0, 0, 1, b), (0, 1, 0, b), (0, 9, 0, a), (1, 3, 0, a)], "group long, window long, cluster long, v array<double>")
    ids = lambda age: {(r.group, r.window, r.cluster): r.global_id for r in linking.stitch_windows(centres, 0.5, age).collect()}
    assert ids(None) == {(0, 0, 0): 1, (0, 0, 1): 2, (0, 1, 0): 2, (0, 9, 0): 1, (1, 3, 0): 1}
    assert ids(5) == {(0, 0, 0): 1, (0, 0, 1): 2, (0, 1, 0): 2, (0, 9, 0): 3, (1, 3, 0): 1}
    assert linking.stitch_windows(centres.limit(0), 0.5).count() == 0


def test_buffered_query_takes_every_box(spark):
    got = QUERIES["buffered_ids"](spark, DIR)
    assert got.agg(F.count("*"), F.countDistinct("det_id")).first()[0:2] == (spark.read.parquet(f"{DIR}/events.parquet").count(),) * 2


def test_constrained_query(spark):
    got = QUERIES["constrained_links"](spark, DIR).collect()
    assert got and all(r.cluster <= r.node and r.cluster % 1_000_000 == r.scene for r in got)


def test_remap_chains_and_cycles(spark):
    chain = [(k, k - 1) for k in range(1, 70)] + [(200, 3), (200, 7), (300, 301), (301, 300)]
    got = {r.source: r.target for r in linking.compress_remap(spark.createDataFrame(chain, "source long, target long")).collect()}
    assert all(got[k] == 0 for k in range(1, 70)) and got[200] == 0 and {got[300], got[301]} <= {300, 301}


def test_remap_chains_of_any_length(spark):
    rows = [(0, k, k - 1) for k in range(1, 1000)] + [(1, 5, 6), (1, 6, 7), (1, 7, 5), (1, 9, 8), (1, 8, 7)]
    m = spark.createDataFrame(rows, "scene long, source long, target long")
    got = {(r.scene, r.source): r.target for r in linking.compress_remap(m, by=("scene",)).collect()}
    assert got == {(0, k): 0 for k in range(1, 1000)} | {(1, k): 5 for k in (5, 6, 7, 8, 9)}
    assert linking.compress_remap(m.limit(0), by=("scene",)).count() == 0


def test_votes_take_the_first_of_ties(spark):
    rows = [(0, 1, f, f, g) for f, g in enumerate([5, 5, 7, 7, 9])]
    d = spark.createDataFrame(rows, "cam_id int, local_track_id long, frame_no long, det_id long, global_id long")
    assert [r.voted for r in paths.vote(d, 3).orderBy("det_id").collect()] == [5, 5, 7, 7, 7]
    assert paths.vote(d.limit(0), 3).count() == 0


def test_empty_grids(spark):
    g = spark.createDataFrame([], "cam_id int, gx int, gy int, occupancy long")
    p = spark.createDataFrame([(1, None, None)], "det_id long, x double, y double")
    assert grids.smoothed(g, 4, 4, 1.0).count() == grids.stats(g, 4, 4).count() == grids.floor_histogram(p, 3, 3).count() == 0


def test_dedup_boxes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(2)), int(rng.integers(6)), int(rng.integers(9)), *map(float, rng.integers(0, 12, 2)), *map(float, rng.integers(10, 16, 2))) for i in range(90)]
    d = spark.createDataFrame(rows, "det_id long, cam_id int, frame_no long, global_id long, left double, top double, width double, height double")
    taken: list[tuple] = []
    for r in sorted(rows, key=lambda r: (-r[6] * r[7], r[0])):
        if any(t[1:4] == r[1:4] for t in taken if t[-1] >= 0):
            continue
        taken.append((*r, 0))

    def over(a, b):
        w, h = (max(0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (4, 5))
        return w * h / (a[6] * a[7] + b[6] * b[7] - w * h)

    kept: list[tuple] = []
    for r in taken:
        if not any(k[1:3] == r[1:3] and over(k, r) > 0.4 for k in kept):
            kept.append(r)
    assert 0 < len(kept) < len(taken) < len(rows)
    assert {r.det_id for r in linking.dedup_boxes(d, 0.4).collect()} == {k[0] for k in kept}


def test_centres_come_with_the_clusters(spark):
    """A window is clustered once, and no box becomes a row for each component of its vector."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    d = spark.createDataFrame([(0, i % 2, i // 4, i, i % 3, v[i].tolist()) for i in range(60)], "group long, cam_id int, frame_no long, det_id long, local_track_id long, v array<double>")
    rows = linking._window_clusters(d, 5, 40, 64, 2, None).collect()
    for at in {(r.window, r.cluster) for r in rows}:
        mine = [r for r in rows if (r.window, r.cluster) == at]
        (centre,) = [r.centre for r in mine if r.centre is not None]
        assert np.allclose(centre, v[[r.det_id for r in mine]].mean(0))
    plan = linking.buffered_ids(d, 5, 0.5, chunks=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
