"""Scores and linkers against plain Python versions, on small random scenes."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from paceline.operators import identity, linking

BOX = "cam_id int, frame_no long, {} long, det_id long, left double, top double, width double, height double"


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def scene(seed):
    """Persons on lines with gaps, ids that switch, boxes that crowd each other."""
    rng = random.Random(seed)
    gt, pred = [], []
    for cam in range(2):
        for f in range(30):
            for p in range(4):
                if rng.random() < 0.85:
                    gt.append((cam, f, p, len(gt), 10.0 * p + f, 0.0, 30.0, 60.0))
                if rng.random() < 0.8:
                    g = p if rng.random() < 0.8 else rng.randrange(6)
                    if not any(r[0] == cam and r[1] == f and r[2] == g for r in pred):
                        pred.append((cam, f, g, len(pred), 10.0 * p + f + rng.randrange(-4, 5), 0.0, 30.0, 60.0))
    return gt, pred


def plain_clear(gt, pred, cam):
    """Carried correspondences, frame by frame, with all assignments tried."""
    held, out, on, seen = {}, Counter(), defaultdict(list), 0.0
    for f in range(30):
        g = {r[2]: r[4:] for r in gt if r[:2] == (cam, f)}
        p = {r[2]: r[4:] for r in pred if r[:2] == (cam, f)}
        ok = {(a, b): iou(g[a], p[b]) for a in g for b in p if iou(g[a], p[b]) >= 0.5}
        kept = {}
        for a in sorted(held):
            if (a, held[a]) in ok and held[a] not in kept.values():
                kept[a] = held[a]
        left_g, left_p = [a for a in g if a not in kept], [b for b in p if b not in kept.values()]
        best = (0, 0.0, {})
        small, wide, turn = (left_g, left_p, False) if len(left_g) <= len(left_p) else (left_p, left_g, True)
        for perm in itertools.permutations(wide, len(small)):
            m = {(b if turn else a): (a if turn else b) for a, b in zip(small, perm)}
            m = {a: b for a, b in m.items() if (a, b) in ok}
            value = (len(m), sum(ok[x] for x in m.items()), m)
            if value[:2] > best[:2]:
                best = value
        for a, b in best[2].items():
            out["switches"] += a in held and held[a] != b
            kept[a] = b
        held |= kept
        out["matches"] += len(kept)
        seen += sum(ok[x] for x in kept.items())
        for a in g:
            on[a].append(a in kept)
    frags = 0
    for x in on.values():
        hits = [i for i, y in enumerate(x) if y]
        frags += sum(b - a > 1 for a, b in zip(hits, hits[1:]))
    return out["matches"], out["switches"], frags, round(seen / out["matches"], 6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clear_carries_matches_over(spark, seed):
    gt, pred = scene(seed)
    got = {r.cam_id: r for r in identity.clear_metrics(spark.createDataFrame(gt, BOX.format("person_id")), spark.createDataFrame(pred, BOX.format("global_id"))).collect()}
    for cam in (0, 1):
        r = got[cam]
        assert (r.matches, r.switches, r.fragmentations, r.motp) == plain_clear(gt, pred, cam)
        n, m = sum(x[0] == cam for x in gt), sum(x[0] == cam for x in pred)
        assert r.mota == round(1 - (n - r.matches + m - r.matches + r.switches) / n, 6) and r.misses == n - r.matches
        count = Counter((a[2], b[2]) for a in gt for b in pred if a[:2] == b[:2] == (cam, a[1]) and iou(a[4:], b[4:]) >= 0.5)
        best = max(sum(count[a, b] for a, b in zip(range(4), perm)) for perm in itertools.permutations(range(6), 4))
        assert r.idf1 == round(2 * best / (n + m), 6)


def test_missing_camera_and_diagnosis(spark):
    gt = spark.createDataFrame([(0, 1, 1, 1, 0.0, 0.0, 9.0, 9.0), (5, 1, 1, 2, 0.0, 0.0, 9.0, 9.0)], BOX.format("person_id"))
    pred = spark.createDataFrame([(0, 1, 4, 1, 0.0, 0.0, 9.0, 9.0)], BOX.format("global_id"))
    c = identity.clear_metrics(gt, pred)
    assert {r.cam_id: (r.matches, r.recall, r.idf1) for r in c.collect()} == {0: (1, 1.0, 1.0), 5: (0, 0.0, 0.0)}
    d = identity.stage_diagnosis(c, identity.global_idf1(gt, pred)).first()
    assert (d.recall, d.verdict) == (0.5, "detector")
    assert {(r.det_id, r.person_id) for r in identity.oracle_ids(gt, pred).collect()} == {(1, 1)}


def test_ids_of_two_scenes_never_link(spark):
    rows = [(s, 10 * s + t, 10 * s + t, t, f, 0.1 * t, 0.0) for s in (0, 1) for t in (1, 2) for f in range(5)]
    p = spark.createDataFrame(rows, "scene long, tracklet_id long, global_id long, cam_id long, frame_no long, x double, y double")
    pairs = {(1, 2), (11, 12)}
    assert {(r.a, r.b) for r in linking.pair_distances(p, "tracklet_id", 3, ("scene",)).collect()} == pairs
    assert {(r.a, r.b) for r in linking.tracklet_links(p, 1.0, 3, 5, 1.0, ("scene",)).collect()} == pairs
    assert {r.node: r.component for r in linking.geo_merge(p, 1.0, 3, 0.5, ("scene",)).collect()} == {1: 1, 2: 1, 11: 11, 12: 11}
    d = linking.pair_distances(p, "tracklet_id", 3, ("scene",)).collect()
    assert all(abs(r.distance - 0.1) < 1e-12 and r.shared == 5 for r in d)  # in metres, too


def test_blended_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(24, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [(i % 2, i) for i in range(24)]
    geo = {(a, b): float(rng.random()) for a in range(24) for b in range(a + 1, 24) if a % 2 == b % 2 and rng.random() < 0.3}
    apart = {p for p in geo if rng.random() < 0.2} | {(0, 2)}
    v = spark.createDataFrame([(s, i, x[i].tolist()) for s, i in ids], "scene long, id long, v array<double>")
    g = spark.createDataFrame([(a % 2, a, b, z) for (a, b), z in geo.items()], "scene long, a long, b long, score double")
    c = spark.createDataFrame([(a % 2, a, b) for a, b in apart], "scene long, a long, b long")
    w, least, margin, k = 0.3, 0.35, 0.02, 2
    s = np.full((24, 24), -1.0)
    for a, b in itertools.permutations(range(24), 2):
        if a % 2 == b % 2:
            p = (min(a, b), max(a, b))
            cos = float(x[a] @ x[b])
            s[a, b] = cos if p in apart else (1 - w) * cos + w * geo.get(p, 0.0)
    want = {}
    for a in range(24):
        order = [j for j in np.argsort(-s[a], kind="stable") if s[a, j] >= least]
        if order and not (len(order) > 1 and s[a, order[0]] < s[a, order[1]] + margin):
            for b in order[:k]:
                want[min(a, b), max(a, b)] = s[a, b]
    got = {(r.a, r.b): r.score for r in linking.blended_pairs(v, g, c, w, least, margin, k).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want) and len(want) > 4


def test_trajectory_scores(spark):
    decay = lambda d: float(np.exp(-3 * max(0.0, (d - 300) / 1700) ** 2))
    path = {1: [(f, 100.0 * f, 0.0) for f in range(10)], 2: [(f, 100.0 * f, 500.0) for f in range(10)], 3: [(f, -100.0 * f + 900, 400.0) for f in range(10)], 4: [(f, 100.0 * f + 50, 0.0) for f in range(20, 25)], 5: [(300, 0.0, 0.0), (301, 0.0, 0.0)], 6: [(5, 0.0, 0.0)]}
    rows = [(i, *r) for i, x in path.items() for r in x]
    p = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (4, 1)], "a long, b long")
    got = {(r.a, r.b): r.score for r in linking.trajectory_scores(p, spark.createDataFrame(rows, "id long, frame_no long, x double, y double"), 5).collect()}
    mid = float(np.median([decay(np.hypot(100.0 * f - (900 - 100.0 * f), 400)) for f in range(10)]))
    want = {(1, 2): decay(500), (1, 3): mid * 0.5, (1, 4): 0.85, (1, 5): 0.0, (1, 6): 0.0, (4, 1): 0.85}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_meeting_trajectories(spark):
    """The same pairs and scores as listing the pairs first, and no exchange of pairs that only follow each other."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        start, n, cam = int(rng.integers(0, 80)), int(rng.integers(1, 9)), i % 3
        rows += [(i, cam, start + 2 * k, *map(float, rng.normal(0, 900, 2))) for k in range(n)]
    t = spark.createDataFrame(rows, "tracklet_id long, cam_id int, frame_no long, x double, y double")
    path = t.withColumnRenamed("tracklet_id", "id")
    follow = linking.handoff_scores(t, 5, 10, 300.0, 2000.0).select("a", "b")
    near = linking.pair_distances(t, "tracklet_id", 1).select("a", "b").unionByName(follow).distinct()
    want = sorted((r.a, r.b, round(r.score, 9)) for r in linking.trajectory_scores(near, path.drop("cam_id"), 2).collect())
    got = linking.meeting_trajectories(path, 2, 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.a, r.b, round(r.score, 9)) for r in got.collect()) == want
    assert len({(a, b) for a, b, _ in want}) == len(want) > 300 and sum(s > 0 for _, _, s in want) > 50
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(a#" in line]
    assert len(wide) == 1, wide  # the pairs of common frames


def plain_ward(x, k):
    sets = [[i] for i in range(len(x))]
    while len(sets) > k:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        i, j = min(itertools.combinations(range(len(sets)), 2), key=lambda p: cost(sets[p[0]], sets[p[1]]))
        sets[i] += sets.pop(j)
    return {frozenset(s) for s in sets}


def test_ward_chain():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (2, 1), (12, 3), (25, 4), (25, 25)):
        x = rng.normal(size=(n, 3))
        label = linking.ward(x, k)
        assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label)} == plain_ward(x, k)


def test_cosine_merge(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(14, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = [9, 2] * 7
    got = {r.global_id: r.label for r in linking.cosine_merge(spark.createDataFrame([(0, i, x[i].tolist(), n[i]) for i in range(14)], "scene long, global_id long, v array<double>, n long"), 0.4, 5).collect()}
    d, sets = 1 - x @ x.T, [[i] for i in range(14)]
    while len(sets) > 1:
        i, j = min(itertools.combinations(range(len(sets)), 2), key=lambda p: d[np.ix_(sets[p[0]], sets[p[1]])].mean())
        if d[np.ix_(sets[i], sets[j])].mean() > 0.4:
            break
        sets[i] += sets.pop(j)
    label = {i: k for k, s in enumerate(sets) for i in s}
    for i in range(14):
        if n[i] < 5:
            j = min((j for j in range(14) if n[j] >= 5 and j != i), key=lambda j: d[i, j])
            label = label | {i: {q: k for k, s in enumerate(sets) for q in s}[j]}
    assert all((got[i] == got[j]) == (label[i] == label[j]) for i in range(14) for j in range(14)) and set(got.values()) == set(range(1, len(set(label.values())) + 1))


def test_velocity_tracks(spark):
    rows = [(0, f, 0, 1.0 * f, 0.0, [1.0, 0.0]) for f in range(10)] + [(0, f, 1, 9.0 - f, 0.5, [0.0, 1.0]) for f in range(10) if f not in (4, 5)]
    rows += [(0, 30, 0, 30.0, 0.0, [0.0, 1.0]), (0, 31, 0, 31.0, 0.0, None), (1, 0, 0, 0.0, 0.0, None)]
    d = spark.createDataFrame(rows, "scene long, frame_no long, instance long, x double, y double, v array<double>")
    got = {(r.scene, r.frame_no, r.instance): r.global_id for r in linking.velocity_tracks(d, 2.0, 3.0, 5, 50, 0.5, 0.0).collect()}
    assert {got[0, f, 0] for f in range(10)} == {1} and {got[0, f, 1] for f in range(10) if f not in (4, 5)} == {2}
    # At 30 the place fits the first, but its vector doesn't; at 31 there is no vector to say so.
    assert (got[0, 30, 0], got[0, 31, 0], got[1, 0, 0]) == (3, 1, 1)
    again = {(r.scene, r.frame_no, r.instance): r.global_id for r in linking.velocity_tracks(d, 2.0, 3.0, 5, 50, 0.0, 0.0).collect()}
    assert again[0, 30, 0] == 1


TRACKLET = "scene long, cam_id long, global_id long, start_frame long, end_frame long, num_detections long, v array<double>, n long"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, 0, 1, 0, 100, 20, [1.0, 0.0], 5), (0, 1, 2, 0, 100, 20, [1.0, 0.0], 5)], [(2, 1, 150)]),
        ([(0, 0, 1, 0, 100, 20, [1.0, 0.0], 5), (0, 0, 2, 50, 100, 20, [1.0, 0.0], 5)], []),  # one camera, at once
        ([(0, 0, 1, 0, 100, 20, [1.0, 0.0], 5), (0, 1, 2, 0, 100, 20, [0.0, 1.0], 5)], []),
        ([(0, 0, 1, 0, 100, 20, [1.0, 0.0], 5), (0, 1, 2, 0, 100, 3, [1.0, 0.0], 5)], []),  # too few boxes
        ([(0, 0, 1, 0, 100, 20, [1.0, 0.0], 5), (0, 1, 3, 0, 100, 20, [1.0, 0.01], 5), (0, 2, 2, 300, 400, 20, [1.0, 0.0], 5)], [(3, 1, 175), (2, 1, 450)]),
        ([(0, 0, 1, 0, 100, 20, [1.0, 0.0], 5), (1, 1, 2, 0, 100, 20, [1.0, 0.0], 5)], []),  # two scenes
    ],
)
def test_windowed_merges(spark, rows, want):
    out = linking.windowed_merges(spark.createDataFrame(rows, TRACKLET), 125, 50, 0.5, 0.0, 5)
    assert [(r.source, r.target, r.event_frame) for r in out.orderBy("event_frame").collect()] == want


def test_replay(spark):
    events = spark.createDataFrame([(0, 10, 3, 2), (0, 20, 2, 1)], "scene long, event_frame long, source long, target long")
    det = spark.createDataFrame([(0, k, f, g) for k, (f, g) in enumerate([(5, 3), (10, 3), (25, 3), (15, 2), (20, 2), (99, 7)])], "scene long, det_id long, frame_no long, global_id long")
    assert [r.global_id for r in linking.replayed(det, events).orderBy("det_id").collect()] == [3, 2, 1, 2, 1, 7]
    assert {(r.source, r.target) for r in identity.merge_by_pass(events).collect()} == {(3, 1), (2, 1)}
    with_one = linking.fusion_records(spark.createDataFrame([(0, 0, 1, "x")], "scene long, cam_id long, local_track_id long, of string"), spark.createDataFrame([(0, 0, 1, "g"), (0, 0, 2, "g")], "scene long, cam_id long, local_track_id long, of string"))
    assert {(r.local_track_id, r.of) for r in with_one.collect()} == {(1, "x"), (2, "g")}
    points = spark.createDataFrame([(0, 7, 10, 1.0, 1.0), (0, 7, 10, 3.0, 1.0), (0, 7, 7, 9.0, 9.0)], "scene long, global_id long, frame_no long, x double, y double")
    assert [(r.frame_no, r.x, r.n) for r in linking.sampled_points(points, 5).collect()] == [(10, 2.0, 2)]


def test_reassign_passes(spark):
    rows = [(1, 0, 10, 0.0, 0.0), (2, 0, 10, 100.0, 0.0), (3, 0, 20, 99.0, 0.0), (4, 0, 20, 101.0, 0.0), (5, 1, 10, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "det_id long, frame_no long, global_id long, x double, y double")
    assert {r.det_id: r.new_id for r in identity.reassign(p, (5.0,), 0.65).collect()} == {1: 10, 2: 20, 3: 20, 4: 20, 5: 10}
    assert {r.det_id: r.new_id for r in identity.reassign(p, (), 0.65).collect()} == {1: 10, 2: 10, 3: 20, 4: 20, 5: 10}


def test_sweep(spark):
    scenes = spark.createDataFrame([(s, float(x)) for s in range(3) for x in range(4)], "scene long, x double")
    grid = spark.createDataFrame([(0, 1.0), (1, 3.0)], "setting long, least double")
    out = linking.sweep(grid, scenes, lambda p, d: {"n": float((d.x >= p["least"]).sum())}, "n double", "n").collect()
    assert [(r.setting, r["mean"], r.scenes) for r in out] == [(0, 3.0, 3), (1, 1.0, 3)]
