"""HOTA against a brute-force version that tries every assignment of a frame."""

import itertools
import random
from collections import Counter, defaultdict

from paceline.operators import identity

BOX = "cam_id int, frame_no long, {} long, det_id long, left double, top double, width double, height double"


def iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


def brute(gt, pred):
    frames = defaultdict(lambda: ([], []))
    for side, rows in enumerate((gt, pred)):
        for _, frame, who, _, *box in rows:
            frames[frame][side].append((who, box))
    n_g, n_p = Counter(r[2] for r in gt), Counter(r[2] for r in pred)
    shared = Counter()
    for g, p in frames.values():
        s = [[iou(x[1], y[1]) for y in p] for x in g]
        for i, j in itertools.product(range(len(g)), range(len(p))):
            if s[i][j] > 0:
                shared[g[i][0], p[j][0]] += s[i][j] / (sum(s[i]) + sum(r[j] for r in s) - s[i][j])
    agree = {(a, b): x / (n_g[a] + n_p[b] - x) for (a, b), x in shared.items()}
    matches = []
    for g, p in frames.values():
        p = p + [(None, (1e6, 1e6, 1.0, 1.0))] * len(g)
        worth = lambda c: sum(agree.get((x[0], y[0]), 0) * iou(x[1], y[1]) for x, y in zip(g, c, strict=True))
        best = max(itertools.permutations(p, len(g)), key=worth)
        matches += [(x[0], y[0], iou(x[1], y[1])) for x, y in zip(g, best, strict=True) if iou(x[1], y[1]) > 0]
    total = [0.0] * 8
    for k in range(1, 20):
        kept = [m for m in matches if m[2] >= k / 20 - 1e-12]
        tp, n = len(kept), Counter(m[:2] for m in kept)
        det = tp / (len(gt) + len(pred) - tp)
        ass = sum(x * x / (n_g[a] + n_p[b] - x) for (a, b), x in n.items()) / tp if tp else 0.0
        loc = sum(m[2] for m in kept) / tp if tp else 1.0
        of = lambda n_of, k: sum(x * x / n_of[m[k]] for m, x in n.items()) / tp if tp else 0.0  # noqa: E731, B023
        total = [t + x / 19 for t, x in zip(total, ((det * ass) ** 0.5, det, ass, loc, tp / len(gt), tp / len(pred), of(n_g, 0), of(n_p, 1)), strict=True)]
    return total


def test_hota(spark):
    rng = random.Random(3)
    gt, pred = [], []
    for frame in range(30):
        for person in range(3):
            x = 40.0 * person + 3 * frame + rng.random()
            gt.append((0, frame, person, len(gt), x, 10.0, 60.0 + rng.random(), 80.0))
            if rng.random() < 0.85:
                gid = person if frame < 18 else (person + 1) % 3
                pred.append((0, frame, 100 + gid, len(pred), x + rng.uniform(-9, 9), 10 + rng.uniform(-9, 9), 60.0, 80.0))
    one = identity.hota(spark.createDataFrame(gt, BOX.format("person_id")), spark.createDataFrame(pred, BOX.format("global_id"))).collect()
    assert [r.cam_id for r in one] == [0]
    want = brute(gt, pred)
    assert all(abs(a - b) < 2e-6 for a, b in zip(one[0][1:], want, strict=True)), (one, want)


def test_perfect_and_missed(spark):
    gt = [(c, f, 1, 10 * c + f, 5.0, 5.0, 20.0, 40.0) for c in range(2) for f in range(4)]
    pred = [(c, f, 7, i, x + 500.0 * c, *box) for c, f, _, i, x, *box in gt]
    got = {r.cam_id: tuple(r[1:]) for r in identity.hota(spark.createDataFrame(gt, BOX.format("person_id")), spark.createDataFrame(pred, BOX.format("global_id"))).collect()}
    assert got == {0: (1.0,) * 8, 1: (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)}
