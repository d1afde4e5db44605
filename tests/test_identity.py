"""Assignment, merging and scores on small cases."""

import itertools

import numpy as np

from paceline.operators import identity, regions


def test_assign_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 2), (3, 5), (5, 3), (4, 4), (6, 6)]:
        for _ in range(20):
            c = rng.integers(-9, 10, (n, m)).astype(float)
            got = identity.assign(c)
            assert len(got) == min(n, m) == len({r for r, _ in got}) == len({k for _, k in got})
            small, wide = (c, m) if n <= m else (c.T, n)
            best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(wide), len(small)))
            assert sum(c[r, k] for r, k in got) == best


def test_scores(spark):
    box = "cam_id int, frame_no long, {} long, det_id long, left double, top double, width double, height double"
    gt = spark.createDataFrame([(0, f, 1, f, 0.0, 0.0, 10.0, 20.0) for f in range(4)], box.format("person_id"))
    pred = spark.createDataFrame([(0, f, 7 if f < 3 else 8, f, 0.0, 0.0, 10.0, 20.0) for f in range(4)] + [(0, 0, 9, 50, 300.0, 0.0, 10.0, 20.0)], box.format("global_id"))
    assert tuple(identity.global_idf1(gt, pred).first()) == (3, 2, 1, round(6 / 9, 6))
    r = identity.clear_metrics(gt, pred).first()
    assert (r.matches, r.misses, r.false_positives, r.switches, r.mota, r.motp) == (4, 0, 1, 1, 0.5, 1.0)


def test_merges_respect_conflicts(spark):
    p = spark.createDataFrame([(1, 1, 2, 0.9), (1, 2, 3, 0.8), (1, 4, 5, 0.7)], "scene long, a long, b long, score double")
    c = spark.createDataFrame([(1, 1, 3)], "scene long, a long, b long")
    assert {(r.global_id, r.target) for r in identity.merge_map(p, c).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}


def test_rules_round_trip():
    z = regions.parse_rules("[roi-filtering-stream-2]\nroi-A=0;0;10;0;10;10\n[line-crossing-stream-2]\nroi-B=1;1\n", 100, 100)
    assert [(c, n) for c, _, n, _ in z] == [(2, "A")]
    assert regions.parse_rules(regions.rules_text(z, 100, 100), 100, 100) == z
