"""Percentiles, bounded segments, fills, means and remaps against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from paceline.operators import grids, linking, paths, projections, store
from paceline.sources import sinks

AT = [0.0, 0.005, 0.25, 0.5, 0.75, 0.98, 1.0]


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_percentiles_are_exact(spark, bins):
    r = random.Random(5)
    groups = {
        "one": [3.25],
        "same": [7.0] * 40,
        "small": [r.random() / 1000 for _ in range(333)],
        "far": [r.gauss(0, 1) for _ in range(200)] + [1e9, -1e7],
        "ties": [float(r.randrange(4)) for _ in range(101)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("small", None), ("none", None), ("ties", float("nan")), (None, 2.0)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.v for r in grids.percentiles(d.where("k is not null"), "v", AT, "k", bins=bins).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, AT)), rel=1e-12, abs=1e-12)
    whole = [v for vs in groups.values() for v in vs] + [2.0]
    assert grids.percentiles(d, "v", AT, bins=bins).first().v == pytest.approx(list(np.quantile(whole, AT)), rel=1e-12)
    assert grids.percentiles(d.where("k = 'none'"), "v", AT, bins=bins).count() == 0


def test_bounds_of_the_floor(spark):
    xs = [float(x) for x in range(11)] + [1000.0]
    p = spark.createDataFrame([(x, 5.0) for x in xs] + [(None, 1.0)], "x double, y double")
    q1, q3 = np.percentile(xs, [25, 75])
    f = grids.footprint(p).first()
    assert (f.x_low, f.x_high, f.y_low, f.y_high) == pytest.approx((0.0, q3 + 1.6 * (q3 - q1), 5.0, 5.0))  # never beyond the points
    a, b = np.percentile(xs, [2, 98])
    w = grids.walked_area(p).first()
    assert (w.x_low, w.x_high, w.y_low, w.y_high) == pytest.approx((a - 0.12 * (b - a), b + 0.12 * (b - a), 5.0, 5.0))


def test_segments_break_at_bounds(spark):
    xs = [9.0, 0.0, 1.0, 9.0, 9.0, 2.0, 2.5]
    p = spark.createDataFrame([(1, i, x, 0.0) for i, x in enumerate(xs)], "global_id long, frame_no long, x double, y double")
    got = store.path_segments(p, 100.0, 20, 1, (0.0, 5.0, -1.0, 1.0)).orderBy("segment").collect()
    assert [(r.first_frame, r.last_frame) for r in got] == [(0, 0), (1, 2), (3, 3), (4, 4), (5, 6)]
    assert store.path_segments(p, 100.0, 20, 1).count() == 1


def test_person_means(spark):
    rows = [(0, 7, 0, 9, 10, [1.0, 0.0], 3), (1, 7, 5, 20, 10, [0.0, 1.0], 1), (0, 7, 30, 31, 2, [5.0, 5.0], 9), (0, 8, 0, 9, 10, [1.0, 0.0], 1), (0, 9, 0, 9, 10, [1.0, 0.0], 2), (1, 9, 0, 9, 10, [-1.0, 0.0], 2), (2, 9, 0, 1, 10, None, 5)]
    t = spark.createDataFrame(rows, "cam_id long, global_id long, start_frame long, end_frame long, num_detections long, v array<double>, n long")
    got = {r.global_id: r for r in store.person_means(t, 6, 2).collect()}
    assert set(got) == {7}  # 8 has too few vectors, 9 a mean of length zero
    assert list(got[7].v) == pytest.approx([3 / np.sqrt(10), 1 / np.sqrt(10)])
    assert got[7].n == 4 and [tuple(x) for x in got[7].spans] == [(0, 0, 9), (1, 5, 20)]


def test_fill_and_detected_together(spark):
    box = "global_id long, cam_id long, frame_no long, left double, top double, width double, height double"
    det = spark.createDataFrame([(1, 0, 5, 1.0, 1.0, 2.0, 2.0), (-1, 0, 5, 1.0, 1.0, 2.0, 2.0)], box)
    both = paths.with_fill(det, spark.createDataFrame([(1, 0, 6, 1.0, 1.0, 2.0, 2.0)], box))
    assert {(r.frame_no, r.synthetic) for r in both.collect()} == {(5, False), (6, True)}


def test_final_remap(spark):
    events = spark.createDataFrame([(0, 10, 5, 3), (0, 20, 3, 1), (1, 10, 5, 4), (0, 30, 9, 8)], "scene long, event_frame long, source long, target long")
    remap = linking.final_remap(events)
    assert {tuple(r) for r in remap.select("scene", "source", "target").collect()} == {(0, 5, 1), (0, 3, 1), (1, 5, 4), (0, 9, 8)}
    det = spark.createDataFrame([(0, 5, "a"), (1, 5, "b"), (2, 5, "c"), (0, 1, "d")], "scene long, global_id long, name string")
    assert {(r.name, r.global_id) for r in linking.resolved(det, remap).collect()} == {("a", 1), ("b", 4), ("c", 5), ("d", 1)}
    assert linking.final_remap(events.limit(0)).count() == 0


def test_reclustered(spark):
    """All evidence at once links what early windows could not tell apart."""
    schema = "scene long, cam_id long, global_id long, start_frame long, end_frame long, num_detections long, v array<double>, n long"
    rows = [(0, 0, 1, 0, 100, 20, [1.0, 0.0], 5), (0, 1, 2, 0, 100, 20, [1.0, 0.0], 5), (0, 2, 3, 200, 900, 20, [1.0, 0.0], 5), (0, 2, 4, 300, 400, 20, [1.0, 0.0], 5), (1, 0, 8, 0, 50, 20, [1.0, 0.0], 5)]
    got = linking.reclustered(spark.createDataFrame(rows, schema), 0.5, 0.0, 5)
    assert {(r.source, r.target) for r in got.collect()} == {(2, 1), (3, 1)}  # 4 is in 3's camera at the same time
    assert linking.reclustered(spark.createDataFrame([], schema), 0.5, 0.0, 5).count() == 0


def test_whole_cap_and_medians(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i)) for i in range(100)], "id long, class string, v double")
    assert sorted(r.id for r in projections.balanced(rows, [((), 4)], ["id"]).collect()) == [0, 1, 2, 3]
    got = {r["class"]: (r.n, r.v) for r in projections.class_medians(rows.unionByName(rows.selectExpr("id", "'c' as class", "null as v").limit(1)), "v").collect()}
    assert got == {"a": (66, 49.5), "b": (34, 49.5), "c": (1, None)}


def test_stats_of_a_smoothed_grid(spark, tmp_path):
    """One cell with most hits, but more in all around another."""
    hits = {(0, 0): 5} | {(x, y): 4 for x in (5, 6, 7) for y in (5, 6, 7)}
    g = spark.createDataFrame([(3, x, y, n) for (x, y), n in hits.items()], "cam_id int, gx int, gy int, occupancy long")
    raw = grids.stats(g, 10, 10).first()
    assert (raw.peak_gx, raw.peak_gy, raw.n_dets, raw.occupied) == (0, 0, 41, 0.1)
    s = grids.stats(g, 10, 10, dense=grids.smoothed(g, 10, 10, 1.0))
    assert (s.first().peak_gx, s.first().peak_gy, s.first().n_dets) == (6, 6, 41) and s.first().occupied > 0.1
    sinks.write_grids(g, s, str(tmp_path))
    assert {(r.cam_id, r.gx, r.gy): r.occupancy for r in spark.read.option("header", True).csv(f"{tmp_path}/grids", inferSchema=True).collect()} == {(3, x, y): n for (x, y), n in hits.items()}
    assert spark.read.json(f"{tmp_path}/stats").first().n_dets == 41


def test_span_fill_frames(spark):
    """A box in each frame of the path's span that a camera with enough frames misses."""
    from paceline.plans.queries import CAMERA, CAMERAS

    det = spark.createDataFrame([(1, 0, f) for f in (2, 4, 9)] + [(1, 1, 3)] + [(-1, 0, 5)], "global_id long, cam_id int, frame_no long")
    path = spark.createDataFrame([(1, f, 10.0 * f, 0.0) for f in (2, 3, 4, 9, 12)], "global_id long, frame_no long, x double, y double")
    cameras = spark.createDataFrame(CAMERAS, CAMERA)
    wide = (1e9, 1e9)
    fill = lambda least, last: sorted((r.cam_id, r.frame_no) for r in paths.span_fill(det, path, cameras, least, last, wide, 1700.0, 0.33).collect())
    assert fill(2, 11) == [(0, f) for f in (3, 5, 6, 7, 8, 10, 11)]
    assert fill(1, 4) == [(0, 3), (1, 2), (1, 4)]


def test_span_fill_lists_frames_in_place(spark):
    """Frames in which a camera has a person without a place count as seen; no frame that is listed is moved or looked up."""
    from paceline.plans.queries import CAMERA, CAMERAS

    det = spark.createDataFrame([(1, 0, f) for f in (2, 5, 6, 9)] + [(1, 1, 4), (2, 0, 3)], "global_id long, cam_id int, frame_no long")
    path = spark.createDataFrame([(1, f, 10.0 * f, 0.0) for f in (2, 4, 9)] + [(2, 3, 0.0, 0.0), (2, 5, 0.0, 0.0)], "global_id long, frame_no long, x double, y double")
    fill = paths.span_fill(det, path, spark.createDataFrame(CAMERAS, CAMERA), 1, 100, (1e9, 1e9), 1700.0, 0.33)
    plan = fill._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sorted((r.global_id, r.cam_id, r.frame_no) for r in fill.collect()) == [(1, 0, f) for f in (3, 4, 7, 8)] + [(1, 1, f) for f in (2, 3, 5, 6, 7, 8, 9)] + [(2, 0, 4), (2, 0, 5)]
    listed = next(i for i, line in enumerate(plan) if "Generate explode(sequence(f0" in line)
    assert not [line for line in plan[:listed] if " Exchange" in line or "SortMergeJoin" in line]


def test_span_fill_means_are_those_of_its_boxes(spark, monkeypatch):
    """Sums of a step's frames, however these are cut, are those of the boxes; no frame becomes a row."""
    from pyspark.sql import functions as F

    from paceline.plans.queries import CAMERA, CAMERAS

    rng = random.Random(2)
    path = [(g, f, rng.uniform(-3000, 3000), rng.uniform(500, 6000)) for g in range(5) for f in sorted(rng.sample(range(3000), 12))]
    det = [(g, rng.randrange(4), max(0, f + rng.choice([-3, 0, 0, 40]))) for g, f, *_ in path for _ in range(3)]
    det, path = spark.createDataFrame(det, "global_id long, cam_id int, frame_no long"), spark.createDataFrame(path, "global_id long, frame_no long, x double, y double")
    args = det, path, spark.createDataFrame(CAMERAS, CAMERA), 5, 2500, (640.0, 360.0), 1700.0, 0.33
    boxes = paths.span_fill(*args).groupBy("global_id", "cam_id").agg(F.count("*"), F.min("frame_no"), F.max("frame_no"), *[F.avg(c) for c in ("left", "top", "width", "height")])
    want = sorted(tuple(r) for r in boxes.collect())
    assert len(want) > 5 and sum(r[2] for r in want) > 1000
    for listed in (paths._LISTED, 7):
        monkeypatch.setattr(paths, "_LISTED", listed)
        means = paths.span_fill_means(*args)
        got = sorted(tuple(r) for r in means.collect())
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert all(x == pytest.approx(y, rel=1e-9) for x, y in zip(got, want))
        assert "explode" not in means._jdf.queryExecution().optimizedPlan().toString()
