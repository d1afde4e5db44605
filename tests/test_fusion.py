"""Incremental fusion against one that recomputes all pairs at every window, and the stream against the batch."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators.fusion import FusionRules, Meetings, SceneFusion, windowed
from paceline.streaming.fusion import live_fusion

RULES = FusionRules(50, 10, 0.6, 0.01, 3, 2, 3, 2)
PLACES = FusionRules(50, 10, 0.55, 0.0, 3, 0, 1, 1, 0.4, 3, 1.0, 6.0)


def tracklets(seed, scenes=2, n=70, places=False):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(scenes):
        people = rng.normal(size=(7, 5))
        for _ in range(n):
            p = int(rng.integers(7))
            lo = int(rng.integers(0, 900))
            hi = lo + int(rng.integers(5, 60))
            v = people[p] + rng.normal(size=5) * 0.8
            at = [(f, float(2 * p + rng.normal() * 0.5), float(rng.normal() * 0.5)) for f in range(lo - lo % 5 + 5, hi, 5)] if places else None
            rows.append((s, int(rng.integers(4)), 10 * p + int(rng.integers(5)), lo, hi, int(rng.integers(1, 12)), (v / np.linalg.norm(v)).tolist(), int(rng.integers(1, 4)), at))
    return rows


def from_scratch(rows, r):
    """The rules with nothing kept but the merges: all persons and pairs are computed anew at each window."""
    out = []
    meet = lambda a, b, t: any(x[0] == y[0] and max(x[1], y[1]) <= min(x[2], y[2]) + t for x in a for y in b)
    for scene in sorted({x[0] for x in rows}):
        mine = sorted((x for x in rows if x[0] == scene and x[5] >= r.least_dets), key=lambda x: (x[4], x[2], x[1], x[3]))
        if not mine:
            continue
        last, gone = max(x[4] for x in mine), {}

        def end_of(g, gone=gone):
            while g in gone:
                g = gone[g]
            return g

        for b in range(r.window, last + r.window, r.window):
            end = min(b, last)
            seen = [x for x in mine if x[4] <= end]
            if not any(b - r.window < x[4] for x in seen):
                continue
            total, n, spans, places = {}, {}, {}, {}
            for _, cam, g, lo, hi, _, v, k, at in seen:
                total[g] = total.get(g, np.zeros(len(v))) + np.array(v) * k
                n[g] = n.get(g, 0) + k
                spans.setdefault(g, []).append((cam, lo, hi))
                places.setdefault(g, []).extend((f, cam, x, y) for f, x, y in at or ())
            ids = sorted(g for g in total if n[g] >= r.least_vectors)
            score = {}
            for a, c in itertools.permutations(ids, 2):
                s = float(total[a] @ total[c] / np.linalg.norm(total[a]) / np.linalg.norm(total[c]))
                if r.geo_weight and not meet(spans[a], spans[c], 0):
                    d = [np.hypot(x - u, y - w) for f, i, x, y in places[a] for g, j, u, w in places[c] if f == g and i != j]
                    geo = np.exp(-3 * max(0.0, (np.median(d) - r.near) / (r.far - r.near)) ** 2) if len(d) >= r.geo_least else 0.0
                    s = (1 - r.geo_weight) * s + r.geo_weight * geo
                score[a, c] = s
            pairs = {}
            for a in ids:
                top = sorted(((-score[a, c], c) for c in ids if c != a and score[a, c] >= r.threshold))[: max(2, r.k + 1)]
                if top and not (len(top) > 1 and -top[0][0] < -top[1][0] + r.margin):
                    for s, c in top[: r.k]:
                        pairs[min(a, c), max(a, c)] = max(-s, pairs.get((min(a, c), max(a, c)), -1))
            root, inside = {g: g for g in ids}, {g: list(spans[g]) for g in ids}
            for (a, c), s in sorted(pairs.items(), key=lambda x: (-round(x[1], 12), x[0])):
                a, c = sorted((root[a], root[c]))
                if a == c or meet(inside[a], inside[c], r.tolerance):
                    continue
                root = {x: a if y == c else y for x, y in root.items()}
                inside[a] += inside[c]
                lo, hi = sorted((end_of(a), end_of(c)))
                if lo != hi:
                    gone[hi] = lo
                    out.append((scene, end + r.delay, end, hi, lo, s))
    return sorted(out)


SCHEMA = "scene long, cam_id long, global_id long, start_frame long, end_frame long, num_detections long, v array<double>, n long, places array<struct<frame_no: long, x: double, y: double>>"


@pytest.mark.parametrize(("rules", "seed"), [(RULES, 1), (RULES, 2), (PLACES, 3), (PLACES, 4)])
def test_windows_as_from_scratch(spark, rules, seed):
    rows = tracklets(seed, places=rules.geo_weight > 0)
    got = windowed(spark.createDataFrame(rows, SCHEMA).repartition(3), rules).collect()
    got, want = sorted(tuple(r) for r in got), from_scratch(rows, rules)
    assert [r[:5] for r in got] == [r[:5] for r in want] and [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=2e-6) and len(got) > 5


def test_work_follows_what_a_window_changes():
    rng = np.random.default_rng(0)
    fusion = SceneFusion(FusionRules(50, 0, 0.9, 0.0, 3, least_dets=1))
    unit = rng.normal(size=(400, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    fusion.step([(0, g, 0, 9, unit[g], 1, []) for g in range(400)], 50)
    before = fusion.scored
    fusion.step([(1, 7, 60, 70, unit[7], 1, [])], 100)
    assert before == 400 * 400 and fusion.scored - before == 400


def test_a_person_seen_by_two_cameras_merges_once(spark):
    v = [1.0, 0.0]
    rows = [(0, 0, 1, 0, 20, 9, v, 5, None), (0, 1, 2, 0, 30, 9, v, 5, None), (0, 0, 1, 60, 70, 9, v, 5, None), (0, 1, 2, 60, 80, 9, v, 5, None)]
    got = windowed(spark.createDataFrame(rows, SCHEMA), FusionRules(50, 5, 0.5, 0.0, 3)).collect()
    assert [tuple(r) for r in got] == [(0, 55, 50, 2, 1, 1.0)]  # the second window decides the same and tells nothing
    assert windowed(spark.createDataFrame([], SCHEMA), RULES).count() == 0


@pytest.mark.parametrize("rules", [RULES, PLACES])
def test_any_cut_of_the_stream_gives_the_events_of_the_batch(spark, tmp_path, rules):
    rows = tracklets(9, places=rules.geo_weight > 0)
    want = sorted((r.scene, r.source, r.target, -(-r.window_end // 50)) for r in windowed(spark.createDataFrame(rows, SCHEMA), rules).collect())
    assert len(want) > 5
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime.datetime(2024, 1, 1)
    at = lambda f: start + datetime.timedelta(milliseconds=40 * f)
    rng, files = random.Random(1), {}
    for r in rows:
        files.setdefault(min(3, r[4] // 250 + (rng.random() < 0.3)), []).append((*r, at(r[4])))
    end = [(s, 9, 10**6, 99_990, 100_000, 99, [0.0] * 5, 1, None, at(100_000)) for s in (0, 1)]
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), SCHEMA + ", event_time timestamp"
    for part in (*(files[k] for k in sorted(files)), end):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        events = live_fusion(spark.readStream.schema(schema).parquet(src), rules, 40, "20 seconds")
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    got = sorted((r.scene, r.source, r.target, r.window_end // 50) for r in spark.read.parquet(out).collect())
    assert got == want


@pytest.mark.parametrize("tolerance", [0, 2, 40])
def test_meetings_are_kept_up(tolerance):
    """The same pairs as comparing all spans, with few comparisons where spans lie apart."""
    rng = np.random.default_rng(tolerance)
    spans = [(int(rng.integers(12)), int(rng.integers(2)), lo := int(rng.integers(-50, 900)), lo + int(rng.choice([0, 3, 200]))) for _ in range(150)]
    m = Meetings(tolerance, 25)
    for s in spans:
        m.add(*s)
    want = {(g, h) for g, c, lo, hi in spans for h, k, x, y in spans if g != h and c == k and max(lo, x) <= min(hi, y) + tolerance}
    assert {(g, h) for g, others in m.of.items() for h in others} == want
    far = Meetings(tolerance, 25)
    for k in range(2000):
        far.add(k, 0, 1000 * k, 1000 * k)
    assert not far.of and max(map(len, far.listed.values())) <= 1


def test_nothing_is_scored_until_someone_is_apart():
    """A merge is told once, so windows are only summed up where all have merged; what they bring counts later."""
    fusion = SceneFusion(FusionRules(50, 0, 0.5, 0.0, 3, least_dets=1))
    unit = np.array([[1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 1.0, 0.0]])
    assert [e[2:4] for e in fusion.step([(0, 1, 0, 9, unit[0], 1, []), (1, 2, 0, 9, unit[1], 1, [])], 50)] == [(2, 1)]
    before = fusion.scored
    for k in range(1, 30):
        assert fusion.step([(0, 1, 50 * k, 50 * k + 9, unit[2], 1, [])], 50 * k + 50) == []
    assert fusion.scored == before  # though the first has turned to another side by now
    assert [e[2:4] for e in fusion.step([(0, 3, 9000, 9009, unit[2], 1, [])], 9050)] == [(3, 1)]


@pytest.mark.parametrize("seed", [5, 6])
def test_best_partners_are_enough(spark, seed):
    """Where nearly all pairs pass, a person holds some, and finds others when those go."""
    rules = FusionRules(50, 10, -0.9, 0.0, 1, 2, 1, 1)
    rows = tracklets(seed, n=260)
    fusion, got = SceneFusion(rules), []
    rows = [x for x in rows if x[0] == 0]
    last = max(x[4] for x in rows)
    for b in range(50, last + 50, 50):
        here = sorted((x for x in rows if b - 50 < x[4] <= b or x[4] <= b == 50), key=lambda x: (x[4], x[2], x[1], x[3]))
        if here:
            got += [(0, *e) for e in fusion.step([(c, g, lo, hi, v, n, []) for _, c, g, lo, hi, _, v, n, _ in here], min(b, last))]
    assert np.isfinite(fusion.last[: len(fusion.at)]).any() and fusion.partner.shape[1] == fusion.room < len(fusion.at) - 1
    assert [r[:5] for r in sorted(got)] == [r[:5] for r in from_scratch(rows, rules)] and len(got) > 5


def test_scenes_are_dealt_out_evenly(spark):
    """With as many partitions as scenes each has one of its own."""
    v = [1.0, 0.0]
    rows = [(s, c, 10 * s + c, 0, 20, 9, v, 5, None) for s in range(8) for c in (1, 2)]
    got = windowed(spark.createDataFrame(rows, SCHEMA), FusionRules(50, 5, 0.5, 0.0, 3)).withColumn("p", F.spark_partition_id()).collect()
    assert len(got) == 8 == len({r.p for r in got})


def test_places_are_joined_by_their_part(spark):
    """Tracklets meet the places of their own 100 frames only, not all those of their person to be filtered."""
    from paceline.plans.store_queries import fused_with_places

    plan = fused_with_places(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join Inner" in line and "start_frame" in line and "<=" in line]
