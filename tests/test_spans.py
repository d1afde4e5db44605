"""What runs in parallel by exact cuts against the same rules in one serial pass."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import identity, linking


def serial_matches(rows):
    """Carried matches of all pairs in order, every assignment of a frame tried."""
    out, held = [], {}
    for cam in sorted({r[0] for r in rows}):
        for f in sorted({r[1] for r in rows if r[0] == cam}):
            iou = {(p, g): x for c, k, p, g, x in rows if (c, k) == (cam, f)}
            kept = {}
            for p in sorted({p for p, _ in iou}):
                g = held.get((cam, p))
                if (p, g) in iou and g not in kept.values():
                    kept[p] = g
            ps, gs = [p for p in sorted({p for p, _ in iou}) if p not in kept], [g for g in sorted({g for _, g in iou}) if g not in kept.values()]
            gs += [None] * len(ps)
            best = max((m for m in itertools.permutations(gs, len(ps)) if all(g is None or (p, g) in iou for p, g in zip(ps, m))), key=lambda m: (sum(g is not None for g in m), sum(iou.get(x, 0) for x in zip(ps, m))))
            fresh = {p: g for p, g in zip(ps, best) if g is not None}
            for p, g in {**kept, **fresh}.items():
                out.append((cam, f, p, g, p in fresh and held.get((cam, p), g) != g))
            held |= {(cam, p): g for p, g in {**kept, **fresh}.items()}
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_carried_matches_by_spans(spark, seed):
    rng = random.Random(seed)
    rows, crowded = [], seed % 2
    for cam in (0, 1):
        for f in range(40):
            for p in range(4):
                for g in {p, *(rng.sample(range(5), 2) if rng.random() < (0.7 if crowded else 0.15) else [])}:
                    if rng.random() < 0.75:
                        rows.append((cam, f, p, g, 0.5 + rng.random() / 2))
    d = spark.createDataFrame(rows + rows[:7], "cam_id int, frame_no long, person_id long, global_id long, iou double").repartition(3)
    got = identity.kept_matches(d)
    assert sorted((r.cam_id, r.frame_no, r.person_id, r.global_id, r.switch) for r in got.collect()) == serial_matches(rows)
    assert got.columns == ["cam_id", "frame_no", "person_id", "global_id", "iou", "switch"]


def test_a_camera_with_few_contested_frames_is_no_group(spark):
    """Spans hold contested pairs only: a long quiet camera goes through no kernel."""
    quiet = spark.range(20_000).select(F.lit(0).cast("int").alias("cam_id"), F.col("id").alias("frame_no"), (F.col("id") % 3).alias("person_id"), (F.col("id") % 3 + 10).alias("global_id"), F.lit(0.9).alias("iou"))
    fight = spark.createDataFrame([(0, 500, 500 % 3, 77, 0.95), (0, 9000, 0, 10, 0.8), (0, 9000, 1, 10, 0.9)], quiet.schema)
    got = {(r.frame_no, r.person_id): (r.global_id, r.switch) for r in identity.kept_matches(quiet.unionByName(fight)).collect()}
    assert len(got) == 20_000 and got[500, 500 % 3] == (12, False) and got[9000, 0] == (10, False) and not any(s for _, s in got.values())


def serial_tracks(rows, gate, relink_gate, relink_gap, age, cosine, decay):
    out, tracks, opened = {}, [], {}
    for scene, f in sorted({r[:2] for r in rows}):
        here = sorted((r for r in rows if r[:2] == (scene, f)), key=lambda r: r[2])
        live = [t for t in tracks if t["scene"] == scene and f - t["seen"] <= age]
        cost = np.array([[np.hypot(*(np.array(r[3:5]) - (t["at"] + t["v"] * (f - t["seen"])))) for t in live] for r in here]).reshape(len(here), len(live))
        pairs = dict(identity.assign(cost)) if len(live) else {}
        for k, r in enumerate(here):
            t, x = (live[pairs[k]] if k in pairs else None), None if r[5] is None else np.array(r[5])
            if t is not None:
                gap = f - t["seen"]
                late = gap > relink_gap
                unlike = late and cosine > 0 and x is not None and t["sum"] is not None and t["sum"] @ x < cosine * np.linalg.norm(t["sum"])
                if cost[k, pairs[k]] > (relink_gate if late else gate) or unlike:
                    t = None
            if t is None:
                opened[scene] = opened.get(scene, 0) + 1
                t = {"scene": scene, "id": opened[scene], "at": np.array(r[3:5]), "v": np.zeros(2), "seen": f, "sum": None}
                tracks.append(t)
            else:
                t["v"] = decay * t["v"] + (1 - decay) * (np.array(r[3:5]) - t["at"]) / gap
                t["at"], t["seen"] = np.array(r[3:5]), f
            if x is not None:
                t["sum"] = x if t["sum"] is None else t["sum"] + x
            out[r[:3]] = t["id"]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tracks_by_idle_parts(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for scene in range(3):
        f = 0
        for _ in range(60):
            f += int(rng.choice([1, 1, 2, 4, 9, 30 if scene else 5]))
            for i in range(int(rng.integers(1, 5))):
                v = None if rng.random() < 0.3 else (lambda x: (x / np.linalg.norm(x)).tolist())(rng.normal(size=3))
                rows.append((scene, f, i, float(rng.normal(3 * i, 1.5) + 0.02 * f), float(rng.normal()), v))
    d = spark.createDataFrame(rows, "scene long, frame_no long, instance long, x double, y double, v array<double>").repartition(4)
    rules = (2.5, 1.5, 3, 12, 0.1, 0.6)
    got = {(r.scene, r.frame_no, r.instance): r.global_id for r in linking.velocity_tracks(d, *rules).collect()}
    assert got == serial_tracks(rows, *rules)
    parts = linking.idle_parts(d.select("scene", "frame_no"), 12)
    assert {r.scene: r.n for r in parts.groupBy("scene").agg(F.countDistinct("part").alias("n")).collect()}[1] > 3
