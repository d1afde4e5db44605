"""Interval joins, percentiles and track versions against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import grids, pairs
from paceline.sources import sinks


@pytest.mark.parametrize("tolerance", [0, 7])
def test_intervals_meet_once_whatever_their_length(spark, tolerance):
    rng = random.Random(tolerance)
    rows = []
    for i in range(160):
        lo = rng.randrange(-500, 3000)
        rows.append((i, rng.randrange(2), rng.randrange(6), lo, lo + rng.choice([0, 1, 2, 40, 700, 100_000])))
    t = spark.createDataFrame(rows, "tracklet_id long, cam_id long, global_id long, start_frame long, end_frame long").repartition(3)
    got = sorted((r.cam_id, r.a, r.b) for r in pairs.interval_conflicts(t, tolerance).collect())
    want = sorted((x[1], x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] != y[2] and max(x[3], y[3]) <= min(x[4], y[4]) + tolerance)
    assert got == want and len(want) > 100


def test_covers_are_canonical(spark):
    ends = [(lo, lo + n) for lo in (-9, -1, 0, 1, 6, 1000) for n in (0, 1, 2, 3, 10, 63, 64, 1000)]
    d = spark.createDataFrame(ends, "lo long, hi long").select("lo", "hi", pairs._cover(F.col("lo"), F.col("hi")).alias("c"))
    for r in d.collect():
        inside = sorted(x for n in r.c for x in range(n.number << n.level, (n.number + 1) << n.level))
        assert inside == list(range(r.lo, r.hi + 1)) and len(r.c) <= 2 * max(1, (r.hi - r.lo + 1).bit_length())


def test_percentiles_do_not_care_how_far_values_lie_apart(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=5000), [1e12, -1e12, 1e-12], np.full(700, 0.5), 10.0 ** rng.integers(-200, 200, 300)])
    d = spark.createDataFrame([(float(v), k % 2) for k, v in enumerate(x)], "x double, k long").repartition(4)
    at = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]
    assert grids.percentiles(d, "x", at).first().x == pytest.approx(np.quantile(x, at).tolist(), rel=1e-12)
    got = {r.k: r.x for r in grids.percentiles(d, "x", at, "k").collect()}
    assert all(got[k] == pytest.approx(np.quantile(x[k::2], at).tolist(), rel=1e-12) for k in (0, 1))


TRACKS = "group string, cam_id int, frame_no long, local_track_id long, global_id long"


def test_versions_of_the_track_map(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    folder, now, chunks = str(tmp_path), {}, []
    read = lambda: {(r.group, r.cam_id, r.local_track_id): r.global_id for r in sinks.track_map(spark, folder).collect()}
    assert read() == {}
    for b in range(7):
        rows = [("g", rng.randrange(2), 100 * b + k, rng.randrange(5), rng.randrange(50)) for k in range(12)]
        chunks.append(spark.createDataFrame(rows, TRACKS))
        for g, c, _, t, i in rows:
            now[g, c, t] = i
        sinks.append_assignments(chunks[-1], folder, b, compact_every=3)
        assert read() == now
    sinks.append_assignments(chunks[0], folder, 0)  # played again
    sinks.append_assignments(chunks[-1], folder, 6)
    assert read() == now and spark.read.parquet(f"{folder}/assignments").count() == 84

    def stopped(*_):
        raise RuntimeError("stopped")

    late = spark.createDataFrame([("g", 0, 9999, 1, 77)], TRACKS)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_commit", stopped)
        with pytest.raises(RuntimeError):
            sinks.append_assignments(late, folder, 7)
    assert read() == now  # the former version
    sinks.append_assignments(late, folder, 7)
    assert read() == now | {("g", 0, 1): 77}
    names = {p.name for p in (tmp_path / "tracks").iterdir() if not p.name.startswith(".")}
    assert {"base-000000000002", "base-000000000005"} <= names


def test_beginnings_are_listed_once_for_each_class_of_lengths(spark):
    """Two rows of an interval and one of a beginning for each class meet; none is broadcast by a wrong guess of its size."""
    t = spark.range(3000).select(F.col("id").alias("tracklet_id"), F.lit(0).alias("cam_id"), F.col("id").alias("global_id"), (F.col("id") * 50).alias("start_frame"), (F.col("id") * 50 + F.when(F.col("id") % 100 == 0, 90_000).otherwise(0)).alias("end_frame"))
    found = pairs.interval_conflicts(t, 60)
    assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()
    met = found.count()
    want = sum(1 for i in range(3000) for j in range(i + 1, min(3000, i + 1 + (90_060 if i % 100 == 0 else 60) // 50)))
    assert met == want


def _unordered(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, i, lo := rng.randrange(20_000), lo + rng.choice([0, 900, 8000])) for i in rng.sample(range(600), 600)]
    return rows, spark.createDataFrame(rows, "tracklet_id long, cam_id long, global_id long, start_frame long, end_frame long").repartition(5)


def test_conflicts_come_in_runs(spark):
    """One of a pair's two ids stays from row to row, whatever order the tracklets have: written pairs take little."""
    _, t = _unordered(spark)
    got = [(r.a, r.b) for r in pairs.interval_conflicts(t, 60).collect()]
    jumps = sum(x[0] != y[0] and x[1] != y[1] for x, y in zip(got, got[1:]))
    assert len(got) > 20_000 and jumps < len(got) / 5


def test_handoffs_come_in_the_order_of_time(spark):
    rows, t = _unordered(spark)
    met = pairs.handoffs(t, 900).collect()
    on = sum(x.a == y.a and x.gap <= y.gap for x, y in zip(met, met[1:]))
    want = sorted((x[0], y[0], y[3] - x[4]) for x in rows for y in rows if x[1] != y[1] and 0 < y[3] - x[4] <= 900)
    assert sorted(tuple(r) for r in met) == want and len(met) > 5000 and on > 0.7 * len(met)
