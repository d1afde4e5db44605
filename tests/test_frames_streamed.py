"""One-to-one matches as frames stream by: any batches, no table of frames or boxes."""

import random
from itertools import permutations

import pytest

from paceline.operators import identity

PAIR = "cam_id int, frame_no long, person_id long, global_id long, gt_id long, det_id long, iou double"


def heaviest_of(rows):
    g, p = sorted({r[4] for r in rows}), sorted({r[5] for r in rows})
    w = {(r[4], r[5]): r[6] for r in rows}
    return max(sum(w.get(x, 0.0) for x in zip(g, c)) for c in permutations([*p, *[-1 - i for i in g]], len(g)))  # noqa: B905


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_frames_in_any_batches(spark, size):
    rng = random.Random(size)
    rows = []
    for cam in range(2):
        for f in range(40):
            pairs = {(rng.randrange(3), rng.randrange(3)) for _ in range(rng.randint(1, 6))}
            rows += [(cam, f, g, p, 10 * f + g, 10 * f + p, rng.random()) for g, p in sorted(pairs)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = [tuple(r) for r in identity._one_to_one(spark.createDataFrame(rows, PAIR).repartition(5), "iou").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert set(got) <= set(rows) and len(set(got)) == len(got)
    for at in {r[:2] for r in rows}:
        mine = [r for r in got if r[:2] == at]
        assert len({r[4] for r in mine}) == len({r[5] for r in mine}) == len(mine)
        assert abs(sum(r[6] for r in mine) - heaviest_of([r for r in rows if r[:2] == at])) < 1e-9


def test_no_table_of_frames(spark):
    pairs = spark.createDataFrame([(0, 0, 1, 1, 1, 1, 0.5)], PAIR)
    plan = identity._one_to_one(pairs, "iou")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_hota_repeats_no_match_for_each_step(spark):
    """What is repeated for each threshold comes after the matches of a track are summed."""
    box = "cam_id int, frame_no long, {} long, det_id long, left double, top double, width double, height double"
    gt, pred = (spark.createDataFrame([(0, 0, 1, 1, 0.0, 0.0, 10.0, 10.0)], box.format(c)) for c in ("person_id", "global_id"))
    plan = identity.hota(gt, pred)._jdf.queryExecution().optimizedPlan().toString()
    steps = [line for line in plan.splitlines() if "Generate explode" in line and "below" in line]
    assert len(steps) == 1
