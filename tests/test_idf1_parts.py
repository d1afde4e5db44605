"""The assignment behind IDF1, on sparse hits and by component."""

import numpy as np

from paceline.operators import identity


def test_sparse_assignment_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(400):
        w = rng.integers(1, 12, rng.integers(1, 8, 2))
        w = w * (rng.random(w.shape) < rng.random())
        r, c = np.nonzero(w)
        assert identity.heaviest(r.tolist(), c.tolist(), w[r, c].tolist()) == sum(w[i, k] for i, k in identity.assign(-w))


def test_idf1_over_many_components(spark):
    """40,000 persons that meet an id each (a dense matrix of them has 12.8 GB), a star and a tangle."""
    hits = [(0, 0, 5), (0, 1, 3), (1, 0, 4), (1, 1, 1), (2, 7, 2), (2, 8, 3), (2, 9, 1)]  # 3 + 4 and 3
    met = [(p, g) for p, g, n in hits for _ in range(n)]
    rows = spark.createDataFrame([(k, p, g) for k, (p, g) in enumerate(met)], "f long, p long, g long")
    rows = rows.unionByName(spark.range(100, 40_100).selectExpr("id AS f", "id AS p", "id AS g"))
    form = "0 AS cam_id", "f AS frame_no", "f AS det_id", "0D AS left", "0D AS top", "10D AS width", "20D AS height"
    gt, pred = rows.selectExpr("p AS person_id", *form), rows.selectExpr("g AS global_id", *form)
    assert identity.global_idf1(gt, pred).first().idtp == 40_000 + 7 + 3
