"""The whole forms of queries that are registered with a subset too."""

from paceline.plans.linking_queries import _placed_vectors
from paceline.plans.queries import _dense
from paceline.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def test_components_keep_every_link(spark):
    """Both ends of each link are in one component."""
    assert "% 7" not in ORACLES["remap_components_all"]
    of = {r.node: r.component for r in QUERIES["remap_components_all"](spark, DIR).collect()}
    links = QUERIES["colocated_pairs"](spark, DIR).collect()
    assert any(r.a % 7 != r.b % 7 for r in links) and all(of[r.a] == of[r.b] for r in links)
    assert len(of) == QUERIES["persons_seen"](spark, DIR).count()


def test_every_track_is_interpolated(spark):
    """Each track with a box on a detector frame."""
    assert "local_track_id <" not in ORACLES["box_interp_all"]
    tracks = ["cam_id", "local_track_id"]
    got = {tuple(r) for r in QUERIES["box_interp_all"](spark, DIR).select(*tracks).distinct().collect()}
    keyed = _dense(spark, DIR).where("frame_no % 5 = 0").select(*tracks).distinct()
    assert got == {tuple(r) for r in keyed.collect()} and any(track >= 4 for _, track in got)


def test_every_scene_and_camera_is_queried(spark):
    v = {r.vec_id: (r.scene, r.cam_id) for r in _placed_vectors(spark, DIR).collect()}
    asked = {v[r.query_id] for r in QUERIES["retrieval_scores_all"](spark, DIR).collect()}
    assert asked == set(v.values()) and len(asked) == 20
