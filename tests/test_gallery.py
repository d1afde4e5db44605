"""The rules of the live gallery, one by one, and the operator on a stream."""

import datetime
import random

import numpy as np
import pytest

from paceline.streaming.gallery import NONE, GalleryRules, SiteGallery, gallery_ids, ruled_gallery


def unit(*x):
    v = np.array(x, float)
    return v / np.linalg.norm(v)


def near(c):
    """A unit vector with cosine c to (1, 0, 0)."""
    return np.array([c, (1 - c * c) ** 0.5, 0.0])


X, Y, Z = np.eye(3)
PLAIN = GalleryRules(least_vectors=1, merge=False)


def track(gid, seen=0, sampled=NONE, vectors=(), place=(np.nan, np.nan)):
    return gid, seen, sampled, list(vectors), place


def gallery(rules=PLAIN, tracks=None, known=None, **by_name):
    """A site with tracks {(cam, track): track(..)} and identities {gid: (seen, [(cam, frame, vector)])}."""
    g = SiteGallery(rules, 3)
    known = {int(k[1:]): (0, [(0, 0, v)]) for k, v in by_name.items()} | (known or {})
    for gid, (seen, prototypes) in sorted(known.items()):
        g.add_identities([gid], [seen])
        for c, f, v in prototypes:
            g.add_prototypes([gid], [c], [f], [v])
    for (cam, t), (gid, seen, sampled, vectors, (x, y)) in (tracks or {}).items():
        full = np.zeros((rules.track_vectors, 3))
        if vectors:
            full[-len(vectors) :] = vectors
        g.add_tracks({"cam": [cam], "track": [t], "gid": [gid], "seen": [seen], "sampled": [sampled], "n": [len(vectors)], "x": [x], "y": [y], "v": [full]})
    return g


def box(det, cam, track, v, good=True, place=(np.nan, np.nan)):
    return det, cam, track, np.zeros(3) if v is None else v, good, place


def ids(g, boxes, at=1):
    det, cam, t, v, good, place = zip(*boxes, strict=True)
    return dict(g.frame(at, np.array(det), np.array(cam), np.array(t), np.array(v, float), np.array(good), np.array(place, float)))


def prototypes(g, gid):
    return g.proto["frame"][g.proto["gid"] == gid].tolist()


def row(g, cam, t):
    return int(np.flatnonzero((g.tracks["cam"] == cam) & (g.tracks["track"] == t))[0])


def test_threshold_and_new_ids():
    g = gallery(g5=X)
    assert ids(g, [box(1, 1, 1, near(0.69)), box(2, 2, 1, unit(0.6, -0.8, 0))]) == {1: 5, 2: 1}


def test_one_identity_per_camera_and_frame():
    g = gallery(g5=X)
    got = ids(g, [box(1, 1, 1, X), box(2, 1, 2, near(0.8)), box(3, 2, 1, X)])
    assert got[1] == 5 == got[3] and got[2] not in (5, -1)


def test_known_track_keeps_its_identity():
    g = gallery(tracks={(1, 1): track(5)}, g5=X, g6=Y)
    assert ids(g, [box(1, 1, 1, Y)]) == {1: 5}


def test_stickiness():
    # Track 2 is released; 6 is better than 5 for it, but only by less than the margin.
    tracks = {(1, 1): track(5, vectors=[X] * 3), (1, 2): track(5)}
    v = unit(0.995, 0.15, 0)
    assert ids(gallery(tracks=tracks, g5=X, g6=near(0.98)), [box(1, 1, 1, X), box(2, 1, 2, v)])[2] not in (5, 6)
    free = gallery(GalleryRules(least_vectors=1, merge=False, switch_margin=-1, ambiguity=-1), tracks, g5=X, g6=near(0.98))
    assert ids(free, [box(1, 1, 1, X), box(2, 1, 2, v)])[2] == 6


def test_ambiguity():
    assert ids(gallery(g5=X, g6=near(0.97)), [box(1, 1, 1, near(0.99))])[1] not in (5, 6)
    assert ids(gallery(g5=X, g6=near(0.8)), [box(1, 1, 1, X)]) == {1: 5}


def test_poor_vectors_wait():
    g = gallery(g5=X)
    assert ids(g, [box(1, 1, 1, Y, good=False), box(2, 1, 2, None), box(3, 1, 3, X, good=False)]) == {1: -1, 2: -1, 3: 5}
    assert len(prototypes(g, 5)) == 1  # and teach nothing


def test_release_prefers_longer_tracks_then_score_then_lower_id():
    tracks = {(1, 1): track(5, 0, 0, [X]), (1, 2): track(5, 0, 0, [X, X, X])}
    assert ids(gallery(tracks=tracks, g5=X), [box(1, 1, 1, Y, False), box(2, 1, 2, X)])[2] == 5
    tracks = {(1, 1): track(5), (1, 2): track(5)}
    got = ids(gallery(tracks=tracks, g5=X), [box(1, 1, 1, near(0.9), False), box(2, 1, 2, X, False)])
    assert got[2] == 5 and got[1] != 5
    assert ids(gallery(tracks=tracks, g5=X), [box(1, 1, 1, X, False), box(2, 1, 2, X, False)]) == {1: 5, 2: -1}


def test_sampling_of_tracks():
    g = gallery(GalleryRules(merge=False), g5=X)
    for f in range(1, 40):
        ids(g, [box(f, 1, 1, X)], f)
    k = row(g, 1, 1)
    assert g.tracks["n"][k] == 8 and g.tracks["sampled"][k] == 38  # frames 1, 2, 3, then every fifth: 8, 13, ...
    ids(g, [box(99, 1, 1, X, good=False)], 43)
    assert g.tracks["sampled"][k] == 38


def test_prototypes():
    rules = GalleryRules(merge=False, prototypes=3, least_vectors=1, sample_every=1)
    g = gallery(rules, {(0, 1): track(5)}, g5=X)
    ids(g, [box(1, 0, 1, near(0.9))], 1)
    assert len(prototypes(g, 5)) == 1  # near enough to what is there
    ids(g, [box(2, 0, 1, near(0.5))], 2)
    assert len(prototypes(g, 5)) == 2
    g.add_tracks({"cam": [7], "track": [1], "gid": [5], "seen": [2], "sampled": [NONE], "n": [0], "x": [np.nan], "y": [np.nan], "v": np.zeros((1, 8, 3))})
    ids(g, [box(3, 7, 1, X)], 3)  # the first of its camera
    ids(g, [box(4, 0, 1, Z)], 4)
    assert prototypes(g, 5) == [2, 3, 4]


def test_expiry():
    g = gallery(GalleryRules(gallery_age=10, track_age=20, merge=False, least_vectors=1), {(1, 1): track(5, 0, 0, [X])}, g5=X)
    g.expire(10)
    assert 5 in g.known["gid"]
    g.expire(11)
    assert not len(g.known["gid"]) and not len(g.proto["gid"]) and g.tracks["gid"].tolist() == [NONE]
    g.expire(21)
    assert not len(g.tracks["gid"])


def test_places_of_other_cameras():
    def world(close_only=False, cam=2):
        rules = GalleryRules(least_vectors=1, merge=False, ambiguity=-1, close_only=close_only, geo_margin=0.02)
        return gallery(rules, {(cam, 9): track(6, place=(0.0, 0.0))}, g5=X, g6=near(0.9))

    def blended(g, x):
        return g.blended(np.array([[1.0, 0.9]]), np.array([1]), np.array([[x, 0.0]]))[0, 1]

    # 5 is nearer by vector, 6 stands at the same place in another camera.
    assert blended(world(), 10.0) == pytest.approx(0.65 * 0.9 + 0.35)
    assert blended(world(), 9000.0) < 0.65 * 0.9 + 0.01
    assert blended(world(cam=1), 10.0) == 0.9  # one's own camera says nothing
    assert ids(world(close_only=True), [box(1, 1, 1, X, place=(10.0, 0.0))]) == {1: 5}


def test_merging_of_duplicates():
    rules = GalleryRules(least_vectors=1, merge_vectors=2, merge_every=1)
    known = {2: (0, [(0, 0, X)]), 9: (0, [(1, 0, near(0.9))])}
    tracks = {(1, 1): track(9, 0, 0, [near(0.9)] * 3)}
    g = gallery(rules, tracks, known)
    assert ids(g, [box(1, 1, 1, near(0.9))]) == {1: 2} and 9 not in g.known["gid"] and len(prototypes(g, 2)) == 2
    # Not while a track of the same camera has the older one, not for a short track, not into a younger one.
    g = gallery(rules, tracks | {(1, 2): track(2, 0, 0, [X] * 3)}, known)
    assert ids(g, [box(1, 1, 1, near(0.9)), box(2, 1, 2, X)]) == {1: 9, 2: 2}
    g = gallery(GalleryRules(least_vectors=1, merge_vectors=6, merge_every=1), tracks, known)
    assert ids(g, [box(1, 1, 1, near(0.9))]) == {1: 9}
    g = gallery(rules, {(1, 1): track(2, 0, 0, [X] * 3)}, known)
    assert ids(g, [box(1, 1, 1, X)]) == {1: 2}
    g = gallery(rules, tracks, known | {3: (0, [(0, 0, X)])})  # two alike: neither
    assert ids(g, [box(1, 1, 1, near(0.9))]) == {1: 9}
    # Nor while some other camera shows both.
    g = gallery(rules, tracks | {(2, 1): track(9, 0, 0, [near(0.9)] * 3), (2, 2): track(2, 0, 0, [X] * 3)}, known)
    assert ids(g, [box(1, 1, 1, near(0.9)), box(2, 2, 1, near(0.9)), box(3, 2, 2, X)]) == {1: 9, 2: 9, 3: 2}


def test_bounded_candidates():
    g = gallery(GalleryRules(candidates=2), known={k: (s, []) for k, s in ((1, 9), (2, 9), (3, 4), (4, 8))})

    def seen(allowed):
        return g.known["gid"][g.lately_seen(10, np.array([[x in allowed for x in (1, 2, 3, 4)]]))[0]].tolist()

    assert seen({1, 2, 3, 4}) == [1, 2] and seen({1, 3, 4}) == [1, 4] and seen({1}) == [1] and seen(set()) == []


def test_two_boxes_of_a_track_in_a_frame():
    g = gallery(g5=X)
    assert ids(g, [box(2, 1, 1, Y), box(1, 1, 1, X), box(3, 1, 2, Z)]) == {1: 5, 2: 5, 3: 1}


SCHEMA = "site long, frame_no long, cam_id long, det_id long, local_track_id long, embedding array<double>, good boolean, x double, y double, event_time timestamp"


def walk(seed, frames):
    """Boxes of six persons in three cameras of two sites, with noise, gaps and missing vectors."""
    rng = np.random.default_rng(seed)
    people = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = []
    for s in (0, 1):
        for f in range(1, frames + 1):
            for p in range(6):
                for c in range(3):
                    if rng.random() < 0.6 and (f // 12 + p + c) % 3:
                        v = people[p] + rng.normal(size=6) * rng.choice([0.05, 0.3])
                        rows.append((s, f, c, len(rows), 10 * p + (f // 12) % 3, None if rng.random() < 0.1 else v.tolist(), bool(rng.random() < 0.9), float(100 * p + f), float(s), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=f)))
    return rows


RULES = GalleryRules(track_age=20, gallery_age=30)


def test_a_split_and_shuffled_stream_gives_the_ids_of_the_batch(spark, tmp_path):
    """Frames are split over files, and files come out of order within the allowed lateness."""
    rows = walk(3, 40)
    want = {r.det_id: r.global_id for r in gallery_ids(spark.createDataFrame(rows, SCHEMA).repartition(3), 6, RULES).collect()}
    assert len(want) == len(rows) and len(set(want.values())) > 6
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    parts = {}
    for r in rows:
        parts.setdefault(r[1] // 14 + (rng.random() < 0.4), []).append(r)  # a frame's boxes lie in two files
    end = [(s, 999, 9, 10**6 + s, 9, None, False, None, None, datetime.datetime(2024, 1, 1, 1)) for s in (0, 1)]
    src, out = tmp_path / "in", str(tmp_path / "out")
    for k, part in enumerate([*(p for _, p in sorted(parts.items())), end]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(SCHEMA).parquet(str(src))
        q = ruled_gallery(stream, 6, "30 seconds", RULES).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = {r.det_id: r.global_id for r in spark.read.parquet(out).collect() if r.det_id < 10**6}
    assert got == want


def test_full_identities_keep_their_last_prototypes_in_place():
    """The table of a gallery whose identities are full is not copied for a new prototype, and scores follow it."""
    rng = np.random.default_rng(0)
    g = SiteGallery(GalleryRules(prototypes=3), 4)
    g.add_identities([1, 2], [0, 0])
    v = rng.normal(size=(6, 4))
    g.add_prototypes([1, 2, 1, 2, 1, 2], [0] * 6, range(6), v)
    table, more = g.proto["v"], rng.normal(size=(2, 4))
    q = rng.normal(size=(5, 4))
    g.scores(q)
    g._add_last(np.array([1, 2]), np.array([0, 1]), 9, more)
    assert g.proto["v"] is table and g.proto["frame"][g.proto["gid"] == 1].tolist() == [2, 4, 9]
    for gid, kept in ((0, [v[2], v[4], more[0]]), (1, [v[3], v[5], more[1]])):
        assert np.allclose(g.scores(q)[:, gid], (q @ np.stack(kept).T).max(1))
