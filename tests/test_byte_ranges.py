"""Large files in ranges, against plain readers of the whole file."""

import json
import random

import numpy as np
import pytest

from paceline.sources import files, ranges


def truth_document(frames, spaced):
    rng = random.Random(frames)
    doc = {}
    for f in range(frames):
        objects = []
        for p in range(rng.randrange(4)):
            boxes = {f"Camera_{c:04d}": [x := rng.random() * 100, y := rng.random() * 100, x + rng.choice([0, 3.5]), y + 2] for c in range(rng.randrange(4))}
            kind = rng.choice(["Person", "Person", "Forklift"])
            objects.append({"object type": kind, "object id": p, "object name": 'a "7": [{ tricky } é', "3d location": [1, 2], "2d bounding box visible": boxes or None})
        doc[str(f)] = objects
    return doc, json.dumps(doc, indent=2 if spaced else None, ensure_ascii=False)


def plain_truth(doc, stride=1, cameras=None):
    out = []
    for f, objects in doc.items():
        for o in objects:
            for name, b in (o["2d bounding box visible"] or {}).items():
                cam = int(name[-4:])
                if o["object type"] == "Person" and int(f) % stride == 0 and (cameras is None or cam in cameras) and b[2] > b[0] and b[3] > b[1]:
                    out.append((int(f), cam, o["object id"], b[0], b[1], b[2] - b[0], b[3] - b[1]))
    return sorted(out)


@pytest.mark.parametrize("spaced", [False, True])
def test_truth_in_ranges(spark, tmp_path, spaced):
    doc, text = truth_document(300, spaced)
    (tmp_path / "gt.json").write_text(text)
    for part_bytes in (700, 20_000, 1 << 30):
        got = files.read_warehouse_truth(spark, f"{tmp_path}/gt.json", part_bytes=part_bytes)
        assert sorted(tuple(r) for r in got.collect()) == plain_truth(doc)
        assert got.rdd.getNumPartitions() == max(1, -(-len(text.encode()) // part_bytes))
    got = files.read_warehouse_truth(spark, f"{tmp_path}/gt.json", 3, [1, 2], 5000)
    assert sorted(tuple(r) for r in got.collect()) == plain_truth(doc, 3, [1, 2])


@pytest.mark.parametrize("cut", [1, 7, 64])
def test_every_cut_reads_each_frame_once(monkeypatch, cut):
    doc, text = truth_document(40, cut == 7)
    data = text.encode()
    monkeypatch.setattr(ranges, "CHUNK", 97)  # keys and frames lie across reads
    edges = [len(data) * k // cut for k in range(cut + 1)]
    got = {}
    for lo, hi in zip(edges, edges[1:], strict=False):
        for f, objects in ranges.frames_in(lambda at, n: data[at : at + n], len(data), lo, hi, lambda x: True):
            assert f not in got
            got[f] = objects
    assert got == {int(f): o for f, o in doc.items() if o}


def test_arrays_in_slices(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 5000
    arrays = {"cam_id": rng.integers(0, 4, n).astype(np.int32), "frame_no": np.arange(n), "local_track_id": rng.integers(0, 9, n), "embeddings": rng.normal(size=(n, 6)).astype(np.float32)}
    arrays["embeddings"][3] = 0
    np.savez(tmp_path / "a.npz", **arrays)
    np.savez_compressed(tmp_path / "b.npz", **arrays | {"frame_no": np.arange(n) + n, "embeddings": np.asfortranarray(arrays["embeddings"])})
    (tmp_path / "c.npz").write_bytes(b"no archive")
    got = files.read_npz(spark, f"{tmp_path}/*.npz", files.DETECTION_VECTORS, {"embedding": "embeddings"}, True, part_bytes=30_000)
    assert got.rdd.getNumPartitions() > 6
    rows = sorted(got.collect(), key=lambda r: r.frame_no)
    assert [r.frame_no for r in rows] == list(range(2 * n))
    v = arrays["embeddings"].astype(float)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose([r.embedding for r in rows], np.tile(v / np.where(size > 0, size, 1), (2, 1)))
    assert [r.cam_id for r in rows[:n]] == arrays["cam_id"].tolist() == [r.cam_id for r in rows[n:]]
