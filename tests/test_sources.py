"""Readers on small files."""

import json

import numpy as np

from paceline.sources import files


def test_npz(spark, tmp_path):
    v = np.array([[3.0, 4.0], [0.0, 0.0]])
    np.savez(tmp_path / "det_emb_chunk_0000.npz", cam_id=[0, 1], frame_no=[5, 6], local_track_id=[7, 8], embeddings=v)
    (tmp_path / "det_emb_chunk_0001.npz").write_bytes(b"not a zip")
    np.savez(tmp_path / "det_emb_chunk_0002.npz", other=[1])
    got = files.read_detection_vectors(spark, f"{tmp_path}/det_emb_chunk_*.npz", normalise=True).orderBy("cam_id").collect()
    assert [(r.cam_id, r.frame_no, r.local_track_id, r.embedding) for r in got] == [(0, 5, 7, [0.6, 0.8]), (1, 6, 8, [0.0, 0.0])]
    np.savez(tmp_path / "tracklets.npz", tracklet_ids=[4], embeddings=v[:1])
    assert [tuple(r) for r in files.read_tracklet_vectors(spark, f"{tmp_path}/tracklets.npz").collect()] == [(4, [3.0, 4.0])]


def test_warehouse_truth(spark, tmp_path):
    person = lambda kind, i, boxes: {"object type": kind, "object id": i, "2d bounding box visible": boxes}
    (tmp_path / "gt.json").write_text(json.dumps({"7": [person("Person", 3, {"Camera_0002": [1, 2, 11, 22], "Camera_0010": [5, 5, 5, 9]}), person("Forklift", 4, {"Camera_0002": [0, 0, 9, 9]})]}))
    got = files.read_warehouse_truth(spark, f"{tmp_path}/gt.json").collect()
    assert [tuple(r) for r in got] == [(7, 2, 3, 1.0, 2.0, 10.0, 20.0)]


def test_cameras(spark, tmp_path):
    turn = [1, 0, 0, 0, -1, 0, 0, 0, -1]
    (tmp_path / "a.json").write_text(json.dumps({"Cameras": [{"CameraId": 1, "IntrinsicParameters": {"Fx": 100, "Fy": 110, "Cx": 50, "Cy": 60}, "ExtrinsicParameters": {"Rotation": turn, "Translation": [0, 0, 3000]}}]}))
    rows = [[1, 0, 0, 0], [0, -1, 0, 0], [0, 0, -1, 3000]]
    sensor = {"id": "Camera_0000", "type": "camera", "intrinsicMatrix": [[100, 0, 50], [0, 110, 60], [0, 0, 1]], "extrinsicMatrix": rows}
    (tmp_path / "b.json").write_text(json.dumps({"sensors": [sensor, sensor | {"type": "lidar"}]}))
    a, b = files.read_cameras(spark, f"{tmp_path}/a.json").collect(), files.read_sensor_cameras(spark, f"{tmp_path}/b.json").collect()
    assert len(a) == len(b) == 1 and a[0].asDict() == b[0].asDict()
    assert (a[0].cam_id, a[0].fy, a[0].r33, a[0].t3) == (0, 110.0, -1.0, 3000.0)


def test_lists(spark, tmp_path):
    (tmp_path / "sources.txt").write_text("# cameras\n\n/videos/a.mp4\n rtsp://host/1 \n")
    assert {tuple(r) for r in files.read_sources(spark, f"{tmp_path}/sources.txt").collect()} == {("file:///videos/a.mp4", False), ("rtsp://host/1", True)}
    left, right = spark.createDataFrame([(2,), (0,), (1,)], "s int"), spark.createDataFrame([(5,), (1,), (3,)], "c int")
    assert {tuple(r) for r in files.zip_by_rank(left, right).collect()} == {(0, 1), (1, 3), (2, 5)}
