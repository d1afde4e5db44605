"""Runs, the store's queries with arguments, sources, sinks and projections, on small cases."""

import json
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import pairs, projections, regions, store
from paceline.plans.store_api import Store
from paceline.sources import files, sinks, tracking

DET = "cam_id int, frame_no long, local_track_id long, global_id long, zone string, foot_x double, foot_y double, world_x double, world_y double"


def run(spark, shift=0):
    rows = [(0, f + shift, 1, 7, "cam0:door", 1.0, 2.0, f * 1.0, 0.0) for f in (0, 1, 2, 30, 31)] + [(1, f + shift, 2, 8, "cam1:desk", 1.0, 2.0, None, None) for f in range(4)] + [(0, 5 + shift, 3, -1, "cam0:door", 0.0, 0.0, 0.0, 0.0)]
    vectors = spark.createDataFrame([(7, [3.0, 4.0]), (7, [3.0, 4.0]), (8, [0.0, 2.0]), (-1, [1.0, 0.0])], "global_id long, embedding array<double>")
    return sinks.store_tables(spark.createDataFrame(rows, DET), vectors, 1000.0, 10.0, 20, 1.0, {"scene": "lobby"})


def test_store_of_two_runs(spark, tmp_path):
    root = str(tmp_path / "store")
    assert sinks.save_run(run(spark), root, "a") and not sinks.save_run(run(spark), root, "a")
    assert sinks.save_run(run(spark, 100), root, "b")
    assert sinks.save_run(run(spark), root, "a", replace=True)  # again: no rows twice
    s = Store.open(spark, root)
    assert s.run_id == "a" and [r.run_id for r in s.list_runs().collect()] == ["a", "b"]
    info = s.run_info().first()
    assert (info.n_dets, info.n_gids, info.n_cams, info.scene) == (9, 2, 2, "lobby")
    assert [r.zone for r in s.zones().collect()] == ["cam0:door", "cam1:desk"] and [r.global_id for r in s.list_persons().collect()] == [7, 8]
    t = [(r.t_start, r.t_end, r.seconds, r.n_frames) for r in s.person_timeline(7).collect()]
    assert t == [(1000.0, 1000.2, 0.2, 3), (1003.0, 1003.1, 0.1, 2)]
    assert len(s.person_timeline(7, (1002.0, 1004.0)).collect()) == 1
    assert [r.world_x for r in s.person_trajectory(7, step=2).collect()] == [0.0, 2.0, 31.0] and s.person_trajectory(8).count() == 0
    assert [(r.zone, r.seconds, r.n_visits) for r in s.person_dwell(7).collect()] == [("cam0:door", 0.3, 2)]
    assert [(r.seconds, r.n_visits) for r in s.person_dwell(7, (1002.0, 1004.0)).collect()] == [(0.1, 1)]
    assert [(r.zone, r.value) for r in s.top_zones(metric="occupancy").collect()] == [("cam0:door", 0.5), ("cam1:desk", 0.4)]
    assert [(r.zone, r.value) for r in s.top_zones(k=1).collect()] == [("cam0:door", 1.0)]
    assert [(r.bucket, r.occupancy_s, r.footfall) for r in s.zone_occupancy("cam0:door").collect()] == [(0, 0.3, 1), (3, 0.2, 1)]
    q = spark.createDataFrame([(1, [6.0, 8.0])], "query_id long, embedding array<double>")
    assert [(r.global_id, r.score) for r in s.search(q, 2).collect()] == [(7, 1.0), (8, 0.8)]
    assert s.gid_vector(8).first().v == [0.0, 1.0]
    both = Store(s.tables)
    assert Counter(r.run_id for r in both.person_timeline(7).collect()) == {"a": 2, "b": 2}
    assert [(r.run_id, r.t_start) for r in Store.open(spark, root, "b").person_timeline(7).collect()][0] == ("b", 1010.0)


def test_dispatch(spark):
    s = Store({n: t.withColumn("run_id", F.lit("a")) for n, t in run(spark).items()}, "a")
    assert s.dispatch("nothing", {}) == {"error": "unknown tool nothing"}
    assert s.dispatch("person_timeline", {"global_id": 7}).count() == 2
    span = {"t_start": "1970-01-01T00:16:42+00:00", "t_end": "1970-01-01T00:16:45+00:00"}
    assert s.dispatch("person_timeline", {"global_id": 7} | span).count() == 1
    assert s.dispatch("person_timeline", {"global_id": 7, "t_start": span["t_start"]}).count() == 2  # one end is no span
    assert s.dispatch("top_zones", {"k": 1}).count() == 1
    assert s.dispatch("person_trajectory_bev", {"global_id": 7}).count() == s.person_trajectory(7).count()
    some = s.tables["gid_embeddings"].first()
    assert s.dispatch("search_person", {"embedding": list(some.v), "k": 1}).first().global_id == some.global_id


def test_predictions_round_trip(spark, tmp_path):
    det = spark.createDataFrame([(0, 5, 1, 7, 1.234, 2.0, 3.0, 4.0), (3, 6, 2, -1, 1.0, 2.0, 3.0, 4.0)], "cam_id int, frame_no long, local_track_id long, global_id long, left double, top double, width double, height double")
    sinks_path = str(tmp_path / "out")
    files.write_predictions(det, sinks_path)
    got = sorted(tuple(r) for r in tracking.read_predictions(spark, sinks_path).collect())
    assert got == [(5, 0, 1, 7, 1.23, 2.0, 3.0, 4.0), (6, 3, 2, -1, 1.0, 2.0, 3.0, 4.0)]
    (tmp_path / "cam_12_predictions.csv").write_text("frame_no_cam,cam_id,local_track_id,global_id,left,top,width,height\n1,0,2,3,1.5,2.5,3.5,4.5\n")
    assert [r.cam_id for r in tracking.read_predictions(spark, f"{tmp_path}/cam_12_predictions.csv").collect()] == [12]


def test_assignments_truth_and_lists(spark, tmp_path):
    (tmp_path / "assign.csv").write_text("group,cam_id,frame_no,local_track_id,global_id\na,0,1,5,7\na,0,1,5,9\na,0,2,5,7\n")
    got = {(r.frame_no, r.global_id) for r in tracking.read_assignments(spark, f"{tmp_path}/assign.csv").collect()}
    assert got == {(1, 9), (2, 7)}
    rows = "frame,person_id,left,top,width,height\n4,1,0,0,1,1\n2,1,0,0,1,1\n3,1,0,0,1,1\n"
    (tmp_path / "cam_0.csv").write_text(rows)
    (tmp_path / "cam_1.csv").write_text(rows)
    (tmp_path / "cam_1_clean.csv").write_text("frame,person_id,left,top,width,height\n8,1,0,0,1,1\n")
    read = lambda *a, **k: [r.frame for r in tracking.read_truth(spark, str(tmp_path), *a, **k).collect()]
    assert read(0) == [2, 3, 4] and read(1) == [8] and read(0, stride=2) == [2, 4] and read(0, most=1) == [2]
    (tmp_path / "ids.txt").write_text("3 # a note\n\n5\n3\n")
    assert {r.id for r in tracking.read_ids(spark, f"{tmp_path}/ids.txt").collect()} == {3, 5}
    (tmp_path / "list.txt").write_text("# c\n/v/Camera_0007.mp4\n\nrtsp://h/Camera_03\n/v/x.mp4\n")
    assert [tuple(r) for r in files.camera_numbers(spark, f"{tmp_path}/list.txt").orderBy("source_id").collect()] == [(0, 7), (1, 3), (2, 2)]
    got, live = files.resolve_sources(spark, f"{tmp_path}/list.txt", folder="/nowhere")
    assert live and [r.uri for r in got.orderBy("nth").collect()] == ["file:///v/Camera_0007.mp4", "rtsp://h/Camera_03", "file:///v/x.mp4"]
    (tmp_path / "videos").mkdir()
    for n in ("b.mp4", "a.MP4", "c.txt"):
        (tmp_path / "videos" / n).write_text("x")
    got, live = files.resolve_sources(spark, folder=str(tmp_path / "videos"))
    assert not live and [r.uri.rsplit("/", 1)[1] for r in got.orderBy("nth").collect()] == ["a.MP4", "b.mp4"]
    assert files.list_folder(spark, str(tmp_path / "videos"), most=1).count() == 1
    with pytest.raises(ValueError):
        files.resolve_sources(spark)
    (tmp_path / "00012_3.json").write_text('{"4": [1, 2, 11, 22]}')
    assert [tuple(r) for r in tracking.read_frame_labels(spark, f"{tmp_path}/00012_3.json").collect()] == [(12, 3, 4, 1.0, 2.0, 10.0, 20.0)]
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "manifest.json").write_text(json.dumps({"git_dirty": True, "duration_s": 2.5, "models": {"d": "x"}}))
    m = tracking.read_manifests(spark, f"{tmp_path}/run1/manifest.json").first()
    assert (m.run_id, m.git_dirty, m.duration_s, m.models) == ("run1", True, 2.5, {"d": "x"})
    sinks.write_manifest(spark, {"gpu": "none"}, f"{tmp_path}/run2")
    assert tracking.read_manifests(spark, f"{tmp_path}/run2").first().gpu == "none"


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("x/rgb_00001_2.jpg", "x/rgb_00002_2.jpg", "l/00001_2.json", "readme.txt"):
            z.writestr(n, "")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = files.paired_members(files.zip_members(spark, f"{tmp_path}/*.zip")).collect()
    assert [(r.frame, r.cam_id, r.image.member, r.label.member) for r in got] == [(1, 2, "x/rgb_00001_2.jpg", "l/00001_2.json")]


def test_rules_and_zone_names(spark):
    text = "[roi-filtering-stream-0]\n# roi-NO=0;0;1;0;1;1\nroi-door = 0;0,10;0;10;10;5\nroi-two=0;0;1;1\n[line-crossing-stream-0]\nroi-x=0;0;1;0;1;1\n[overcrowding-stream-1]\nroi-door=0;0;10;0;10;10;0;10\n"
    z = regions.parse_rules(text, 10, 10)
    assert [(c, n, len(p)) for c, _, n, p in z] == [(0, "door", 3), (1, "door", 4)]
    table = regions.zone_table(spark, z)
    assert {r.zone_name for r in regions.zone_vocabulary(table).collect()} == {"cam0:door", "cam0:other", "cam1:door", "cam1:other"}
    det = spark.createDataFrame([(0, 4.0, 1.0, 2.0, 1.0), (1, 4.0, 1.0, 2.0, 1.0), (0, -50.0, 0.0, 1.0, 1.0), (5, 0.0, 0.0, 1.0, 1.0)], "cam_id int, left double, top double, width double, height double")
    assert Counter(r.zone_name for r in regions.resolve_zones(det, table, 10.0, 10.0).collect()) == {"cam0:door": 1, "cam1:door": 1, "cam0:other": 1, "cam5:other": 1}
    m = {r.cam_id: tuple(r)[1:] for r in regions.function_matrix(spark.createDataFrame([(0, ["count", "density"], True), (0, ["crossing"], False), (1, ["count"], True)], "cam_id int, analytics array<string>, on boolean")).collect()}
    assert m == {0: (1, 0, 1, 0), 1: (1, 0, 0, 0)}


def test_sinks(spark, tmp_path):
    det = spark.createDataFrame([(1, 0, 1, 5, 7), (2, 0, 2, 5, 8)], "det_id long, cam_id int, frame_no long, local_track_id long, global_id long")
    chunk = lambda *rows: spark.createDataFrame(rows, "group string, cam_id int, frame_no long, local_track_id long, global_id long")
    for c in (chunk(("g", 0, 1, 5, 7)), chunk(("g", 0, 9, 5, 8), ("g", 1, 9, 5, 2))):
        sinks.append_assignments(c, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/assignments").count() == 3
    assert {(r.cam_id, r.global_id) for r in sinks.track_map(spark, str(tmp_path)).collect()} == {(0, 8), (1, 2)}
    events = spark.createDataFrame([(10, 5, 8, 7, 0.9)], "event_frame long, window_end_frame long, source long, target long, score double")
    sinks.write_remap(det, spark.createDataFrame([(8, 7)], "source long, target long"), events, f"{tmp_path}/remap")
    assert [r.global_id for r in spark.read.parquet(f"{tmp_path}/remap/predictions").collect()] == [7, 7]
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/remap/remap").collect()) == [("7", "7"), ("8", "7")]
    assert spark.read.option("header", True).csv(f"{tmp_path}/remap/merges").count() == 1 == spark.read.option("header", True).csv(f"{tmp_path}/remap/events").count()
    n = spark.createDataFrame([(0, 4, "b", 2, 1), (0, 4, "a", 1, 0)], "cam_id int, frame_no long, zone_name string, n long, overcrowded int")
    sinks.write_region_counts(n, f"{tmp_path}/counts")
    r = spark.read.option("header", True).csv(f"{tmp_path}/counts")
    assert tuple(r.first()) == ("4", "0", "3", "a=1;b=2", "a=0;b=1")
    assert r.select(sinks.unpacked("roi").alias("m")).first().m == {"a": 1, "b": 2}
    sinks.append_results(det, f"{tmp_path}/results")
    sinks.append_results(det, f"{tmp_path}/results")
    sinks.write_metrics(det, f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/results").count() == 4 and spark.read.json(f"{tmp_path}/metrics").count() == 2
    boxes = det.select("*", *[F.lit(10.0).alias(c) for c in ("width", "height")])
    v = spark.createDataFrame([(0, 5, 7, [3.0, 4.0])], "cam_id int, local_track_id long, global_id long, embedding array<double>")
    points = det.select("cam_id", "frame_no", "local_track_id", "global_id", F.lit(1.0).alias("world_x"), F.lit(2.0).alias("world_y"))
    sinks.write_tracklets(boxes, v, points, f"{tmp_path}/t")
    t = tracking.read_tracklets(spark, f"{tmp_path}/t/tracklets").orderBy("tracklet_id").collect()
    assert [(r.tracklet_id, r.global_id, r.num_embeddings, r.mean_area) for r in t] == [(0, 7, 1, 100.0), (1, 8, 0, 100.0)]
    assert spark.read.parquet(f"{tmp_path}/t/tracklet_vectors").first().embedding == [0.6, 0.8]
    assert spark.read.option("header", True).csv(f"{tmp_path}/t/tracklet_bev").count() == 2
    chunks = spark.createDataFrame([(0, 5, 1, [1.0]), (0, 105, 1, [1.0])], "cam_id int, frame_no long, local_track_id long, embedding array<double>")
    sinks.write_vector_chunks(chunks, f"{tmp_path}/chunks", 100)
    back = spark.read.parquet(f"{tmp_path}/chunks")
    assert [(r.chunk, r.n, r.dim) for r in projections.chunk_summary(back).orderBy("chunk").collect()] == [(0, 1, 1), (1, 1, 1)]
    stream = spark.readStream.schema(back.schema).parquet(f"{tmp_path}/chunks")
    sinks.stream_vector_chunks(stream, f"{tmp_path}/streamed", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/streamed").count() == 2
    tracking.write_by_run(det.withColumn("run_id", F.lit("a")), f"{tmp_path}/runs")
    tracking.write_by_run(det.withColumn("run_id", F.lit("a")), f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2


def one(spark, schema, *rows):
    return spark.createDataFrame(rows, schema)


BOXES = "det_id long, cam_id int, frame_no long, global_id long, left double, top double, width double, height double"


def test_projections(spark):
    d = one(spark, BOXES, (1, 0, 50, 3, 100.0, 50.0, 20.0, 40.0), (2, 0, 50, -1, 600.0, 10.0, 20.0, 40.0))
    r = projections.stamped(d, 1000.0, 25.0).select("ts", projections.clock(F.col("ts") + 2661).alias("c"), projections.epoch_of(F.lit("1970-01-01T00:00:10Z")).alias("e"), projections.epoch_of(F.lit("no time")).alias("n")).first()
    assert (r.ts, r.c, r.e, r.n) == (1002.0, "01:01:03", 10.0, None)
    kp = [[float(k), float(k), 0.9 if k == 15 else 0.1] for k in range(17)]
    p = d.withColumn("keypoints", F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("x", "y", "conf"), k)]) for k in kp])).select(*[c.alias(n) for c, n in zip(projections.pose_foot(), "uv")]).first()
    assert (p.u, p.v) == (15.0, 15.0)
    p = d.withColumn("keypoints", F.array(F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("conf")))).select(*[c.alias(n) for c, n in zip(projections.pose_foot(), "uv")]).first()
    assert (p.u, p.v) == (110.0, 90.0)
    for truth, want in (((320.0, 180.0), 100.0), ((90.0, 80.0), 100.0 * 90 / 640)):
        assert projections.to_truth_space(d, truth, (640.0, 360.0), (1920.0, 1080.0)).first().left == pytest.approx(want)
    g = one(spark, BOXES, (9, 0, 50, 3, 0.0, 0.0, 1240.0, 90.0))
    assert projections.rescaled(d, g).orderBy("det_id").first().asDict() == {"det_id": 1, "cam_id": 0, "frame_no": 50, "global_id": 3, "left": 200.0, "top": 50.0, "width": 40.0, "height": 40.0}
    assert [r.k for r in d.select(projections.box_kept(10, 10, (1.0, 1.9)).alias("k")).collect()] == [False, False]
    rules = {"default": {"width": 10.0, "edge": 30.0}, "cafe": {"area": 900.0}}
    assert [r.k for r in d.withColumn("env", F.lit("x")).select(projections.crop_kept(rules, (640.0, 360.0)).alias("k")).collect()] == [True, False]
    assert [r.k for r in d.withColumn("env", F.lit("cafe")).select(projections.crop_kept(rules, (640.0, 360.0)).alias("k")).collect()] == [False, False]
    t = projections.tile_boxes(one(spark, BOXES, (1, 0, 0, 0, 700.0, 400.0, 20.0, 40.0)), 2, (640.0, 360.0), (1280.0, 720.0)).first()
    assert (t.source_id, t.left, t.top, t.width, t.height) == (3, 120.0, 80.0, 40.0, 80.0)
    truth = one(spark, "cam_id int, frame_no long, person_id long, left double, top double, width double, height double", (0, 50, 1, -5.0, 0.0, 10.0, 10.0), (0, 50, 2, 0.0, 0.0, 0.2, 9.0), (0, 52, 3, 0.0, 0.0, 9.0, 9.0))
    got = projections.snapped_boxes(one(spark, "cam_id int, frame_no long", (0, 54)), truth, 5, (2.0, 2.0), (640.0, 360.0)).collect()
    assert [(r.person_id, r.left, r.width) for r in got] == [(1, 0.0, 10.0)]
    px = d.select(*[c.alias(n) for c, n in zip(projections.map_point(F.lit(1.0), F.lit(2.0), (3.0, 4.0), 10.0, 100.0), "xy")]).first()
    assert (px.x, px.y) == (40.0, 40.0)
    names = one(spark, "scene string", ("64am_lobby_0",), ("63pm_cafe_shop_1",), ("retail_12",), ("office",))
    assert [r.e for r in names.select(projections.environment(F.col("scene")).alias("e")).collect()] == ["lobby", "cafe_shop", "retail", "office"]
    groups = projections.camera_groups(spark, "lobby:0-2+7, office:4", {"office": 9}).collect()
    assert [(r.group, r.cam_id, r.k) for r in groups] == [("lobby", 0, None), ("lobby", 1, None), ("lobby", 2, None), ("lobby", 7, None), ("office", 4, 9)]
    for bad in ("lobby", "lobby:x"):
        with pytest.raises(ValueError):
            projections.camera_groups(spark, bad)
    assert projections.capped(d, 49).count() == 0 and projections.capped(d, cameras=[0]).count() == 2
    q = {r.det_id: (r.ok, r.reason) for r in projections.vector_quality(d.withColumn("v", F.when(F.col("det_id") == 1, F.array(F.lit(1.0)))), (640.0, 360.0), vector="v").collect()}
    assert q == {1: (True, "ok"), 2: (False, "no_embedding")}
    assert {r.reason for r in projections.vector_quality(d, (640.0, 360.0), enabled=False).collect()} == {"disabled"}


def test_joins_and_rollups(spark):
    det = one(spark, "det_id long, cam_id int, frame_no long, local_track_id long, global_id long", (1, 0, 1, 5, 90), (2, 0, 4, 5, 90), (3, 0, 9, 5, 90), (4, 1, 9, 5, 91))
    a = one(spark, "cam_id int, frame_no long, local_track_id long, global_id long", (0, 4, 5, 7), (0, 6, 5, 8))
    assert {(r.det_id, r.global_id) for r in projections.assigned(det, a).collect()} == {(2, 7)}
    assert {(r.det_id, r.global_id) for r in projections.assigned(det, a, True).collect()} == {(1, -1), (2, 7), (3, -1), (4, -1)}
    assert {(r.det_id, r.global_id) for r in projections.latest_assignment(det, a).collect()} == {(1, 90), (2, 7), (3, 8), (4, 91)}
    assert projections.without(det, a.withColumn("global_id", F.lit(91)), "global_id").count() == 3
    scores = one(spark, "scene string, f1 double", ("1_lobby", 0.8), ("2_lobby", 0.6), ("3_retail", 0.2))
    got = {r.env: round(r["mean"], 6) for r in projections.scene_means(scores, "f1").collect()}
    assert got == {"lobby": 0.7, "retail": 0.2, "all": round(1.6 / 3, 6), "all but retail": 0.7}
    lines = one(spark, "value string", ("ERROR x",), ("warning: deprecated",), ("Traceback",), ("Warn: hot",), ("fine",))
    assert tuple(projections.log_counts(lines).first()) == (2, 1, 1)
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    assert Counter(r.k for r in projections.balanced(rows, [(("k",), 7)], ["id"]).collect()) == {0: 7, 1: 7}
    assert projections.balanced(rows, [((), 9)], ["id"], seed=3).count() == 9
    assert projections.balanced(rows, [(("k",), 3)], ["id"], seed=3).exceptAll(projections.balanced(rows, [(("k",), 3)], ["id"], seed=3)).count() == 0


def test_numbers_without_one_task(spark):
    rng = np.random.default_rng(0)
    rows = [(int(c), int(t)) for c, t in {(int(a), int(b)) for a, b in rng.integers(0, 90, (300, 2))}]
    d = spark.createDataFrame(rows, "c int, t long").repartition(4)
    assert [(r.c, r.t) for r in store.numbered(d, "n", "c", "t", bins=7).orderBy("n").collect()] == sorted(rows)
    assert sorted(r.n for r in store.numbered(d, "n", "c", "t").collect()) == list(range(len(rows)))


def test_similar_and_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i % 3, i, r.tolist()) for i, r in enumerate(x)], "scene long, id long, v array<double>")
    want = {(i % 3, i, j) for i in range(90) for j in range(i + 1, 90) if i % 3 == j % 3 and x[i] @ x[j] >= 0.6}
    assert {(r.scene, r.a, r.b) for r in pairs.similar(v, 0.6).collect()} == want and want
    q = v.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = pairs.nearest(q, v.select(F.col("id").alias("vec_id"), "v"), 4).orderBy("query_id", "rank").collect()
    for k, i in enumerate(range(0, 90, 10)):
        s = np.round(x @ x[i], 4)
        s[i] = -9
        assert [r.vec_id for r in got[4 * k : 4 * k + 4]] == np.lexsort((np.arange(90), -s))[:4].tolist()
