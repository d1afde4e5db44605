"""Registered queries of the store of runs, of as-of and similarity joins, and of trackers and merges."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import foot
from ..operators import fusion, identity, linking, pairs, projections, sweeps
from ..sources import sinks
from ..streaming import gallery
from .linking_queries import _placed_vectors, _points, _tracklet_points, _vectors, _with_vector, track_stats
from .queries import BUCKET, FPS, GAP, _dense, _det, _located, _truth, query
from .store_api import TABLES, Store

RUNS = 3


def _store(s, d) -> Store:
    """The detections as three recordings (by event id), with the vectors of labels as those of persons."""
    det = _located(s, _det(s, d))
    u, v = foot()
    det = det.select("det_id", "cam_id", "frame_no", "local_track_id", "global_id", "zone", u.alias("foot_x"), v.alias("foot_y"), F.col("x").alias("world_x"), F.col("y").alias("world_y"))
    vectors = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("global_id"), "embedding")
    parts = []
    for k in range(RUNS):
        t = sinks.store_tables(det.where(F.col("det_id") % RUNS == k).drop("det_id"), vectors.where(F.col("vec_id") % RUNS == k), 0.0, FPS, GAP, BUCKET)
        parts.append({n: x.withColumn("run_id", F.lit(f"run{k}")) for n, x in t.items()})
    return Store({n: reduce(DataFrame.unionByName, [p[n] for p in parts]) for n in TABLES})


@query
def store_runs(s, d):
    return _store(s, d).list_runs()


@query
def store_zones(s, d):
    return _store(s, d).zones()


@query
def store_persons(s, d):
    return _store(s, d).list_persons()


@query
def store_timeline(s, d):
    return _store(s, d).person_timeline()


@query
def store_trajectory(s, d):
    t = _store(s, d).person_trajectory(step=3)
    return t.select("run_id", "global_id", "ts", "cam_id", F.round("world_x", 3).alias("world_x"), F.round("world_y", 3).alias("world_y"), "zone")


@query
def store_dwell(s, d):
    return _store(s, d).person_dwell()


@query
def store_top_zones(s, d):
    return _store(s, d).top_zones(k=3)


@query
def store_zone_occupancy(s, d):
    return _store(s, d).zone_occupancy()


@query
def store_search(s, d):
    """Vectors with an id divisible by 50 against the persons of each run."""
    q = s.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0").select((-1 - F.col("vec_id")).alias("query_id"), "embedding")
    return _store(s, d).search(q, 3).select("run_id", "query_id", "rank", "global_id", F.round("score", 3).alias("score"))


@query
def latest_ids(s, d):
    """Boxes under the last id that their track was given up to their frame."""
    t = _dense(s, d)
    a = t.where("det_id % 5 = 0").groupBy("cam_id", "local_track_id", "frame_no").agg(F.max("global_id").alias("global_id"))
    return projections.latest_assignment(t, a).select("det_id", "global_id")


@query
def similar_vectors(s, d):
    """Pairs of vectors of one scene with a cosine of 0.4 or more."""
    v = _placed_vectors(s, d).select("scene", F.col("vec_id").alias("id"), "v")
    return pairs.similar(v, 0.4).select("scene", "a", "b", F.round("score", 5).alias("score"))


@query
def vector_chunks(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null")
    return projections.chunk_summary(e.select(F.floor(F.col("vec_id") / 100).cast("int").alias("chunk"), F.col("vec_id").alias("frame_no"), "embedding"))


@query
def track_filter_yield(s, d):
    return projections.filter_yield(track_stats(s, d), [500, 5000], [100.0, 150.0])


@query
def track_class_medians(s, d):
    t = projections.class_medians(track_stats(s, d), "motion", "span", "height")
    return t.select("class", "n", *[F.round(c, 4).alias(c) for c in ("motion", "span", "height")])


@query
def dashboard(s, d):
    limits = s.createDataFrame([("click", 0), ("view", 100)], "zone string, most int")
    return projections.dashboard(_det(s, d), s.createDataFrame([(0,), (2,), (9,)], "cam_id int"), limits)


@query
def balanced_caps(s, d):
    """At most 200 detections of each zone, and of those 60 of each zone and camera: the caps are the feature."""
    return projections.balanced(_det(s, d), [(("zone",), 200), (("zone", "cam_id"), 60)], ["frame_no", "det_id"]).select("det_id", "zone", "cam_id")


@query
def truth_space(s, d):
    """Boxes brought from the space of a tile to that of the truth."""
    t = projections.to_truth_space(_dense(s, d), (320.0, 180.0), (640.0, 360.0), (1280.0, 720.0))
    return t.select("det_id", *[F.round(c, 4).alias(c) for c in projections.BOX])


@query
def clock_times(s, d):
    """Detections with their time of day in words, from the epoch."""
    t = projections.stamped(_det(s, d), 0.0, FPS)
    return t.select("det_id", projections.clock(F.col("ts") % 86_400).alias("time"))


@query
def camera_idf1(s, d):
    t = identity.clear_metrics(_truth(s, d), _dense(s, d))
    return t.select("cam_id", "fragmentations", "idf1")


@query
def stage_diagnosis(s, d):
    gt, pred = _truth(s, d), _dense(s, d)
    return identity.stage_diagnosis(identity.clear_metrics(gt, pred), identity.global_idf1(gt, pred))


@query
def oracle_ids(s, d):
    return identity.oracle_ids(_truth(s, d), _dense(s, d))


@query
def blended_pairs(s, d):
    """Persons by the cosine of vectors blended with how near their paths are."""
    p = _points(s, d).withColumn("scene", F.lit(0).cast("long"))
    ids = p.select("scene", F.col("global_id").alias("id")).distinct()
    v = _with_vector(ids, "id", _vectors(s, d)).select("scene", "id", "v")
    g = linking.pair_scores(linking.pair_distances(p, "global_id", 2, ("scene",)), 300.0, 2000.0)
    apart = p.alias("a").join(p.alias("b"), (F.col("a.cam_id") == F.col("b.cam_id")) & (F.col("a.frame_no") == F.col("b.frame_no")) & (F.col("a.global_id") < F.col("b.global_id")))
    apart = apart.select("a.scene", F.col("a.global_id").alias("a"), F.col("b.global_id").alias("b")).distinct()
    return linking.blended_pairs(v, g, apart, 0.25, 0.45, 0.005, 5)


@query
def trajectory_scores(s, d):
    """Tracklets of other cameras that meet within 100 frames, by their paths."""
    t = _tracklet_points(s, d)
    return linking.meeting_trajectories(t.withColumnRenamed("tracklet_id", "id"), 2, 10)


@query
def cosine_merged_ids(s, d):
    """Persons of each scene (by id) merged by average linkage of their mean vectors."""
    t = _dense(s, d).groupBy("global_id").agg(F.count("*").alias("n"))
    v = _with_vector(t, "global_id", _vectors(s, d)).select(F.pmod(F.xxhash64("global_id"), F.lit(8)).alias("scene"), "global_id", "v", "n")
    return linking.cosine_merge(v, 0.8, 5)


@query
def velocity_tracks(s, d):
    """Frame clusters followed over time, by site of two cameras."""
    p = _points(s, d).withColumn("scene", (F.col("cam_id") % 2).cast("long"))
    c = linking.cluster_frames(p, 1500.0, ("scene",))
    i = p.join(c, "det_id").groupBy("scene", "frame_no", "instance").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    v = _vectors(s, d)
    i = i.join(F.broadcast(v.agg(F.count("*").alias("n_vectors")))).withColumn("vec", F.col("instance") % F.col("n_vectors")).join(v.select(F.col("vec_id").alias("vec")), "vec", "left_semi")
    return linking.velocity_tracks(i, 2500.0, 2500.0, 5, 50, 0.1, vectors=v.select(F.col("vec_id").alias("vec"), "v"))


def _ended(s, d):
    """Tracklets of 100 frames with vectors, as merges take them."""
    t = _dense(s, d).withColumn("part", F.floor(F.col("frame_no") / 100))
    t = t.groupBy("cam_id", "local_track_id", "global_id", "part").agg(F.min("frame_no").alias("start_frame"), F.max("frame_no").alias("end_frame"), F.count("*").alias("num_detections"))
    t = _with_vector(t.withColumn("key", F.col("global_id") * 7 + F.col("part")), "key", _vectors(s, d))
    return t.select(F.pmod(F.xxhash64("global_id"), F.lit(8)).alias("scene"), "cam_id", "global_id", "start_frame", "end_frame", "num_detections", "v", F.lit(1).alias("n"))


@query
def windowed_merges(s, d):
    return linking.windowed_merges(_ended(s, d), 125, 25, 0.25, 0.005, 5, least_dets=1)


@query
def threshold_sweep(s, d):
    """Links of tracklets up to five distances, each scored by IDF1, from one merge tree."""
    truth, key = _truth(s, d), (F.col("global_id") * 4 + F.col("cam_id")) * 1_000_000 + F.floor(F.col("frame_no") / 100)
    boxes = _dense(s, d).withColumn("global_id", key)
    hits = identity.frame_matches(truth, boxes).groupBy("person_id", F.col("global_id").alias("node")).agg(F.count("*").alias("n"))
    n = lambda t: t.agg(F.count("*").alias("n"))
    far = linking.pair_distances(_tracklet_points(s, d), "tracklet_id", 2)
    return sweeps.threshold_scores(far, hits, boxes.select(F.col("global_id").alias("node")), n(truth), n(boxes), [100.0, 300.0, 1000.0, 3000.0, 9000.0])


@query
def fused_with_places(s, d):
    """Windowed merges that blend in how near persons are in common frames."""
    p = _points(s, d).groupBy("cam_id", "global_id", F.floor(F.col("frame_no") / 100).alias("part"), "frame_no").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    p = p.groupBy("cam_id", "global_id", "part").agg(F.sort_array(F.collect_list(F.struct("frame_no", "x", "y"))).alias("places"))
    t = _ended(s, d).withColumn("part", F.floor(F.col("start_frame") / 100)).join(p, ["cam_id", "global_id", "part"])
    return fusion.windowed(t, fusion.FusionRules(125, 25, 0.25, 0.005, 5, least_dets=1, geo_weight=0.35, geo_least=1, near=300.0, far=2000.0))


@query
def gallery_ids(s, d):
    """The live gallery's rules over all boxes, by site of two cameras."""
    p = _located(s, _dense(s, d)).select("det_id", "cam_id", "frame_no", "local_track_id", "global_id", "x", "y").withColumn("site", (F.col("cam_id") % 2).cast("long"))
    v = _with_vector(p, "global_id", _vectors(s, d)).withColumnRenamed("v", "embedding").withColumn("good", F.lit(True))
    return gallery.gallery_ids(v, 64)


@query
def replayed_ids(s, d):
    det = _dense(s, d).select(F.pmod(F.xxhash64("global_id"), F.lit(8)).alias("scene"), "det_id", "frame_no", "global_id")
    return linking.replayed(det, windowed_merges(s, d))


@query
def linker_sweep(s, d):
    """Three radii of frame clustering on every site, by how many boxes a cluster holds on average."""
    p = _points(s, d).select((F.col("frame_no") % 16).alias("scene"), "frame_no", "x", "y")
    grid = s.createDataFrame([(0, 500.0), (1, 1500.0), (2, 4000.0)], "setting long, cell double")

    def score(params: dict, pdf: pd.DataFrame) -> dict:
        cells = pdf.assign(i=pdf.x // params["cell"], j=pdf.y // params["cell"])
        return {"boxes": float(len(pdf) / len(cells.drop_duplicates(["frame_no", "i", "j"])))}

    return linking.sweep(grid, p, score, "boxes double", "boxes").withColumn("mean", F.round("mean", 6))

