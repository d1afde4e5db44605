"""The registered queries over the tracking relations, and the store's query functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import closeness, foot, ground_point, pixel_of
from ..operators import identity, pairs, projections, regions, store
from ..sources import tracking

FPS, GAP, BUCKET = 1.0, 43_200, 86_400.0
#: Four cameras that look down on a floor (focal length, centre, rotation, translation).
CAMERAS = [(c, 500.0 + 10 * c, 505.0 + 10 * c, 320.0, 180.0, 1.0, 0.0, 0.0, 0.0, -0.6, -0.8, 0.0, 0.8, -0.6, 100.0 * c, 200.0, 3000.0 + 100 * c) for c in range(4)]
CAMERA = "cam_id int, fx double, fy double, cx double, cy double, r11 double, r12 double, r13 double, r21 double, r22 double, r23 double, r31 double, r32 double, r33 double, t1 double, t2 double, t3 double"
#: Zones of each camera in 0..1, in file order.
ZONES = [(c, 2 * c + k, f"{name}{c}", poly) for c in range(4) for k, (name, poly) in enumerate([("door", [(0.1, 0.2), (0.5, 0.1), (0.6, 0.7), (0.2, 0.8)]), ("desk", [(0.4, 0.3), (0.9, 0.4), (0.7, 0.9)])])]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _det(spark: SparkSession, d: str) -> DataFrame:
    return tracking.detections(_events(spark, d))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return tracking.dense_detections(_events(spark, d))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return tracking.ground_truth(_events(spark, d))


def _located(spark: SparkSession, det: DataFrame) -> DataFrame:
    """Detections with world points; four cameras are a table to broadcast."""
    u, v = foot()
    j = det.join(F.broadcast(spark.createDataFrame(CAMERAS, CAMERA)), "cam_id")
    x, y = ground_point(u, v)
    return j.select(*det.columns, x.alias("x"), y.alias("y"))


def _stays(spark: SparkSession, d: str) -> DataFrame:
    """Visits of tracks as tracklets, numbered by person and first frame."""
    v = store.visits(_det(spark, d), GAP, FPS, "cam_id", "local_track_id", "global_id")
    v = v.withColumnsRenamed({"first_frame": "start_frame", "last_frame": "end_frame"})
    return v.withColumn("tracklet_id", F.col("global_id") * 100_000_000 + F.col("start_frame") % 100_000_000)


def in_range(df: DataFrame, column: str, span: tuple[float, float] | None) -> DataFrame:
    """Inclusive at both ends; no range, no filter."""
    return df.where(F.col(column).between(*span)) if span else df


def top_zones(det: DataFrame, series: DataFrame, metric: str, k: int) -> DataFrame:
    if metric == "footfall":
        g = det.groupBy("zone").agg(F.countDistinct("global_id").alias("value"))
    else:
        g = series.groupBy("zone").agg(F.round(F.sum("occupancy_s"), 2).alias("value"))
    return g.orderBy(F.desc("value"), "zone").limit(k)


@query
def top_zones_footfall(s, d):
    return top_zones(_det(s, d), None, "footfall", 3)


@query
def top_zones_occupancy(s, d):
    return top_zones(None, store.zone_series(_det(s, d), FPS, BUCKET), "occupancy", 3)


@query
def zones_seen(s, d):
    return _det(s, d).select("zone").distinct()


@query
def persons_seen(s, d):
    return _det(s, d).where("global_id >= 0").select("global_id").distinct()


@query
def presence(s, d):
    v = store.visits(_det(s, d), GAP, FPS)
    return v.withColumn("seconds", F.round("seconds", 3))


@query
def dwell(s, d):
    return store.dwell(store.visits(_det(s, d), GAP, FPS))


@query
def person_timeline(s, d):
    """The visits of every person, numbered in the order of time."""
    w = Window.partitionBy("global_id").orderBy("first_frame", "cam_id", "zone")
    return presence(s, d).withColumn("nth", F.row_number().over(w))


@query
def person_dwell_range(s, d):
    first = _det(s, d).agg(F.min("frame_no").alias("f0"))
    v = presence(s, d).join(F.broadcast(first)).where("first_frame between f0 + 86400 and f0 + 1296000")
    return v.groupBy("global_id", "zone").agg(F.round(F.sum("seconds"), 2).alias("seconds"), F.count("*").alias("n_visits"))


@query
def zone_timeseries(s, d):
    return store.zone_series(_det(s, d), FPS, BUCKET)


@query
def run_rollup(s, d):
    return store.rollup(_det(s, d))


@query
def foot_world(s, d):
    return _located(s, _det(s, d)).select("det_id", "cam_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query
def world_to_pixel(s, d):
    j = _located(s, _det(s, d)).join(F.broadcast(s.createDataFrame(CAMERAS, CAMERA)), "cam_id")
    u, v = pixel_of(F.col("x"), F.col("y"), F.lit(1700.0))
    return j.select("det_id", F.round(u, 3).alias("u"), F.round(v, 3).alias("v"))


@query
def trajectory_step(s, d):
    p = _located(s, _det(s, d)).where("x is not null")
    p = store.every_nth(p.select("global_id", "frame_no", "det_id", "x", "y"), 5, F.struct("frame_no", "det_id"), "global_id")
    return p.select("global_id", "det_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query
def zone_resolve(s, d):
    z = regions.resolve_zones(_det(s, d), regions.zone_table(s, ZONES), 640.0, 360.0)
    return z.select("det_id", "cam_id", "zone_name")


@query
def zone_counts(s, d):
    z = regions.resolve_zones(_dense(s, d), regions.zone_table(s, ZONES), 640.0, 360.0)
    return regions.crowding(z, 2)


@query
def line_crossing_counts(s, d):
    return regions.line_crossings(_det(s, d), (0.0, 200.0), (640.0, 220.0), (0.0, 1.0))


@query
def density_grid(s, d):
    return regions.density(_det(s, d), 640.0, 360.0, 32, 18)


@query
def density_peaks(s, d):
    return regions.peak_cells(regions.density(_det(s, d), 640.0, 360.0, 16, 9), 0.06, 50).select("cam_id", "gx", "gy", "occupancy")


@query
def visit_grid(s, d):
    return regions.visit_cells(_det(s, d), 8)


@query
def box_area_grid(s, d):
    return regions.box_cells(_det(s, d), 20)


@query
def box_filter(s, d):
    """Difficulty filter: at least 8 by 20 pixels and 30 % of the area in the frame."""
    seen = projections.visible_share(10.0, 10.0, 600.0, 300.0)
    return _det(s, d).where((F.col("width") >= 8) & (F.col("height") >= 20) & (seen >= 0.3)).select("det_id", F.round(seen, 6).alias("visible"))


@query
def quality_gate(s, d):
    """First reason against using a box's vector, in fixed order."""
    return projections.vector_quality(_dense(s, d), (640, 360), 0.005, 0.18, 0.008, (0.3, 0.8)).select("det_id", "reason")


@query
def iou_pairs(s, d):
    return pairs.box_pairs(_truth(s, d), _dense(s, d), 0.3).select("gt_id", "det_id", F.round("iou", 6).alias("iou"))


@query
def geo_scores(s, d):
    p = _located(s, _dense(s, d)).select("det_id", "frame_no", "cam_id", "x", "y")
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, (F.col("a.frame_no") == F.col("b.frame_no")) & (F.col("a.cam_id") < F.col("b.cam_id")))
    far = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return j.select(F.col("a.det_id").alias("a"), F.col("b.det_id").alias("b"), F.round(closeness(far), 6).alias("score"))


@query
def gid_centroids(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    v = store.mean_vectors(e, "label", "embedding")
    return v.select("label", F.posexplode("v").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


@query
def gid_search_topk(s, d):
    """Nearest persons (mean vectors: one for each label) of every twentieth vector."""
    e = s.read.parquet(f"{d}/embeddings.parquet")
    g = store.mean_vectors(e, "label", "embedding").select(F.col("label").cast("long").alias("vec_id"), "v")
    q = e.where("vec_id % 20 = 0").select((-1 - F.col("vec_id")).alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("q"))
    # The gallery has a row for each person, ten here; it is not broadcast by hand.
    return pairs.top_matches(q, g, 3)


@query
def tracklet_summary(s, d):
    return store.tracklets(_det(s, d))


@query
def static_tracks(s, d):
    t = store.static_tracks(_det(s, d), 190.0, 20)
    return t.select("cam_id", "local_track_id", "n", F.round("spread", 6).alias("spread"))


@query
def concurrency_floor(s, d):
    return store.concurrency_floor(_dense(s, d))


@query
def track_majority(s, d):
    return store.mode_of(_det(s, d), ["cam_id", "local_track_id"], "global_id")


@query
def world_centroids(s, d):
    p = _located(s, _dense(s, d)).where("x is not null")
    return p.groupBy("global_id", "frame_no").agg(F.round(F.avg("x"), 3).alias("x"), F.round(F.avg("y"), 3).alias("y"), F.count("*").alias("n"))


@query
def stcra_pass(s, d):
    """Three passes with growing distances over the boxes of each frame."""
    p = _located(s, _dense(s, d)).where("x is not null").select("det_id", "frame_no", "global_id", "x", "y")
    return identity.reassign(p, (1500.0, 3000.0, 6000.0), 0.3)


@query
def interval_conflicts(s, d):
    return pairs.interval_conflicts(_stays(s, d), 60)


@query
def handoff_edges(s, d):
    return pairs.handoffs(_stays(s, d), 900)


@query
def colocated_pairs(s, d):
    p = _located(s, _dense(s, d)).where("x is not null")
    return pairs.colocated(p, 2500.0, 2, 0.5)


@query
def remap_components(s, d):
    """Persons linked by co-location, with the smallest id of each group."""
    nodes = _det(s, d).select(F.col("global_id").alias("node")).distinct()
    return identity.components(colocated_pairs(s, d).select("a", "b"), nodes)


@query
def remap_components_all(s, d):
    """The same; kept under its former name."""
    return remap_components(s, d)


@query
def box_interp(s, d):
    """Boxes between the frames of detection, of all tracks; ties go up by decimal digits."""
    t = _dense(s, d).groupBy("cam_id", "local_track_id", "frame_no").agg(*[F.max(c).alias(c) for c in ("left", "top", "width", "height")])
    b = store.interpolate_boxes(t, 5)
    return b.select("cam_id", "local_track_id", "frame_no", *[F.round(F.col(c).cast("decimal(20,10)"), 4).cast("double").alias(c) for c in ("left", "top", "width", "height")])


@query
def box_interp_all(s, d):
    """The same; kept under its former name."""
    return box_interp(s, d)


def _paths(s: SparkSession, d: str) -> DataFrame:
    return _located(s, _det(s, d)).where("x is not null").groupBy("global_id", "frame_no").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query
def path_segments(s, d):
    return store.path_segments(_paths(s, d), 4000.0, 200_000, 3)


@query
def bounded_segments(s, d):
    """Segments that also break where a path leaves a part of the floor."""
    return store.path_segments(_paths(s, d), 4000.0, 200_000, 1, (-3000.0, 3000.0, -3000.0, 3000.0))


@query
def occlusion_gaps(s, d):
    """Frames that a person's track misses between two detections, 200 at most."""
    w = Window.partitionBy("global_id").orderBy("frame_no")
    p = _dense(s, d).select("global_id", "frame_no").distinct().withColumn("next", F.lead("frame_no").over(w))
    p = p.where((F.col("next") - F.col("frame_no") > 1) & (F.col("next") - F.col("frame_no") <= 200))
    return p.select("global_id", F.explode(F.sequence(F.col("frame_no") + 1, F.col("next") - 1)).alias("frame_no")).groupBy("global_id").agg(F.count("*").alias("missing"))


@query
def gt_union_frames(s, d):
    g, p = _truth(s, d).select("cam_id", "frame_no"), _dense(s, d).select("cam_id", "frame_no")
    return g.union(p).distinct().groupBy("cam_id").agg(F.count("*").alias("n_frames"))


@query
def global_idf1(s, d):
    return identity.global_idf1(_truth(s, d), _dense(s, d))


@query
def clear_metrics(s, d):
    return identity.clear_metrics(_truth(s, d), _dense(s, d))


@query
def hota_metrics(s, d):
    return identity.hota(_truth(s, d), _dense(s, d))


@query
def balanced_sample(s, d):
    """At most three detections of each person and camera, in order: the cap is the feature."""
    w = Window.partitionBy("global_id", "cam_id").orderBy("frame_no", "det_id")
    return _det(s, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("det_id", "global_id", "cam_id")


@query
def env_means(s, d):
    """Means by environment (event type) and over all, as one rollup."""
    e = _events(s, d)
    r = e.rollup("event_type").agg(F.grouping("event_type").alias("whole"), F.round(F.avg("value"), 4).alias("mean"), F.count("*").alias("n"))
    return r.select(F.when(F.col("whole") == 1, "all").otherwise(F.coalesce("event_type", F.lit("unknown"))).alias("env"), "mean", "n")


@query
def ablation_pivot(s, d):
    t = _det(s, d).groupBy("zone").pivot("cam_id", [0, 1, 2, 3]).agg(F.count(F.lit(1)))
    return t.select("zone", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"cam{c}") for c in range(4)], F.greatest(*[F.coalesce(F.col(str(c)), F.lit(0)) for c in range(4)]).alias("best"))


@query
def health_creep(s, d):
    """Mean of the last quarter of a series less that of the first, of each priority's orders."""
    o = s.read.parquet(f"{d}/orders.parquet")
    w = Window.partitionBy("o_orderpriority")
    r = o.withColumn("r", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey"))).withColumn("n", F.count("*").over(w)).withColumn("q", F.greatest(F.lit(1), F.floor(F.col("n") / 4)))
    g = r.groupBy("o_orderpriority").agg(F.avg(F.when(F.col("r") > F.col("n") - F.col("q"), F.col("o_totalprice"))).alias("b"), F.avg(F.when(F.col("r") <= F.col("q"), F.col("o_totalprice"))).alias("a"), F.min("n").alias("n"))
    return g.select("o_orderpriority", F.when(F.col("n") >= 4, F.round(F.col("b") - F.col("a"), 2)).otherwise(0.0).alias("creep"))


@query
def log_scan(s, d):
    t = s.read.parquet(f"{d}/documents.parquet")
    return t.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit("(?i)password|token"))).alias("hits"), F.sum(F.regexp_count("text", F.lit("\n"))).alias("breaks"))
