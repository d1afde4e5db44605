"""The derived tables: visits, dwell, series, rollups, tracklets, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visits(det: DataFrame, gap_frames: int, fps: float, *keys: str) -> DataFrame:
    """Visits per key: a gap of more than ``gap_frames`` starts a new one.

    seconds is (last - first) / fps, unrounded; n_frames counts the span.
    """
    keys = keys or ("global_id", "cam_id", "zone")
    w = Window.partitionBy(*keys).orderBy("frame_no")
    d = det.where("global_id >= 0").withColumn("new", F.coalesce((F.col("frame_no") - F.lag("frame_no").over(w) > gap_frames).cast("int"), F.lit(0)))
    d = d.withColumn("visit", F.sum("new").over(w))
    out = d.groupBy(*keys, "visit").agg(F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"))
    span = F.col("last_frame") - F.col("first_frame")
    return out.select(*keys, "first_frame", "last_frame", (span + 1).alias("n_frames"), (span / fps).alias("seconds"))


def dwell(visit: DataFrame) -> DataFrame:
    """Sum of the unrounded visits of each person and zone."""
    return visit.groupBy("global_id", "zone").agg(F.round(F.sum("seconds"), 3).alias("seconds"), F.count("*").alias("n_visits"))


def zone_series(det: DataFrame, fps: float, bucket_s: float) -> DataFrame:
    bucket = F.floor(F.col("frame_no") / fps / bucket_s)
    d = det.where("global_id >= 0").groupBy("zone", bucket.alias("bucket"))
    return d.agg(F.round(F.count("*") / fps, 3).alias("occupancy_s"), F.countDistinct("global_id").alias("footfall"))


def rollup(det: DataFrame) -> DataFrame:
    d = det.where("global_id >= 0")
    return d.agg(F.count("*").alias("n_dets"), F.countDistinct("global_id").alias("n_gids"), F.countDistinct("cam_id").alias("n_cams"))


def mode_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each key; of ties the smallest."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Unit vector of the mean of each key's vectors: sums per component, so skewed keys combine early.

    Vectors whose length isn't that of most are left out; a mean of length zero stays as it is.
    """
    most = df.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1)
    df = df.join(F.broadcast(most.select("dim")), F.size(vector) == F.col("dim"))
    parts = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("n", norm).select(key, F.transform("v", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(x)).alias("v"))


def tracklets(det: DataFrame) -> DataFrame:
    """Summary of each (camera, track, person), numbered in that order."""
    t = det.groupBy("cam_id", "local_track_id", "global_id").agg(
        F.min("frame_no").alias("start_frame"),
        F.max("frame_no").alias("end_frame"),
        F.count("*").alias("num_detections"),
        F.round(F.avg("width"), 3).alias("mean_width"),
        F.round(F.avg("height"), 3).alias("mean_height"),
        F.round(F.avg(F.col("width") * F.col("height")), 3).alias("mean_area"),
    )
    return numbered(t, "tracklet_id", "cam_id", "local_track_id", "global_id")


def numbered(df: DataFrame, name: str, bin_key: str, *order: str, bins: int = 4096) -> DataFrame:
    """``df`` with numbers from 0 in the order of (bin_key, *order), without one task for all rows.

    Rows are counted by (bin_key, a hash-free range of the first order column); the counts
    before each range are a small table, and rows are numbered inside their range.
    """
    span = df.agg(F.min(order[0]).alias("lo"), F.max(order[0]).alias("hi"))  # one row
    wide = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / bins))
    d = df.join(F.broadcast(span)).withColumn("_bin", F.floor((F.col(order[0]) - F.col("lo")) / wide)).drop("lo", "hi")
    counts = d.groupBy(bin_key, "_bin").agg(F.count("*").alias("_n"))
    ahead = lambda *by: F.coalesce(F.sum("_n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = counts.groupBy(bin_key).agg(F.sum("_n").alias("_n"))  # a row for each camera
    counts = counts.select(bin_key, "_bin", ahead(bin_key, "_bin").alias("_inner")).join(keys.select(bin_key, ahead(bin_key).alias("_outer")), bin_key)
    place = F.row_number().over(Window.partitionBy(bin_key, "_bin").orderBy(*order)) - 1
    return d.withColumn("_place", place).join(counts, [bin_key, "_bin"]).withColumn(name, F.col("_place") + F.col("_inner") + F.col("_outer")).drop("_place", "_inner", "_outer", "_bin")


def static_tracks(det: DataFrame, pixels: float, least: int) -> DataFrame:
    """Tracks whose centre hardly moves: hypot of the sample deviations under ``pixels``."""
    t = det.groupBy("cam_id", "local_track_id").agg(F.count("*").alias("n"), F.stddev_samp(F.col("left") + F.col("width") / 2).alias("sx"), F.stddev_samp(F.col("top") + F.col("height") / 2).alias("sy"))
    return t.withColumn("spread", F.hypot("sx", "sy")).where((F.col("n") >= least) & (F.col("spread") < pixels)).drop("sx", "sy")


def concurrency_floor(det: DataFrame) -> DataFrame:
    """Most tracks at once in one camera's frame, 1 at least."""
    n = det.groupBy("frame_no", "cam_id").agg(F.countDistinct("local_track_id").alias("n"))
    return n.agg(F.coalesce(F.max("n"), F.lit(1)).alias("k"))


def every_nth(df: DataFrame, n: int, order: Column | str, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") % n == 0).drop("_r")


def interpolate_boxes(det: DataFrame, step: int, offset: int = 0) -> DataFrame:
    """Boxes between detector frames (frame % step = offset), linear within first to last of a track."""
    cols = ("left", "top", "width", "height")
    keyed = det.where(F.col("frame_no") % step == offset)
    w = Window.partitionBy("cam_id", "local_track_id").orderBy("frame_no")
    nxt = keyed.withColumn("next_frame", F.lead("frame_no").over(w))
    for c in cols:
        nxt = nxt.withColumn(f"next_{c}", F.lead(c).over(w))
    rows = nxt.withColumn("f", F.explode(F.sequence("frame_no", F.coalesce(F.col("next_frame") - 1, F.col("frame_no")))))
    share = (F.col("f") - F.col("frame_no")) / (F.col("next_frame") - F.col("frame_no"))
    lerp = [F.when(F.col("f") == F.col("frame_no"), F.col(c)).otherwise(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * share).alias(c) for c in cols]
    return rows.select("cam_id", "local_track_id", F.col("f").alias("frame_no"), *lerp)


def path_segments(path: DataFrame, jump: float, gap: int, least: int, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Segments of each person's path: a jump or a gap starts a new one; short ones go.

    With ``bounds`` (x from and to, y from and to) a path also breaks before and after each point beyond them.
    """
    w = Window.partitionBy("global_id").orderBy("frame_no")
    far = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > jump
    cut = far | (F.col("frame_no") - F.lag("frame_no").over(w) > gap)
    if bounds is not None:
        path = path.withColumn("_in", F.col("x").between(*bounds[:2]) & F.col("y").between(*bounds[2:]))
        cut = cut | (F.lag("_in").over(w).isNotNull() & (~F.col("_in") | ~F.lag("_in").over(w)))
    d = path.withColumn("new", F.coalesce(cut.cast("int"), F.lit(0))).withColumn("segment", F.sum("new").over(w))
    return d.groupBy("global_id", "segment").agg(F.count("*").alias("n_points"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame")).where(F.col("n_points") >= least)


def person_means(tracklets: DataFrame, least_boxes: int = 6, least_vectors: int = 1) -> DataFrame:
    """Unit mean vector, vectors and spans of each person, from tracklets weighted by their vectors.

    Tracklets with fewer than ``least_boxes`` boxes stay out, then persons with fewer than
    ``least_vectors`` vectors or a mean of length zero.  A person's spans are a row for each
    tracklet.  tracklets: cam_id, global_id, start_frame, end_frame, num_detections, v, n.
    """
    t = tracklets.where((F.col("num_detections") >= least_boxes) & (F.size("v") > 0))
    p = t.select("global_id", "n", F.posexplode("v").alias("i", "x")).groupBy("global_id", "i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
    v = p.groupBy("global_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    v = v.withColumn("_norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("_norm > 0")
    spans = t.groupBy("global_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("cam_id", "start_frame", "end_frame"))).alias("spans"))
    return v.join(spans.where(F.col("n") >= least_vectors), "global_id").select("global_id", F.transform("v", lambda x: x / F.col("_norm")).alias("v"), "n", "spans")
