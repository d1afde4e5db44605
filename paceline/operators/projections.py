"""Row-wise and per-camera projections: times, scales, tiles, filters, groups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, foot, iou
from .grids import percentiles
from .pairs import box_pairs

BOX = ("left", "top", "width", "height")


def stamped(det: DataFrame, epoch: float, fps: float) -> DataFrame:
    """``det`` with ``ts``: seconds since the epoch of its frame."""
    return det.withColumn("ts", F.lit(epoch) + F.col("frame_no") / fps)


def clock(seconds: Column) -> Column:
    """hh:mm:ss of a number of seconds."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def epoch_of(text: Column) -> Column:
    """Seconds since the epoch of an ISO 8601 text; null if it is none."""
    return F.unix_micros(F.try_to_timestamp(text)) / 1e6


def pose_foot(points: str = "keypoints", least: float = 0.3, ankles: tuple[int, int] = (15, 16)) -> tuple[Column, Column]:
    """Mean of the ankles that are sure enough, else the bottom centre of the box.

    ``points``: array of (x, y, conf) by key point.
    """
    found = F.filter(F.array(*[F.try_element_at(points, F.lit(k + 1)) for k in ankles]), lambda p: p.isNotNull() & (p["conf"] >= least))
    mean = lambda c: F.aggregate(found, F.lit(0.0), lambda s, p: s + p[c]) / F.size(found)
    u, v = foot()
    return F.when(F.size(found) > 0, mean("x")).otherwise(u), F.when(F.size(found) > 0, mean("y")).otherwise(v)


def _scaled(df: DataFrame, x: Column, y: Column) -> DataFrame:
    factor = {"left": x, "width": x, "top": y, "height": y}
    return df.select(*[(F.col(c) * factor[c]).alias(c) if c in factor else F.col(c) for c in df.columns if c not in ("_fx", "_fy")])


def to_truth_space(pred: DataFrame, truth: tuple[float, float], tile: tuple[float, float], mux: tuple[float, float], slack: float = 1.25) -> DataFrame:
    """Assigned boxes in the truth's pixels; the space they are in is told by how far they reach.

    Boxes within ``slack`` times the truth's frame are in its space already, else those
    within that of a tile in the tile's, else in the whole picture's.
    """
    p = pred.where("global_id >= 0")
    reach = p.agg(F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b"))  # one row
    within = lambda s: (F.col("r") <= s[0] * slack) & (F.col("b") <= s[1] * slack)
    space = lambda k: F.when(within(truth), truth[k]).when(within(tile), tile[k]).otherwise(mux[k])
    j = p.join(F.broadcast(reach.select((truth[0] / space(0)).alias("_fx"), (truth[1] / space(1)).alias("_fy"))))
    return _scaled(j, F.col("_fx"), F.col("_fy"))


def rescaled(pred: DataFrame, truth: DataFrame, off: float = 0.05) -> DataFrame:
    """Boxes scaled to the reach of the truth's in their camera, on each axis where they are off by more than ``off``."""
    reach = lambda t, n: t.groupBy("cam_id").agg(F.max(F.col("left") + F.col("width")).alias(f"_{n}x"), F.max(F.col("top") + F.col("height")).alias(f"_{n}y"))
    ratio = lambda a: F.when(F.abs(F.col(f"_g{a}") / F.col(f"_p{a}") - 1) > off, F.col(f"_g{a}") / F.col(f"_p{a}")).otherwise(1.0).alias(f"_f{a}")
    j = reach(truth, "g").join(reach(pred, "p"), "cam_id").select("cam_id", ratio("x"), ratio("y"))
    return _scaled(pred.join(F.broadcast(j), "cam_id"), F.col("_fx"), F.col("_fy"))


def box_kept(least_width: float, least_height: float, aspect: tuple[float, float]) -> Column:
    """Whether a box is large enough and its height / width lies in ``aspect``."""
    ratio = F.col("height") / F.nullif(F.col("width"), F.lit(0.0))
    return F.coalesce((F.col("width") >= least_width) & (F.col("height") >= least_height) & ratio.between(*aspect), F.lit(False))


def crop_kept(rules: dict[str, dict[str, float]], frame: tuple[float, float], env: str = "env") -> Column:
    """Whether a crop passes its environment's rule (or that named ``default``): width, height, area, edge.

    ``edge``: crops that come within so many pixels of the frame's border go.
    """

    def rule(r: dict[str, float]) -> Column:
        w, h, e = F.col("width"), F.col("height"), r.get("edge", 0.0)
        inner = (F.col("left") >= e) & (F.col("top") >= e) & (F.col("left") + w <= frame[0] - e) & (F.col("top") + h <= frame[1] - e)
        return (w >= r.get("width", 0.0)) & (h >= r.get("height", 0.0)) & (w * h >= r.get("area", 0.0)) & (inner if e > 0 else F.lit(True))

    out = rule(rules.get("default", {}))
    for name, r in rules.items():
        if name != "default":
            out = F.when(F.col(env) == name, rule(r)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def tile_boxes(det: DataFrame, columns: int, tile: tuple[float, float], source: tuple[float, float]) -> DataFrame:
    """Boxes of a tiled picture in their source's pixels, with ``source_id`` from the tile that holds the centre."""
    tx = F.floor((F.col("left") + F.col("width") / 2) / tile[0])
    ty = F.floor((F.col("top") + F.col("height") / 2) / tile[1])
    d = det.withColumn("_tx", tx).withColumn("_ty", ty).withColumn("source_id", (F.col("_ty") * columns + F.col("_tx")).cast("int"))
    d = d.withColumn("left", F.col("left") - F.col("_tx") * tile[0]).withColumn("top", F.col("top") - F.col("_ty") * tile[1]).drop("_tx", "_ty")
    return _scaled(d, F.lit(source[0] / tile[0]), F.lit(source[1] / tile[1]))


def snapped_boxes(frames: DataFrame, truth: DataFrame, step: int, scale: tuple[float, float], frame: tuple[float, float]) -> DataFrame:
    """The truth of the last annotated frame for each (cam_id, frame_no): scaled, clipped, boxes under a pixel gone."""
    t = truth.where(F.col("frame_no") % step == 0).select("cam_id", F.col("frame_no").alias("at"), "person_id", *BOX)
    j = frames.select("cam_id", "frame_no", (F.floor(F.col("frame_no") / step) * step).alias("at")).join(t, ["cam_id", "at"])
    side = lambda c, k: F.least(F.greatest(c * scale[k], F.lit(0.0)), F.lit(frame[k]))
    x0, y0 = side(F.col("left"), 0), side(F.col("top"), 1)
    x1, y1 = side(F.col("left") + F.col("width"), 0), side(F.col("top") + F.col("height"), 1)
    return j.select("cam_id", "frame_no", "at", "person_id", x0.alias("left"), y0.alias("top"), (x1 - x0).alias("width"), (y1 - y0).alias("height")).where("width >= 1 and height >= 1")


def map_point(x: Column, y: Column, shift: tuple[float, float], scale: float, flip: float | None = None) -> tuple[Column, Column]:
    """A floor point in a map's pixels; ``flip`` is the map's height where y goes up."""
    px, py = (x + shift[0]) * scale, (y + shift[1]) * scale
    return px, py if flip is None else flip - py


def environment(scene: Column) -> Column:
    """The environment in a scene's name: what is left without digits, am_/pm_ marks and separators at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(scene), r"(^|_)[0-9]+(am|pm)?(?=_|$)|(^|_)(am|pm)(?=_)", "$1"), r"^[_\-]+|[_\-]+$", "")


def camera_groups(spark: SparkSession, spec: str, overrides: dict[str, int] | None = None) -> DataFrame:
    """(group, cam_id, k) of a text like ``lobby:0-3+7,office:4``; k is the group's override, or null."""
    rows = []
    for part in filter(None, (x.strip() for x in spec.split(","))):
        name, _, cams = part.partition(":")
        if not name or not cams:
            raise ValueError(f"{part!r} is not name:cameras")
        for span in cams.split("+"):
            m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", span)
            if not m:
                raise ValueError(f"{span!r} is neither a camera nor a range of them")
            rows += [(name.strip(), c, (overrides or {}).get(name.strip())) for c in range(int(m[1]), int(m[2] or m[1]) + 1)]
    return spark.createDataFrame(rows, "group string, cam_id int, k int")


def capped(det: DataFrame, last_frame: int | None = None, cameras: list[int] | None = None) -> DataFrame:
    """Frames up to ``last_frame`` of these cameras, as the caller asks."""
    d = det if last_frame is None else det.where(F.col("frame_no") <= last_frame)
    return d if cameras is None else d.where(F.col("cam_id").isin(cameras))


def vector_quality(det: DataFrame, frame: tuple[float, float], edge: float = 0.005, height: float = 0.04, area: float = 0.0008, aspect: tuple[float, float] = (0.12, 0.95), overlap: float = 0.25, enabled: bool = True, vector: str | None = None) -> DataFrame:
    """(det_id, ok, reason): the first reason against using a box's vector, in fixed order.

    ``vector`` names the column that has to be there.  Overlap is the largest IoU with
    another box of the camera and frame.
    """
    a, b = det.alias("a"), det.alias("b")
    near = (F.col("a.cam_id") == F.col("b.cam_id")) & (F.col("a.frame_no") == F.col("b.frame_no")) & (F.col("a.det_id") != F.col("b.det_id"))
    most = a.join(b, near).groupBy(F.col("a.det_id").alias("det_id")).agg(F.max(iou(box("a"), box("b"))).alias("_overlap"))
    x, y, w, h = (F.col(c) for c in BOX)
    at_edge = (x < frame[0] * edge) | (y < frame[1] * edge) | (x + w > frame[0] * (1 - edge)) | (y + h > frame[1] * (1 - edge))
    none = F.lit(False) if vector is None else F.col(vector).isNull() | (F.size(vector) < 1)
    reason = (
        F.when(none, "no_embedding").when(F.lit(not enabled), "disabled").when(at_edge, "edge_crop").when(h < frame[1] * height, "small_height").when(w * h < frame[0] * frame[1] * area, "small_area")
        .when(w / h < aspect[0], "thin_crop").when(w / h > aspect[1], "wide_or_merged_crop").when(F.coalesce("_overlap", F.lit(0.0)) > overlap, "overlap_iou").otherwise("ok")
    )
    out = det.join(most, "det_id", "left").select("det_id", reason.alias("reason"))
    return out.select("det_id", F.col("reason").isin("ok", "disabled").alias("ok"), "reason")


def assigned(det: DataFrame, assignments: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Boxes under the id that their (camera, frame, track) was given; those without are dropped, or get -1."""
    keys = ["cam_id", "frame_no", "local_track_id"]
    a = assignments.select(*keys, F.col("global_id").alias("_given"))
    j = det.drop("global_id").join(a, keys, "left" if keep_missing else "inner").withColumn("global_id", F.coalesce("_given", F.lit(-1))).drop("_given")
    return j if keep_missing else j.where("global_id >= 0")


def latest_assignment(det: DataFrame, assignments: DataFrame) -> DataFrame:
    """Boxes under the last id that their track was given up to their frame, else under their own (as-of join).

    One window over both sides' rows by track, so no join of all pairs of frames.
    """
    keys = ["cam_id", "local_track_id"]
    none = F.lit(None)
    b = det.select(*keys, "frame_no", "det_id", F.col("global_id").alias("own"), none.cast("long").alias("given"), F.lit(1).alias("side"))
    a = assignments.select(*keys, "frame_no", none.cast("long").alias("det_id"), none.cast("long").alias("own"), F.col("global_id").alias("given"), F.lit(0).alias("side"))
    w = Window.partitionBy(*keys).orderBy("frame_no", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = b.unionByName(a).withColumn("last", F.last("given", ignorenulls=True).over(w))
    return both.where("side = 1").select("det_id", *keys, "frame_no", F.coalesce("last", "own").alias("global_id"))


def without(det: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """``det`` without the persons or tracks of ``gone``."""
    return det.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def chunk_summary(vectors: DataFrame) -> DataFrame:
    """Per chunk: vectors, first and last frame, their length. vectors: chunk, frame_no, embedding."""
    return vectors.groupBy("chunk").agg(F.count("*").alias("n"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.max(F.size("embedding")).alias("dim"))


def dashboard(det: DataFrame, cameras: DataFrame, limits: DataFrame) -> DataFrame:
    """One row for each zone at the last frame of each camera: persons there, whether that is an alarm; and cameras online.

    cameras: cam_id; limits: zone, most.
    """
    last = det.groupBy("cam_id").agg(F.max("frame_no").alias("frame_no"))
    online = last.join(cameras, "cam_id", "left_semi").agg(F.count("*").alias("online"))
    n = det.join(last, ["cam_id", "frame_no"]).groupBy("zone").agg(F.countDistinct("global_id").alias("people"))
    return n.join(F.broadcast(limits), "zone", "left").select("zone", "people", F.coalesce(F.col("people") > F.col("most"), F.lit(False)).alias("alarm")).join(F.broadcast(online))


def balanced(df: DataFrame, caps: list[tuple[tuple[str, ...], int]], order: list[str], seed: int | None = None) -> DataFrame:
    """At most so many rows of each key, one cap after the other: in ``order``, or in a seeded random one. Caps are the feature.

    A cap without a key is on all rows: the first so many of each partition meet, not all rows.
    """
    for keys, most in caps:
        place = [F.xxhash64(F.lit(seed), *order)] if seed is not None else order
        if keys:
            df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*place))).where(F.col("_r") <= most).drop("_r")
        else:
            df = df.orderBy(*place).limit(most)
    return df


def class_medians(tracks: DataFrame, *values: str, by: str = "class") -> DataFrame:
    """Exact medians of each class of tracks; null where a class has no value."""
    out = tracks.groupBy(by).agg(F.count("*").alias("n"))
    for v in values:
        out = out.join(percentiles(tracks, v, [0.5], by).select(by, F.col(v)[0].alias(v)), by, "left")
    return out.select(by, "n", *values)


def filter_yield(tracks: DataFrame, spans: list[int], motions: list[float], by: str = "class") -> DataFrame:
    """How many tracks of each class a filter on span and motion would drop, for each pair of thresholds."""
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("span_below"), F.lit(float(m)).alias("motion_below")) for s in spans for m in motions])).alias("g")
    t = tracks.select(by, "span", "motion", grid).select(by, "g.*", ((F.col("span") < F.col("g.span_below")) | (F.col("motion") < F.col("g.motion_below"))).cast("long").alias("dropped"))
    return t.groupBy("span_below", "motion_below", by).agg(F.sum("dropped").alias("dropped"), F.count("*").alias("n"))


def scene_means(scores: DataFrame, value: str, apart: str = "retail") -> DataFrame:
    """Means of scene scores by environment, over all, and over all but the environment ``apart``."""
    s = scores.withColumn("env", environment(F.col("scene")))
    r = s.rollup("env").agg(F.grouping("env").alias("whole"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    named = r.select(F.when(F.col("whole") == 1, "all").otherwise(F.coalesce("env", F.lit("unknown"))).alias("env"), "mean", "n")
    return named.unionByName(s.where(~F.col("env").eqNullSafe(F.lit(apart))).agg(F.lit(f"all but {apart}").alias("env"), F.avg(value).alias("mean"), F.count("*").alias("n")))


def log_counts(lines: DataFrame, benign: str = r"deprecat|retry|reconnect") -> DataFrame:
    """Lines of a log by kind: errors, warnings, and those of them that are benign. lines: value."""
    v = F.lower("value")
    bad, warn, fine = v.rlike("error|fatal|traceback"), v.rlike("warn"), v.rlike(benign)
    return lines.agg(*[F.coalesce(F.sum(x.cast("long")), F.lit(0)).alias(n) for n, x in (("errors", bad & ~fine), ("warnings", warn & ~bad & ~fine), ("benign", (bad | warn) & fine))])


def visible_share(x0: float, y0: float, x1: float, y1: float) -> Column:
    """The part of a box's area (1 at least) that lies between two corners."""
    w = F.least(F.col("left") + F.col("width"), F.lit(x1)) - F.greatest(F.col("left"), F.lit(x0))
    h = F.least(F.col("top") + F.col("height"), F.lit(y1)) - F.greatest(F.col("top"), F.lit(y0))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))


def clamped_crops(det: DataFrame, frame: tuple[float, float], least: tuple[float, float], share: float, scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """Boxes as whole pixels (halves to even) within the frame: x1, y1, x2, y2; small or mostly hidden ones go."""
    at = {c: F.col(e) for c, e in (("x1", "left"), ("y1", "top"))} | {c: F.col(e) + F.col(n) for c, e, n in (("x2", "left", "width"), ("y2", "top", "height"))}
    b = det.select("det_id", *[F.bround(v * scale + shift, 0).alias(k) for k, v in at.items()])
    whole = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    b = b.select("det_id", whole.alias("whole"), *[F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(frame[i % 2])).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return b.where((w >= least[0]) & (h >= least[1]) & (w * h >= share * F.col("whole"))).drop("whole")


def normalised_boxes(det: DataFrame, frame: tuple[float, float], digits: int = 6) -> DataFrame:
    """Centre and size as parts of the frame; a frame's equal boxes are one."""
    x, y, w, h = (F.col(c) for c in ("left", "top", "width", "height"))
    parts = {"cx": (x + w / 2) / frame[0], "cy": (y + h / 2) / frame[1], "bw": w / frame[0], "bh": h / frame[1]}
    return det.select("cam_id", "frame_no", *[F.round(v, digits).alias(k) for k, v in parts.items()]).distinct()


def track_quality(det: DataFrame, truth: DataFrame, least: float = 0.5, share: float = 0.2) -> DataFrame:
    """Each track against the truth: part of its boxes on a true one, movement, span, mean height; class false below ``share``."""
    best = box_pairs(truth, det).where(F.col("iou") >= least).select("det_id").distinct().withColumn("_hit", F.lit(1.0))
    t = det.join(best, "det_id", "left").groupBy("cam_id", "local_track_id").agg(
        F.avg(F.coalesce("_hit", F.lit(0.0))).alias("matched"),
        F.hypot(F.stddev_pop(F.col("left") + F.col("width") / 2), F.stddev_pop(F.col("top") + F.col("height") / 2)).alias("motion"),
        (F.max("frame_no") - F.min("frame_no")).alias("span"), F.avg("height").alias("height"),
    )
    return t.withColumn("class", F.when(F.col("matched") < share, "false").otherwise("true"))
