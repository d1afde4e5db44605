"""Tracking relations: schemas, readers of exported files, and the projection of event tables onto them.

Explicit schemas throughout: nothing is inferred from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = "frame_no_cam long, cam_id int, local_track_id long, global_id long, left double, top double, width double, height double"
ASSIGNMENTS = "group string, cam_id int, frame_no long, local_track_id long, global_id long"
TRACKLETS = "tracklet_id long, cam_id int, local_track_id long, global_id long, start_frame long, end_frame long, num_detections long, num_embeddings long, mean_width double, mean_height double, mean_area double"
GROUND_TRUTH = "frame long, person_id long, left double, top double, width double, height double"
HEALTH = "ts double, elapsed_s double, gpu_util double, gpu_mem_mb double, rss_mb double, fps double, n_gids long"


def _number(text, kind: str):
    """A column of digits as a number; null where there are none."""
    return F.nullif(text, F.lit("")).try_cast(kind)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction CSVs, as ``write_predictions`` or a run gives them.

    The camera comes from a file name of the form cam_<N>_..., else from its column.
    """
    rows = spark.read.schema(PREDICTIONS).option("header", True).csv(path)
    named = _number(F.regexp_extract(F.input_file_name(), r"cam_(\d+)_[^/]*$", 1), "int")
    rows = rows.withColumn("cam_id", F.coalesce(named, "cam_id"))
    return rows.select("frame_no_cam", "cam_id", "local_track_id", "global_id", "left", "top", "width", "height")


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """The last assignment of each (camera, frame, track): the last line of the last file by name."""
    rows = spark.read.schema(ASSIGNMENTS).option("header", True).csv(path)
    rows = rows.select("cam_id", "frame_no", "local_track_id", "global_id", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).alias("place"))
    return rows.groupBy("cam_id", "frame_no", "local_track_id").agg(F.max_by("global_id", "place").alias("global_id"))


def read_truth(spark: SparkSession, folder: str, cam_id: int, suffix: str = "_clean", stride: int = 1, most: int | None = None) -> DataFrame:
    """Truth boxes of a camera from <folder>/cam_<N><suffix>.csv, or without the suffix where that isn't there.

    Every ``stride``-th frame, the first ``most`` boxes by frame and person if a cap is set
    (the cap is the caller's), in the order of frames.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/cam_{cam_id}{suffix}.csv")
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    rows = spark.read.schema(GROUND_TRUTH).option("header", True).csv(f"{folder}/cam_{cam_id}{suffix if there else ''}.csv")
    rows = rows.where(F.col("frame") % stride == 0).withColumn("cam_id", F.lit(cam_id)).orderBy("frame", "person_id")
    return rows if most is None else rows.limit(most)


def read_tracklets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACKLETS).option("header", True).csv(path)


def read_health(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEALTH).option("header", True).csv(path)


MANIFEST = "created string, git_commit string, git_dirty boolean, gpu string, pipeline_config string, sources string, env_map map<string,string>, duration_s double, models map<string,string>, tracker_config string, key_thresholds map<string,double>, run_params map<string,string>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests, a JSON document a file, with the file's folder as ``run_id``."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return rows.withColumn("run_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def read_frame_labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of {person: [x1, y1, x2, y2]}, one per frame and camera, named ``<frame>_<cam>.json``."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    boxes = raw.select(F.regexp_extract("file", r"(\d+)_(\d+)\.json$", 1).cast("long").alias("frame"), F.regexp_extract("file", r"(\d+)_(\d+)\.json$", 2).cast("int").alias("cam_id"), F.explode(F.from_json("value", "map<string,array<double>>")).alias("person", "b"))
    return boxes.select("frame", "cam_id", F.col("person").cast("long").alias("person_id"), F.col("b")[0].alias("left"), F.col("b")[1].alias("top"), (F.col("b")[2] - F.col("b")[0]).alias("width"), (F.col("b")[3] - F.col("b")[1]).alias("height"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; ``#`` starts a comment."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("id"))
    return lines.where("id <> ''").select(F.col("id").cast("long").alias("id")).distinct()


def write_by_run(df: DataFrame, path: str) -> None:
    """Idempotent load: the partitions of the runs in ``df`` are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def detections(events: DataFrame) -> DataFrame:
    """The event table as detections: camera, frame (one a second), track, person, zone and box."""
    e = F.col("event_id")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return events.select(
        e.alias("det_id"),
        (e % 4).cast("int").alias("cam_id"),
        second.alias("frame_no"),
        (F.col("user_id") % 40).alias("local_track_id"),
        F.col("user_id").alias("global_id"),
        F.col("event_type").alias("zone"),
        ((e * 37) % 560).cast("double").alias("left"),
        ((e * 53) % 240).cast("double").alias("top"),
        (20 + e % 41).cast("double").alias("width"),
        (60 + e % 61).cast("double").alias("height"),
    )


def dense_detections(events: DataFrame) -> DataFrame:
    """The same with eight boxes to a frame, two in each camera."""
    return detections(events).withColumn("frame_no", F.floor(F.col("det_id") / 8))


def ground_truth(events: DataFrame) -> DataFrame:
    """Dense boxes, moved by a few pixels, without every eleventh."""
    d = dense_detections(events).where("det_id % 11 <> 0")
    jitter = (F.col("det_id") % 5 - 2).cast("double")
    return d.select("det_id", "cam_id", "frame_no", F.col("global_id").alias("person_id"), (F.col("left") + jitter).alias("left"), (F.col("top") - jitter).alias("top"), "width", "height")
