"""Readers of arrays, calibrations, nested truth and lists, and the writers beside them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranges

DETECTION_VECTORS = "cam_id int, frame_no long, local_track_id long, embedding array<double>"
TRACKLET_VECTORS = "tracklet_id long, embedding array<double>"


def read_npz(spark: SparkSession, path: str, schema: str, names: dict[str, str] | None = None, normalise: bool = False, part_bytes: int = ranges.PART_BYTES) -> DataFrame:
    """Rows of the arrays in NPZ files, in slices of about ``part_bytes`` of a file; unreadable files give no rows.

    Files in a store that only Spark opens are read whole, a file to a task.

    ``names`` maps columns to arrays that are called otherwise.  ``normalise`` makes the
    vectors unit length (zero vectors stay).
    """
    names = names or {}
    found_files = ranges.listed(spark, path)
    if found_files is not None:
        return ranges.npz(spark, found_files, schema, names, normalise, part_bytes)
    columns = spark.createDataFrame([], schema).columns

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch.content:
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        found = {c: z[names.get(c, c)] for c in columns}
                except (OSError, ValueError, KeyError, EOFError, zipfile.BadZipFile):
                    continue
                if normalise and "embedding" in found:
                    v = found["embedding"].astype(float)
                    n = np.linalg.norm(v, axis=1, keepdims=True)
                    found["embedding"] = v / np.where(n > 0, n, 1)
                yield pd.DataFrame({c: list(a.astype(float)) if a.ndim == 2 else a for c, a in found.items()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, schema)


def read_detection_vectors(spark: SparkSession, path: str, normalise: bool = False) -> DataFrame:
    return read_npz(spark, path, DETECTION_VECTORS, {"embedding": "embeddings"}, normalise)


def read_tracklet_vectors(spark: SparkSession, path: str) -> DataFrame:
    return read_npz(spark, path, TRACKLET_VECTORS, {"tracklet_id": "tracklet_ids", "embedding": "embeddings"})


def read_warehouse_truth(spark: SparkSession, path: str, stride: int = 1, cameras: list[int] | None = None, part_bytes: int = ranges.PART_BYTES) -> DataFrame:
    """Boxes of persons in JSON files of {frame: [object]}; boxes without a width or height go.

    Every ``stride``-th frame and the ``cameras`` asked for; the others are skipped unparsed.
    A file is read in ranges of about ``part_bytes``; only files in a store that pyarrow
    can't open are read whole, a file to a task.
    """
    found = ranges.listed(spark, path)
    if found is not None:
        return ranges.truth(spark, found, stride, cameras, part_bytes)
    item = "array<struct<`object type`:string,`object id`:long,`2d bounding box visible`:map<string,array<double>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("frame", "objects"))
    one = raw.select(F.col("frame").cast("long").alias("frame"), F.explode("objects").alias("o")).where(F.col("o.`object type`") == "Person")
    b = one.select("frame", F.col("o.`object id`").alias("person_id"), F.explode("o.`2d bounding box visible`").alias("camera", "b"))
    w, h = F.col("b")[2] - F.col("b")[0], F.col("b")[3] - F.col("b")[1]
    cam = F.regexp_extract("camera", r"(\d+)$", 1).cast("int").alias("cam_id")
    asked = (F.col("frame") % stride == 0) & (cam.isin(cameras) if cameras is not None else F.lit(True))
    return b.where((w > 0) & (h > 0) & asked).select("frame", cam, "person_id", F.col("b")[0].alias("left"), F.col("b")[1].alias("top"), w.alias("width"), h.alias("height"))


def _pose(r: Column, t: Column) -> list[Column]:
    return [r(i, j).alias(f"r{i + 1}{j + 1}") for i in range(3) for j in range(3)] + [t(i).alias(f"t{i + 1}") for i in range(3)]


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Camera rows for ``ground_point`` from files of intrinsic and extrinsic parameters; ids count from 1."""
    cam = "struct<CameraId:int,IntrinsicParameters:struct<Fx:double,Fy:double,Cx:double,Cy:double>,ExtrinsicParameters:struct<Rotation:array<double>,Translation:array<double>>>"
    c = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<Cameras:array<{cam}>>")["Cameras"]).alias("c")).select("c.*")
    k, e = F.col("IntrinsicParameters"), F.col("ExtrinsicParameters")
    return c.select((F.col("CameraId") - 1).alias("cam_id"), *[k[n].alias(n.lower()) for n in ("Fx", "Fy", "Cx", "Cy")], *_pose(lambda i, j: e["Rotation"][3 * i + j], lambda i: e["Translation"][i]))


def read_sensor_cameras(spark: SparkSession, path: str) -> DataFrame:
    """The same from files of sensors with 3 x 3 and 3 x 4 matrices; sensors that are not cameras are left out."""
    sensor = "struct<id:string,type:string,intrinsicMatrix:array<array<double>>,extrinsicMatrix:array<array<double>>>"
    c = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<sensors:array<{sensor}>>")["sensors"]).alias("c")).select("c.*").where("type = 'camera'")
    k, e = F.col("intrinsicMatrix"), F.col("extrinsicMatrix")
    cam = F.coalesce(F.nullif(F.regexp_extract("id", r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(0)).alias("cam_id")
    return c.select(cam, k[0][0].alias("fx"), k[1][1].alias("fy"), k[0][2].alias("cx"), k[1][2].alias("cy"), *_pose(lambda i, j: e[i][j], lambda i: e[i][3]))


def _uri(line: Column) -> Column:
    return F.when(line.rlike("^[a-z]+://"), line).otherwise(F.concat(F.lit("file://"), line))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, nth) of a short list file (one for each camera of a run), blank and ``#`` lines left out."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    return rows.where("line <> '' and not startswith(line, '#')").select("line", (F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("nth"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(uri, is_live) of a source list: blank lines and ``#`` lines are skipped, plain paths become file URIs."""
    uri = _uri(F.col("line"))
    return _lines(spark, path).select(uri.alias("uri"), uri.startswith("rtsp://").alias("is_live"))


def list_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("mp4", "mkv", "avi"), by: str = "name", most: int | None = None) -> DataFrame:
    """(uri, modified) of the files with these extensions, by name or by time; ``most`` is the caller's cap."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(f"{folder}/*").select("path", F.col("modificationTime").alias("modified"))
    rows = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin([x.lower() for x in extensions]))
    rows = rows.orderBy("modified", "path") if by == "time" else rows.orderBy("path")
    rows = rows.select(F.col("path").alias("uri"), "modified")
    return rows if most is None else rows.limit(most)


def resolve_sources(spark: SparkSession, text: str | None = None, folder: str | None = None, items: list[str] | None = None) -> tuple[DataFrame, bool]:
    """((uri, nth), whether any is live): of a list file, a folder and single items the first that is given."""
    if text:
        rows = _lines(spark, text).select(_uri(F.col("line")).alias("uri"), "nth")
    elif folder:
        rows = list_folder(spark, folder).select("uri", (F.row_number().over(Window.orderBy("uri")) - 1).cast("int").alias("nth"))
    elif items:
        rows = spark.createDataFrame([(x.strip(), k) for k, x in enumerate(items)], "line string, nth int").select(_uri(F.col("line")).alias("uri"), "nth")
    else:
        raise ValueError("no source is given")
    return rows, not rows.where(F.col("uri").startswith("rtsp://")).isEmpty()


def camera_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, cam_number): the number in each line's Camera_<N>, by its place in the list; else the place itself."""
    n = F.nullif(F.regexp_extract("line", r"Camera_(\d+)", 1), F.lit("")).try_cast("int")
    return _lines(spark, path).select(F.col("nth").alias("source_id"), F.coalesce(n, "nth").alias("cam_number"))


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, frame, cam_id, kind) of label and image files in ZIP archives, an archive to a task at a time.

    Names end in <frame>_<cam> with an extension: kind is image for picture extensions, else label.
    """

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch.path, batch.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        yield pd.DataFrame({"archive": archive, "member": [x for x in z.namelist() if not x.endswith("/")]})
                except zipfile.BadZipFile:
                    continue

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(names, "archive string, member string")
    part = lambda k: F.nullif(F.regexp_extract("member", r"(\d+)_(\d+)\.[A-Za-z]+$", k), F.lit("")).try_cast("long")
    kind = F.when(F.lower("member").rlike(r"\.(jpg|jpeg|png)$"), "image").otherwise("label")
    return rows.select("archive", "member", part(1).alias("frame"), part(2).cast("int").alias("cam_id"), kind.alias("kind")).where("frame is not null")


def paired_members(members: DataFrame) -> DataFrame:
    """(frame, cam_id, image, label) of the frames that have both."""
    side = lambda k: members.where(F.col("kind") == k).groupBy("frame", "cam_id").agg(F.min(F.struct("archive", "member")).alias(k))
    return side("image").join(side("label"), ["frame", "cam_id"])


def zip_by_rank(left: DataFrame, right: DataFrame) -> DataFrame:
    """The k-th smallest of one id list beside the k-th smallest of the other: lists of cameras, not of boxes."""
    ranked = lambda d, n: d.distinct().toDF(n).withColumn("rank", F.row_number().over(Window.orderBy(n)))
    return ranked(left, "source_id").join(ranked(right, "cam_id"), "rank").drop("rank")


def write_predictions(det: DataFrame, path: str) -> None:
    """CSV by camera, with coordinates to two digits; ``read_predictions`` reads it back."""
    boxes = [F.round(c, 2).alias(c) for c in ("left", "top", "width", "height")]
    rows = det.select(F.col("frame_no").alias("frame_no_cam"), "cam_id", "local_track_id", "global_id", *boxes, F.col("cam_id").alias("cam"))
    rows.write.mode("overwrite").option("header", True).partitionBy("cam").csv(path)
