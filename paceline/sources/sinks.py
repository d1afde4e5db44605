"""Writers of a run's results and of the store; each has its reader beside it.

Tables of the store are Parquet partitioned by run: loading a run again replaces its
partitions and no others.  Spark commits a write as a whole, so readers never see a
part of one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..operators.projections import stamped


def _csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Each table under ``root``, with ``run_id``; this run's rows are replaced."""
    for name, df in tables.items():
        df = df.withColumn("run_id", F.lit(run_id))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")


def has_run(spark: SparkSession, root: str, run_id: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/runs")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return False
    return not spark.read.parquet(f"{root}/runs").where(F.col("run_id") == run_id).limit(1).isEmpty()


def save_run(tables: dict[str, DataFrame], root: str, run_id: str, replace: bool = False) -> bool:
    """Writes a run's tables unless it is there already; whether it wrote.  The table ``runs`` comes last."""
    spark = next(iter(tables.values())).sparkSession
    if not replace and has_run(spark, root, run_id):
        return False
    write_tables({k: tables[k] for k in sorted(tables, key=lambda k: k == "runs")}, root, run_id)
    return True


def store_tables(det: DataFrame, vectors: DataFrame, epoch: float, fps: float, gap_frames: int, bucket_s: float, info: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The store's tables of one run.

    det: cam_id, frame_no, local_track_id, global_id, zone, foot_x, foot_y, world_x, world_y;
    vectors: global_id, embedding.  Boxes without an id are left out.
    """
    d = stamped(det.where("global_id >= 0"), epoch, fps)
    v = store.visits(d, gap_frames, fps)
    at = lambda c: (F.lit(epoch) + F.col(c) / fps)
    presence = v.select("global_id", "cam_id", "zone", at("first_frame").alias("t_start"), at("last_frame").alias("t_end"), F.round("seconds", 3).alias("seconds"), "n_frames")
    series = store.zone_series(d, fps, bucket_s).withColumn("t_bucket", F.lit(epoch) + F.col("bucket") * bucket_s)
    runs = store.rollup(d)
    for k, x in (info or {}).items():
        runs = runs.withColumn(k, F.lit(x))
    return {
        "runs": runs.withColumn("epoch", F.lit(epoch)).withColumn("fps", F.lit(fps)),
        "detections": d,
        "presence": presence,
        "dwell": store.dwell(v),
        "zone_timeseries": series,
        "gid_embeddings": store.mean_vectors(vectors.where("global_id >= 0"), "global_id", "embedding").withColumn("dim", F.size("v")),
    }


def write_tracklets(det: DataFrame, vectors: DataFrame, points: DataFrame, folder: str) -> None:
    """tracklets (CSV), tracklet_vectors (Parquet: tracklet_id, embedding) and tracklet_bev (CSV) of a run.

    Tracklets are numbered by camera, track and person.  vectors: cam_id, local_track_id,
    global_id, embedding; points: those keys with frame_no, world_x, world_y.
    """
    keys = ["cam_id", "local_track_id", "global_id"]
    t = store.tracklets(det)
    n = vectors.groupBy(*keys).agg(F.count("*").alias("num_embeddings"))
    order = ["tracklet_id", *keys, "start_frame", "end_frame", "num_detections", "num_embeddings", "mean_width", "mean_height", "mean_area"]
    _csv(t.join(n, keys, "left").fillna(0, ["num_embeddings"]).select(*order), f"{folder}/tracklets")
    ids = t.select(*keys, "tracklet_id")
    store.mean_vectors(vectors.join(ids, keys), "tracklet_id", "embedding").withColumnRenamed("v", "embedding").write.mode("overwrite").parquet(f"{folder}/tracklet_vectors")
    _csv(points.join(ids, keys).select("tracklet_id", F.col("frame_no").alias("frame_no_cam"), *keys, "world_x", "world_y"), f"{folder}/tracklet_bev")


def write_vector_chunks(vectors: DataFrame, path: str, frames: int) -> None:
    """Detection vectors in chunks of ``frames`` frames, a partition for each."""
    d = vectors.withColumn("chunk", F.floor(F.col("frame_no") / frames).cast("int"))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def stream_vector_chunks(vectors: DataFrame, path: str, checkpoint: str):
    """The same of a stream that has a column ``chunk``; the sink's log makes each chunk whole."""
    return vectors.writeStream.partitionBy("chunk").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet")


def append_assignments(chunk: DataFrame, folder: str, batch_id: int | None = None, compact_every: int = 16) -> None:
    """Appends a chunk's assignments and a version of which id each track has now (``track_map`` reads it).

    A chunk writes its own rows and its own tracks only; every ``compact_every`` versions the
    tracks are written anew as a base.  A version counts once its entry in the log is there,
    which is renamed into place: a write that was stopped leaves the former one, and a batch
    that is played again changes nothing.  The log's entry names the files of its version.
    chunk: group, cam_id, frame_no, local_track_id, global_id.  For ``foreachBatch``.
    """
    spark = chunk.sparkSession
    log = _log(spark, folder)
    last, state = log[-1] if log else (-1, {"base": None, "changes": []})
    batch_id = last + 1 if batch_id is None else batch_id
    if batch_id <= last:
        return
    name = f"{batch_id:012d}"
    rows = chunk.select("group", "cam_id", "frame_no", "local_track_id", "global_id")
    rows.write.mode("overwrite").parquet(f"{folder}/assignments/batch={name}")
    _latest(spark.read.schema(rows.schema).parquet(f"{folder}/assignments/batch={name}")).write.mode("overwrite").parquet(f"{folder}/tracks/change-{name}")
    state = {"base": state["base"], "changes": [*state["changes"], f"change-{name}"]}
    if len(state["changes"]) >= compact_every:
        _version(spark, folder, state).write.mode("overwrite").parquet(f"{folder}/tracks/base-{name}")
        state |= {"base": f"base-{name}", "changes": []}
    _commit(spark, f"{folder}/log/{name}.json", json.dumps(state))


_TRACKS = "group string, cam_id int, local_track_id long, global_id long, frame_no long"


def _latest(rows: DataFrame) -> DataFrame:
    by = ["group", "cam_id", "local_track_id"]
    return rows.groupBy(*by).agg(F.max_by("global_id", F.struct("frame_no", "global_id")).alias("global_id"), F.max("frame_no").alias("frame_no"))


def _version(spark: SparkSession, folder: str, state: dict) -> DataFrame:
    files = [f"{folder}/tracks/{x}" for x in [state["base"], *state["changes"]] if x]
    rows = spark.read.parquet(*files) if files else spark.createDataFrame([], _TRACKS)
    return _latest(rows)


def track_map(spark: SparkSession, folder: str) -> DataFrame:
    """(group, cam_id, local_track_id, global_id): the id of each track by its latest frame, in the last whole version."""
    log = _log(spark, folder)
    return _version(spark, folder, log[-1][1] if log else {"base": None, "changes": []}).drop("frame_no")


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _log(spark: SparkSession, folder: str) -> list[tuple[int, dict]]:
    """The last version of the log, if there is one: (batch, what it names)."""
    p, files = _files(spark, f"{folder}/log")
    names = sorted(f.getPath().getName() for f in files.listStatus(p)) if files.exists(p) else []
    names = [n for n in names if n.endswith(".json") and n[0].isdigit()]
    if not names:
        return []
    text = spark.read.text(f"{folder}/log/{names[-1]}", wholetext=True).first().value
    return [(int(names[-1][:-5]), json.loads(text))]


def _commit(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place by a rename, whole or not at all."""
    target, files = _files(spark, path)
    draft, _ = _files(spark, path.rsplit("/", 1)[0] + f"/_{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    if not files.rename(draft, target):
        files.delete(draft, False)
        raise OSError(f"{path} is there already")


def write_remap(det: DataFrame, remap: DataFrame, events: DataFrame | None, folder: str) -> None:
    """Predictions under their new ids, the remap table, the merges alone, and the events that led to them.

    remap: source, target; events: event_frame, window_end_frame, source, target, score.
    """
    r = remap.select(F.col("source").alias("global_id"), F.col("target").alias("remapped_global_id"))
    moved = det.join(r, "global_id", "left").withColumn("global_id", F.coalesce("remapped_global_id", "global_id")).drop("remapped_global_id")
    moved.write.mode("overwrite").parquet(f"{folder}/predictions")
    ids = det.select("global_id").distinct().join(r, "global_id", "left").select("global_id", F.coalesce("remapped_global_id", "global_id").alias("remapped_global_id"))
    _csv(ids, f"{folder}/remap")
    _csv(r.where("global_id <> remapped_global_id").select(F.col("global_id").alias("source_global_id"), F.col("remapped_global_id").alias("target_global_id")), f"{folder}/merges")
    if events is not None:
        _csv(events, f"{folder}/events")


def write_region_counts(counts: DataFrame, path: str) -> None:
    """One line a camera and frame: total, and zones as packed ``name=n`` lists. counts: cam_id, frame_no, zone_name, n, overcrowded."""
    packed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("zone_name", c))), lambda x: F.concat(x["zone_name"], F.lit("="), x[c].cast("string"))), ";")
    rows = counts.groupBy("frame_no", "cam_id").agg(F.sum("n").alias("total"), packed("n").alias("roi"), packed("overcrowded").alias("overcrowding"))
    _csv(rows.select(F.col("frame_no").alias("frame"), F.col("cam_id").alias("cam"), "total", "roi", "overcrowding"), path)


def write_grids(grid: DataFrame, stats: DataFrame, folder: str) -> None:
    """Cells that have been hit, as CSV by camera, and a line of JSON for each camera's peak, occupied part and detections."""
    grid.select("cam_id", "gy", "gx", "occupancy").repartition("cam_id").sortWithinPartitions("cam_id", "gy", "gx").write.mode("overwrite").partitionBy("cam_id").option("header", True).csv(f"{folder}/grids")
    stats.write.mode("overwrite").json(f"{folder}/stats")


def unpacked(packed: str):
    """The map of a packed ``name=n`` list."""
    return F.transform_values(F.str_to_map(packed, F.lit(";"), F.lit("=")), lambda _, v: v.try_cast("long"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def append_results(results: DataFrame, path: str) -> None:
    """A sweep's results, a JSON object a line, after those that are there."""
    results.write.mode("append").json(path)


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("overwrite").text(path)
