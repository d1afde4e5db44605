"""The store of runs and its query functions with their arguments.

``Store`` works on the tables that ``sinks.store_tables`` makes; each method gives a
DataFrame.  Without a run, queries cover all of them and say which run a row is of.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pairs, store

Span = tuple[float, float]
TABLES = ("runs", "detections", "presence", "dwell", "zone_timeseries", "gid_embeddings")


class Store:
    def __init__(self, tables: dict[str, DataFrame], run_id: str | None = None):
        self.tables, self.run_id = tables, run_id

    @classmethod
    def open(cls, spark: SparkSession, root: str, run_id: str | None = None) -> Store:
        """A store that ``sinks.save_run`` wrote; without ``run_id`` its first run."""
        tables = {t: spark.read.parquet(f"{root}/{t}") for t in TABLES}
        if run_id is None:
            first = tables["runs"].agg(F.min("run_id")).first()
            run_id = first[0]
        return cls(tables, run_id)

    def _table(self, name: str, span: Span | None = None, at: str = "ts") -> DataFrame:
        t = self.tables[name]
        t = t if self.run_id is None else t.where(F.col("run_id") == self.run_id)
        return t if span is None else t.where(F.col(at).between(*span))

    def list_runs(self) -> DataFrame:
        return self.tables["runs"].orderBy("run_id")

    def run_info(self) -> DataFrame:
        return self._table("runs")

    def zones(self) -> DataFrame:
        return self._table("detections").select("run_id", "zone").distinct().orderBy("run_id", "zone")

    def list_persons(self) -> DataFrame:
        return self._table("detections").select("run_id", "global_id").distinct().orderBy("run_id", "global_id")

    def person_timeline(self, gid: int | None = None, span: Span | None = None) -> DataFrame:
        """Visits (those that begin within ``span``) in the order of time, of one person or of each."""
        t = self._table("presence", span, "t_start")
        t = t if gid is None else t.where(F.col("global_id") == gid)
        return t.select("run_id", "global_id", "cam_id", "zone", "t_start", "t_end", "seconds", "n_frames").orderBy("run_id", "global_id", "t_start", "cam_id", "zone")

    def person_trajectory(self, gid: int | None = None, span: Span | None = None, step: int = 1) -> DataFrame:
        """Places on the floor in the order of time, every ``step``-th of each person."""
        t = self._table("detections", span).where("world_x is not null")
        t = t if gid is None else t.where(F.col("global_id") == gid)
        t = t if step <= 1 else store.every_nth(t, step, F.struct("ts", "cam_id", "local_track_id", "foot_x", "foot_y"), "run_id", "global_id")
        return t.select("run_id", "global_id", "ts", "cam_id", "world_x", "world_y", "foot_x", "foot_y", "zone").orderBy("run_id", "global_id", "ts", "cam_id")

    def person_dwell(self, gid: int | None = None, span: Span | None = None) -> DataFrame:
        """Seconds and visits of each zone, longest first; with a span from the visits that begin in it."""
        if span is None:
            t = self._table("dwell").select("run_id", "global_id", "zone", "seconds", "n_visits")
        else:
            t = self._table("presence", span, "t_start").groupBy("run_id", "global_id", "zone").agg(F.round(F.sum("seconds"), 2).alias("seconds"), F.count("*").alias("n_visits"))
        t = t if gid is None else t.where(F.col("global_id") == gid)
        return t.orderBy("run_id", "global_id", F.desc("seconds"), "zone")

    def top_zones(self, span: Span | None = None, metric: str = "footfall", k: int = 5) -> DataFrame:
        """The ``k`` zones of each run with most persons (each counted once) or most person-seconds."""
        if metric == "footfall":
            g = self._table("detections", span).groupBy("run_id", "zone").agg(F.countDistinct("global_id").cast("double").alias("value"))
        else:
            g = self._table("zone_timeseries", span, "t_bucket").groupBy("run_id", "zone").agg(F.round(F.sum("occupancy_s"), 2).alias("value"))
        w = Window.partitionBy("run_id").orderBy(F.desc("value"), "zone")
        r = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return r.select("run_id", "zone", F.lit(metric).alias("metric"), "value", "rank").orderBy("run_id", "rank")

    def zone_occupancy(self, zone: str | None = None, span: Span | None = None) -> DataFrame:
        t = self._table("zone_timeseries", span, "t_bucket")
        t = t if zone is None else t.where(F.col("zone") == zone)
        return t.select("run_id", "zone", "bucket", "t_bucket", "occupancy_s", "footfall").orderBy("run_id", "zone", "bucket")

    def search(self, vectors: DataFrame, k: int = 5) -> DataFrame:
        """The ``k`` persons of each run nearest by cosine to each query (query_id, embedding); queries are made unit length."""
        v = F.transform("embedding", lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        q = vectors.select("query_id", F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x)).alias("q"))
        g = self._table("gid_embeddings").select("run_id", F.col("global_id").alias("vec_id"), "v")
        return pairs.nearest(q, g, k, "run_id").withColumnRenamed("vec_id", "global_id")

    def _one(self, vector: list[float]) -> DataFrame:
        return self.tables["runs"].sparkSession.createDataFrame([(0, [float(x) for x in vector])], "query_id long, embedding array<double>")

    def gid_vector(self, gid: int) -> DataFrame:
        return self._table("gid_embeddings").where(F.col("global_id") == gid).select("run_id", "global_id", "v")

    def dispatch(self, name: str, args: dict) -> DataFrame | dict[str, str]:
        """A query by name, as a tool call gives it: times are ISO 8601 texts, and a span needs both ends."""
        a, b = args.get("t_start"), args.get("t_end")
        span = (datetime.fromisoformat(a).timestamp(), datetime.fromisoformat(b).timestamp()) if a and b else None
        tools = {
            "top_zones": lambda: self.top_zones(span, args.get("metric", "footfall"), args.get("k", 5)),
            "zone_occupancy": lambda: self.zone_occupancy(args["zone"], span),
            "person_timeline": lambda: self.person_timeline(args["global_id"], span),
            "person_dwell": lambda: self.person_dwell(args["global_id"], span),
            "person_trajectory": lambda: self.person_trajectory(args["global_id"], span, args.get("step", 1)),
            "person_trajectory_bev": lambda: self.person_trajectory(args["global_id"], span, args.get("step", 1)),
            "search_person": lambda: self.search(self._one(args["embedding"]), args.get("k", 5)),
            "list_runs": self.list_runs,
            "list_persons": self.list_persons,
            "zones": self.zones,
        }
        return tools[name]() if name in tools else {"error": f"unknown tool {name}"}
