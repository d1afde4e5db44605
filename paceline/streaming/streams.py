"""Structured Streaming forms: session visits, chunk windows, delayed remaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def session_visits(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Visits of each person and zone by session windows; ``events`` has a timestamp ``event_time``."""
    s = events.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), "global_id", "zone")
    return s.agg(F.min("event_time").alias("t_start"), F.max("event_time").alias("t_end"), F.count("*").alias("n_dets")).drop("w")


def chunk_counts(events: DataFrame, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Detections and persons of each camera in windows of ``length``, tumbling or a ``slide`` apart.

    Persons are counted exactly: the state of a window holds the ids that one camera shows in it.
    A rolling window over the last k chunks has k times a chunk as length and a chunk as slide.
    """
    w = events.withWatermark("event_time", late).groupBy(F.window("event_time", length, slide).alias("w"), "cam_id")
    return w.agg(F.count("*").alias("n_dets"), F.size(F.collect_set("global_id")).cast("long").alias("n_gids")).select("cam_id", F.col("w.start").alias("start"), "n_dets", "n_gids")


def drain(stream: DataFrame, sink: str, path: str, checkpoint: str, seconds: float | None = None) -> bool:
    """Writes all that a stream has by now and stops; after ``seconds`` it stops in any case. Whether it was through."""
    q = stream.writeStream.format(sink).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done = q.awaitTermination(seconds) is not False
    q.stop()
    return done


class DelayedRemap(StatefulProcessor):
    """Holds boxes for a delay and gives them out under the ids that later merges led to.

    Input rows are boxes (det_id set) or merges (source, target set).  A box waits until
    the watermark is ``delay_ms`` past it, and follows the merges up to then, however rows
    fall into batches.  Of several merges of one source the first holds; merges are kept
    for ``keep_ms``.
    """

    def __init__(self, delay_ms: int, keep_ms: int, hops: int = 64):
        self.delay_ms, self.keep_ms, self.hops = delay_ms, keep_ms, hops

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long", "det_id array<long>, global_id array<long>")
        self.merged = handle.getMapState("merged", "source long", "target long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        fresh: dict[int, tuple[list[int], list[int]]] = {}
        for pdf in rows:
            at = pdf.event_time.astype("datetime64[ms]").astype("int64")
            for t, det, gid, source, target in zip(at, pdf.det_id, pdf.global_id, pdf.source, pdf.target, strict=True):
                if pd.notna(det):
                    ids, gids = fresh.setdefault(int(t), ([], []))
                    ids.append(int(det))
                    gids.append(int(gid))
                elif pd.notna(source):
                    k = (int(source),)
                    if not self.merged.containsKey(k) or int(t) < self.merged.getValue(k)[1]:
                        self.merged.updateValue(k, (int(target), int(t)))
        for t, (ids, gids) in fresh.items():
            if self.held.containsKey((t,)):
                a, b = self.held.getValue((t,))
                ids, gids = list(a) + ids, list(b) + gids
            self.held.updateValue((t,), (ids, gids))
            self.handle.registerTimer(t + self.delay_ms)
        yield pd.DataFrame({"cam_group": [], "det_id": [], "global_id": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        merged = {k[0]: v for k, v in self.merged.iterator()}
        out = []
        for t in sorted(k[0] for k in self.held.keys() if k[0] + self.delay_ms <= now):
            for det, gid in zip(*self.held.getValue((t,)), strict=True):
                for _ in range(self.hops):
                    if gid not in merged or merged[gid][1] > t + self.delay_ms:
                        break
                    gid = merged[gid][0]
                out.append((key[0], det, gid))
            self.held.removeKey((t,))
        for source, (_, at) in merged.items():
            if at + self.keep_ms < now:
                self.merged.removeKey((source,))
        yield pd.DataFrame(out, columns=["cam_group", "det_id", "global_id"]).astype("int64")

    def close(self) -> None:
        pass


def delayed_remap(boxes: DataFrame, merges: DataFrame, delay_ms: int, late: str, keep_ms: int | None = None) -> DataFrame:
    """Boxes under the ids known ``delay_ms`` after them, by camera group.

    boxes: event_time, cam_group, det_id, global_id; merges: event_time, cam_group, source,
    target.  Merges are kept for ``keep_ms``, ten delays unless given.
    """
    none = F.lit(None).cast("long")
    b = boxes.select("event_time", "cam_group", "det_id", "global_id", none.alias("source"), none.alias("target"))
    m = merges.select("event_time", "cam_group", none.alias("det_id"), none.alias("global_id"), "source", "target")
    both = b.unionByName(m).withWatermark("event_time", late).groupBy("cam_group")
    return both.transformWithStateInPandas(DelayedRemap(delay_ms, keep_ms or 10 * delay_ms), "cam_group long, det_id long, global_id long", "append", "eventTime")
