"""Buffered ids as a stream: rolling windows of chunks are clustered as each chunk ends, and stitched to persons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.linking import cluster_window, stitched

OUT = ["group", "det_id", "global_id"]
ROW = ["cam_id", "frame_no", "det_id", "local_track_id", "v"]


class BufferedIds(StatefulProcessor):
    """Persons of a camera group, by the rules of ``linking.buffered_ids``.

    State is the boxes of the last ``chunks`` chunks and a centroid for each person; with
    ``age`` persons unseen for more chunks than that are dropped.  A chunk is worked on once
    the watermark has passed its end; boxes that come later than that are dropped by Spark.
    """

    def __init__(self, chunk_ms: int, gate: float, chunks: int, vote: int | None, age: int | None):
        self.chunk_ms, self.gate, self.chunks, self.vote, self.age = chunk_ms, gate, chunks, vote, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.boxes = handle.getMapState("boxes", "chunk long", "cam array<long>, frame array<long>, det array<long>, track array<long>, v array<array<double>>, done boolean")
        self.persons = handle.getMapState("persons", "id long", "v array<double>, n long, seen long")
        self.next = handle.getValueState("next", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        fresh: dict[int, list[pd.DataFrame]] = {}
        for pdf in rows:
            at = pdf.event_time.astype("datetime64[ms]").astype("int64") // self.chunk_ms
            for c, part in pdf.groupby(at):
                fresh.setdefault(int(c), []).append(part)
        for c, parts in fresh.items():
            p = pd.concat(parts)
            cols = [p[x].astype("int64").tolist() for x in ROW[:4]] + [[list(map(float, v)) for v in p.v]]
            if self.boxes.containsKey((c,)):
                cols = [list(a) + b for a, b in zip(self.boxes.getValue((c,)), cols)]
            self.boxes.updateValue((c,), (*cols, False))
            self.handle.registerTimer((c + 1) * self.chunk_ms)
        yield pd.DataFrame({c: [] for c in OUT}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = expiredTimerInfo.getExpiryTimeInMs() // self.chunk_ms - 1
        held = {k[0]: v for k, v in self.boxes.iterator()}
        out = [x for c in sorted(c for c, v in held.items() if c <= ended and not v[5]) for x in self._chunk(key[0], c, held)]
        yield pd.DataFrame(out, columns=OUT).astype("int64")

    def _chunk(self, group: int, c: int, held: dict) -> list[tuple]:
        inside = [k for k in range(c - self.chunks + 1, c + 1) if k in held]
        rows = pd.concat([pd.DataFrame(dict(zip(ROW, held[k][:5]))).assign(current=k == c) for k in inside])
        rows = rows.sort_values(["frame_no", "cam_id", "det_id"]).reset_index(drop=True)
        cluster = cluster_window(rows, vote=self.vote)
        v = np.stack(rows.v.to_list())
        found = {}
        for k in np.unique(cluster):
            mean = v[cluster == k].mean(0)
            if np.linalg.norm(mean) > 0:
                found[k] = mean / np.linalg.norm(mean)
        known = [(k[0], np.array(x[0]), x[1], x[2]) for k, x in sorted(self.persons.iterator(), key=lambda x: x[0][0])]
        fresh = self.next.get()[0] if self.next.exists() else 1
        after, who = stitched(known, fresh, c, np.stack(list(found.values())), self.gate, self.age) if found else (known, [])
        for k in {k[0] for k in known} - {k[0] for k in after}:
            self.persons.removeKey((k,))
        for k, x, n, seen in after:
            if seen == c:  # only what this window has changed
                self.persons.updateValue((k,), (x.tolist(), int(n), int(seen)))
        self.next.update((max([fresh, *[k + 1 for k in who]]),))
        held[c] = (*held[c][:5], True)
        self.boxes.updateValue((c,), held[c])
        for k in [k for k in held if k <= c - self.chunks + 1]:
            held.pop(k)
            self.boxes.removeKey((k,))
        ids = dict(zip(found, who, strict=True))
        return [(group, int(d), ids[k]) for d, k, now in zip(rows.det_id, cluster, rows.current, strict=True) if now and k in ids]

    def close(self) -> None:
        pass


def live_buffered(boxes: DataFrame, chunk_ms: int, late: str, gate: float, chunks: int = 1, vote: int | None = None, age: int | None = None) -> DataFrame:
    """(group, det_id, global_id) of each box once its chunk is over.

    boxes: event_time, group, cam_id, frame_no, det_id, local_track_id, v (unit vectors;
    boxes without one are left out).  A group is one key, as its ids are shared by its cameras.
    """
    b = boxes.where("v is not null").select("event_time", "group", *ROW).withWatermark("event_time", late)
    p = BufferedIds(chunk_ms, gate, chunks, vote, age)
    return b.groupBy(F.col("group")).transformWithStateInPandas(p, "group long, det_id long, global_id long", "append", "eventTime")
