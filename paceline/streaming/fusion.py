"""Micro-batch fusion as a stream: windows close by event-time timers, and what they change is rescored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.fusion import EVENT, EVENTS, FusionRules, Person, SceneFusion, as_rows, usable

_PLACES = "frames array<long>, place_cams array<long>, xs array<double>, ys array<double>"
_SPANS = "cams array<long>, starts array<long>, ends array<long>"
PERSON = f"total array<double>, n long, {_SPANS}, {_PLACES}, partners array<long>, scores array<double>, last double, last_gid long, stale boolean"
WAITING = "cam long, gid long, start long, end long, v array<double>, n long, frames array<long>, xs array<double>, ys array<double>"


class Fusion(StatefulProcessor):
    """``SceneFusion`` on a stream, a scene to a state.

    State is the tracklets of windows that are not over, a person's sums, spans, places and
    partners as an entry of a map, and merges as another.  A window closes once the watermark
    has passed it; only the persons that it has changed, or whose partners have, are written.
    """

    def __init__(self, rules: FusionRules, frame_ms: int):
        self.rules, self.frame_ms = rules, frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "boundary long, number long", WAITING)
        self.due = handle.getMapState("due", "boundary long", "at long, rows long")
        self.persons = handle.getMapState("persons", "gid long", PERSON)
        self.gone = handle.getMapState("gone", "source long", "target long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        w = self.rules.window
        for pdf in rows:
            at = pdf.event_time.astype("datetime64[ms]").astype("int64")
            for ms, (cam, gid, lo, hi, v, n, places) in zip(at.tolist(), as_rows(pdf), strict=True):
                boundary = max(1, -(-hi // w)) * w
                timer, have = self.due.getValue((boundary,)) if self.due.containsKey((boundary,)) else (ms + (boundary - hi) * self.frame_ms, 0)
                f, x, y = (list(c) for c in zip(*places, strict=True)) if places else ([], [], [])
                self.waiting.updateValue((boundary, have), (cam, gid, lo, hi, list(map(float, v)), n, f, x, y))
                self.due.updateValue((boundary,), (timer, have + 1))
                self.handle.registerTimer(timer)
        yield pd.DataFrame({c: [] for c in EVENT}).astype({c: "float64" if c == "score" else "int64" for c in EVENT})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        closing = sorted((k[0], v[1]) for k, v in self.due.iterator() if v[0] <= now)
        out = []
        if closing:
            fusion = self._load()
            merged = set(fusion.gone)
            for boundary, n in closing:
                rows = []
                for k in range(n):
                    cam, gid, lo, hi, v, m, f, x, y = self.waiting.getValue((boundary, k))
                    rows.append((cam, gid, lo, hi, v, m, list(zip(f, x, y, strict=True))))
                    self.waiting.removeKey((boundary, k))
                self.due.removeKey((boundary,))
                rows.sort(key=lambda r: (r[3], r[1], r[0], r[2]))
                out += [(key[0], *e) for e in fusion.step(rows, boundary)]
            self._store(fusion, merged)
        yield pd.DataFrame(out, columns=EVENT)

    def _load(self) -> SceneFusion:
        fusion, persons = SceneFusion(self.rules), {}
        for (gid,), (total, n, cams, starts, ends, frames, at, xs, ys, *kept) in self.persons.iterator():
            persons[gid] = Person(np.array(total, float), n, list(zip(cams, starts, ends, strict=True)), list(zip(frames, at, xs, ys, strict=True))), *kept
        fusion.load(persons, {k[0]: v[0] for k, v in self.gone.iterator()})
        return fusion

    def _store(self, fusion: SceneFusion, merged: set[int]) -> None:
        for gid in fusion.touched:
            p = fusion.persons[gid]
            spans = [list(c) for c in zip(*p.spans, strict=True)] or [[], [], []]
            places = [list(c) for c in zip(*p.places, strict=True)] or [[], [], [], []]
            self.persons.updateValue((gid,), (p.total.tolist(), p.n, *spans, *places, *fusion.stored(gid)))
        for source in fusion.gone.keys() - merged:
            self.gone.updateValue((source,), (fusion.gone[source],))

    def close(self) -> None:
        pass


def live_fusion(tracklets: DataFrame, rules: FusionRules, frame_ms: int, late: str) -> DataFrame:
    """Merge events of a stream of ended tracklets, by scene: the events of ``operators.fusion.windowed``, as windows close.

    tracklets: event_time (when the tracklet ended; ``frame_ms`` a frame) and the columns of
    ``windowed``.  Tracklets may come in any order and split within ``late``; Spark drops later
    ones.  The session needs the RocksDB state store provider.
    """
    t = usable(tracklets, rules).withWatermark("event_time", late)
    return t.groupBy("scene").transformWithStateInPandas(Fusion(rules, frame_ms), EVENTS, "append", "eventTime")
