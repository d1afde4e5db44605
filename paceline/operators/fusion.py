"""Windowed merges of persons: what a window changes is rescored, the rest stays as it was.

``SceneFusion`` holds a scene's persons and the best partners of each.  The batch
form passes a scene's tracklets through a task in order; the stream form is
``streaming.fusion``.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FusionRules:
    window: int  # frames from one decision to the next
    delay: int  # frames until an event counts
    threshold: float
    margin: float  # the best partner has to be better than the second by this
    k: int  # partners that a person proposes, at most
    tolerance: int = 0  # frames by which two tracklets of one camera have to be apart
    least_dets: int = 6
    least_vectors: int = 1
    geo_weight: float = 0.0
    geo_least: int = 8  # places in common frames, before they count
    near: float = 300.0
    far: float = 2000.0


@dataclass
class Person:
    total: np.ndarray
    n: int = 0
    spans: list[tuple[int, int, int]] = field(default_factory=list)  # camera, first and last frame
    places: list[tuple[int, int, float, float]] = field(default_factory=list)  # frame, camera, x, y


class Meetings:
    """Who one camera has at once (within a tolerance), kept up as spans come in.

    Spans are listed by camera and stretch of frames, so a new one is compared with those of
    its own stretches only.  Spans are never taken back, so those who have met stay so.
    """

    def __init__(self, tolerance: int, stretch: int):
        self.tolerance, self.stretch = tolerance, max(1, stretch)
        self.of: dict[int, set[int]] = {}
        self.listed: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def add(self, gid: int, cam: int, lo: int, hi: int) -> None:
        if lo > hi + self.tolerance:
            return
        for k in range((lo - self.tolerance) // self.stretch, (max(lo, hi) + self.tolerance) // self.stretch + 1):
            here = self.listed.setdefault((cam, k), [])
            for x, y, other in here:
                if other != gid and lo <= y + self.tolerance and x <= hi + self.tolerance:
                    self.of.setdefault(gid, set()).add(other)
                    self.of.setdefault(other, set()).add(gid)
            here.append((lo, hi, gid))


class SceneFusion:
    """Persons of a scene, the best partners of each, and what has merged.

    ``step`` takes the tracklets that a window adds.  A person keeps the first ``room`` of its
    partners from the threshold on, and the last of them where there are more; rows of the score
    matrix are computed for changed persons, and for one that has lost so many partners that
    its proposals are no longer among those it keeps.  A merge is told once, so where all
    persons have merged already, nothing is scored until another comes; and only connected
    parts of the proposals that hold a change, and persons still apart, are merged again.
    """

    def __init__(self, rules: FusionRules, keep: bool = True):
        self.rules, self.keep = rules, keep  # spans and places are kept with a person for a state to be stored
        self.persons: dict[int, Person] = {}
        self.gone: dict[int, int] = {}
        self.touched: set[int] = set()
        self.scored = 0  # pairs, since the beginning
        self.foes, self.together = Meetings(rules.tolerance, rules.window), Meetings(0, rules.window)
        self.in_frame: dict[int, list[tuple[int, int, float, float]]] = {}
        self.away: dict[tuple[int, int], list[float]] = {}  # sorted distances of two persons in common frames
        self.closeness: dict[int, dict[int, float]] = {}
        self.at: dict[int, int] = {}  # persons are rows of the arrays below, in the order they came
        self.stale: set[int] = set()  # rows that have changed since they were scored
        self.room = 2 * (rules.k + 1) + 4
        self.gid = np.zeros(0, np.int64)
        self.end = np.zeros(0, np.int64)  # the id that each is under now
        self.known = np.zeros(0, bool)
        self.unit = np.zeros((0, 0))
        self.partner = np.zeros((0, self.room), np.int64)  # rows, best first
        self.score = np.zeros((0, self.room))  # -inf: no partner
        self.last = np.zeros(0)  # score and id of the last partner that is kept; -inf: all are
        self.last_gid = np.zeros(0, np.int64)

    def end_of(self, gid: int) -> int:
        while gid in self.gone:
            gid = self.gone[gid]
        return gid

    def _row(self, gid: int, dim: int) -> int:
        if gid in self.at:
            return self.at[gid]
        i = self.at[gid] = len(self.at)
        if i >= len(self.gid):
            more = max(64, len(self.gid))
            wide = lambda x, fill: np.concatenate([x, np.full((more, *x.shape[1:]), fill, x.dtype)])
            self.gid, self.end, self.known = wide(self.gid, 0), wide(self.end, 0), wide(self.known, False)
            self.unit = wide(self.unit if self.unit.shape[1] else np.zeros((len(self.unit), dim)), 0.0)
            self.partner, self.score, self.last, self.last_gid = wide(self.partner, 0), wide(self.score, -np.inf), wide(self.last, -np.inf), wide(self.last_gid, 0)
        self.gid[i], self.end[i] = gid, self.end_of(gid)
        return i

    def load(self, persons: dict[int, tuple[Person, list[int], list[float], float, int, bool]], gone: dict[int, int]) -> None:
        """Takes up a stored state: persons with what ``stored`` gives, and merges."""
        self.gone, self.persons = dict(gone), {g: x[0] for g, x in persons.items()}
        for g, (p, *_) in persons.items():
            self._row(g, len(p.total))
        for g, (p, partners, scores, last, last_gid, stale) in persons.items():
            i = self.at[g]
            self._sum_up(i, p)
            self.partner[i, : len(partners)], self.score[i, : len(scores)] = [self.at[h] for h in partners], scores
            self.last[i], self.last_gid[i] = last, last_gid
            self._list(g, p.spans, p.places)
            if stale:
                self.stale.add(i)

    def stored(self, gid: int) -> tuple[list[int], list[float], float, int, bool]:
        """A person's partners, their scores, the score and id of the last if there are more, and whether it has changed since."""
        i = self.at[gid]
        have = np.isfinite(self.score[i])
        return self.gid[self.partner[i, have]].tolist(), self.score[i, have].tolist(), float(self.last[i]), int(self.last_gid[i]), i in self.stale

    def _sum_up(self, i: int, p: Person) -> None:
        size = float(np.linalg.norm(p.total))
        self.known[i] = p.n >= self.rules.least_vectors and size > 0
        if self.known[i]:
            self.unit[i] = p.total / size

    def step(self, rows: list[tuple], end: int) -> list[tuple]:
        """(event_frame, window_end, source, target, score) of the merges that are new.

        rows: cam_id, global_id, start_frame, end_frame, v, n, places (frame, x, y).
        """
        changed = {}
        for cam, gid, lo, hi, v, n, places in rows:
            p = self.persons.get(gid)
            if p is None:
                p = self.persons[gid] = Person(np.zeros(len(v)))
            p.total = p.total + np.asarray(v, float) * n
            p.n += n
            at = [(f, cam, x, y) for f, x, y in places or ()]
            if self.keep:
                p.spans.append((cam, lo, hi))
                p.places += at
            self._list(gid, [(cam, lo, hi)], at)
            changed[gid] = p
        for gid, p in changed.items():
            i = self._row(gid, len(p.total))
            self._sum_up(i, p)
            self.stale.add(i)
        self.touched |= changed.keys()
        ends = self.end[: len(self.at)][self.known[: len(self.at)]]
        if not len(ends) or (ends == ends[0]).all():
            return []  # whatever merges now has been told
        return self._events(self._rescore(), end)

    def _list(self, gid: int, spans: list[tuple[int, int, int]], places: list[tuple[int, int, float, float]]) -> None:
        """Takes up spans and places of a person, be it by a step or with a loaded state."""
        for span in spans:
            self.foes.add(gid, *span)
            if self.rules.geo_weight > 0:
                self.together.add(gid, *span)
        if self.rules.geo_weight > 0:
            for f, cam, x, y in places:
                here = self.in_frame.setdefault(f, [])
                for other, i, u, w in here:
                    if other != gid and i != cam:
                        self._apart(gid, other, float(np.hypot(x - u, y - w)))
                here.append((gid, cam, x, y))

    def _apart(self, g: int, h: int, distance: float) -> None:
        r, d = self.rules, self.away.setdefault((min(g, h), max(g, h)), [])
        bisect.insort(d, distance)
        if len(d) >= r.geo_least:
            median = (d[(len(d) - 1) // 2] + d[len(d) // 2]) / 2
            near = float(np.exp(-3 * max(0.0, (median - r.near) / (r.far - r.near)) ** 2))
            self.closeness.setdefault(g, {})[h] = self.closeness.setdefault(h, {})[g] = near

    def _scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of ``rows`` against all persons; -inf with itself and with those that don't count.  Rounded, so that ties don't depend on the shape of the product."""
        n = len(self.at)
        score = self.unit[rows] @ self.unit[:n].T
        self.scored += int(self.known[:n].sum()) * len(rows)
        if self.rules.geo_weight > 0:
            score = self._blended(score, rows)
        score = np.round(score, 12)
        score[:, ~self.known[:n]] = -np.inf
        score[np.arange(len(rows)), rows] = -np.inf
        return score

    def _blended(self, score: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(1 - weight) * cosine + weight * closeness of places in common frames (0 without); the cosine alone for persons that meet."""
        weight = self.rules.geo_weight
        out = (1 - weight) * score
        for i, g in enumerate(self.gid[rows].tolist()):
            near = self.closeness.get(g)
            if near:
                out[i, [self.at[h] for h in near]] += weight * np.array(list(near.values()))
            met = [self.at[h] for h in self.together.of.get(g, ())]
            out[i, met] = score[i, met]
        return out

    def _keep(self, rows: np.ndarray, owner: np.ndarray, partner: np.ndarray, score: np.ndarray) -> None:
        """Gives ``rows`` the best of the partners that are listed by ``owner``, and the last of them where one is left out."""
        order = np.lexsort((self.gid[partner], -score, owner))
        owner, partner, score = owner[order], partner[order], score[order]
        first = np.searchsorted(owner, owner)
        rank = np.arange(len(owner)) - first
        self.score[rows] = -np.inf
        kept, full = rank < self.room, owner[rank == self.room]
        self.partner[owner[kept], rank[kept]], self.score[owner[kept], rank[kept]] = partner[kept], score[kept]
        self.last[full], self.last_gid[full] = self.score[full, -1], self.gid[self.partner[full, -1]]

    def _blocks(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``rows`` with their scores, some 4 M at a time."""
        step = max(1, 4_000_000 // max(1, len(self.at)))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            yield part, self._scores(part)

    def _renew(self, part: np.ndarray, score: np.ndarray) -> None:
        """The partners of ``part`` from whole rows of scores."""
        least = np.full(len(part), self.rules.threshold)
        if score.shape[1] > self.room + 1:  # one more than is kept, and what ties with it
            least = np.maximum(least, np.partition(score, score.shape[1] - self.room - 1, axis=1)[:, score.shape[1] - self.room - 1])
        i, j = np.nonzero(score >= least[:, None])
        self.last[part] = -np.inf
        self._keep(part, part[i], j, score[i, j])

    def _rescore(self) -> np.ndarray:
        """Renews the partners of changed persons, and with them those of others; the rows that may propose others now, as a mask."""
        n = len(self.at)
        stale = np.array(sorted(self.stale), np.int64)
        self.stale.clear()
        changed = np.zeros(n, bool)
        changed[stale] = True
        held = np.isfinite(self.score[:n])
        hit = held & changed[self.partner[:n]]
        affected = changed | hit.any(1)
        self.score[stale] = -np.inf
        self.last[stale] = -np.inf
        found = []
        for part, score in self._blocks(stale[self.known[stale]]):
            self._renew(part, score)
            score[:, changed] = -np.inf
            last = self.last[:n]
            i, j = np.nonzero((score >= self.rules.threshold) & (score >= last))
            s, g = score[i, j], part[i]
            before = (s > last[j]) | (self.gid[g] < self.last_gid[j])
            found.append((j[before], g[before], s[before]))
        owner, partner, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        affected[owner] = True
        rows = np.flatnonzero(affected & ~changed)
        left = held[rows] & ~hit[rows]
        i, j = np.nonzero(left)
        self._keep(rows, np.concatenate([rows[i], owner]), np.concatenate([self.partner[rows[i], j], partner]), np.concatenate([self.score[rows[i], j], score]))
        short = rows[np.isfinite(self.last[rows]) & ~np.isfinite(self.score[rows, self.rules.k])]
        for part, score in self._blocks(short):
            self._renew(part, score)
        self.touched.update(self.gid[:n][affected].tolist())
        return affected

    def _proposals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, partner, score) of the best partners of each; none if the second is too near the best."""
        n, k = len(self.at), self.rules.k
        clear = ~(self.score[:n, 0] < self.score[:n, 1] + self.rules.margin)
        i, j = np.nonzero(np.isfinite(self.score[:n, :k]) & clear[:, None])
        return i, self.partner[i, j], self.score[i, j]

    def _events(self, affected: np.ndarray, end: int) -> list[tuple]:
        a, b, score = self._proposals()
        size = 0
        while size != (size := int(affected.sum())):  # the connected parts that hold a change
            affected[a[affected[b]]] = True
            affected[b[affected[a]]] = True
        here = affected[a]
        a, b, score = a[here], b[here], score[here]
        if not len(a) or (self.end[a] == self.end[a[0]]).all() and (self.end[b] == self.end[a[0]]).all():
            return []
        lo, hi = np.minimum(self.gid[a], self.gid[b]), np.maximum(self.gid[a], self.gid[b])
        order = np.lexsort((hi, lo, -score))
        once = np.ones(len(order), bool)  # of a pair that both propose
        once[1:] = (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0) | (np.diff(score[order]) != 0)
        order = order[once]
        root = self.gid[: len(self.at)].tolist()
        members: dict[int, list[int]] = {}
        foes: dict[int, set[int]] = {}
        none: set[int] = set()
        out = []
        for i, j, s in zip(a[order].tolist(), b[order].tolist(), score[order].tolist(), strict=True):
            p, q = root[i], root[j]
            if p == q:
                continue
            # Foes are so both ways: the members of the smaller side are looked up among the foes of the larger.
            of_p, of_q = members.get(p) or [p], members.get(q) or [q]
            if len(of_p) < len(of_q):
                p, q, of_p, of_q = q, p, of_q, of_p
            if not (foes.get(p) or self.foes.of.get(p, none)).isdisjoint(of_q):
                continue
            more = foes.pop(q, None) or self.foes.of.get(q, none)
            if p in members:
                members[p] += of_q
                foes[p] |= more
            else:
                members[p], foes[p] = of_p + of_q, self.foes.of.get(p, none) | more
            for x in of_q:
                root[self.at[x]] = p
            members.pop(q, None)
            lo, hi = sorted((int(self.end[i]), int(self.end[j])))
            if lo != hi:
                self.gone[hi] = lo
                self.end[self.end == hi] = lo
                out.append((end + self.rules.delay, end, hi, lo, round(s, 6)))
        return out


EVENT = ["scene", "event_frame", "window_end", "source", "target", "score"]
EVENTS = "scene long, event_frame long, window_end long, source long, target long, score double"


def usable(tracklets: DataFrame, rules: FusionRules) -> DataFrame:
    """The columns that fusion reads, of tracklets with boxes enough and a vector; ``places`` may be missing."""
    places = F.col("places") if "places" in tracklets.columns else F.lit(None).cast("array<struct<frame_no: long, x: double, y: double>>")
    t = tracklets.where((F.col("num_detections") >= rules.least_dets) & F.col("v").isNotNull())
    return t.select("scene", "cam_id", "global_id", "start_frame", "end_frame", "v", "n", places.alias("places"), *[c for c in ("event_time",) if c in tracklets.columns])


def as_rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    for cam, gid, lo, hi, v, n, places in pdf[["cam_id", "global_id", "start_frame", "end_frame", "v", "n", "places"]].itertuples(index=False, name=None):
        yield int(cam), int(gid), int(lo), int(hi), v, int(n), [(int(p["frame_no"]), float(p["x"]), float(p["y"])) for p in places] if places is not None else []


def windowed(tracklets: DataFrame, rules: FusionRules) -> DataFrame:
    """Merge events as windows close: (scene, event_frame, window_end, source, target, score).

    At each window's end persons are summed up from the tracklets that have ended, candidate
    pairs (score, margin, ``k`` each) merge greedily unless two of one camera overlap in
    time, and merges that are new become events, ``delay`` frames later.  The last window
    ends with the last tracklet.  A scene's tracklets stream through a task in the order of
    their ends; only its persons are held.
    tracklets: scene, cam_id, global_id, start_frame, end_frame, num_detections, v (unit), n,
    and with a geo weight places (frame_no, x, y).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scene, fusion, waiting, until = None, None, [], 0

        def close(end: int) -> list[tuple]:
            rows, waiting[:] = list(waiting), []
            return [(scene, *e) for e in fusion.step(rows, end)] if rows else []

        for pdf in itertools.chain(batches, [None]):
            out = []
            if pdf is None:
                out = close(min(until, max(r[3] for r in waiting))) if waiting else []
            else:
                for s, row in zip(pdf.scene.tolist(), as_rows(pdf), strict=True):
                    boundary = max(1, -(-row[3] // rules.window)) * rules.window
                    if s != scene:
                        out += close(min(until, max(r[3] for r in waiting))) if waiting else []
                        scene, fusion = s, SceneFusion(rules, keep=False)
                    elif boundary > until:
                        out += close(until)
                    until = boundary
                    waiting.append(row)
            yield pd.DataFrame(out, columns=EVENT)

    n = int(tracklets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By ranges: hashes of a few scenes would put several in one task while others have none.
    t = usable(tracklets, rules).repartitionByRange(n, "scene").sortWithinPartitions("scene", "end_frame", "global_id", "cam_id", "start_frame")
    return t.mapInPandas(run, EVENTS)
