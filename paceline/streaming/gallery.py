"""A live gallery of identities over the cameras of a site, batch and stream.

A site is tables of arrays: tracks, identities, and prototypes (a matrix with the
identity, camera and frame of each row).  A frame's boxes meet them all at once: one
product of vectors gives the scores of all boxes and identities, and each rule is a mask
over that matrix.  Rules in order: old tracks and identities expire; boxes refresh their
tracks, which sample vectors; of two tracks of one camera under one identity the weaker is
released; identities take sampled vectors as prototypes; tracks without an identity are
assigned one to one within their camera; from time to time young duplicates merge into
older ones.

On a stream a frame's boxes are held until the watermark has passed its time, so it may be
split over batches, and batches may come in any order within the allowed lateness.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.identity import assign


@dataclass(frozen=True)
class GalleryRules:
    """The defaults of the rules."""

    threshold: float = 0.68
    switch_margin: float = 0.12  # another identity than the track's last has to be better by this
    ambiguity: float = 0.06  # the best has to be better than the second by this
    sample_every: int = 5  # frames
    track_vectors: int = 8
    least_vectors: int = 3  # of a track, before their mean stands for it
    track_age: int = 1800
    gallery_age: int = 1800
    prototypes: int = 24
    prototype_below: float = 0.72
    candidates: int = 80
    geo_weight: float = 0.35
    close_only: bool = False  # blend places in only for identities whose vectors come near the best
    geo_margin: float = 1.0
    merge: bool = True
    merge_every: int = 5
    merge_threshold: float = 0.76
    merge_margin: float = 0.04
    merge_vectors: int = 6
    near: float = 300.0
    far: float = 2000.0


NONE = -1  # no identity, no frame
TRACK = {"cam": np.int64, "track": np.int64, "gid": np.int64, "seen": np.int64, "sampled": np.int64, "n": np.int64, "x": float, "y": float}


def _rows(table: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: a[which] for k, a in table.items()}


def _joined(table: dict[str, np.ndarray], more: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([a, np.asarray(more[k], a.dtype).reshape((-1, *a.shape[1:]))]) for k, a in table.items()}


def _among(a: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which of ``a`` are among a frame's ``few`` values."""
    return (a[:, None] == few[None]).any(1)


class SiteGallery:
    """The tables of one site; ``frame`` takes the boxes of a frame of all its cameras.

    Vectors have ``dim`` components; a zero row is no vector.
    """

    def __init__(self, rules: GalleryRules, dim: int, fresh: int = 1):
        self.rules, self.dim, self.fresh = rules, dim, fresh
        self.tracks = {k: np.zeros(0, t) for k, t in TRACK.items()} | {"v": np.zeros((0, rules.track_vectors, dim))}
        self.known = {"gid": np.zeros(0, np.int64), "seen": np.zeros(0, np.int64)}
        self.proto = {"gid": np.zeros(0, np.int64), "cam": np.zeros(0, np.int64), "frame": np.zeros(0, np.int64), "v": np.zeros((0, dim))}
        self.touched_tracks: set[tuple[int, int]] = set()
        self.touched_ids: set[int] = set()
        self._order: tuple | None = None  # prototypes by identity, of the tables that it was made from
        self._place: tuple | None = None  # row of each track, likewise

    def add_tracks(self, rows: dict) -> None:
        self.tracks = _joined(self.tracks, rows)

    def add_identities(self, gid, seen) -> None:
        self.known = _joined(self.known, {"gid": gid, "seen": seen})

    def add_prototypes(self, gid, cam, frame, v) -> None:
        self.proto = _joined(self.proto, {"gid": gid, "cam": cam, "frame": frame, "v": v})

    def scores(self, q: np.ndarray, cam: np.ndarray | None = None) -> np.ndarray:
        """Of each row of ``q`` with each identity: the best product with a prototype (of the row's camera, if given); 0 without one."""
        out = np.full((len(q), len(self.known["gid"])), -np.inf)
        if self._order is None or self._order[0] is not self.proto or self._order[1] is not self.known:
            at = np.searchsorted(self.known["gid"], self.proto["gid"])
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            self._order = self.proto, self.known, order, first, at[order][first]
        _, _, order, first, whose = self._order
        dots = q @ self.proto["v"].T
        if cam is not None:
            dots = np.where(cam[:, None] == self.proto["cam"][None], dots, -np.inf)
        if len(first):
            out[:, whose] = np.maximum.reduceat(dots[:, order], first, axis=1)
        out[~np.isfinite(out)] = 0.0
        out[~q.any(1)] = 0.0
        return out

    def closeness(self, cam: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How near each row's place is to an identity's last places in other cameras; 0 if none is known."""
        r, t = self.rules, self.tracks
        out = np.zeros((len(cam), len(self.known["gid"])))
        has = (t["gid"] != NONE) & ~np.isnan(t["x"]) & np.isin(t["gid"], self.known["gid"])
        if not has.any():
            return out
        away = np.hypot(place[:, :1] - t["x"][has], place[:, 1:] - t["y"][has])
        near = np.exp(-3 * np.maximum(0.0, (away - r.near) / (r.far - r.near)) ** 2)
        near = np.where(np.isnan(near) | (cam[:, None] == t["cam"][has][None]), 0.0, near)
        at = np.searchsorted(self.known["gid"], t["gid"][has])
        for k in range(len(cam)):
            np.maximum.at(out[k], at, near[k])
        return out

    def blended(self, scores: np.ndarray, cam: np.ndarray, place: np.ndarray) -> np.ndarray:
        w = self.rules.geo_weight
        near = self.closeness(cam, place) if w > 0 else np.zeros_like(scores)
        return np.where(near == 0, scores, (1 - w) * scores + w * near)

    def lately_seen(self, at: int, allowed: np.ndarray) -> np.ndarray:
        """Of the ``allowed`` identities of each row those seen last (of these the largest), a bounded number."""
        if (allowed.sum(1) <= self.rules.candidates).all():
            return allowed
        order = np.lexsort((-self.known["gid"], at - self.known["seen"]))
        out = np.zeros_like(allowed)
        out[:, order] = allowed[:, order] & (np.cumsum(allowed[:, order], axis=1) <= self.rules.candidates)
        return out

    def expire(self, at: int) -> None:
        r, t = self.rules, self.tracks
        old = at - self.known["seen"] > r.gallery_age
        if old.any():
            gone = self.known["gid"][old]
            self.touched_ids |= set(gone.tolist())
            self.known, self.proto = _rows(self.known, ~old), _rows(self.proto, ~np.isin(self.proto["gid"], gone))
            lost = np.isin(t["gid"], gone)
            t["gid"][lost] = NONE
            self._touch(np.flatnonzero(lost))
        old = at - t["seen"] > r.track_age
        if old.any():
            self._touch(np.flatnonzero(old))
            self.tracks = _rows(t, ~old)

    def _touch(self, rows: np.ndarray) -> None:
        self.touched_tracks |= set(zip(self.tracks["cam"][rows].tolist(), self.tracks["track"][rows].tolist(), strict=True))

    def _rows_of(self, cam: np.ndarray, track: np.ndarray, at: int) -> np.ndarray:
        """The rows of these tracks; those not known yet are added."""
        if self._place is None or self._place[0] is not self.tracks:
            self._place = self.tracks, {k: i for i, k in enumerate(zip(self.tracks["cam"].tolist(), self.tracks["track"].tolist(), strict=True))}
        have = self._place[1]
        keys = list(zip(cam.tolist(), track.tolist(), strict=True))
        new = [k for k in keys if k not in have]
        if new:
            n = len(new)
            self.add_tracks({"cam": [k[0] for k in new], "track": [k[1] for k in new], "gid": [NONE] * n, "seen": [at] * n, "sampled": [NONE] * n, "n": [0] * n, "x": [np.nan] * n, "y": [np.nan] * n, "v": np.zeros((n, self.rules.track_vectors, self.dim))})
            have.update({k: len(have) + i for i, k in enumerate(new)})
            self._place = self.tracks, have
        return np.array([have[k] for k in keys], np.int64)

    def refresh(self, row: np.ndarray, v: np.ndarray, good: np.ndarray, place: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(query vectors, whether to learn) of the boxes; their tracks take up places and, when due, vectors."""
        r, t = self.rules, self.tracks
        t["seen"][row] = at
        there = ~np.isnan(place).any(1)
        t["x"][row[there]], t["y"][row[there]] = place[there, 0], place[there, 1]
        due = (t["n"][row] < r.least_vectors) | (t["sampled"][row] == NONE) | (at - t["sampled"][row] >= r.sample_every)
        learn = v.any(1) & good & due
        mine = row[learn]
        t["v"][mine] = np.concatenate([t["v"][mine][:, 1:], v[learn][:, None]], axis=1)  # newest last
        t["n"][mine] = np.minimum(t["n"][mine] + 1, r.track_vectors)
        t["sampled"][mine] = at
        total = t["v"][row].sum(1)
        size = np.sqrt((total * total).sum(1))
        stands = (t["n"][row] >= r.least_vectors) & (size > 0)
        query = np.where(stands[:, None], total / np.maximum(size, 1e-300)[:, None], v)
        self._touch(row)
        return query, learn

    def release(self, b: dict, at: int) -> None:
        """Of a camera's tracks under one identity the one with most vectors keeps it (then score, then lower track)."""
        held = np.flatnonzero(b["gid"] != NONE)
        gid = b["gid"][held]
        if len(set(zip(b["cam"][held].tolist(), gid.tolist(), strict=True))) == len(held):
            return
        place = np.searchsorted(self.known["gid"], gid)
        known = np.isin(gid, self.known["gid"])
        score = np.zeros(len(held))
        score[known] = self.scores(b["query"][held])[np.flatnonzero(known), place[known]]
        order = np.lexsort((b["track"][held], -score, -self.tracks["n"][b["row"][held]], gid, b["cam"][held]))
        first = np.ones(len(held), bool)
        c, g = b["cam"][held][order], gid[order]
        first[1:] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        lost = held[order[~first]]
        b["gid"][lost], b["learn"][lost] = NONE, False

    def learn(self, b: dict, which: np.ndarray, at: int) -> None:
        """Boxes' identities are seen now, and take the vectors of those that are due as prototypes."""
        if not len(which):
            return
        gid, cam = b["gid"][which], b["cam"][which]
        new = np.unique(gid[~_among(gid, self.known["gid"])])
        if len(new):
            merged = _joined(self.known, {"gid": new, "seen": np.full(len(new), at)})
            self.known = _rows(merged, np.argsort(merged["gid"]))
        self.known["seen"][np.searchsorted(self.known["gid"], gid)] = at
        self.tracks["gid"][b["row"][which]] = gid
        self.touched_ids |= set(gid.tolist())
        self._touch(b["row"][which])
        due = b["learn"][which]
        b["learn"][which] = False
        which, gid, cam = which[due], gid[due], cam[due]
        if not len(which):
            return
        own = np.flatnonzero(_among(self.proto["gid"], gid))
        same = (self.proto["gid"][own][None] == gid[:, None]) & (self.proto["cam"][own][None] == cam[:, None])
        score = np.where(same, b["v"][which] @ self.proto["v"][own].T, -np.inf).max(1, initial=-np.inf)
        take = ~same.any(1) | (score < self.rules.prototype_below)
        if take.any():
            self._add_last(gid[take], cam[take], at, b["v"][which[take]])

    def _add_last(self, gid: np.ndarray, cam: np.ndarray, at: int, v: np.ndarray) -> None:
        """New prototypes; of each of these identities the last are kept."""
        for k, g in enumerate(gid):
            mine = np.flatnonzero(self.proto["gid"] == g)
            new = {"gid": [g], "cam": [cam[k]], "frame": [at], "v": v[k]}
            if len(mine) < self.rules.prototypes:
                self.proto = _joined(self.proto, new)
                continue
            for c, a in self.proto.items():  # a full one's move up by one place
                a[mine[:-1]] = a[mine[1:]]
                a[mine[-1]] = new[c] if c == "v" else new[c][0]

    def worth(self, b: dict, new: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """What each of the ``open_`` identities is worth to each new box; -1 where the rules forbid it."""
        r, q = self.rules, b["query"][new]
        every = self.scores(q)
        s = np.where(open_, every, -np.inf)
        best = s.max(1, initial=0.0)
        # The best other identity: the second where an identity is the best itself.
        top = np.sort(np.where(open_, every, 0.0), axis=1)
        top = np.concatenate([np.zeros((len(new), 2)), top], axis=1)
        is_best = open_ & (every == top[:, -1:]) & (np.cumsum(open_ & (every == top[:, -1:]), axis=1) == 1)
        other = np.where(is_best, top[:, -2:-1], top[:, -1:])
        last = b["last"][new]
        at = np.searchsorted(self.known["gid"], last)
        had = np.isin(last, self.known["gid"])
        own = np.zeros(len(new))
        own[had] = every[np.flatnonzero(had), at[had]]
        same = self.known["gid"][None] == last[:, None]
        switch = had[:, None] & (every < own[:, None] + r.switch_margin)
        unclear = (other > 0) & (every < other + r.ambiguity)
        ok = open_ & q.any(1)[:, None] & (every >= r.threshold) & (same | ~(switch | unclear))
        near = ~(r.close_only & (best[:, None] - every > r.geo_margin))
        return np.where(ok, np.where(near, self.blended(every, b["cam"][new], b["place"][new]), every), -1.0)

    def place(self, b: dict, at: int) -> None:
        """New tracks of each camera compete one to one for identities; each also has a place for a new one."""
        for cam in np.unique(b["cam"]):
            mine = b["cam"] == cam
            new = np.flatnonzero(mine & (b["gid"] == NONE))
            if not len(new):
                continue
            open_ = ~_among(self.known["gid"], b["gid"][mine])
            open_ = np.repeat(self.lately_seen(at, open_[None]), len(new), axis=0)
            worth = self.worth(b, new, open_)
            cols = np.flatnonzero(open_[0])
            for i, j in assign(-np.concatenate([worth[:, cols], np.zeros((len(new), len(new)))], axis=1)):
                k = new[i]
                if j < len(cols) and worth[i, cols[j]] > 0:
                    b["gid"][k] = self.known["gid"][cols[j]]
                elif b["good"][k] and b["v"][k].any():  # poor vectors wait for better ones
                    while self.fresh in self.known["gid"]:
                        self.fresh += 1
                    b["gid"][k] = self.fresh
                    self.fresh += 1
            self.learn(b, new[b["gid"][new] != NONE], at)

    def merge(self, b: dict, at: int) -> None:
        """Young duplicates go into an older identity that no track of the same camera has now."""
        r, done = self.rules, 0
        while done < len(b["gid"]):
            ids = self.known["gid"]
            shown = {c: b["gid"][b["cam"] == c] for c in np.unique(b["cam"]).tolist()}
            active = {c: _among(ids, shown[c]) for c in shown}
            active = np.stack([active[c] for c in b["cam"].tolist()])
            cand = self.lately_seen(at, ~active & (ids[None] < b["gid"][:, None]))
            s = np.where(cand, self.blended(self.scores(b["query"]), b["cam"], b["place"]), -np.inf)
            two = -np.sort(-np.concatenate([s, np.full((len(s), 2), -np.inf)], axis=1), axis=1)[:, :2]
            apart = np.zeros_like(cand)  # an identity stays one track of a camera
            for gids in shown.values():
                apart |= _among(b["gid"], gids)[:, None] & _among(ids, gids)[None]
            ready = _among(b["gid"], ids) & (self.tracks["n"][b["row"]] >= r.merge_vectors) & b["query"].any(1)
            ready &= (two[:, 0] >= r.merge_threshold) & ~((two[:, 1] > 0) & (two[:, 0] < two[:, 1] + r.merge_margin)) & (np.arange(len(ready)) >= done)
            pick = s.argmax(1) if s.shape[1] else np.zeros(len(s), int)
            go = [k for k in np.flatnonzero(ready) if not apart[k, pick[k]]]
            if not go:
                return
            source, target = int(b["gid"][go[0]]), int(ids[pick[go[0]]])
            self.unite(source, target)
            b["gid"][b["gid"] == source] = target
            done = go[0] + 1  # those before have had their turn

    def unite(self, source: int, target: int) -> None:
        k = np.isin(self.known["gid"], [source, target])
        self.known["seen"][k] = self.known["seen"][k].max()
        self.known = _rows(self.known, self.known["gid"] != source)
        # The younger one's prototypes come after the older's, of each frame.
        own, theirs = np.flatnonzero(self.proto["gid"] == target), np.flatnonzero(self.proto["gid"] == source)
        both = np.concatenate([own, theirs])
        both = both[np.argsort(self.proto["frame"][both], kind="stable")]
        rest = np.setdiff1d(np.arange(len(self.proto["gid"])), both)
        self.proto["gid"][theirs] = target
        self.proto = _rows(self.proto, np.concatenate([rest, both[-self.rules.prototypes :]]))
        moved = np.flatnonzero(self.tracks["gid"] == source)
        self.tracks["gid"][moved] = target
        self._touch(moved)
        self.touched_ids |= {source, target}

    def frame(self, at: int, det: np.ndarray, cam: np.ndarray, track: np.ndarray, v: np.ndarray, good: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
        """(det, identity or -1) of a frame's boxes; of several boxes of one track the first stands for it."""
        self.expire(at)
        order = np.lexsort((det, track, cam))
        first = np.ones(len(order), bool)
        first[1:] = (cam[order][1:] != cam[order][:-1]) | (track[order][1:] != track[order][:-1])
        use = order[first]
        row = self._rows_of(cam[use], track[use], at)
        b = {"cam": cam[use], "track": track[use], "row": row, "v": v[use], "good": good[use], "place": place[use]}
        b["gid"] = self.tracks["gid"][row].copy()
        b["last"] = b["gid"].copy()
        b["query"], b["learn"] = self.refresh(row, b["v"], b["good"], b["place"], at)
        self.release(b, at)
        self.learn(b, np.flatnonzero(b["gid"] != NONE), at)
        self.place(b, at)
        if self.rules.merge and at % self.rules.merge_every == 0:
            self.merge(b, at)
        self.tracks["gid"][row] = b["gid"]
        ids = b["gid"][np.cumsum(first) - 1]
        return list(zip(det[order].tolist(), ids.tolist(), strict=True))


def _arrays(rows: pd.DataFrame, dim: int) -> tuple[np.ndarray, ...]:
    """det, cam, track, v, good and place of the rows, as a gallery takes them; vectors of another length than ``dim`` count as none."""
    v = np.zeros((len(rows), dim))
    for k, x in enumerate(rows.embedding):
        if x is not None and len(x) == dim:
            n = np.linalg.norm(x)
            if n > 0 and np.isfinite(n):
                v[k] = np.asarray(x, float) / n
    return (*(rows[c].to_numpy(np.int64) for c in ("det_id", "cam_id", "local_track_id")), v, rows.good.fillna(False).to_numpy(bool), rows[["x", "y"]].to_numpy(float))


def _take_frame(g: SiteGallery, at: int, rows: pd.DataFrame) -> list[tuple[int, int]]:
    """One frame's rows through the gallery."""
    return g.frame(at, *_arrays(rows, g.dim))


COLUMNS = ["det_id", "cam_id", "local_track_id", "embedding", "good", "x", "y"]


def gallery_ids(boxes: DataFrame, dim: int, rules: GalleryRules = GalleryRules()) -> DataFrame:
    """(site, det_id, global_id; -1 while a track waits) of all boxes, by the same rules as on a stream.

    What a frame does depends on those before: a site's frames pass through a task in order,
    which holds the site's live tracks and identities.  boxes: site, frame_no, cam_id, det_id,
    local_track_id, embedding (``dim`` components, or null), good, x, y.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, g, rest = None, None, None
        for batch in _with_end(batches):
            if batch is not None:
                batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
                if not len(batch):
                    continue
                open_ = (batch.site == batch.site.iloc[-1]) & (batch.frame_no == batch.frame_no.iloc[-1])
                rest, batch = batch[open_], batch[~open_]
            else:
                batch, rest = rest, None
            out = []
            if batch is not None and len(batch):
                key = batch[["site", "frame_no"]].to_numpy(np.int64)
                whole = _arrays(batch, dim)
                bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
                for lo, hi in zip(bounds, bounds[1:], strict=False):
                    s, at = key[lo].tolist()
                    if s != site:
                        site, g = s, SiteGallery(rules, dim)
                    out += [(s, *x) for x in g.frame(at, *(a[lo:hi] for a in whole))]
            yield pd.DataFrame(out, columns=["site", "det_id", "global_id"]).astype("int64")

    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = boxes.select("site", "frame_no", *COLUMNS).repartition(n, "site").sortWithinPartitions("site", "frame_no")
    return rows.mapInPandas(run, "site long, det_id long, global_id long")


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


TRACK_STATE = "gid long, seen long, sampled long, n long, x double, y double, v array<array<double>>"
ID_STATE = "seen long, cams array<long>, frames array<long>, vectors array<array<double>>"
HELD = "det array<long>, cam array<long>, track array<long>, v array<array<double>>, good array<boolean>, x array<double>, y array<double>"


class RuledGallery(StatefulProcessor):
    """``SiteGallery`` on a stream: frames wait for the watermark, then pass the rules in order.

    State is the boxes of frames that are not over yet, and tracks and identities as entries of
    two maps, of which those that a frame has changed are written.
    """

    def __init__(self, rules: GalleryRules, dim: int):
        self.rules, self.dim = rules, dim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at long, frame long", HELD)
        self.tracks = handle.getMapState("tracks", "cam long, track long", TRACK_STATE)
        self.known = handle.getMapState("known", "gid long", ID_STATE)
        self.next = handle.getValueState("next", "gid long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch["at"] = batch.event_time.astype("datetime64[ms]").astype("int64")
        for (at, frame), part in batch.groupby(["at", "frame_no"]):
            cols = [part[c].astype("int64").tolist() for c in COLUMNS[:3]]
            cols += [[None if x is None else list(map(float, x)) for x in part.embedding], part.good.fillna(False).astype(bool).tolist()]
            cols += [[None if pd.isna(x) else float(x) for x in part[c]] for c in ("x", "y")]
            k = (int(at), int(frame))
            if self.held.containsKey(k):
                cols = [list(a) + b for a, b in zip(self.held.getValue(k), cols, strict=True)]
            self.held.updateValue(k, tuple(cols))
            self.handle.registerTimer(int(at))
        yield pd.DataFrame({"site": [], "det_id": [], "global_id": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(tuple(k) for k in self.held.keys() if k[0] <= now)
        g = self._load() if due else None
        out = []
        for k in due:
            rows = pd.DataFrame(dict(zip(COLUMNS, self.held.getValue(k), strict=True))).astype({"x": float, "y": float})
            out += [(key[0], *x) for x in _take_frame(g, k[1], rows)]
            self.held.removeKey(k)
        if due:
            self._store(g)
        yield pd.DataFrame(out, columns=["site", "det_id", "global_id"]).astype("int64")

    def _load(self) -> SiteGallery:
        g = SiteGallery(self.rules, self.dim, self.next.get()[0] if self.next.exists() else 1)
        rows = [(*k, *v) for k, v in self.tracks.iterator()]
        if rows:
            cam, track, gid, seen, sampled, n, x, y, v = zip(*rows, strict=True)
            full = np.zeros((len(rows), self.rules.track_vectors, self.dim))
            for k, one in enumerate(v):
                if len(one):
                    full[k, -len(one) :] = one
            g.add_tracks({"cam": cam, "track": track, "gid": gid, "seen": seen, "sampled": sampled, "n": n, "x": [np.nan if p is None else p for p in x], "y": [np.nan if p is None else p for p in y], "v": full})
        for (gid,), (seen, cams, frames, vectors) in sorted(self.known.iterator(), key=lambda e: e[0][0]):
            g.add_identities([gid], [seen])
            g.add_prototypes([gid] * len(cams), cams, frames, np.array(vectors, float).reshape(-1, self.dim))
        return g

    def _store(self, g: SiteGallery) -> None:
        t, have = g.tracks, {k: i for i, k in enumerate(zip(g.tracks["cam"].tolist(), g.tracks["track"].tolist(), strict=True))}
        for k in g.touched_tracks:
            if k in have:
                i = have[k]
                x, y = (None if np.isnan(t[c][i]) else float(t[c][i]) for c in "xy")
                n = int(t["n"][i])
                self.tracks.updateValue(k, (int(t["gid"][i]), int(t["seen"][i]), int(t["sampled"][i]), n, x, y, t["v"][i][len(t["v"][i]) - n :].tolist()))
            elif self.tracks.containsKey(k):
                self.tracks.removeKey(k)
        for gid in g.touched_ids:
            i = np.flatnonzero(g.known["gid"] == gid)
            if len(i):
                p = _rows(g.proto, g.proto["gid"] == gid)
                self.known.updateValue((gid,), (int(g.known["seen"][i[0]]), p["cam"].tolist(), p["frame"].tolist(), p["v"].tolist()))
            elif self.known.containsKey((gid,)):
                self.known.removeKey((gid,))
        self.next.update((int(g.fresh),))

    def close(self) -> None:
        pass


def ruled_gallery(rows: DataFrame, dim: int, late: str, rules: GalleryRules = GalleryRules()) -> DataFrame:
    """(site, det_id, global_id; -1 while a track waits) for a stream of boxes of all cameras of each site.

    rows: event_time (one for all boxes of a frame), site, frame_no, cam_id, det_id,
    local_track_id, embedding (``dim`` components), good, x, y.  A frame is worked on once the
    watermark, ``late`` behind the latest time, has passed it; boxes that come later are dropped
    by Spark.  The session needs the RocksDB state store provider.
    """
    b = rows.select("event_time", "site", "frame_no", *COLUMNS).withWatermark("event_time", late)
    return b.groupBy("site").transformWithStateInPandas(RuledGallery(rules, dim), "site long, det_id long, global_id long", "append", "eventTime")
