"""Identity operators: assignment, merging, components, scores.

Edges and counts are DataFrame work; what depends on an order of merges inside one
scene runs as a grouped kernel, a scene to a task; the assignment of IDF1, a connected
component of hits to a group; carried matches, a span of contested frames to a group.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keeping import _kept
from .pairs import box_pairs


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost one-to-one assignment of a rectangular matrix, by shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_of = np.full(m, -1)
    u, v = np.zeros(n), np.zeros(m)
    for start in range(n):
        least, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col = start, -1
        while True:
            slack = cost[row] - u[row] - v
            slack += least[col] if col >= 0 else 0
            better = ~done & (slack < least)
            least[better], via[better] = slack[better], col
            col = int(np.where(done, np.inf, least).argmin())
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        far = least[col]
        for c in np.flatnonzero(done):
            if c != col:
                u[row_of[c]] += far - least[c]
                v[c] -= far - least[c]
        u[start] += far
        while col >= 0:
            before = via[col]
            row_of[col] = row_of[before] if before >= 0 else start
            col = before
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)


def heaviest(rows: list[int], cols: list[int], weights: list[int]) -> int:
    """Total weight of the heaviest one-to-one choice of sparse edges (weights above 0; any row may stay alone).

    Shortest augmenting paths with potentials over the edges alone, so memory grows with them
    and not with rows times columns.
    """
    edges: dict[int, dict[int, int]] = {}
    for r, c, w in zip(rows, cols, weights, strict=True):
        edges.setdefault(r, {})[c] = max(w, edges.get(r, {}).get(c, 0))
    u = {r: max(e.values()) for r, e in edges.items()}
    v: dict[int, int] = {}
    row_of: dict[int, int] = {}
    col_of: dict[int, int] = {}
    for start in edges:
        # Ends: a free column, or a row whose own potential (the cost of leaving it alone) is the least.
        dist, via, done = {start: 0}, {}, set()
        reach: dict[int, int] = {}
        heap: list[tuple[int, int, int]] = []
        end, least, row, far = start, u[start], start, 0
        free = None
        while True:
            for c, w in edges[row].items():
                d = far + u[row] + v.get(c, 0) - w
                if c not in done and d < least and d < reach.get(c, d + 1):
                    reach[c], via[c] = d, row
                    heapq.heappush(heap, (d, c, row))
            while heap and (heap[0][1] in done or heap[0][0] > reach[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least:
                break
            far, col, _ = heapq.heappop(heap)
            done.add(col)
            if col not in row_of:
                least, free = far, col
                break
            row = row_of[col]
            dist[row] = far
            if far + u[row] < least:
                end, least = row, far + u[row]
        for r, d in dist.items():
            u[r] -= least - d
        for c in done:
            v[c] = v.get(c, 0) + least - reach[c]
        col = free if free is not None else col_of.pop(end, None)
        while col is not None:
            r = via[col]
            before = col_of.get(r)
            row_of[col], col_of[r] = r, col
            col = before if r != start else None
    return sum(edges[r][c] for r, c in col_of.items())


def _taken(gt: np.ndarray, det: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which pairs of one frame the one-to-one assignment of most ``weight`` takes."""
    (g, r), (p, c) = np.unique(gt, return_inverse=True), np.unique(det, return_inverse=True)
    m = np.zeros((len(g), len(p)))
    m[r, c] = weight
    if min(m.shape) == 1:
        return r * len(p) + c == m.argmax()
    chosen = np.full(len(g), -1)
    for row, col in assign(-m):
        chosen[row] = col
    return chosen[r] == c


def _one_to_one(pairs: DataFrame, weight: str) -> DataFrame:
    """The pairs of each camera and frame that the one-to-one assignment of most ``weight`` takes.

    Frames are dealt to tasks and pass through them one by one, after one sort, which may spill:
    no table of frames or boxes is held.
    """

    def run(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and rest is not None:
                batch = pa.concat_batches([rest, batch])
            whole = rest if batch is None else batch
            if whole is None or not whole.num_rows:
                continue
            cam, frame, gt, det, w = (whole.column(whole.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cam_id", "frame_no", "gt_id", "det_id", weight))
            begins = np.flatnonzero(np.concatenate([[True], (cam[1:] != cam[:-1]) | (frame[1:] != frame[:-1])]))
            ends = np.append(begins[1:], len(cam))
            if batch is not None:  # the last frame may go on in the next batch
                rest = batch.slice(begins[-1])
                begins, ends = begins[:-1], ends[:-1]
            if not len(begins):
                continue
            took = np.ones(ends[-1], bool)
            # A frame in which every box meets one other at most needs no assignment.
            of = np.repeat(np.arange(len(begins)), ends - begins)
            contested = np.zeros(len(begins), bool)
            for box_id in (gt[: len(of)], det[: len(of)]):
                order = np.lexsort((box_id, of))
                again = (box_id[order][1:] == box_id[order][:-1]) & (of[1:] == of[:-1])
                contested[of[1:][again]] = True
            for a, b in zip(begins[contested].tolist(), ends[contested].tolist(), strict=True):
                took[a:b] = _taken(gt[a:b], det[a:b], w[a:b])
            yield whole.slice(0, len(took)).filter(pa.array(took))

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "cam_id", "frame_no").sortWithinPartitions("cam_id", "frame_no").mapInArrow(run, pairs.schema)


def frame_matches(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one matches per camera and frame: assigned on IoU, then kept from ``least`` on."""
    return _one_to_one(box_pairs(gt, pred), "iou").where(F.col("iou") >= least)


def _heaviest_totals(hits: DataFrame, by: list[str]) -> DataFrame:
    """(by, idtp): parts of the heaviest one-to-one choice of edges within each value of ``by``; their sum is its weight.

    It is a sum over the connected components of the edges: where all edges of one share a
    person or an id it is their maximum, and only the others go to a kernel, one a group.
    hits: by, person_id, global_id, n.
    """
    hits = _kept(hits)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[by][:1].assign(idtp=[heaviest(pdf.person_id.tolist(), pdf.global_id.tolist(), pdf.n.tolist())])

    # Edges that are alone at both ends are components by themselves.
    side = lambda c: F.count("*").over(Window.partitionBy(*by, c))
    several = hits.withColumn("of_p", side("person_id")).withColumn("of_g", side("global_id"))
    alone = several.where("of_p = 1 and of_g = 1").select(*by, F.col("n").alias("idtp"))
    shared = several.where("of_p > 1 or of_g > 1")
    person, other = F.xxhash64(*by, "person_id", F.lit(0)), F.xxhash64(*by, "global_id", F.lit(1))
    shared = shared.withColumn("node", person)
    shared = shared.join(components(shared.select(F.col("node").alias("a"), other.alias("b"))), "node")
    stars = _kept(shared.groupBy(*by, "component").agg(F.max("n").alias("idtp"), (F.least(F.countDistinct("person_id"), F.countDistinct("global_id")) == 1).alias("star")))
    schema = ", ".join([*(f"`{c}` {hits.schema[c].dataType.simpleString()}" for c in by), "idtp long"])
    tangled = shared.join(stars.where("not star").select(*by, "component"), [*by, "component"]).groupBy(*by, "component").applyInPandas(best, schema)
    return alone.unionByName(stars.where("star").select(*by, "idtp")).unionByName(tangled)


def global_idf1(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """IDTP, IDFP, IDFN, IDF1 over all cameras that have predictions.

    Hits of each (person, id) are a grouped count, their one-to-one assignment a sum over
    the connected components of the hits.
    """
    hits = frame_matches(gt, pred, least).groupBy("person_id", "global_id").agg(F.count("*").alias("n"))
    idtp = _heaviest_totals(hits, []).agg(F.coalesce(F.sum("idtp"), F.lit(0)).alias("idtp"))
    seen = gt.join(pred.select("cam_id").distinct(), "cam_id", "left_semi").agg(F.count("*").alias("n_gt"))
    n = pred.agg(F.count("*").alias("n_pred"))
    all_ = idtp.join(F.broadcast(seen)).join(F.broadcast(n))
    tp, fn, fp = F.col("idtp"), F.col("n_gt") - F.col("idtp"), F.col("n_pred") - F.col("idtp")
    return all_.select(tp.alias("idtp"), fp.alias("idfp"), fn.alias("idfn"), F.round(2 * tp / F.greatest(F.lit(1), 2 * tp + fp + fn), 6).alias("idf1"))


def kept_matches(pairs: DataFrame) -> DataFrame:
    """(cam_id, frame_no, person_id, global_id, iou, switch): one-to-one matches that carry over.

    A person keeps the id of its last match while the two still overlap enough; what is
    left of the frame is assigned for the largest total IoU.  A match is a switch if the
    person's last one was of another id.

    A pair whose person and id meet nobody else in the frame matches whatever came before,
    so window functions settle it, and say what a person holds when a contested stretch
    begins.  Only contested pairs depend on those before: stretches of persons that meet over
    an id make up a span, and each span is a group of its own, in the order of its frames.
    pairs: cam_id, frame_no, person_id, global_id, iou, those from the gate on.
    """
    frame = ["cam_id", "frame_no"]
    e = pairs.groupBy(*frame, "person_id", "global_id").agg(F.max("iou").alias("iou"))
    rivals = [F.count("*").over(Window.partitionBy(*frame, side)) for side in ("person_id", "global_id")]
    e = e.withColumn("contested", (rivals[0] > 1) | (rivals[1] > 1))
    plain = F.when(~F.col("contested"), F.col("global_id"))
    before = Window.partitionBy("cam_id", "person_id").orderBy("frame_no").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("stretch", F.count(plain).over(before)).withColumn("held", F.last(plain, ignorenulls=True).over(before))
    fought = _kept(e.where("contested").withColumn("node", F.xxhash64("cam_id", "person_id", "stretch")))
    meet = fought.select(F.col("node").alias("a"), F.min("node").over(Window.partitionBy(*frame, "global_id")).alias("b"))
    spans = fought.join(components(meet), "node", "left").withColumn("span", F.coalesce("component", "node"))
    names = [*frame, "person_id", "global_id", "iou"]
    settled = spans.groupBy("span").applyInPandas(_settled, e.select(*names).schema)
    last = F.lag("global_id").over(Window.partitionBy("cam_id", "person_id").orderBy("frame_no"))
    m = e.where("not contested").select(*names).unionByName(settled)
    return m.withColumn("switch", F.coalesce(last != F.col("global_id"), F.lit(False)))


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The matches of one span, frame by frame; ``held`` is what a stretch starts with (null: nothing)."""
    pdf = pdf.sort_values(["frame_no", "person_id", "global_id"])
    holds: dict[tuple[int, int], int | None] = {}
    taken = []
    for _, rows in pdf.groupby("frame_no", sort=True):
        who, ids, iou = rows.person_id.to_numpy(), rows.global_id.to_numpy(), rows.iou.to_numpy()
        stretch = list(zip(who.tolist(), rows.stretch.tolist(), strict=True))
        for key, h in zip(stretch, rows.held, strict=True):
            holds.setdefault(key, None if pd.isna(h) else int(h))
        hit = np.array([holds[k] == g for k, g in zip(stretch, ids.tolist(), strict=True)])
        # Two persons may hold one id: the first of them keeps it.
        carried = np.flatnonzero(hit)
        carried = carried[np.unique(ids[carried], return_index=True)[1]]
        free = ~np.isin(who, who[carried]) & ~np.isin(ids, ids[carried])
        p, r = np.unique(who[free], return_inverse=True)
        g, c = np.unique(ids[free], return_inverse=True)
        cost = np.full((len(p), len(g)), 1e6)  # more than all pairs that are there cost together
        cost[r, c] = 1 - iou[free]
        won = {(p[i], g[j]) for i, j in assign(cost) if cost[i, j] < 1e6}
        fresh = [k for k in np.flatnonzero(free) if (who[k], ids[k]) in won]
        for k in [*carried.tolist(), *fresh]:
            holds[stretch[k]] = int(ids[k])
            taken.append(rows.index[k])
    return pdf.loc[taken, ["cam_id", "frame_no", "person_id", "global_id", "iou"]]


def camera_idf1(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """(cam_id, idtp): the heaviest one-to-one choice of the (person, id) pairs of a camera, by frames that they share."""
    shared = box_pairs(gt, pred).where(F.col("iou") >= least).groupBy("cam_id", "person_id", "global_id").agg(F.countDistinct("frame_no").alias("n"))
    return _heaviest_totals(shared, ["cam_id"]).groupBy("cam_id").agg(F.sum("idtp").alias("idtp"))


def clear_metrics(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """Per camera: matches, misses, false positives, switches, fragmentations, MOTA, MOTP, precision, recall, IDF1.

    Matches carry over (``kept_matches``).  A fragmentation is a stretch of frames in which
    a person is present but not matched, between two in which it is.  Cameras without
    predictions count as all missed.
    """
    m = kept_matches(box_pairs(gt, pred).where(F.col("iou") >= least))
    t = gt.select("cam_id", "frame_no", "person_id").distinct().join(m.select("cam_id", "frame_no", "person_id", F.lit(1).alias("hit")).distinct(), ["cam_id", "frame_no", "person_id"], "left")
    w = Window.partitionBy("cam_id", "person_id").orderBy("frame_no")
    later = F.max("hit").over(w.rowsBetween(1, Window.unboundedFollowing))
    breaks = t.withColumn("break", (F.lag("hit").over(w) == 1) & F.col("hit").isNull() & (later == 1)).groupBy("cam_id").agg(F.sum(F.coalesce(F.col("break").cast("long"), F.lit(0))).alias("fragmentations"))
    m = m.groupBy("cam_id").agg(F.count("*").alias("matches"), F.sum(F.col("switch").cast("long")).alias("switches"), F.avg("iou").alias("motp"))
    g, p = gt.groupBy("cam_id").agg(F.count("*").alias("n_gt")), pred.groupBy("cam_id").agg(F.count("*").alias("n_pred"))
    a = g.join(p, "cam_id", "left").join(m, "cam_id", "left").join(breaks, "cam_id", "left").join(camera_idf1(gt, pred, least), "cam_id", "left")
    a = a.fillna(0, ["n_pred", "matches", "switches", "fragmentations", "idtp"])
    miss, false = F.col("n_gt") - F.col("matches"), F.col("n_pred") - F.col("matches")
    return a.select(
        "cam_id", "matches", miss.alias("misses"), false.alias("false_positives"), "switches", "fragmentations",
        F.round(1 - (miss + false + F.col("switches")) / F.col("n_gt"), 6).alias("mota"), F.round("motp", 6).alias("motp"),
        F.round(F.when(F.col("n_pred") > 0, F.col("matches") / F.col("n_pred")).otherwise(0.0), 6).alias("precision"), F.round(F.col("matches") / F.col("n_gt"), 6).alias("recall"),
        F.round(2 * F.col("idtp") / (F.col("n_gt") + F.col("n_pred")), 6).alias("idf1"),
    )


def stage_diagnosis(clear: DataFrame, overall: DataFrame, least_recall: float = 0.8, most_gap: float = 0.1) -> DataFrame:
    """One row: mean recall and IDF1 of cameras, switches, fragmentations, overall IDF1, its gap, and where identities are lost.

    Too low a recall is the detector's; a local IDF1 far under the recall is the tracker's;
    an overall one far under the local is the linker's.
    """
    c = clear.agg(F.avg("recall").alias("recall"), F.avg("idf1").alias("local_idf1"), F.sum("switches").alias("switches"), F.sum("fragmentations").alias("fragmentations"))
    d = c.join(F.broadcast(overall.select(F.col("idf1").alias("global_idf1")))).withColumn("gap", F.col("local_idf1") - F.col("global_idf1"))
    verdict = F.when(F.col("recall") < least_recall, "detector").when(F.col("recall") - F.col("local_idf1") > most_gap, "tracker").when(F.col("gap") > most_gap, "linker").otherwise("ok")
    return d.select(*[F.round(x, 6).alias(x) for x in ("recall", "local_idf1", "global_idf1", "gap")], "switches", "fragmentations", verdict.alias("verdict"))


def oracle_ids(gt: DataFrame, pred: DataFrame, least: float = 0.5) -> DataFrame:
    """(det_id, person_id): the truth that each frame's one-to-one assignment gives a box; what perfect linking could reach."""
    return frame_matches(gt, pred, least).select("det_id", "person_id")


def hota(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Per camera: HOTA, DetA and AssA with their recalls and precisions, and LocA, as means over the thresholds 0.05, 0.10, ... 0.95.

    By the published definition: frames are assigned on IoU weighted by how well the
    two trajectories agree over all frames; each threshold then keeps matches from it
    on.  A threshold without matches counts as 0 (LocA: 1).  Cameras need boxes on
    both sides.  Only the assignment of frames leaves the DataFrame functions.
    """
    track, iou = ["cam_id", "person_id", "global_id"], F.col("iou")
    s = box_pairs(gt, pred)
    rivals = F.sum("iou").over(Window.partitionBy("cam_id", "frame_no", "gt_id")) + F.sum("iou").over(Window.partitionBy("cam_id", "frame_no", "det_id"))
    shared = s.withColumn("share", iou / (rivals - iou)).groupBy(*track).agg(F.sum("share").alias("shared"))
    of_gt, of_pred = gt.groupBy("cam_id", "person_id").agg(F.count("*").alias("n_g")), pred.groupBy("cam_id", "global_id").agg(F.count("*").alias("n_p"))
    agree = shared.join(of_gt, ["cam_id", "person_id"]).join(of_pred, ["cam_id", "global_id"])
    agree = agree.withColumn("agree", F.col("shared") / (F.col("n_g") + F.col("n_p") - F.col("shared"))).drop("shared")
    m = _one_to_one(s.join(agree, track).withColumn("score", iou * F.col("agree")).select(*s.columns, "n_g", "n_p", "score"), "score")

    # A match counts up to its last step.  Matches of a track are added up by that step, and sums over
    # the steps from above hold down to the next step that occurs, so only these sums are repeated for each step.
    last = sum(((iou >= k / 20 - 1e-12).cast("int") for k in range(1, 20)), F.lit(0))
    hits = m.select(*track, "n_g", "n_p", "iou", last.alias("last")).where("last > 0").repartition(*track)
    hits = hits.groupBy(*track, "n_g", "n_p", "last").agg(F.count("*").alias("n"), F.sum("iou").alias("loc"))
    down = Window.partitionBy(*track).orderBy(F.desc("last"))
    hits = hits.select("cam_id", "n_g", "n_p", "last", F.sum("n").over(down).alias("n"), F.sum("loc").over(down).alias("loc"), F.lead("last", 1, 0).over(down).alias("below"))
    hits = hits.withColumn("step", F.explode(F.sequence(F.col("below") + 1, F.col("last"))))
    n = F.col("n")
    hits = hits.groupBy("cam_id", "step").agg(F.sum("n").alias("tp"), (F.sum(n * n / (F.col("n_g") + F.col("n_p") - n)) / F.sum("n")).alias("ass"), (F.sum(n * n / F.col("n_g")) / F.sum("n")).alias("ass_re"), (F.sum(n * n / F.col("n_p")) / F.sum("n")).alias("ass_pr"), (F.sum("loc") / F.sum("n")).alias("loc"))
    boxes = gt.groupBy("cam_id").agg(F.count("*").alias("n_gt")).join(pred.groupBy("cam_id").agg(F.count("*").alias("n_pred")), "cam_id")
    steps = F.explode(F.sequence(F.lit(1), F.lit(19))).alias("step")
    a = boxes.select("*", steps).join(hits, ["cam_id", "step"], "left").fillna(0, ["tp", "ass", "ass_re", "ass_pr"]).fillna(1, ["loc"])
    det = F.col("tp") / (F.col("n_gt") + F.col("n_pred") - F.col("tp"))
    score = {"hota": F.sqrt(det * F.col("ass")), "det_a": det, "ass_a": F.col("ass"), "loc_a": F.col("loc")}
    score |= {"det_re": F.col("tp") / F.col("n_gt"), "det_pr": F.col("tp") / F.col("n_pred"), "ass_re": F.col("ass_re"), "ass_pr": F.col("ass_pr")}
    return a.groupBy("cam_id").agg(*[F.round(F.avg(x), 6).alias(k) for k, x in score.items()])


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) with the smallest node as component, by alternating star rounds.

    edges: a, b.  Each round is written by a reliable checkpoint; a local session without a
    folder for it caches.
    """
    keep = _kept
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == before:
            break
        before = now
    out = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    if nodes is None:
        return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return nodes.join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def by_component(pairs: DataFrame, apart: DataFrame, scene: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (scene, a, b, more) and ``apart`` (scene, a, b), each with the connected component of the pairs that it lies in.

    Merges go along pairs only, so what depends on their order can be worked on component by
    component.
    """
    p = _kept(pairs.withColumn("node", F.xxhash64(scene, "a")))
    of = _kept(components(p.select(F.col("node").alias("a"), F.xxhash64(scene, "b").alias("b"))))
    c = apart.select(F.col(scene).alias("apart_scene"), F.col("a").alias("a"), F.col("b").alias("b")).withColumn("node", F.xxhash64("apart_scene", "a"))
    return p.join(of, "node").drop("node"), c.join(of, "node").select(F.col("component").alias("apart"), "a", "b")


def each_component(pairs: DataFrame, apart: DataFrame, scene: str, value: str, work, schema: str) -> DataFrame:
    """(scene, schema): what ``work`` makes of the pairs (a, b, value) and the apart pairs (a, b) of each component of the pairs.

    Components are dealt to tasks and pass through them one by one, in batches that hold many:
    most are small, and a group of its own for each costs more than the work on it.
    """
    names = [scene, *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        at, where, edges, foes = None, None, [], []

        def done():
            return [(where, *x) for x in work(edges, foes)]

        for batch in batches:
            out = []
            for component, kind, s, a, b, x in zip(*(batch[c].tolist() for c in ("component", "kind", scene, "a", "b", value)), strict=True):
                if component != at:
                    if at is not None:
                        out += done()
                    at, where, edges, foes = component, s, [], []
                if kind:
                    foes.append((a, b))
                else:
                    edges.append((a, b, x))
            yield pd.DataFrame(out, columns=names)
        if at is not None:
            yield pd.DataFrame(done(), columns=names)

    p, c = by_component(pairs.select(scene, "a", "b", F.col(value).cast("double").alias(value)), apart, scene)
    p = p.select("component", F.lit(0).alias("kind"), F.col(scene).cast("long").alias(scene), "a", "b", value)
    c = c.select(F.col("apart").alias("component"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias(scene), "a", "b", F.lit(0.0).alias(value))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = p.unionByName(c).repartition(n, "component").sortWithinPartitions("component", "kind", "a", "b")
    return rows.mapInPandas(run, f"{scene} long, {schema}")


def _greedy(pairs: list[tuple], apart: list[tuple]) -> list[tuple[int, int]]:
    """(id, target) after merging (a, b, score) by falling score, never two ids with a conflict."""
    members = {x: {x} for x in sorted({x for e in pairs for x in e[:2]})}
    root = {x: x for x in members}
    foes: dict[int, set[int]] = {}
    for a, b in apart:
        foes.setdefault(a, set()).add(b)
        foes.setdefault(b, set()).add(a)
    for a, b, _ in sorted(pairs, key=lambda e: (-e[2], e[0], e[1])):
        a, b = sorted((root[a], root[b]))
        if a == b or any(foes.get(x, set()) & members[b] for x in members[a]):
            continue
        for x in members[b]:
            root[x] = a
        members[a] |= members.pop(b)
    return list(root.items())


def merge_map(pairs: DataFrame, conflicts: DataFrame, scene: str = "scene") -> DataFrame:
    """Greedy merges by falling score, never of two ids with a conflict: (scene, global_id, target).

    pairs: scene, a, b, score; conflicts: scene, a, b.  The order of merges matters within a
    connected component of the pairs; components run in parallel.
    """
    return each_component(pairs, conflicts, scene, "score", _greedy, "global_id long, target long")


def nearest_centroid_pass(points: DataFrame, radius: float, confidence: float) -> DataFrame:
    """One re-assignment pass: a point joins the nearest other person's centroid in its frame.

    It does so within ``radius`` if that is nearer than its own by the confidence
    1 - d / d_own.  Centroids are those before the pass.
    """
    centroids = points.groupBy("frame_no", "global_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    own = points.join(centroids, ["frame_no", "global_id"]).withColumn("own", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))).drop("mx", "my")
    other = centroids.withColumnRenamed("global_id", "other")
    j = own.join(other, "frame_no").where("other <> global_id").withColumn("d", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")))
    j = j.where((F.col("d") < radius) & (F.col("own") > 0) & (1 - F.col("d") / F.col("own") >= confidence))
    best = j.groupBy("det_id").agg(F.min_by("other", F.struct("d", "other")).alias("new_id"))
    return points.join(best, "det_id", "left").select("det_id", "frame_no", "global_id", F.coalesce("new_id", "global_id").alias("new_id"))


def reassign(points: DataFrame, passes: tuple[float, ...], confidence: float) -> DataFrame:
    """``nearest_centroid_pass`` with one distance after the other; each pass starts from the ids of the one before."""
    p = points.select("det_id", "frame_no", F.col("global_id").alias("first_id"), "global_id", "x", "y")
    for radius in passes:
        moved = nearest_centroid_pass(p.select("det_id", "frame_no", "global_id", "x", "y"), radius, confidence).select("det_id", "new_id")
        p = p.join(moved, "det_id").select("det_id", "frame_no", "first_id", F.col("new_id").alias("global_id"), "x", "y")
    return p.select("det_id", "frame_no", F.col("first_id").alias("global_id"), F.col("global_id").alias("new_id"))


def merge_by_pass(merges: DataFrame) -> DataFrame:
    """(source, target): the ends of merge events in the order of their frames.

    An event merges what its two ids have become by then into the smaller.  That is the
    smallest id of the component of all events, so the order plays no part in the end.
    merges: source, target.
    """
    c = components(merges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return c.where("node <> component").select(F.col("node").alias("source"), F.col("component").alias("target"))
