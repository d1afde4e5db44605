"""ANSI SQL with the results of the registered tracking queries."""

from __future__ import annotations

from .queries import CAMERAS, ZONES

_DET = """det AS (SELECT event_id AS det_id, CAST(event_id % 4 AS INTEGER) AS cam_id, epoch_us(ts) // 1000000 AS frame_no,
  user_id % 40 AS local_track_id, user_id AS global_id, event_type AS zone,
  CAST((event_id * 37) % 560 AS DOUBLE) AS l, CAST((event_id * 53) % 240 AS DOUBLE) AS t,
  CAST(20 + event_id % 41 AS DOUBLE) AS w, CAST(60 + event_id % 61 AS DOUBLE) AS h FROM events)"""
_DENSE = _DET + """, dense AS (SELECT det_id, cam_id, det_id // 8 AS frame_no, local_track_id, global_id, zone, l, t, w, h FROM det)"""
_TRUTH = _DENSE + """, gt AS (SELECT det_id, cam_id, frame_no, global_id AS person_id, l + (det_id % 5 - 2) AS l, t - (det_id % 5 - 2) AS t, w, h
  FROM dense WHERE det_id % 11 <> 0)"""
_CAM = "cam AS (SELECT * FROM (VALUES " + ", ".join(str(c) for c in CAMERAS) + ") v(cam_id, fx, fy, cx, cy, r11, r12, r13, r21, r22, r23, r31, r32, r33, t1, t2, t3))"


def _world(source: str) -> str:
    ray = lambda k: f"(r1{k} * ((l + w / 2 - cx) / fx) + r2{k} * ((t + h - cy) / fy) + r3{k})"
    org = lambda k: f"(-(r1{k} * t1 + r2{k} * t2 + r3{k} * t3))"
    return f"""{_CAM}, ray AS (SELECT d.*, {ray(1)} AS dx, {ray(2)} AS dy, {ray(3)} AS dz, {org(1)} AS ox, {org(2)} AS oy, {org(3)} AS oz FROM {source} d JOIN cam USING (cam_id)),
  far AS (SELECT *, CASE WHEN abs(dz) >= 1e-6 THEN -oz / dz END AS k FROM ray),
  pt AS (SELECT *, CASE WHEN k >= 0 THEN ox + k * dx END AS x, CASE WHEN k >= 0 THEN oy + k * dy END AS y FROM far)"""


def _visits(keys: str) -> str:
    return f"""g AS (SELECT *, CASE WHEN frame_no - lag(frame_no) OVER (PARTITION BY {keys} ORDER BY frame_no) > 43200 THEN 1 ELSE 0 END AS brk FROM det WHERE global_id >= 0),
  s AS (SELECT *, SUM(brk) OVER (PARTITION BY {keys} ORDER BY frame_no RANGE UNBOUNDED PRECEDING) AS vid FROM g),
  v AS (SELECT {keys}, MIN(frame_no) AS first_frame, MAX(frame_no) AS last_frame, MAX(frame_no) - MIN(frame_no) + 1 AS n_frames,
    (MAX(frame_no) - MIN(frame_no)) / 1.0::DOUBLE AS seconds FROM s GROUP BY {keys}, vid)"""


def _inside(poly, x: str, y: str) -> str:
    terms = []
    for i, (bx, by) in enumerate(poly):
        ax, ay = poly[i - 1]
        terms.append(f"(CASE WHEN ({by} > {y}) <> ({ay} > {y}) AND {x} < ({ax} - {bx})::DOUBLE * ({y} - {by}) / nullif({ay} - {by}, 0)::DOUBLE + {bx}::DOUBLE THEN 1 ELSE 0 END)")
    return f"(({' + '.join(terms)}) % 2 = 1)"


_NAME = "CASE " + " ".join(f"WHEN cam_id = {c} AND {_inside([(f'{x}::DOUBLE', f'{y}::DOUBLE') for x, y in p], 'fx', 'fy')} THEN 'cam{c}:{n}'" for c, _, n, p in ZONES) + " ELSE 'cam' || cam_id || ':other' END"


def _zoned(source: str) -> str:
    return f"f AS (SELECT *, (l + w / 2) / 640.0::DOUBLE AS fx, (t + h) / 360.0::DOUBLE AS fy FROM {source}), z AS (SELECT *, {_NAME} AS zone_name FROM f)"


_IOU_OVER = "greatest(least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l), 0) * greatest(least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t), 0)"
_IOU = f"(({_IOU_OVER}) / (a.w * a.h + b.w * b.h - ({_IOU_OVER})))"
_GRID = "CAST(greatest(0, least({n} - 1, floor({x} * {n} / {s}::DOUBLE))) AS INTEGER)"
_MEAN = """e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
  m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)"""


def _grid(columns: int, rows: int) -> str:
    return f"""SELECT cam_id, {_GRID.format(n=columns, x='(l + w / 2)', s='640.0')} AS gx, {_GRID.format(n=rows, x='(t + h)', s='360.0')} AS gy,
  count(*) AS occupancy, count(DISTINCT global_id) AS footfall FROM det GROUP BY 1, 2, 3"""


_SIDE = "({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0})"

ORACLES: dict[str, str] = {
    "top_zones_footfall": f"WITH {_DET} SELECT zone, count(DISTINCT global_id) AS value FROM det GROUP BY zone ORDER BY value DESC, zone LIMIT 3",
    "top_zones_occupancy": f"WITH {_DET} SELECT zone, round(count(*) / 1.0::DOUBLE, 2) AS value FROM det WHERE global_id >= 0 GROUP BY zone ORDER BY value DESC, zone LIMIT 3",
    "zones_seen": f"WITH {_DET} SELECT DISTINCT zone FROM det",
    "persons_seen": f"WITH {_DET} SELECT DISTINCT global_id FROM det WHERE global_id >= 0",
    "presence": f"WITH {_DET}, {_visits('global_id, cam_id, zone')} SELECT global_id, cam_id, zone, first_frame, last_frame, n_frames, round(seconds, 3) AS seconds FROM v",
    "person_timeline": f"WITH {_DET}, {_visits('global_id, cam_id, zone')} SELECT global_id, cam_id, zone, first_frame, last_frame, n_frames, round(seconds, 3) AS seconds, row_number() OVER (PARTITION BY global_id ORDER BY first_frame, cam_id, zone) AS nth FROM v",
    "dwell": f"WITH {_DET}, {_visits('global_id, cam_id, zone')} SELECT global_id, zone, round(sum(seconds), 3) AS seconds, count(*) AS n_visits FROM v GROUP BY global_id, zone",
    "person_dwell_range": f"""WITH {_DET}, {_visits('global_id, cam_id, zone')}, o AS (SELECT min(frame_no) AS f0 FROM det)
      SELECT global_id, zone, round(sum(round(seconds, 3)), 2) AS seconds, count(*) AS n_visits FROM v, o WHERE first_frame BETWEEN f0 + 86400 AND f0 + 1296000 GROUP BY global_id, zone""",
    "zone_timeseries": f"WITH {_DET} SELECT zone, CAST(floor(frame_no / 86400) AS BIGINT) AS bucket, round(count(*) / 1.0::DOUBLE, 3) AS occupancy_s, count(DISTINCT global_id) AS footfall FROM det GROUP BY 1, 2",
    "run_rollup": f"WITH {_DET} SELECT count(*) AS n_dets, count(DISTINCT global_id) AS n_gids, count(DISTINCT cam_id) AS n_cams FROM det WHERE global_id >= 0",
    "foot_world": f"WITH {_DET}, {_world('det')} SELECT det_id, cam_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM pt",
    "world_to_pixel": f"""WITH {_DET}, {_world('det')}, q AS (SELECT det_id, fx, fy, cx, cy, r11 * x + r12 * y + r13 * 1700.0::DOUBLE + t1 AS px, r21 * x + r22 * y + r23 * 1700.0::DOUBLE + t2 AS py,
      r31 * x + r32 * y + r33 * 1700.0::DOUBLE + t3 AS pz FROM pt JOIN cam USING (cam_id))
      SELECT det_id, round(CASE WHEN pz > 1e-6 THEN fx * px / pz + cx END, 3) + 0.0 AS u, round(CASE WHEN pz > 1e-6 THEN fy * py / pz + cy END, 3) + 0.0 AS v FROM q""",
    "trajectory_step": f"""WITH {_DET}, {_world('det')}, r AS (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY frame_no, det_id) - 1 AS r FROM pt WHERE x IS NOT NULL)
      SELECT global_id, det_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM r WHERE r % 5 = 0""",
    "zone_resolve": f"WITH {_DET}, {_zoned('det')} SELECT det_id, cam_id, zone_name FROM z",
    "zone_counts": f"WITH {_DENSE}, {_zoned('dense')} SELECT cam_id, frame_no, zone_name, count(*) AS n, CAST(count(*) >= 2 AS INTEGER) AS overcrowded FROM z GROUP BY 1, 2, 3",
    "line_crossing_counts": f"""WITH {_DET}, p AS (SELECT cam_id, local_track_id, l + w / 2 AS x, t + h AS y, lag(l + w / 2) OVER o AS px, lag(t + h) OVER o AS py FROM det
      WINDOW o AS (PARTITION BY cam_id, local_track_id ORDER BY frame_no, det_id))
      SELECT cam_id, count(*) AS crossings, count(DISTINCT local_track_id) AS tracks FROM p
      WHERE ({_SIDE.format('0', '200', '640', '220', 'px', 'py')}) * ({_SIDE.format('0', '200', '640', '220', 'x', 'y')}) < 0
      AND ({_SIDE.format('px', 'py', 'x', 'y', '0', '200')}) * ({_SIDE.format('px', 'py', 'x', 'y', '640', '220')}) < 0 AND y - py > 0 GROUP BY cam_id""",
    "density_grid": f"WITH {_DET}, g AS ({_grid(32, 18)}) SELECT *, round(occupancy / greatest(footfall, 1), 6) AS per_person FROM g",
    "density_peaks": f"WITH {_DET}, g AS ({_grid(16, 9)}) SELECT cam_id, gx, gy, occupancy FROM g WHERE occupancy >= 0.06 * (SELECT max(occupancy) FROM g) ORDER BY occupancy DESC, cam_id, gx, gy LIMIT 50",
    "visit_grid": f"WITH {_DET} SELECT cam_id, CAST(floor((l + w / 2) / 8) AS INTEGER) AS gx, CAST(floor((t + h) / 8) AS INTEGER) AS gy, count(DISTINCT local_track_id) AS tracks FROM det GROUP BY 1, 2, 3",
    "box_area_grid": f"""WITH {_DET}, x AS (SELECT cam_id, t, h, unnest(generate_series(CAST(floor(l / 20) AS INTEGER), CAST(floor((l + w - 1) / 20) AS INTEGER))) AS gx FROM det),
      y AS (SELECT cam_id, gx, unnest(generate_series(CAST(floor(t / 20) AS INTEGER), CAST(floor((t + h - 1) / 20) AS INTEGER))) AS gy FROM x) SELECT cam_id, gx, gy, count(*) AS boxes FROM y GROUP BY 1, 2, 3""",
    "box_filter": f"""WITH {_DET}, v AS (SELECT *, greatest(least(l + w, 600) - greatest(l, 10), 0) * greatest(least(t + h, 300) - greatest(t, 10), 0) / greatest(w * h, 1) AS s FROM det)
      SELECT det_id, round(s, 6) AS visible FROM v WHERE w >= 8 AND h >= 20 AND s >= 0.3""",
    "quality_gate": f"""WITH {_DENSE}, o AS (SELECT a.det_id, max({_IOU}) AS overlap FROM dense a JOIN dense b ON a.cam_id = b.cam_id AND a.frame_no = b.frame_no AND a.det_id <> b.det_id GROUP BY a.det_id)
      SELECT det_id, CASE WHEN l < 3.2 OR t < 1.8 OR l + w > 636.8 OR t + h > 358.2 THEN 'edge_crop' WHEN h < 64.8 THEN 'small_height' WHEN w * h < 1843.2 THEN 'small_area'
      WHEN w / h < 0.3 THEN 'thin_crop' WHEN w / h > 0.8 THEN 'wide_or_merged_crop' WHEN coalesce(overlap, 0) > 0.25 THEN 'overlap_iou' ELSE 'ok' END AS reason FROM dense LEFT JOIN o USING (det_id)""",
    "iou_pairs": f"WITH {_TRUTH}, j AS (SELECT a.det_id AS gt_id, b.det_id AS det_id, {_IOU} AS iou FROM gt a JOIN dense b ON a.cam_id = b.cam_id AND a.frame_no = b.frame_no) SELECT gt_id, det_id, round(iou, 6) AS iou FROM j WHERE iou > 0.3",
    "geo_scores": f"""WITH {_DENSE}, {_world('dense')}, j AS (SELECT a.det_id AS a, b.det_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM pt a JOIN pt b ON a.frame_no = b.frame_no AND a.cam_id < b.cam_id)
      SELECT a, b, coalesce(round(CASE WHEN d IS NOT NULL THEN exp(-3 * power(greatest(0, (d - 300) / 1700), 2)) END, 6), 0.0) AS score FROM j""",
    "gid_centroids": f"WITH {_MEAN} SELECT label, CAST(i AS INTEGER) AS i, round(x / n, 5) + 0.0 AS x FROM m JOIN n USING (label)",
    "gid_search_topk": f"""WITH {_MEAN}, q AS (SELECT vec_id, unnest(embedding)::DOUBLE AS q, unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id % 20 = 0),
      d AS (SELECT -1 - vec_id AS query_id, CAST(label AS BIGINT) AS vec_id, round(sum(q * x / n), 4) + 0.0 AS score FROM q JOIN m USING (i) JOIN n USING (label) GROUP BY 1, 2),
      r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM d) SELECT * FROM r WHERE rank <= 3""",
    "tracklet_summary": f"""WITH {_DET}, g AS (SELECT cam_id, local_track_id, global_id, min(frame_no) AS start_frame, max(frame_no) AS end_frame, count(*) AS num_detections, round(avg(w), 3) AS mean_width, round(avg(h), 3) AS mean_height,
      round(avg(w * h), 3) AS mean_area FROM det GROUP BY 1, 2, 3) SELECT *, row_number() OVER (ORDER BY cam_id, local_track_id, global_id) - 1 AS tracklet_id FROM g""",
    "static_tracks": f"""WITH {_DET}, g AS (SELECT cam_id, local_track_id, count(*) AS n, sqrt(power(stddev_samp(l + w / 2), 2) + power(stddev_samp(t + h / 2), 2)) AS spread FROM det GROUP BY 1, 2)
      SELECT cam_id, local_track_id, n, round(spread, 6) AS spread FROM g WHERE n >= 20 AND spread < 190""",
    "concurrency_floor": f"WITH {_DENSE}, g AS (SELECT count(DISTINCT local_track_id) AS n FROM dense GROUP BY frame_no, cam_id) SELECT coalesce(max(n), 1) AS k FROM g",
    "track_majority": f"""WITH {_DET}, g AS (SELECT cam_id, local_track_id, global_id, count(*) AS n FROM det GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY cam_id, local_track_id ORDER BY n DESC, global_id) AS r FROM g)
      SELECT cam_id, local_track_id, global_id, n FROM r WHERE r = 1""",
    "world_centroids": f"WITH {_DENSE}, {_world('dense')} SELECT global_id, frame_no, round(avg(x), 3) + 0.0 AS x, round(avg(y), 3) + 0.0 AS y, count(*) AS n FROM pt WHERE x IS NOT NULL GROUP BY 1, 2",
    "stcra_pass": f"WITH {_DENSE}, {_world('dense')}, p0 AS (SELECT det_id, frame_no, global_id AS first_id, global_id, x, y FROM pt WHERE x IS NOT NULL)"
    + "".join(
        f""", c{k} AS (SELECT frame_no, global_id, avg(x) AS mx, avg(y) AS my FROM p{k - 1} GROUP BY 1, 2), o{k} AS (SELECT p.*, sqrt(power(x - mx, 2) + power(y - my, 2)) AS own FROM p{k - 1} p JOIN c{k} USING (frame_no, global_id)),
      j{k} AS (SELECT o.det_id, c.global_id AS other, sqrt(power(x - mx, 2) + power(y - my, 2)) AS d, own FROM o{k} o JOIN c{k} c ON o.frame_no = c.frame_no AND o.global_id <> c.global_id),
      b{k} AS (SELECT det_id, other, row_number() OVER (PARTITION BY det_id ORDER BY d, other) AS r FROM j{k} WHERE d < {far} AND own > 0 AND 1 - d / own >= 0.3),
      p{k} AS (SELECT p.det_id, p.frame_no, p.first_id, coalesce(b.other, p.global_id) AS global_id, p.x, p.y FROM p{k - 1} p LEFT JOIN b{k} b ON p.det_id = b.det_id AND b.r = 1)"""
        for k, far in enumerate((1500, 3000, 6000), 1)
    )
    + " SELECT det_id, frame_no, first_id AS global_id, global_id AS new_id FROM p3",
    "interval_conflicts": f"""WITH {_DET}, {_visits('cam_id, local_track_id, global_id')}, t AS (SELECT *, global_id * 100000000 + first_frame % 100000000 AS id FROM v)
      SELECT a.cam_id, a.id AS a, b.id AS b FROM t a JOIN t b ON a.cam_id = b.cam_id AND a.id < b.id AND a.global_id <> b.global_id WHERE greatest(a.first_frame, b.first_frame) <= least(a.last_frame, b.last_frame) + 60""",
    "handoff_edges": f"""WITH {_DET}, {_visits('cam_id, local_track_id, global_id')}, t AS (SELECT *, global_id * 100000000 + first_frame % 100000000 AS id FROM v)
      SELECT a.id AS a, b.id AS b, b.first_frame - a.last_frame AS gap FROM t a JOIN t b ON a.cam_id <> b.cam_id AND b.first_frame > a.last_frame AND b.first_frame - a.last_frame <= 900""",
    "colocated_pairs": f"""WITH {_DENSE}, {_world('dense')}, g AS (SELECT a.global_id AS a, b.global_id AS b, count(*) AS shared, CAST(sum(CASE WHEN sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 2500 THEN 1 ELSE 0 END) AS BIGINT) AS near
      FROM pt a JOIN pt b ON a.frame_no = b.frame_no AND a.global_id < b.global_id AND a.cam_id <> b.cam_id WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2) SELECT a, b, shared, near FROM g WHERE shared >= 2 AND near >= 0.5 * shared""",
    "remap_components": f"""WITH RECURSIVE {_DENSE}, {_world('dense')}, g AS (SELECT a.global_id AS a, b.global_id AS b, count(*) AS shared, sum(CASE WHEN sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 2500 THEN 1 ELSE 0 END) AS near
      FROM pt a JOIN pt b ON a.frame_no = b.frame_no AND a.global_id < b.global_id AND a.cam_id <> b.cam_id WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2),
      e AS (SELECT a, b FROM g WHERE shared >= 2 AND near >= 0.5 * shared), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      r AS (SELECT DISTINCT global_id AS node, global_id AS seen FROM det UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node, min(seen) AS component FROM r GROUP BY node""",
    "box_interp": f"""WITH {_DENSE}, d AS (SELECT cam_id, local_track_id, frame_no, max(l) AS l, max(t) AS t, max(w) AS w, max(h) AS h FROM dense WHERE frame_no % 5 = 0 GROUP BY 1, 2, 3),
      n AS (SELECT *, lead(frame_no) OVER o AS nf, lead(l) OVER o AS nl, lead(t) OVER o AS nt, lead(w) OVER o AS nw, lead(h) OVER o AS nh FROM d WINDOW o AS (PARTITION BY cam_id, local_track_id ORDER BY frame_no)),
      x AS (SELECT *, unnest(generate_series(frame_no, coalesce(nf - 1, frame_no))) AS f FROM n)
      SELECT cam_id, local_track_id, f AS frame_no, """
    + ", ".join(f"round(CASE WHEN f = frame_no THEN {a} ELSE {a} + (n{a} - {a}) * ((f - frame_no) / (nf - frame_no)) END, 4) AS \"{b}\"" for a, b in (("l", "left"), ("t", "top"), ("w", "width"), ("h", "height")))
    + " FROM x",
    "path_segments": f"""WITH {_DET}, {_world('det')}, p AS (SELECT global_id, frame_no, avg(x) AS x, avg(y) AS y FROM pt WHERE x IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT *, CASE WHEN sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)) > 4000 OR frame_no - lag(frame_no) OVER o > 200000 THEN 1 ELSE 0 END AS brk FROM p WINDOW o AS (PARTITION BY global_id ORDER BY frame_no)),
      s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY global_id ORDER BY frame_no) AS BIGINT) AS segment FROM b)
      SELECT global_id, segment, count(*) AS n_points, min(frame_no) AS first_frame, max(frame_no) AS last_frame FROM s GROUP BY 1, 2 HAVING count(*) >= 3""",
    "bounded_segments": f"""WITH {_DET}, {_world('det')}, p AS (SELECT global_id, frame_no, avg(x) AS x, avg(y) AS y FROM pt WHERE x IS NOT NULL GROUP BY 1, 2), i AS (SELECT *, x BETWEEN -3000 AND 3000 AND y BETWEEN -3000 AND 3000 AS inside FROM p),
      b AS (SELECT *, CASE WHEN lag(x) OVER o IS NOT NULL AND (sqrt(power(x - lag(x) OVER o, 2) + power(y - lag(y) OVER o, 2)) > 4000 OR frame_no - lag(frame_no) OVER o > 200000 OR NOT inside OR NOT lag(inside) OVER o) THEN 1 ELSE 0 END AS brk FROM i WINDOW o AS (PARTITION BY global_id ORDER BY frame_no)),
      s AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY global_id ORDER BY frame_no) AS BIGINT) AS segment FROM b)
      SELECT global_id, segment, count(*) AS n_points, min(frame_no) AS first_frame, max(frame_no) AS last_frame FROM s GROUP BY 1, 2""",
    "occlusion_gaps": f"""WITH {_DENSE}, p AS (SELECT DISTINCT global_id, frame_no FROM dense), n AS (SELECT *, lead(frame_no) OVER (PARTITION BY global_id ORDER BY frame_no) - frame_no AS gap FROM p)
      SELECT global_id, CAST(sum(gap - 1) AS BIGINT) AS missing FROM n WHERE gap > 1 AND gap <= 200 GROUP BY global_id""",
    "gt_union_frames": f"WITH {_TRUTH}, u AS (SELECT cam_id, frame_no FROM gt UNION SELECT cam_id, frame_no FROM dense) SELECT cam_id, count(*) AS n_frames FROM u GROUP BY cam_id",
    "balanced_sample": f"WITH {_DET}, r AS (SELECT *, row_number() OVER (PARTITION BY global_id, cam_id ORDER BY frame_no, det_id) AS r FROM det) SELECT det_id, global_id, cam_id FROM r WHERE r <= 3",
    "env_means": "SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE coalesce(event_type, 'unknown') END AS env, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY ROLLUP (event_type)",
    "ablation_pivot": f"""WITH {_DET}, g AS (SELECT zone, {', '.join(f'count(*) FILTER (cam_id = {c}) AS cam{c}' for c in range(4))} FROM det GROUP BY zone) SELECT *, greatest(cam0, cam1, cam2, cam3) AS best FROM g""",
    "health_creep": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
      q AS (SELECT *, greatest(1, n // 4) AS q FROM r) SELECT o_orderpriority, CASE WHEN min(n) >= 4 THEN round(avg(o_totalprice) FILTER (r > n - q) - avg(o_totalprice) FILTER (r <= q), 2) + 0.0 ELSE 0.0 END AS creep FROM q GROUP BY 1""",
    "log_scan": """SELECT lang, CAST(sum(len(regexp_extract_all(text, '(?i)password|token'))) AS BIGINT) AS hits, CAST(sum(len(regexp_extract_all(text, '\\n'))) AS BIGINT) AS breaks FROM documents GROUP BY lang""",
}
# Ties go up by decimal digits.
ORACLES["box_interp"] = ORACLES["box_interp"].replace("round(CASE", "round(CAST(CASE").replace(" END, 4)", " END AS DECIMAL(20, 10)), 4)::DOUBLE")
ORACLES |= {"box_interp_all": ORACLES["box_interp"], "remap_components_all": ORACLES["remap_components"]}
