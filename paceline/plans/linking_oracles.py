"""ANSI SQL with the results of the queries of paths, grids and linking."""

from __future__ import annotations

import math

from .oracles import _DENSE, _DET, _IOU, _TRUTH, _world

_PT = f"{_DENSE}, {_world('dense')}, q AS (SELECT det_id, cam_id, frame_no, global_id, x, y FROM pt WHERE x IS NOT NULL)"
_PATH = f"{_PT}, p AS (SELECT global_id, frame_no, avg(x) AS x, avg(y) AS y FROM q WHERE global_id >= 0 GROUP BY 1, 2)"
_TRACKLETS = f"{_PT}, tp AS (SELECT (global_id * 4 + cam_id) * 1000000 + frame_no // 100 AS id, cam_id, frame_no, avg(x) AS x, avg(y) AS y FROM q GROUP BY 1, 2, 3)"
_FAR = "sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))"


def _pairs(source: str, key: str) -> str:
    return f"""pd AS (SELECT a.{key} AS a, b.{key} AS b, count(*) AS shared, quantile_cont({_FAR}, 0.5) AS distance
      FROM {source} a JOIN {source} b ON a.frame_no = b.frame_no AND a.{key} < b.{key} AND a.cam_id <> b.cam_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


_SCORED = f"{_PT}, {_pairs('q', 'global_id')}, sc AS (SELECT a, b, shared, exp(-3 * power(greatest(0, (distance - 300) / 1700.0::DOUBLE), 2)) AS score FROM pd)"


def _cells(columns: int, rows: int) -> str:
    return f"""cells AS (SELECT cam_id, CAST(greatest(0, least({columns} - 1, floor((l + w / 2) * {columns} / 640.0::DOUBLE))) AS INTEGER) AS gx,
      CAST(greatest(0, least({rows} - 1, floor((t + h) * {rows} / 360.0::DOUBLE))) AS INTEGER) AS gy, frame_no FROM dense),
      grid AS (SELECT cam_id, gx, gy, count(*) AS occupancy FROM cells GROUP BY 1, 2, 3)"""


def _mirror(i: str, n: str) -> str:
    return f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"


def _smooth(source: str, axis: str, n: int, sigma: float) -> str:
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    taps = ", ".join(f"({k}, CAST('{w / sum(raw)!r}' AS DOUBLE))" for k, w in zip(range(-reach, reach + 1), raw, strict=True))
    at, other = f"((c.{axis} + k + {2 * n}) % {2 * n})", "gy" if axis == "gx" else "gx"
    return f"""(SELECT c.cam_id, c.gx, c.gy, sum(tw * coalesce(s.occupancy, 0)) AS occupancy FROM allc c CROSS JOIN (VALUES {taps}) taps(k, tw)
      LEFT JOIN {source} s ON s.cam_id = c.cam_id AND s.{other} = c.{other} AND s.{axis} = CASE WHEN {at} >= {n} THEN {2 * n - 1} - {at} ELSE {at} END GROUP BY 1, 2, 3)"""


def _lerp(f: str, c: str) -> str:
    return f"CASE WHEN {f} = f0 THEN {c}0 ELSE {c}0 + ({c}1 - {c}0) * (({f} - f0) / (f1 - f0)) END AS {c}"


def _pixel(z: str, name: str) -> str:
    p = lambda k: f"(r{k}1 * x + r{k}2 * y + r{k}3 * {z}::DOUBLE + t{k})"
    return f"CASE WHEN {p(3)} > 1e-6 THEN fx * {p(1)} / {p(3)} + cx END AS {name}u, CASE WHEN {p(3)} > 1e-6 THEN fy * {p(2)} / {p(3)} + cy END AS {name}v"


_UNIT = """u AS (SELECT vec_id, CAST(label AS BIGINT) AS person_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  v AS (SELECT vec_id, person_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM u)"""

ORACLES: dict[str, str] = {
    "vote_smoothing": f"""WITH {_DET}, r AS (SELECT *, row_number() OVER (PARTITION BY cam_id, local_track_id ORDER BY frame_no, det_id) AS r FROM det),
      c AS (SELECT a.det_id, b.global_id, count(*) AS n, min(b.r) AS f FROM r a JOIN r b ON a.cam_id = b.cam_id AND a.local_track_id = b.local_track_id AND b.r BETWEEN a.r - 5 AND a.r + 5 GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY det_id ORDER BY n DESC, f) AS k FROM c) SELECT det_id, global_id AS voted FROM k WHERE k = 1""",
    "end_velocities": f"""WITH {_PATH}, u AS (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY frame_no) AS up, row_number() OVER (PARTITION BY global_id ORDER BY frame_no DESC) AS dn FROM p),
      e AS (SELECT global_id, {', '.join(f'arg_{m}({c}, frame_no) FILTER ({s} <= 5) AS {c}_{s}_{m}' for c in ('x', 'y', 'frame_no') for s in ('up', 'dn') for m in ('min', 'max'))} FROM u GROUP BY 1)
      SELECT global_id, {', '.join(f'round(({c}_{s}_max - {c}_{s}_min) / nullif(frame_no_{s}_max - frame_no_{s}_min, 0), 4) + 0.0 AS {n}_v{c}' for s, n in (('up', 'entry'), ('dn', 'exit')) for c in ('x', 'y'))} FROM e""",
    "smooth_paths": f"""WITH {_PATH}, o AS (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY frame_no) - 1 AS i, count(*) OVER (PARTITION BY global_id) AS n FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
      m AS (SELECT a.global_id, a.frame_no, a.i, a.n, CASE WHEN a.n < 5 THEN any_value(a.x) ELSE quantile_cont(b.x, 0.5) END AS x, CASE WHEN a.n < 5 THEN any_value(a.y) ELSE quantile_cont(b.y, 0.5) END AS y
        FROM o a JOIN range(-4, 5) t(k) ON abs(k) <= (a.n - 1) // 2 JOIN o b ON b.global_id = a.global_id AND b.i = {_mirror('a.i + k', 'a.n')} GROUP BY a.global_id, a.frame_no, a.i, a.n)
      SELECT a.global_id, a.frame_no, round(CASE WHEN a.n < 5 THEN any_value(a.x) ELSE avg(b.x) END, 3) + 0.0 AS x, round(CASE WHEN a.n < 5 THEN any_value(a.y) ELSE avg(b.y) END, 3) + 0.0 AS y
        FROM m a CROSS JOIN range(-2, 3) t(k) JOIN m b ON b.global_id = a.global_id AND b.i = {_mirror('a.i + k', 'a.n')} GROUP BY a.global_id, a.frame_no, a.i, a.n""",
    "gap_filled_paths": f"""WITH {_PATH}, b AS (SELECT global_id, frame_no // 20 AS f0, avg(x) AS x0, avg(y) AS y0 FROM p GROUP BY 1, 2), c AS (SELECT *, count(*) OVER (PARTITION BY global_id) AS have FROM b),
      k AS (SELECT * FROM c WHERE have >= 3 AND have >= 0.04 * (SELECT max(f0) - min(f0) + 1 FROM b)),
      n AS (SELECT *, lead(f0) OVER o AS f1, lead(x0) OVER o AS x1, lead(y0) OVER o AS y1 FROM k WINDOW o AS (PARTITION BY global_id ORDER BY f0)),
      g AS (SELECT *, unnest(generate_series(f0, CASE WHEN f1 - f0 <= 3 THEN f1 - 1 ELSE f0 END)) AS bin FROM n), z AS (SELECT global_id, bin, {_lerp('bin', 'x')}, {_lerp('bin', 'y')} FROM g)
      SELECT global_id, bin, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM z""",
    "nearest_camera": f"""WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY global_id, frame_no ORDER BY w * h DESC, cam_id, det_id) AS r FROM dense WHERE global_id >= 0)
      SELECT global_id, frame_no, cam_id, det_id FROM r WHERE r = 1""",
    "floor_segments": f"""WITH {_PATH}, g AS (SELECT global_id, frame_no, lag(frame_no) OVER o AS f, lag(x) OVER o AS x0, lag(y) OVER o AS y0, x AS x1, y AS y1 FROM p WINDOW o AS (PARTITION BY global_id ORDER BY frame_no))
      SELECT global_id, frame_no, {', '.join(f'round({c}, 3) + 0.0 AS {c}' for c in ('x0', 'y0', 'x1', 'y1'))} FROM g WHERE frame_no - f <= 15""",
    "occlusion_fill": f"""WITH {_PATH}, y AS (SELECT global_id, frame_no AS f0, x AS x0, y AS y0, lead(frame_no) OVER o AS f1, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM p WINDOW o AS (PARTITION BY global_id ORDER BY frame_no)),
      e AS (SELECT *, unnest(generate_series(f0, CASE WHEN f1 - f0 <= 50 THEN f1 - 1 ELSE f0 END)) AS f FROM y), pos AS (SELECT global_id, f AS frame_no, {_lerp('f', 'x')}, {_lerp('f', 'y')} FROM e),
      s AS (SELECT DISTINCT global_id, cam_id, frame_no FROM dense WHERE global_id >= 0), n AS (SELECT *, lead(frame_no) OVER (PARTITION BY global_id, cam_id ORDER BY frame_no) AS nx FROM s),
      m AS (SELECT global_id, cam_id, unnest(generate_series(frame_no + 1, nx - 1)) AS frame_no FROM n WHERE nx - frame_no > 1 AND nx - frame_no <= 50),
      j AS (SELECT global_id, cam_id, frame_no, {_pixel('0.0', 'f')}, {_pixel('1700.0', 'h')} FROM m JOIN pos USING (global_id, frame_no) JOIN cam USING (cam_id))
      SELECT global_id, cam_id, frame_no, round((fu + hu) / 2 - abs(fv - hv) * 0.33::DOUBLE / 2, 3) + 0.0 AS "left", round(least(fv, hv), 3) + 0.0 AS "top", round(abs(fv - hv) * 0.33::DOUBLE, 3) AS "width", round(abs(fv - hv), 3) AS "height"
      FROM j WHERE fu BETWEEN 0 AND 640 AND greatest(fv, hv) BETWEEN 0 AND 360 AND hv IS NOT NULL""",
    "span_fill": f"""WITH {_PATH}, y AS (SELECT global_id, frame_no AS f0, x AS x0, y AS y0, lead(frame_no) OVER o AS f1, lead(x) OVER o AS x1, lead(y) OVER o AS y1 FROM p WINDOW o AS (PARTITION BY global_id ORDER BY frame_no)),
      e AS (SELECT *, unnest(generate_series(f0, coalesce(f1 - 1, f0))) AS f FROM y), pos AS (SELECT global_id, f AS frame_no, {_lerp('f', 'x')}, {_lerp('f', 'y')} FROM e),
      s AS (SELECT DISTINCT global_id, cam_id, frame_no FROM dense WHERE global_id >= 0), o AS (SELECT global_id, cam_id FROM s GROUP BY 1, 2 HAVING count(*) >= 3),
      m AS (SELECT * FROM pos JOIN o USING (global_id) ANTI JOIN s USING (global_id, cam_id, frame_no) WHERE frame_no <= 1000000),
      j AS (SELECT global_id, cam_id, frame_no, {_pixel('0.0', 'f')}, {_pixel('1700.0', 'h')} FROM m JOIN cam USING (cam_id))
      SELECT global_id, cam_id, count(*) AS n, min(frame_no) AS first_frame, max(frame_no) AS last_frame, round(avg((fu + hu) / 2 - abs(fv - hv) * 0.33::DOUBLE / 2), 3) + 0.0 AS "left", round(avg(least(fv, hv)), 3) + 0.0 AS "top",
        round(avg(abs(fv - hv) * 0.33::DOUBLE), 3) AS "width", round(avg(abs(fv - hv)), 3) AS "height"
      FROM j WHERE fu BETWEEN 0 AND 640 AND greatest(fv, hv) BETWEEN 0 AND 360 AND hv IS NOT NULL GROUP BY 1, 2""",
    "smoothed_grid": f"""WITH {_DENSE}, {_cells(32, 18)}, allc AS (SELECT cam_id, CAST(x AS INTEGER) AS gx, CAST(y AS INTEGER) AS gy FROM (SELECT DISTINCT cam_id FROM grid), range(32) r(x), range(18) s(y)),
      a AS {_smooth('grid', 'gx', 32, 1.2)}, b AS {_smooth('a', 'gy', 18, 1.2)} SELECT cam_id, gx, gy, round(occupancy, 5) AS occupancy FROM b""",
    "grid_stats": f"""WITH {_DENSE}, {_cells(32, 18)}, r AS (SELECT *, row_number() OVER (PARTITION BY cam_id ORDER BY occupancy DESC, gy, gx) AS r, max(occupancy) OVER (PARTITION BY cam_id) AS m FROM grid)
      SELECT cam_id, max(m) AS peak, max(gx) FILTER (r = 1) AS peak_gx, max(gy) FILTER (r = 1) AS peak_gy, CAST(sum(occupancy) AS BIGINT) AS n_dets, round(count(*) FILTER (occupancy > 0.05 * m) / 576.0::DOUBLE, 6) AS occupied FROM r GROUP BY cam_id""",
    "floor_histogram": f"""WITH {_PT}, e AS (SELECT quantile_cont(x, 0.005) AS x0, quantile_cont(x, 0.995) AS x1, quantile_cont(y, 0.005) AS y0, quantile_cont(y, 0.995) AS y1 FROM q)
      SELECT CAST(least(23, floor((x - x0) / (x1 - x0) * 24)) AS INTEGER) AS gx, CAST(least(23, floor((y - y0) / (y1 - y0) * 24)) AS INTEGER) AS gy, count(*) AS occupancy FROM q, e
      WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2""",
    "footprint_bounds": f"""WITH {_PT}, e AS (SELECT quantile_cont(x, 0.25) AS x0, quantile_cont(x, 0.75) AS x1, quantile_cont(y, 0.25) AS y0, quantile_cont(y, 0.75) AS y1, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM q),
      w AS (SELECT *, 1.6 * greatest(x1 - x0, 0.001) AS xw, 1.6 * greatest(y1 - y0, 0.001) AS yw FROM e)
      SELECT round(greatest(xa, x0 - xw), 3) AS x_low, round(least(xb, x1 + xw), 3) AS x_high, round(greatest(ya, y0 - yw), 3) AS y_low, round(least(yb, y1 + yw), 3) AS y_high FROM w""",
    "walked_area": f"""WITH {_PT}, e AS (SELECT quantile_cont(x, 0.02) AS x0, quantile_cont(x, 0.98) AS x1, quantile_cont(y, 0.02) AS y0, quantile_cont(y, 0.98) AS y1 FROM q)
      SELECT round(x0 - 0.12 * (x1 - x0), 3) AS x_low, round(x1 + 0.12 * (x1 - x0), 3) AS x_high, round(y0 - 0.12 * (y1 - y0), 3) AS y_low, round(y1 + 0.12 * (y1 - y0), 3) AS y_high FROM e""",
    "zone_percentiles": f"""WITH {_DET} SELECT zone, round(min(t + h), 4) AS low, round(quantile_cont(t + h, 0.25), 4) AS q1, round(quantile_cont(t + h, 0.5), 4) AS "median", round(quantile_cont(t + h, 0.75), 4) AS q3, round(max(t + h), 4) AS high
      FROM det GROUP BY zone""",
    "live_grid": f"""WITH {_DENSE}, {_cells(32, 18)}, m AS (SELECT cam_id, max(frame_no) AS f FROM cells GROUP BY 1)
      SELECT cam_id, gx, gy, round(sum(power(0.96::DOUBLE, f - frame_no)), 6) AS heat FROM cells JOIN m USING (cam_id) GROUP BY 1, 2, 3""",
    "time_lapse": f"""WITH {_DENSE}, {_cells(16, 9)}, e AS (SELECT min(frame_no) AS f0, max(frame_no) AS f1 FROM cells),
      n AS (SELECT cam_id, gx, gy, CAST((frame_no - f0) * 8 // (f1 - f0 + 1) AS INTEGER) AS step, count(*) AS n FROM cells, e GROUP BY 1, 2, 3, 4)
      SELECT cam_id, gx, gy, step, CAST(sum(n) OVER (PARTITION BY cam_id, gx, gy ORDER BY step) AS BIGINT) AS occupancy FROM n""",
    "pair_median_scores": f"WITH {_SCORED} SELECT a, b, shared, round(score, 6) AS score FROM sc",
    "candidate_pairs": f"""WITH {_SCORED}, u AS (SELECT a, b, score FROM sc WHERE score >= 0.3 UNION ALL SELECT b, a, score FROM sc WHERE score >= 0.3),
      r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM u), e AS (SELECT a, max(score) FILTER (r = 1) AS s1, max(score) FILTER (r = 2) AS s2 FROM r GROUP BY a)
      SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(score), 6) AS score FROM r JOIN e USING (a) WHERE r <= 5 AND (s2 IS NULL OR s1 >= s2 + 0.005::DOUBLE) GROUP BY 1, 2""",
    "geo_merge": f"""WITH RECURSIVE {_PT}, f AS (SELECT a.global_id AS a, b.global_id AS b, a.frame_no, min({_FAR}) AS d, max(CAST(a.cam_id = b.cam_id AS INTEGER)) AS same
      FROM q a JOIN q b ON a.frame_no = b.frame_no AND a.global_id < b.global_id GROUP BY 1, 2, 3),
      g AS (SELECT a, b FROM f GROUP BY 1, 2 HAVING count(*) >= 3 AND max(same) = 0 AND count(*) FILTER (d < 1000) >= 0.7 * count(*)), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
      r AS (SELECT DISTINCT global_id AS node, global_id AS seen FROM q UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a) SELECT node, min(seen) AS component FROM r GROUP BY node""",
    "tracklet_links": f"""WITH {_TRACKLETS}, {_pairs('tp', 'id')}, t AS (SELECT id, min(frame_no) AS f0, max(frame_no) AS f1, arg_min(x, frame_no) AS x0, arg_min(y, frame_no) AS y0, arg_max(x, frame_no) AS x1, arg_max(y, frame_no) AS y1 FROM tp GROUP BY id),
      h AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM t a JOIN t b ON b.f0 > a.f1 AND b.f0 <= a.f1 + 20 WHERE sqrt(power(b.x0 - a.x1, 2) + power(b.y0 - a.y1, 2)) <= 300)
      SELECT a, b FROM pd WHERE distance <= 1500 UNION SELECT a, b FROM h""",
    "geo_split": f"""WITH RECURSIVE {_TRACKLETS}, t AS (SELECT *, id // 8000000 * 1000000 + id % 1000000 AS gid FROM tp),
      g AS (SELECT a.gid, a.id AS a, b.id AS b, quantile_cont({_FAR}, 0.5) AS d, max(CAST(a.cam_id = b.cam_id AS INTEGER)) AS same FROM t a JOIN t b ON a.gid = b.gid AND a.frame_no = b.frame_no AND a.id < b.id GROUP BY 1, 2, 3),
      s AS (SELECT DISTINCT gid FROM g WHERE same = 1 OR d > 4000), l AS (SELECT a, b FROM g SEMI JOIN s USING (gid) WHERE same = 0 AND d <= 2000), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
      n AS (SELECT DISTINCT id, gid FROM t), r AS (SELECT id AS node, id AS seen FROM n SEMI JOIN s USING (gid) UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a), c AS (SELECT node, min(seen) AS part FROM r GROUP BY node)
      SELECT id AS tracklet_id, gid AS global_id, coalesce(part, min(id) OVER (PARTITION BY gid)) AS part FROM n LEFT JOIN c ON c.node = n.id""",
    "handoff_scores": f"""WITH {_TRACKLETS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY frame_no DESC) AS r FROM tp),
      a AS (SELECT id, min(frame_no) AS f0, max(frame_no) AS f1, arg_min(x, frame_no) AS x0, arg_min(y, frame_no) AS y0, arg_max(x, frame_no) AS x1, arg_max(y, frame_no) AS y1 FROM r WHERE r <= 5 GROUP BY id),
      v AS (SELECT *, CASE WHEN f1 > f0 THEN (x1 - x0) / (f1 - f0) ELSE 0 END AS vx, CASE WHEN f1 > f0 THEN (y1 - y0) / (f1 - f0) ELSE 0 END AS vy FROM a),
      b AS (SELECT id, min(frame_no) AS f, arg_min(x, frame_no) AS x, arg_min(y, frame_no) AS y FROM tp GROUP BY id),
      j AS (SELECT v.id AS a, b.id AS b, f - f1 AS gap, sqrt(power(x1 + vx * (f - f1) - x, 2) + power(y1 + vy * (f - f1) - y, 2)) AS d FROM v JOIN b ON f > f1 AND f <= f1 + 10)
      SELECT a, b, gap, round(exp(-3 * power(greatest(0, (d - 300) / 1700.0::DOUBLE), 2)) * 0.85::DOUBLE, 6) AS score FROM j""",
    "remap_compressed": f"""WITH RECURSIVE {_DET}, d AS (SELECT DISTINCT cam_id, local_track_id, global_id FROM det WHERE global_id >= 0),
      l AS (SELECT global_id AS source, lag(global_id) OVER (PARTITION BY cam_id, local_track_id ORDER BY global_id) AS target FROM d), m AS (SELECT source, min(target) AS target FROM l WHERE target IS NOT NULL GROUP BY source),
      r AS (SELECT source, target FROM m UNION SELECT r.source, m.target FROM r JOIN m ON r.target = m.source) SELECT source, min(target) AS target FROM r GROUP BY source""",
    "retrieval_scores": f"""WITH {_UNIT}, s AS (SELECT *, vec_id % 5 AS scene, vec_id // 5 % 4 AS cam FROM v),
      j AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) AS score, CAST(a.person_id = b.person_id AS INTEGER) AS m FROM s a JOIN s b ON a.scene = b.scene AND a.cam <> b.cam WHERE a.vec_id % 20 = 1),
      r AS (SELECT *, row_number() OVER w AS rank, sum(m) OVER w AS hits FROM j WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id))
      SELECT query_id, CAST(max(m) FILTER (rank = 1) AS INTEGER) AS hit, round(avg(hits / rank) FILTER (m = 1), 6) AS ap FROM r GROUP BY query_id HAVING max(m) = 1""",
    "gid_summaries": f"""WITH {_DENSE}, {_UNIT}, g AS (SELECT cam_id, local_track_id, global_id, count(*) AS n FROM dense GROUP BY 1, 2, 3), t AS (SELECT *, row_number() OVER (ORDER BY cam_id, local_track_id, global_id) - 1 AS id FROM g),
      p AS (SELECT global_id, n, unnest(v) AS x, unnest(range(len(v))) AS i FROM t JOIN v ON id % (SELECT count(*) FROM v) = vec_id WHERE n >= 6),
      m AS (SELECT global_id, CAST(i AS INTEGER) AS i, sum(x * n) / sum(n) AS x FROM p GROUP BY 1, 2), k AS (SELECT global_id, sqrt(sum(x * x)) AS k FROM m GROUP BY 1)
      SELECT global_id, i, round(x / k, 5) + 0.0 AS x FROM m JOIN k USING (global_id) WHERE k > 0""",
    "crop_clamp": f"""WITH {_DET}, r AS (SELECT det_id, round_even(l * 1.5::DOUBLE - 30, 0) AS x1, round_even(t * 1.5::DOUBLE - 30, 0) AS y1, round_even((l + w) * 1.5::DOUBLE - 30, 0) AS x2, round_even((t + h) * 1.5::DOUBLE - 30, 0) AS y2 FROM det),
      c AS (SELECT det_id, (x2 - x1) * (y2 - y1) AS a, least(greatest(x1, 0), 640) AS x1, least(greatest(y1, 0), 360) AS y1, least(greatest(x2, 0), 640) AS x2, least(greatest(y2, 0), 360) AS y2 FROM r)
      SELECT det_id, x1::DOUBLE + 0.0 AS x1, y1::DOUBLE + 0.0 AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM c WHERE x2 - x1 >= 16 AND y2 - y1 >= 32 AND (x2 - x1) * (y2 - y1) >= 0.6::DOUBLE * a""",
    "normalised_boxes": f"WITH {_DENSE} SELECT DISTINCT cam_id, frame_no, "
    # Ties go up by decimal digits.
    + ", ".join(f"round(CAST({e} AS DECIMAL(20, 10)), 6)::DOUBLE AS {n}" for e, n in (("(l + w / 2) / 640", "cx"), ("(t + h / 2) / 360", "cy"), ("w / 640", "bw"), ("h / 360", "bh")))
    + " FROM dense",
    "rescaled_boxes": f"""WITH {_TRUTH}, s AS (SELECT det_id, cam_id, k * l AS l, k * t AS t, k * w AS w, k * h AS h FROM (SELECT *, CASE WHEN cam_id = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k FROM dense)),
      g AS (SELECT cam_id, max(l + w) AS gx, max(t + h) AS gy FROM gt GROUP BY 1), p AS (SELECT cam_id, max(l + w) AS px, max(t + h) AS py FROM s GROUP BY 1),
      f AS (SELECT *, CASE WHEN abs(gx / px - 1) > 0.05 THEN gx / px ELSE 1.0::DOUBLE END AS kx, CASE WHEN abs(gy / py - 1) > 0.05 THEN gy / py ELSE 1.0::DOUBLE END AS ky FROM s JOIN g USING (cam_id) JOIN p USING (cam_id))
      SELECT det_id, round(l * kx, 4) AS "left", round(t * ky, 4) AS "top", round(w * kx, 4) AS "width", round(h * ky, 4) AS "height" FROM f""",
    "snapped_truth": f"WITH {_TRUTH} SELECT a.det_id, b.frame_no AS \"at\", b.person_id FROM dense a JOIN gt b ON a.cam_id = b.cam_id AND a.frame_no // 5 * 5 = b.frame_no",
    "assignment_join": f"""WITH {_DENSE}, a AS (SELECT cam_id, local_track_id, frame_no, arg_max(global_id, det_id) AS given FROM dense WHERE det_id % 3 <> 0 GROUP BY 1, 2, 3)
      SELECT det_id, coalesce(given, -1) AS given FROM dense LEFT JOIN a USING (cam_id, local_track_id, frame_no)""",
    "track_stats": f"""WITH {_TRUTH}, b AS (SELECT a.det_id, max({_IOU}) AS iou FROM dense a JOIN gt b ON a.cam_id = b.cam_id AND a.frame_no = b.frame_no GROUP BY 1),
      t AS (SELECT cam_id, local_track_id, avg(CASE WHEN iou >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS matched, sqrt(power(stddev_pop(l + w / 2), 2) + power(stddev_pop(t + h / 2), 2)) AS motion, max(frame_no) - min(frame_no) AS span, avg(h) AS height
      FROM dense LEFT JOIN b USING (det_id) GROUP BY 1, 2)
      SELECT cam_id, local_track_id, round(matched, 6) AS matched, round(motion, 4) AS motion, span, round(height, 4) AS height, CASE WHEN matched < 0.2 THEN 'false' ELSE 'true' END AS class FROM t""",
    "health_rollup": """WITH e AS (SELECT event_type, value, epoch_us(ts) // 1000000 AS s FROM events), f AS (SELECT event_type, min(s) AS t0, max(s) AS t1 FROM e GROUP BY 1)
      SELECT event_type, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM e JOIN f USING (event_type) WHERE s >= t0 + 86400 OR t1 < t0 + 86400 GROUP BY 1""",
}
#: Every vector is a query; scene and camera come from a hash of its id.
_HASH = "('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 6))::BIGINT"
_PLACED = ORACLES["retrieval_scores"].replace("vec_id % 5 AS scene, vec_id // 5 % 4 AS cam", f"{_HASH} % 5 AS scene, {_HASH} // 5 % 4 AS cam")
ORACLES["retrieval_scores_all"] = _PLACED.replace(" WHERE a.vec_id % 20 = 1", "")
ORACLES["retrieval_scores"] = _PLACED.replace("a.vec_id % 20 = 1", "a.vec_id % 50 = 0")
