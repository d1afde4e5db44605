"""ANSI SQL with the results of the store's and the joins' queries."""

from __future__ import annotations

from .linking_oracles import _HASH, ORACLES as LINKING
from .linking_oracles import _PT, _UNIT
from .oracles import _DENSE, _DET, _world

_RUN = "'run' || (det_id % 3)"
_VISITS = """g AS (SELECT *, det_id % 3 AS run, CASE WHEN frame_no - lag(frame_no) OVER (PARTITION BY det_id % 3, global_id, cam_id, zone ORDER BY frame_no) > 43200 THEN 1 ELSE 0 END AS brk FROM det WHERE global_id >= 0),
  s AS (SELECT *, SUM(brk) OVER (PARTITION BY run, global_id, cam_id, zone ORDER BY frame_no RANGE UNBOUNDED PRECEDING) AS vid FROM g),
  v AS (SELECT 'run' || run AS run_id, global_id, cam_id, zone, MIN(frame_no)::DOUBLE AS t_start, MAX(frame_no)::DOUBLE AS t_end, round((MAX(frame_no) - MIN(frame_no))::DOUBLE, 3) AS seconds, MAX(frame_no) - MIN(frame_no) + 1 AS n_frames
    FROM s GROUP BY run, global_id, cam_id, zone, vid)"""
_STATS = LINKING["track_stats"]

ORACLES: dict[str, str] = {
    "store_runs": f"WITH {_DET} SELECT {_RUN} AS run_id, count(*) AS n_dets, count(DISTINCT global_id) AS n_gids, count(DISTINCT cam_id) AS n_cams, 0.0::DOUBLE AS epoch, 1.0::DOUBLE AS fps FROM det WHERE global_id >= 0 GROUP BY 1",
    "store_zones": f"WITH {_DET} SELECT DISTINCT {_RUN} AS run_id, zone FROM det WHERE global_id >= 0",
    "store_persons": f"WITH {_DET} SELECT DISTINCT {_RUN} AS run_id, global_id FROM det WHERE global_id >= 0",
    "store_timeline": f"WITH {_DET}, {_VISITS} SELECT * FROM v",
    "store_trajectory": f"""WITH {_DET}, {_world('det')}, r AS (SELECT *, row_number() OVER (PARTITION BY det_id % 3, global_id ORDER BY frame_no, cam_id, local_track_id, l + w / 2, t + h) - 1 AS n FROM pt WHERE x IS NOT NULL AND global_id >= 0)
      SELECT {_RUN} AS run_id, global_id, frame_no::DOUBLE AS ts, cam_id, round(x, 3) + 0.0 AS world_x, round(y, 3) + 0.0 AS world_y, zone FROM r WHERE n % 3 = 0""",
    "store_dwell": f"WITH {_DET}, {_VISITS} SELECT run_id, global_id, zone, round(sum(t_end - t_start), 3) AS seconds, count(*) AS n_visits FROM v GROUP BY 1, 2, 3",
    "store_top_zones": f"""WITH {_DET}, g AS (SELECT {_RUN} AS run_id, zone, count(DISTINCT global_id)::DOUBLE AS value FROM det WHERE global_id >= 0 GROUP BY 1, 2),
      r AS (SELECT run_id, zone, 'footfall' AS metric, value, row_number() OVER (PARTITION BY run_id ORDER BY value DESC, zone) AS rank FROM g) SELECT * FROM r WHERE rank <= 3""",
    "store_zone_occupancy": f"""WITH {_DET} SELECT {_RUN} AS run_id, zone, CAST(floor(frame_no / 86400) AS BIGINT) AS bucket, CAST(floor(frame_no / 86400) AS BIGINT) * 86400.0::DOUBLE AS t_bucket,
      round(count(*) / 1.0::DOUBLE, 3) AS occupancy_s, count(DISTINCT global_id) AS footfall FROM det WHERE global_id >= 0 GROUP BY 1, 2, 3""",
    "store_search": """WITH e AS (SELECT vec_id, 'run' || (vec_id % 3) AS run_id, label::BIGINT AS gid, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
      m AS (SELECT run_id, gid, i, avg(x) AS x FROM e WHERE gid >= 0 GROUP BY 1, 2, 3), n AS (SELECT run_id, gid, sqrt(sum(x * x)) AS n FROM m GROUP BY 1, 2),
      q AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS q FROM e WHERE vec_id % 50 = 0),
      d AS (SELECT m.run_id, -1 - vec_id AS query_id, m.gid AS global_id, round(sum(q * m.x / n), 4) AS score FROM q JOIN m USING (i) JOIN n ON m.run_id = n.run_id AND m.gid = n.gid GROUP BY 1, 2, 3),
      r AS (SELECT run_id, query_id, row_number() OVER (PARTITION BY run_id, query_id ORDER BY score DESC, global_id) AS rank, global_id, round(score, 3) + 0.0 AS score FROM d) SELECT * FROM r WHERE rank <= 3""",
    "latest_ids": f"""WITH {_DENSE}, a AS (SELECT cam_id, local_track_id, frame_no, max(global_id) AS given FROM dense WHERE det_id % 5 = 0 GROUP BY 1, 2, 3)
      SELECT det_id, coalesce(given, global_id) AS global_id FROM dense d ASOF LEFT JOIN a ON d.cam_id = a.cam_id AND d.local_track_id = a.local_track_id AND d.frame_no >= a.frame_no""",
    "similar_vectors": f"""WITH {_UNIT}, s AS (SELECT *, {_HASH} % 5 AS scene FROM v), j AS (SELECT a.scene, a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS score FROM s a JOIN s b ON a.scene = b.scene AND a.vec_id < b.vec_id)
      SELECT scene, a, b, round(score, 5) + 0.0 AS score FROM j WHERE score >= 0.4""",
    "vector_chunks": "SELECT CAST(vec_id // 100 AS INTEGER) AS chunk, count(*) AS n, min(vec_id) AS first_frame, max(vec_id) AS last_frame, CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1",
    "track_filter_yield": f"""WITH t AS ({_STATS}), g AS (SELECT * FROM (VALUES (500), (5000)) a(span_below), (VALUES (100.0::DOUBLE), (150.0::DOUBLE)) b(motion_below))
      SELECT CAST(span_below AS INTEGER) AS span_below, motion_below, class, CAST(sum(CAST(span < span_below OR motion < motion_below AS INTEGER)) AS BIGINT) AS dropped, count(*) AS n FROM t, g GROUP BY 1, 2, 3""",
    "track_class_medians": f"WITH t AS ({_STATS}) SELECT class, count(*) AS n, round(quantile_cont(motion, 0.5), 4) AS motion, round(quantile_cont(span::DOUBLE, 0.5), 4) AS span, round(quantile_cont(height, 0.5), 4) AS height FROM t GROUP BY class",
    "dashboard": f"""WITH {_DET}, m AS (SELECT cam_id, max(frame_no) AS frame_no FROM det GROUP BY 1), o AS (SELECT count(*) AS online FROM m WHERE cam_id IN (0, 2, 9)),
      n AS (SELECT zone, count(DISTINCT global_id) AS people FROM det JOIN m USING (cam_id, frame_no) GROUP BY zone)
      SELECT zone, people, coalesce(people > CASE zone WHEN 'click' THEN 0 WHEN 'view' THEN 100 END, false) AS alarm, online FROM n, o""",
    "balanced_caps": f"""WITH {_DET}, r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY frame_no, det_id) AS r FROM det), q AS (SELECT *, row_number() OVER (PARTITION BY zone, cam_id ORDER BY frame_no, det_id) AS q FROM r WHERE r <= 200)
      SELECT det_id, zone, cam_id FROM q WHERE q <= 60""",
    "truth_space": f"""WITH {_DENSE} SELECT det_id, round(l * 0.5, 4) AS "left", round(t * 0.5, 4) AS top, round(w * 0.5, 4) AS width, round(h * 0.5, 4) AS height FROM dense WHERE global_id >= 0""",
    "clock_times": f"WITH {_DET}, s AS (SELECT det_id, frame_no % 86400 AS s FROM det) SELECT det_id, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS time FROM s",
    "linker_sweep": f"""WITH {_PT}, c AS (SELECT frame_no % 16 AS scene, frame_no, x, y, setting, cell FROM q, (VALUES (0, 500.0::DOUBLE), (1, 1500.0::DOUBLE), (2, 4000.0::DOUBLE)) g(setting, cell)),
      k AS (SELECT setting, cell, scene, count(*) / count(DISTINCT (frame_no, floor(x / cell), floor(y / cell))) AS boxes FROM c GROUP BY 1, 2, 3)
      SELECT CAST(setting AS BIGINT) AS setting, round(avg(boxes), 6) AS mean, count(*) AS scenes, cell FROM k GROUP BY setting, cell""",
}
