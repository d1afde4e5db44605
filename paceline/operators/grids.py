"""Density grids over floors and frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, column: str, at: list[float], *keys: str, bins: int = 128) -> DataFrame:
    """Exact percentiles of ``column``, interpolated: an array in the order of ``at``, one row or one for each key.

    Values are counted by themselves and by spans between splitters, which a sketch of the
    distinct values places so that spans hold about as many each, however far values lie apart.
    Ranks are looked up in the spans that hold them, in rows sorted there, so no task holds
    the column; the sketch's error moves a span's ends and no result.
    Nulls and NaN don't count; a key with nothing else has no row.
    """
    v = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    v = v.groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    one = F.lit(0).alias("_all")  # stands in for a key where there is none
    v = v.select(one, *keys, "_v", "_n")
    by = ["_all", *keys]
    steps = [k / max(2, bins) for k in range(1, max(2, bins))]
    reach = v.groupBy(*by).agg(F.percentile_approx("_v", steps, 10 * bins).alias("_splits"), F.sum("_n").alias("_total"))
    v = v.join(reach, by).select(*by, F.size(F.filter("_splits", lambda s: s <= F.col("_v"))).alias("_bin"), "_v", "_n")
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = v.groupBy(*by, "_bin").agg(F.sum("_n").alias("_n")).select(*by, "_bin", "_n", ahead.alias("_before"))
    places = F.posexplode(F.array(*[F.lit(float(p)) for p in at])).alias("_i", "_p")
    asked = reach.select(*by, (F.col("_total") - 1).alias("_top"), places).withColumn("_at", F.col("_p") * F.col("_top"))
    asked = asked.select(*by, "_i", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_k"))
    asked = asked.join(spans, by).where((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_n"))).drop("_n")
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = v.join(asked.select(*by, "_bin").distinct(), [*by, "_bin"], "left_semi").withColumn("_inner", inner)
    first = F.col("_before") + F.col("_inner")
    found = asked.join(rows, [*by, "_bin"]).where((F.col("_k") >= first) & (F.col("_k") < first + F.col("_n")))
    ends = found.groupBy(*by, "_i").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.first(F.col("_at") - F.floor("_at")).alias("_t"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")
    out = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", value.alias("_q")))).alias("_q"))
    return out.select(*keys, F.transform("_q", lambda q: q["_q"]).alias(column))


def smoothed(grid: DataFrame, columns: int, rows: int, sigma: float, value: str = "occupancy") -> DataFrame:
    """Gaussian smoothing of each camera's grid, axis by axis, mirrored at the borders; all cells come back."""
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    taps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w / sum(raw)).alias("w")) for k, w in zip(range(-reach, reach + 1), raw, strict=True)])).alias("tap")

    def mirror(i: Column, n: int) -> Column:
        i = F.pmod(i, F.lit(2 * n))
        return F.when(i >= n, 2 * n - 1 - i).otherwise(i)

    cells = grid.select("cam_id").distinct().select("cam_id", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("gx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("gy"))
    out = grid.select("cam_id", "gx", "gy", F.col(value).cast("double").alias("v"))
    for axis, n in (("gx", columns), ("gy", rows)):
        wide = cells.select("*", taps).withColumn("from", mirror(F.col(axis) + F.col("tap.k"), n))
        src = out.withColumnRenamed(axis, "from")
        keys = ["cam_id", "from", "gy" if axis == "gx" else "gx"]
        out = wide.join(src, keys, "left").groupBy("cam_id", "gx", "gy").agg(F.sum(F.col("tap.w") * F.coalesce("v", F.lit(0.0))).alias("v"))
    return out.withColumnRenamed("v", value)


def stats(grid: DataFrame, columns: int, rows: int, share: float = 0.05, dense: DataFrame | None = None) -> DataFrame:
    """Per camera: the peak cell (of ties the first), the part of the cells above ``share`` of it, and detections.

    With ``dense``, a smoothed form of the grid, peak and part are taken from that, to 9 digits; detections never are.
    """
    d = grid if dense is None else dense.withColumn("occupancy", F.round("occupancy", 9))
    best = F.struct(F.col("occupancy"), -F.col("gy"), -F.col("gx"))
    peak = d.groupBy("cam_id").agg(F.max("occupancy").alias("peak"), F.max_by("gx", best).alias("peak_gx"), F.max_by("gy", best).alias("peak_gy"))
    peak = peak.join(grid.groupBy("cam_id").agg(F.sum("occupancy").alias("n_dets")), "cam_id")
    full = d.join(peak, "cam_id").where(F.col("occupancy") > share * F.col("peak")).groupBy("cam_id").agg((F.count("*") / (columns * rows)).alias("occupied"))
    return peak.join(full, "cam_id")


def floor_histogram(points: DataFrame, columns: int, rows: int, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Points per cell of the floor between two percentiles of x and y; points beyond them don't count."""
    p = points.where("x is not null and y is not null")
    ends = percentiles(p, "x", [low, high]).join(F.broadcast(percentiles(p, "y", [low, high])).withColumnRenamed("y", "ys")).select(F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), F.col("ys")[0].alias("y0"), F.col("ys")[1].alias("y1"))
    j = p.join(F.broadcast(ends)).where("x between x0 and x1 and y between y0 and y1 and x1 > x0 and y1 > y0")
    cell = lambda c, n: F.least(F.lit(n - 1), F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * n)).cast("int")
    return j.groupBy(cell("x", columns).alias("gx"), cell("y", rows).alias("gy")).agg(F.count("*").alias("occupancy"))


def footprint(points: DataFrame, spread: float = 1.6, least: float = 1e-3) -> DataFrame:
    """Robust bounds of the floor in use: quartiles moved out by ``spread`` times their distance (``least`` at least), no further than the points."""
    p = points.where("x is not null and y is not null")
    q = percentiles(p, "x", [0.0, 0.25, 0.75, 1.0]).join(F.broadcast(percentiles(p, "y", [0.0, 0.25, 0.75, 1.0])))
    wide = lambda c: spread * F.greatest(F.col(c)[2] - F.col(c)[1], F.lit(least))
    ends = [f(F.col(c)[i], F.col(c)[j] + sign * wide(c)).alias(f"{c}_{n}") for c in ("x", "y") for n, f, i, j, sign in (("low", F.greatest, 0, 1, -1), ("high", F.least, 3, 2, 1))]
    return q.select(*ends)


def walked_area(points: DataFrame, low: float = 0.02, high: float = 0.98, margin: float = 0.12) -> DataFrame:
    """Bounds between two percentiles of the points, wider by ``margin`` of their distance on each side."""
    p = points.where("x is not null and y is not null")
    q = percentiles(p, "x", [low, high]).join(F.broadcast(percentiles(p, "y", [low, high])))
    side = lambda c, k, sign: (F.col(c)[k] + sign * margin * (F.col(c)[1] - F.col(c)[0]))
    return q.select(*[side(c, k, sign).alias(f"{c}_{n}") for c in ("x", "y") for n, k, sign in (("low", 0, -1), ("high", 1, 1))])


def decayed(cells: DataFrame, decay: float) -> DataFrame:
    """A live grid as it stands after the last frame: each hit fades by ``decay`` a frame.

    cells: cam_id, gx, gy, frame_no.
    """
    n = cells.groupBy("cam_id", "gx", "gy", "frame_no").agg(F.count("*").alias("n"))
    last = cells.groupBy("cam_id").agg(F.max("frame_no").alias("last"))
    return n.join(last, "cam_id").groupBy("cam_id", "gx", "gy").agg(F.sum(F.col("n") * F.pow(F.lit(decay), F.col("last") - F.col("frame_no"))).alias("heat"))


def time_lapse(cells: DataFrame, steps: int) -> DataFrame:
    """Hits of each cell up to the end of each of ``steps`` equal spans of time, where a span adds some."""
    ends = cells.agg(F.min("frame_no").alias("f0"), F.max("frame_no").alias("f1"))  # one row
    step = F.floor((F.col("frame_no") - F.col("f0")) * steps / (F.col("f1") - F.col("f0") + 1)).cast("int")
    n = cells.join(F.broadcast(ends)).groupBy("cam_id", "gx", "gy", step.alias("step")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("cam_id", "gx", "gy").orderBy("step")
    return n.select("cam_id", "gx", "gy", "step", F.sum("n").over(w).alias("occupancy"))
