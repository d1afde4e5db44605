"""Zones, region rules and density grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import foot, in_polygon

ZONES = "cam_id int, ord int, name string, poly array<struct<x:double,y:double>>"


def parse_rules(text: str, width: float, height: float) -> list[tuple[int, int, str, list[tuple[float, float]]]]:
    """(camera, order, name, corners in 0..1) of each region in a rule file, in file order.

    Sections ``[roi-filtering-stream-N]`` and ``[overcrowding-stream-N]`` give zones for
    camera N from ``roi-NAME=x;y;...``; any other section ends the camera.
    """
    found, cam = [], None
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("["):
            head, _, n = line.strip("[]").rpartition("-stream-")
            if head in ("roi-filtering", "overcrowding") and n.isdigit():
                cam = int(n)
            elif not line.startswith(("[roi", "[over")):
                cam = None
        elif cam is not None and line.startswith("roi-"):
            name, _, points = line[4:].partition("=")
            p = [float(x) for x in points.replace(",", ";").split(";") if x.strip()]
            corners = [(x / width, y / height) for x, y in zip(p[::2], p[1::2])]  # noqa: B905 (an odd last value counts for nothing)
            if len(corners) >= 3:
                found.append((cam, len(found), name.strip(), corners))
    return found


def rules_text(zones: list[tuple[int, int, str, list[tuple[float, float]]]], width: float, height: float) -> str:
    """The inverse of ``parse_rules``, one filtering section for each camera."""
    out = []
    for cam in sorted({z[0] for z in zones}):
        out.append(f"[roi-filtering-stream-{cam}]")
        out += [f"roi-{name}=" + ";".join(f"{round(x * width)};{round(y * height)}" for x, y in poly) for c, _, name, poly in sorted(zones, key=lambda z: z[1]) if c == cam]
    return "\n".join(out) + "\n"


def zone_table(spark: SparkSession, zones: list) -> DataFrame:
    """Zones are a rule file: a handful for each camera."""
    return spark.createDataFrame(zones, ZONES)


def resolve_zones(det: DataFrame, zones: DataFrame, width: float, height: float) -> DataFrame:
    """``det`` with ``zone_name``: the first zone in file order that holds the foot point, else cam{N}:other.

    Names are cam{N}:{zone}, so zones of two cameras with one name stay two.
    """
    u, v = foot()
    per_cam = zones.groupBy("cam_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "poly"))).alias("zones"))
    d = det.join(F.broadcast(per_cam), "cam_id", "left")
    hit = F.filter("zones", lambda z: in_polygon(u / width, v / height, z["poly"]))
    name = F.concat(F.lit("cam"), F.col("cam_id").cast("string"), F.lit(":"), F.coalesce(F.try_element_at(hit, F.lit(1))["name"], F.lit("other")))
    return d.withColumn("zone_name", name).drop("zones")


def zone_vocabulary(zones: DataFrame) -> DataFrame:
    """(cam_id, zone_name) of every zone and of the rest of each camera that has zones."""
    named = zones.select("cam_id", "name").unionByName(zones.select("cam_id", F.lit("other").alias("name")))
    return named.select("cam_id", F.concat(F.lit("cam"), F.col("cam_id").cast("string"), F.lit(":"), "name").alias("zone_name")).distinct()


def function_matrix(enabled: DataFrame) -> DataFrame:
    """Per camera, which of the analytics its enabled regions use: enabled (cam_id, analytics array<string>, on boolean)."""
    kinds = ["count", "crossing", "density", "overcrowding"]
    rows = enabled.where("on").select("cam_id", F.explode("analytics").alias("kind"))
    return rows.groupBy("cam_id").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in kinds])


def crowding(resolved: DataFrame, threshold: int) -> DataFrame:
    """Count and overcrowding flag of each camera, frame and zone."""
    n = resolved.groupBy("cam_id", "frame_no", "zone_name").agg(F.count("*").alias("n"))
    return n.withColumn("overcrowded", (F.col("n") >= threshold).cast("int"))


def line_crossings(det: DataFrame, a: tuple[float, float], b: tuple[float, float], direction: tuple[float, float]) -> DataFrame:
    """Crossings of the line a-b by each track's foot point, with the direction, summed up per camera.

    A crossing: the segment from the last foot point to this one strictly cuts the line
    and the movement has a positive part along ``direction``.
    """
    u, v = foot()
    d = det.select("cam_id", "local_track_id", "frame_no", "det_id", u.alias("x"), v.alias("y"))
    w = Window.partitionBy("cam_id", "local_track_id").orderBy("frame_no", "det_id")
    d = d.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))

    def side(px, py, qx, qy, x, y) -> Column:
        return (qx - px) * (y - py) - (qy - py) * (x - px)

    ax, ay, bx, by = map(F.lit, (*a, *b))
    cut = (side(ax, ay, bx, by, F.col("px"), F.col("py")) * side(ax, ay, bx, by, F.col("x"), F.col("y")) < 0) & (side(F.col("px"), F.col("py"), F.col("x"), F.col("y"), ax, ay) * side(F.col("px"), F.col("py"), F.col("x"), F.col("y"), bx, by) < 0)
    along = (F.col("x") - F.col("px")) * direction[0] + (F.col("y") - F.col("py")) * direction[1] > 0
    return d.where(cut & along).groupBy("cam_id").agg(F.count("*").alias("crossings"), F.countDistinct("local_track_id").alias("tracks"))


def _cell(x: Column, size: float, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x * n / size))).cast("int")


def density(det: DataFrame, width: float, height: float, columns: int, rows: int) -> DataFrame:
    """Foot points, distinct persons, and their ratio, of each cell of each camera."""
    u, v = foot()
    g = det.groupBy("cam_id", _cell(u, width, columns).alias("gx"), _cell(v, height, rows).alias("gy"))
    g = g.agg(F.count("*").alias("occupancy"), F.countDistinct("global_id").alias("footfall"))
    return g.withColumn("per_person", F.round(F.col("occupancy") / F.greatest("footfall", F.lit(1)), 6))


def visit_cells(det: DataFrame, size: int) -> DataFrame:
    """Tracks that came through each cell of ``size`` pixels."""
    u, v = foot()
    cells = det.select("cam_id", "local_track_id", F.floor(u / size).cast("int").alias("gx"), F.floor(v / size).cast("int").alias("gy")).distinct()
    return cells.groupBy("cam_id", "gx", "gy").agg(F.count("*").alias("tracks"))


def box_cells(det: DataFrame, size: int) -> DataFrame:
    """Boxes that cover each cell of ``size`` pixels."""
    span = lambda lo, n: F.sequence(F.floor(F.col(lo) / size).cast("int"), F.floor((F.col(lo) + F.col(n) - 1) / size).cast("int"))
    x = det.select("cam_id", F.explode(span("left", "width")).alias("gx"), "top", "height")
    return x.select("cam_id", "gx", F.explode(span("top", "height")).alias("gy")).groupBy("cam_id", "gx", "gy").agg(F.count("*").alias("boxes"))


def peak_cells(grid: DataFrame, share: float, k: int) -> DataFrame:
    """The fullest cells: at least ``share`` of the peak, k at most."""
    peak = grid.agg(F.max("occupancy").alias("peak"))
    return grid.join(F.broadcast(peak)).where(F.col("occupancy") >= share * F.col("peak")).orderBy(F.desc("occupancy"), "cam_id", "gx", "gy").limit(k).drop("peak")
