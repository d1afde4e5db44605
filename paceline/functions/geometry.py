"""Column builders for boxes, cameras and polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def foot(left="left", top="top", width="width", height="height") -> tuple[Column, Column]:
    """Bottom centre of a box."""
    return F.col(left) + F.col(width) / 2, F.col(top) + F.col(height)


def ground_point(u: Column, v: Column, flat: float = 1e-6) -> tuple[Column, Column]:
    """World point under a pixel, on the plane z = 0, from a joined camera row.

    Null if the ray is level (|dz| < flat) or meets the plane behind the camera.
    Camera columns: fx, fy, cx, cy, r11 .. r33, t1 .. t3.
    """
    c = F.col
    x, y = (u - c("cx")) / c("fx"), (v - c("cy")) / c("fy")
    dx, dy, dz = (c(f"r1{k}") * x + c(f"r2{k}") * y + c(f"r3{k}") for k in (1, 2, 3))
    ox, oy, oz = (-(c(f"r1{k}") * c("t1") + c(f"r2{k}") * c("t2") + c(f"r3{k}") * c("t3")) for k in (1, 2, 3))
    far = F.when(F.abs(dz) >= flat, -oz / dz)
    far = F.when(far >= 0, far)
    return ox + far * dx, oy + far * dy


def pixel_of(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pixel of a world point, from a joined camera row; null unless it is before the camera."""
    c = F.col
    px, py, pz = (c(f"r{k}1") * x + c(f"r{k}2") * y + c(f"r{k}3") * z + c(f"t{k}") for k in (1, 2, 3))
    pz = F.when(pz > 1e-6, pz)
    return c("fx") * px / pz + c("cx"), c("fy") * py / pz + c("cy")


def closeness(distance: Column, close: float = 300.0, far: float = 2000.0) -> Column:
    """1 within ``close``, then a Gaussian decay; 0 where the distance is unknown."""
    t = F.greatest(F.lit(0.0), (distance - close) / (far - close))
    return F.coalesce(F.exp(-3 * t * t), F.lit(0.0))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes; 0 where both are empty."""
    w = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    either = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def box(alias: str) -> dict[str, Column]:
    return {n: F.col(f"{alias}.{n}") for n in ("left", "top", "width", "height")}


def in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd rule over an array of (x, y) structs; fewer than three corners hold nothing."""
    n = F.size(poly)

    def crossing(i: Column) -> Column:
        a, b = F.element_at(poly, i + 1), F.element_at(poly, (i + n - 1) % n + 1)
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    count = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + crossing(i))
    return F.when(n < 3, F.lit(False)).otherwise(count % 2 == 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))
