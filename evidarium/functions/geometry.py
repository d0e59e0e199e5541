"""Rectangles, crops, similarity transforms and camera poses as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centre(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / 2, y + h / 2


def inside(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return px.between(x, x + w) & py.between(y, y + h)


def distance(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """From a point to a rectangle, 0 inside."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x - px, zero, px - (x + w)), F.greatest(y - py, zero, py - (y + h)))


def relative(p: Column, start: Column, size: Column) -> Column:
    """Place in a side of a rectangle, 0 to 1; null for a side of no length."""
    return F.when(size != 0, (p - start) / size)


def uncropped(r: Column, low: Column, high: Column) -> Column:
    """Place in the original picture of a place in the cropped one."""
    return low + r * (1 - low - high)


def region(kind: Column, x: Column, y: Column, w: Column, h: Column, points: Column, width: Column, height: Column) -> Column:
    """A region as one struct: kind, its place and size as fractions and in pixels of a picture of width x height, and the
    points of a polygon (array of x, y fractions) in both. A point has no size, and only a polygon has points."""
    sized, many = kind.isin("box"), kind == "polygon"
    pixel = lambda v, side: F.round(v * side).cast("long")
    return F.struct(
        kind.alias("kind"), x.alias("x_norm"), y.alias("y_norm"), F.when(sized, w).alias("w_norm"), F.when(sized, h).alias("h_norm"), pixel(x, width).alias("x_px"), pixel(y, height).alias("y_px"), F.when(sized, pixel(w, width)).alias("w_px"), F.when(sized, pixel(h, height)).alias("h_px"),
        F.when(many, points).alias("points"), F.when(many, F.transform(points, lambda p: F.struct(pixel(p["x"], width).alias("x"), pixel(p["y"], height).alias("y")))).alias("points_px"),
    )


def other_axes(points, order: tuple[str, str, str] = ("x", "-z", "y"), columns=("x", "y", "z")):
    """Points in axes of another convention: each new one is an old one or its opposite, as in -z."""
    return points.select(*[c for c in points.columns if c not in columns], *[(-F.col(o[1:]) if o[0] == "-" else F.col(o)).alias(c) for c, o in zip(columns, order)])


def crop_fraction(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0)) / 100000


def similarity(points, scale: float, rotation: list[list[float]], shift: list[float], columns=("x", "y", "z")):
    """s R p + t for every row of points; one projection."""
    moved = {c: scale * sum((F.lit(r) * F.col(o) for r, o in zip(row, columns)), F.lit(0.0)) + t for c, row, t in zip(columns, rotation, shift)}
    return points.withColumns(moved)


def quaternion_product(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    (w, x, y, z), (p, q, r, s) = a, b
    return w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p


def rotated(q: tuple[Column, ...], v: tuple[Column, ...]) -> tuple[Column, ...]:
    """v turned by the unit quaternion q."""
    zero = F.lit(0.0)
    back = (q[0], -q[1], -q[2], -q[3])
    return quaternion_product(quaternion_product(q, (zero, *v)), back)[1:]


def camera_update(poses, scale: float, turn: tuple[float, float, float, float], shift: tuple[float, float, float]):
    """World-to-camera poses (qw..qz, tx..tz) after the world has moved by P' = s R P + t: q' = q r*, t' = s T - q'(t)."""
    q = tuple(F.col(c) for c in ("qw", "qx", "qy", "qz"))
    r = tuple(F.lit(float(v)) for v in turn)
    new = quaternion_product(q, (r[0], -r[1], -r[2], -r[3]))
    moved = rotated(new, tuple(F.lit(float(v)) for v in shift))
    out = dict(zip(("qw", "qx", "qy", "qz"), new)) | {c: F.lit(float(scale)) * F.col(c) - m for c, m in zip(("tx", "ty", "tz"), moved)}
    return poses.withColumns(out)
