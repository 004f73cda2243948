"""Box algebra on four coordinate columns; a box is any object with x0, y0, x1, y1 columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def center_y(self) -> Column:
        return (self.y0 + self.y1) / 2


def box(prefix: str = "") -> Box:
    """Box of the columns ``<prefix>x0 … <prefix>y1``."""
    return Box(*[F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")])


def struct_box(column: str) -> Box:
    return Box(*[F.col(column)[c] for c in ("x0", "y0", "x1", "y1")])


def contains(inner: Box, outer: Box) -> Column:
    return (inner.x0 >= outer.x0) & (inner.y0 >= outer.y0) & (inner.x1 <= outer.x1) & (inner.y1 <= outer.y1)


def relative_position(a: Box, b: Box) -> dict[str, Column]:
    """``left``: b ends before a starts; ``right``: a ends before b starts; same for y."""
    return {"left": b.x1 < a.x0, "right": a.x1 < b.x0, "bottom": b.y1 < a.y0, "top": a.y1 < b.y0}


def edge_distance(a: Box, b: Box) -> Column:
    """Gap between two boxes; diagonal neighbours are measured corner to corner."""
    dx = F.greatest(b.x0 - a.x1, a.x0 - b.x1, F.lit(0.0))
    dy = F.greatest(b.y0 - a.y1, a.y0 - b.y1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def center_distance(a: Box, b: Box) -> Column:
    dx, dy = a.center_x - b.center_x, a.center_y - b.center_y
    return F.sqrt(dx * dx + dy * dy)


def overlap_width(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0))


def overlap_height(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0))


def overlap_area(a: Box, b: Box) -> Column:
    return overlap_width(a, b) * overlap_height(a, b)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def iou(a: Box, b: Box) -> Column:
    shared = overlap_area(a, b)
    degenerate = (a.area == 0) | (b.area == 0)
    return F.when(degenerate, F.lit(0.0)).otherwise(shared / (a.area + b.area - shared))


def overlap_min_area(a: Box, b: Box) -> Column:
    return _ratio(overlap_area(a, b), F.least(a.area, b.area))


def overlap_own_area(a: Box, b: Box) -> Column:
    """Share of ``a`` that ``b`` covers."""
    return _ratio(overlap_area(a, b), a.area)


def x_projection_overlap(a: Box, b: Box) -> Column:
    return _ratio(overlap_width(a, b), a.width)


def y_overlap_ratio(a: Box, b: Box) -> Column:
    smaller = F.least(a.height, b.height)
    return F.when(smaller > 0, overlap_height(a, b) / smaller).otherwise(F.lit(0.0))


def x_overlap_ratio(a: Box, b: Box) -> Column:
    smaller = F.least(a.width, b.width)
    return F.when(smaller > 0, overlap_width(a, b) / smaller).otherwise(F.lit(0.0))


def smaller_if_overlapping(a: Box, b: Box, ratio: float) -> Column:
    """1 or 2 for the smaller box of a pair overlapping above ``ratio``, else null."""
    return F.when(overlap_min_area(a, b) > ratio, F.when(a.area <= b.area, 1).otherwise(2))


def _as_struct(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def integer_box(b: Box, width=None, height=None) -> Column:
    """Outward-rounded box clamped to the page; null when nothing is left."""
    x0, y0 = F.floor(b.x0).cast("long"), F.floor(b.y0).cast("long")
    x1, y1 = F.ceil(b.x1).cast("long"), F.ceil(b.y1).cast("long")
    if width is not None:
        clamp = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top).cast("long") if not isinstance(top, Column) else top, v))
        x0, x1, y0, y1 = clamp(x0, width), clamp(x1, width), clamp(y0, height), clamp(y1, height)
    return F.when((x1 > x0) & (y1 > y0), _as_struct(x0, y0, x1, y1))


def page_scale(b: Box, width, height, scale: int = 1000) -> Column:
    """Box on a 0..1000 page scale, truncated."""
    part = lambda v, size: (v * scale / size).cast("int")
    return _as_struct(part(b.x0, width), part(b.y0, height), part(b.x1, width), part(b.y1, height))


def relative_box(child: Box, parent: Box, digits: int = 3) -> Column:
    """Child box in parent units, clamped to 0..1."""
    part = lambda v, lo, size: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - lo) / F.greatest(size, F.lit(1e-9)))), digits)
    return _as_struct(
        part(child.x0, parent.x0, parent.width), part(child.y0, parent.y0, parent.height),
        part(child.x1, parent.x0, parent.width), part(child.y1, parent.y0, parent.height),
    )


def pixel_box(b: Box, width, height) -> Column:
    """Pixel box from relative (all values in 0..1) or pixel input, corners put in order."""
    relative = F.greatest(*b) <= 1.0
    relative = relative & (F.least(*b) >= 0.0)
    sx, sy = F.when(relative, F.lit(width)).otherwise(F.lit(1)), F.when(relative, F.lit(height)).otherwise(F.lit(1))
    x0, x1, y0, y1 = b.x0 * sx, b.x1 * sx, b.y0 * sy, b.y1 * sy
    left, right, top, bottom = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    return F.when((right > left) & (bottom > top), _as_struct(left, top, right, bottom))


def is_small(b: Box, side: float = 6.0) -> Column:
    return (b.width < side) | (b.height < side)
