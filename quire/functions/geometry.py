"""Geometry of axis-aligned boxes as Column expressions (corners x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1)


def union_box(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union has no area."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def normalised(v: Column, size: Column) -> Column:
    """Pixels to the integer 0-1000 scale, clamped."""
    return F.least(F.lit(1000), F.greatest(F.lit(0), (v / size * 1000).cast("int")))


def axis_gap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Distance of two intervals; negative: length of their overlap."""
    return F.greatest(a_low, b_low) - F.least(a_high, b_high)


def h_overlap_ratio(a: Box, b: Box) -> Column:
    """Horizontal overlap as a share of the narrower box."""
    narrow = F.least(a[2] - a[0], b[2] - b[0])
    return F.when(narrow > 0, F.greatest(F.lit(0.0), -axis_gap(a[0], a[2], b[0], b[2])) / narrow).otherwise(0.0)


def edge_gap(a: Box, b: Box) -> Column:
    """Euclidean distance between the nearest edges."""
    dx, dy = (F.greatest(F.lit(0.0), axis_gap(a[i], a[i + 2], b[i], b[i + 2])) for i in (0, 1))
    return F.sqrt(dx * dx + dy * dy)


def caption_cost(fig: Box, cap: Box, width: Column, height: Column, max_gap: float = 0.2, above: float = 2.0, beside: float = 3.0, align: float = 0.5) -> Column:
    """Cost of a caption belonging to a figure, null where they are too far apart on either axis.

    (gap + align * misalignment) times 1 below, `above` above, `beside` beside; all in shares of the page.
    """
    v, h = axis_gap(fig[1], fig[3], cap[1], cap[3]), axis_gap(fig[0], fig[2], cap[0], cap[2])
    centre = lambda b, i: (b[i] + b[i + 2]) / 2
    stacked = v >= h
    gap = F.greatest(F.lit(0.0), F.when(stacked, v / height).otherwise(h / width))
    off = F.when(stacked, F.abs(centre(fig, 0) - centre(cap, 0)) / width).otherwise(F.abs(centre(fig, 1) - centre(cap, 1)) / height)
    turn = F.when(stacked, F.when(centre(cap, 1) >= centre(fig, 1), 1.0).otherwise(above)).otherwise(beside)
    return F.when((v <= max_gap * height) & (h <= max_gap * width), (gap + align * off) * turn)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x, y, x + w, y + h


def to_xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return b[0], b[1], b[2] - b[0], b[3] - b[1]


def from_polygon(p: Column) -> Box:
    """Axis-aligned box of an array x, y, x, y, ... of corners."""
    xs, ys = F.filter(p, lambda _, i: i % 2 == 0), F.filter(p, lambda _, i: i % 2 == 1)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def to_polygon(b: Box) -> Column:
    """Corners clockwise from the upper left."""
    return F.array(b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3])


def denormalised(v: Column, size: Column) -> Column:
    """The 0-1000 scale back to pixels."""
    return v / 1000 * size


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _reference(mode: str, union: Column, a: Column, b: Column) -> Column:
    return {"union": union, "small": F.least(a, b), "large": F.greatest(a, b)}[mode]


def overlap_ratio(a: Box, b: Box, mode: str = "union") -> Column:
    """Intersection as a share of the union, of the smaller or of the larger box."""
    inter = intersection(a, b)
    return _share(inter, _reference(mode, area(a) + area(b) - inter, area(a), area(b)))


def projection_ratio(a: Box, b: Box, axis: int = 0, mode: str = "union") -> Column:
    """Overlap of the boxes' projections on an axis (0: x, 1: y) as a share of their span, of the shorter or the longer."""
    over = F.greatest(F.lit(0.0), -axis_gap(a[axis], a[axis + 2], b[axis], b[axis + 2]))
    span = F.greatest(a[axis + 2], b[axis + 2]) - F.least(a[axis], b[axis])
    return _share(over, _reference(mode, span, a[axis + 2] - a[axis], b[axis + 2] - b[axis]))


def covered_share(line: Box, region: Box) -> Column:
    """Share of a line's area that lies in a region."""
    return _share(intersection(line, region), area(line))


def vertical_gap(a: Box, b: Box) -> Column:
    """Free height between two boxes, 0 where they overlap vertically."""
    return F.greatest(F.lit(0.0), axis_gap(a[1], a[3], b[1], b[3]))


def is_below(a: Box, b: Box) -> Column:
    """Whether a's centre lies below b's."""
    return (a[1] + a[3]) / 2 > (b[1] + b[3]) / 2


def edge_distance(a: Box, b: Box, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0)) -> Column:
    """Distance of the nearest edges per axis where projections do not overlap, weighted by the side (left, right, up, down)."""
    out = F.lit(0.0)
    for axis, (before, after) in enumerate((weights[:2], weights[2:])):
        near = F.least(F.abs(a[axis] - b[axis + 2]), F.abs(a[axis + 2] - b[axis]))
        out = out + F.when(axis_gap(a[axis], a[axis + 2], b[axis], b[axis + 2]) < 0, 0.0).otherwise(near * F.when(a[axis + 2] < b[axis], before).otherwise(after))
    return out


def centroid(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def manhattan(a: Box, b: Box) -> Column:
    """Between upper left corners."""
    return F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])


def euclidean(a: Box, b: Box) -> Column:
    """Between centroids."""
    (ax, ay), (bx, by) = centroid(a), centroid(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def line_height(page_height: Column) -> Column:
    """Estimate from the page's height."""
    return F.greatest(F.lit(8), F.floor(page_height / 75).cast("int"))


def crop(b: Box, width: Column, height: Column, padding: int = 4) -> Box:
    """Pixels of a box on the 0-1000 scale, padded and clamped to the page."""
    px = lambda v, size: (v / 1000 * size).cast("int")
    return F.greatest(F.lit(0), px(b[0], width) - padding), F.greatest(F.lit(0), px(b[1], height) - padding), F.least(width, px(b[2], width) + padding), F.least(height, px(b[3], height) + padding)
