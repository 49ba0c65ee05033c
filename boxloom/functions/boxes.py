"""Box arithmetic as plain column expressions (everything stays in generated JVM code).

Boxes are continuous half-open ``x1,y1,x2,y2`` pixels: boxes that only touch do not overlap.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip(self._fields, self)]

    def cast(self, kind: str) -> "Box":
        return Box(*[c.cast(kind) for c in self])


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box held in columns ``<prefix>x1<suffix> ...``."""
    return Box(*[F.col(f"{prefix}{n}{suffix}") for n in Box._fields])


def box_from_yolo(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return Box(
        (cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height
    )


def box_to_yolo(b: Box, width: Column, height: Column) -> dict[str, Column]:
    return {
        "cx": (b.x1 + b.x2) / (2 * width),
        "cy": (b.y1 + b.y2) / (2 * height),
        "w": b.width / width,
        "h": b.height / height,
    }


def box_from_voc(xmin: Column, ymin: Column, xmax: Column, ymax: Column, clamp: bool = True) -> Box:
    """1-based inclusive corners to half-open pixels; ``clamp`` lifts a source 0 to 0."""
    x, y = xmin - 1, ymin - 1
    if clamp:
        x, y = F.greatest(F.lit(0), x), F.greatest(F.lit(0), y)
    return Box(x, y, xmax, ymax)


def box_to_xywh(b: Box) -> dict[str, Column]:
    return {"x": b.x1, "y": b.y1, "w": b.width, "h": b.height}


def box_area(b: Box) -> Column:
    return F.greatest(b.width, F.lit(0)) * F.greatest(b.height, F.lit(0))


def box_short_side(b: Box) -> Column:
    return F.least(b.width, b.height)


# fixed values: short-side bin names and their exclusive upper bounds
SIZE_BINS = ["lt8", "8to16", "16to32", "ge32"]
SIZE_BOUNDS = [8, 16, 32]


def size_bin(b: Box) -> Column:
    side = box_short_side(b)
    out = F.lit(SIZE_BINS[-1])
    for name, bound in reversed(list(zip(SIZE_BINS, SIZE_BOUNDS))):
        out = F.when(side < bound, name).otherwise(out)
    return out


def intersection_area(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def box_iou(a: Box, b: Box) -> Column:
    inter = intersection_area(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_ioa(a: Box, b: Box) -> Column:
    """Intersection over the area of ``a``."""
    area = box_area(a)
    return F.when(area > 0, intersection_area(a, b) / area).otherwise(F.lit(0.0))


def overlaps(a: Box, b: Box) -> Column:
    return (
        (F.least(a.x2, b.x2) > F.greatest(a.x1, b.x1))
        & (F.least(a.y2, b.y2) > F.greatest(a.y1, b.y1))
    )


def box_clip(b: Box, r: Box) -> Box:
    """Intersection with rectangle ``r``; all four sides are NULL when nothing is left."""
    x1, y1 = F.greatest(b.x1, r.x1), F.greatest(b.y1, r.y1)
    x2, y2 = F.least(b.x2, r.x2), F.least(b.y2, r.y2)
    # greatest/least skip NULL, so a box that is already empty is tested by itself
    keep = b.x1.isNotNull() & (x2 > x1) & (y2 > y1)
    return Box(*[F.when(keep, c) for c in (x1, y1, x2, y2)])


def translate(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def restore_box(b: Box, crop: Box, width: Column, height: Column) -> Box:
    """Crop-local box to native pixels: clip to the crop, shift, clip to the image."""
    zero = F.lit(0.0)
    local = box_clip(b, Box(zero, zero, crop.width, crop.height))
    return box_clip(translate(local, crop.x1, crop.y1), Box(zero, zero, width, height))


def visible_fraction(b: Box, crop: Box) -> Column:
    return box_ioa(b, crop)


def normalize_to_crop(b: Box, crop: Box) -> dict[str, Column]:
    w, h = crop.width, crop.height
    return {
        "cx": (b.x1 + b.x2 - 2 * crop.x1) / (2 * w),
        "cy": (b.y1 + b.y2 - 2 * crop.y1) / (2 * h),
        "w": b.width / w,
        "h": b.height / h,
    }


def scale_box(b: Box, width: Column, height: Column, new_width: Column, new_height: Column) -> Box:
    """Rescale to a rounded output size; only the boundary round-off is clamped."""
    sx, sy = new_width / width, new_height / height

    def fit(value: Column, limit: Column) -> Column:
        return F.least(F.greatest(value, F.lit(0.0)), limit.cast("double"))

    return Box(
        fit(b.x1 * sx, new_width), fit(b.y1 * sy, new_height),
        fit(b.x2 * sx, new_width), fit(b.y2 * sy, new_height),
    )


def max_difference(a: Box, b: Box) -> Column:
    return F.greatest(*[F.abs(p - q) for p, q in zip(a, b)])


def expand_roi(b: Box, margin: float, width: Column, height: Column) -> Box:
    dx, dy = b.width * margin, b.height * margin
    return Box(
        F.greatest(F.lit(0), F.floor(b.x1 - dx)), F.greatest(F.lit(0), F.floor(b.y1 - dy)),
        F.least(width, F.ceil(b.x2 + dx)), F.least(height, F.ceil(b.y2 + dy)),
    ).cast("int")


# fixed values: canvas side, and what is taken off half the padding before it is rounded
CANVAS, PAD_SHIFT = 1024, 0.1


def letterbox(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column, size: int = CANVAS) -> Box:
    """Normalised box on a centred square canvas; sides round half to even."""
    ratio = F.least(F.lit(size) / height, F.lit(size) / width)
    left = F.bround((F.lit(size) - F.bround(width * ratio)) / 2 - PAD_SHIFT)
    top = F.bround((F.lit(size) - F.bround(height * ratio)) / 2 - PAD_SHIFT)
    sx, sy = width * ratio, height * ratio
    return Box(
        (cx - w / 2) * sx + left, (cy - h / 2) * sy + top,
        (cx + w / 2) * sx + left, (cy + h / 2) * sy + top,
    )


def grid_centres(b: Box, stride: int) -> Column:
    """How many cell centres of a ``stride`` grid lie in the box, in closed form."""

    def along(lo: Column, hi: Column) -> Column:
        n = F.floor(hi / stride - 0.5) - F.ceil(lo / stride - 0.5) + 1
        return F.greatest(F.lit(0), n)

    return along(b.x1, b.x2) * along(b.y1, b.y2)


def polygon_area(points: Column) -> Column:
    """Shoelace area of ``array<struct<x,y>>``; NULL below three distinct points."""
    n = F.size(points)
    rotated = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, rotated, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    twice = F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(F.array_distinct(points)) >= 3, F.abs(twice) / 2)


def polygon_bounds(points: Column) -> Box:
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def box_contains(b: Box, px: Column, py: Column) -> Column:
    return (px >= b.x1) & (px < b.x2) & (py >= b.y1) & (py < b.y2)


def centre_distance(a: Box, b: Box) -> Column:
    return F.sqrt(F.pow(a.cx - b.cx, 2) + F.pow(a.cy - b.cy, 2))


def box_problems(b: Box, width: Column, height: Column, class_id: Column, n_classes: int) -> Column:
    """Names of the broken rules, empty for a usable box."""
    finite = F.lit(True)
    for c in b:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rules = [
        ("not_finite", ~finite),
        ("not_positive", finite & ((b.width <= 0) | (b.height <= 0))),
        ("outside_image", finite & ((b.x1 < 0) | (b.y1 < 0) | (b.x2 > width) | (b.y2 > height))),
        ("unknown_class", ~F.coalesce(class_id.between(0, n_classes - 1), F.lit(False))),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def reading_order(b: Box, class_id: Column, row_height: int = 40) -> list[Column]:
    return [F.floor(b.y1 / row_height), b.x1, class_id]
