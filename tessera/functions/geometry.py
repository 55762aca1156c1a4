"""Column arithmetic over rectangles (x0, y0, x1, y1) and points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rect = tuple[Column, Column, Column, Column]


def rect(prefix: str = "") -> Rect:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(r: Rect) -> Column:
    return F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])


def centre(r: Rect) -> tuple[Column, Column]:
    return (r[0] + r[2]) / 2, (r[1] + r[3]) / 2


def intersection(a: Rect, b: Rect) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def iou(a: Rect, b: Rect) -> Column:
    """Intersection over union; 0 for two empty rectangles."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def contains(r: Rect, x: Column, y: Column, margin: float = 0.0) -> Column:
    return x.between(r[0] - margin, r[2] + margin) & y.between(r[1] - margin, r[3] + margin)


def overlap(a: Rect, b: Rect) -> Column:
    """Whether two rectangles overlap or touch."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def distance_to(r: Rect, x: Column, y: Column) -> Column:
    """Of a point to the nearest point of a rectangle."""
    dx = F.greatest(r[0] - x, F.lit(0.0), x - r[2])
    dy = F.greatest(r[1] - y, F.lit(0.0), y - r[3])
    return F.sqrt(dx * dx + dy * dy)


def pin_score(pin: Rect, body: Rect, reach: float = 50.0) -> Column:
    """Vertical overlap counts for a pin, horizontal distance against it."""
    overlap = F.greatest(F.lit(0.0), F.least(pin[3], body[3]) - F.greatest(pin[1], body[1])) / F.greatest(pin[3] - pin[1], F.lit(1.0))
    gap = F.greatest(body[0] - pin[2], pin[0] - body[2], F.lit(0.0)) / reach
    return 0.7 * F.least(overlap, F.lit(1.0)) - 0.3 * F.least(gap, F.lit(1.0))


def biased_distance(x: Column, y: Column, bx: Column, by: Column, bias: float = 0.8) -> Column:
    """Distance of text from a body's centre, less where the text is above and left of it."""
    d = F.sqrt((x - bx) * (x - bx) + (y - by) * (y - by))
    return F.when((x <= bx) & (y <= by), d * bias).otherwise(d)


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Array of the grid cells (cx, cy) that a rectangle touches."""
    along = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(along(x0, x1), lambda i: F.transform(along(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
