"""Box geometry as column expressions; a box is struct<x, y, w, h>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once: a lambda binds it, so no rule of the optimiser writes it out again at each use."""
    return F.transform(F.array(value), f)[0]


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller box that the other covers."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, overlap(a, b) / small).otherwise(0.0)


def centre_distance(a: Column, b: Column) -> Column:
    dx = a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2
    dy = a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2
    return F.sqrt(dx * dx + dy * dy)


def padded(b: Column, ratio: float, width: Column | float, height: Column | float) -> Column:
    """The box widened by a share of its size on each side, clipped to the image."""
    x0, y0 = F.greatest(b["x"] - b["w"] * ratio, F.lit(0.0)), F.greatest(b["y"] - b["h"] * ratio, F.lit(0.0))
    x1 = F.least(b["x"] + b["w"] * (1 + ratio), F.lit(width) if isinstance(width, (int, float)) else width)
    y1 = F.least(b["y"] + b["h"] * (1 + ratio), F.lit(height) if isinstance(height, (int, float)) else height)
    return box(x0, y0, x1 - x0, y1 - y0)


def between(a: Column, b: Column, share: Column) -> Column:
    """Linear interpolation of boxes."""
    return F.struct(*[(a[n] + (b[n] - a[n]) * share).alias(n) for n in ("x", "y", "w", "h")])
