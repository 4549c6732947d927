"""Bounding boxes as columns: [x, y, width, height] in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yolo_box(cx: Column, cy: Column, nw: Column, nh: Column, width: Column, height: Column) -> Column:
    """Pixel box of a normalised centre box. The corner is clamped into the image first and the size to what is left of it;
    what hangs out on the left or the top is not taken off the size."""
    clamp = lambda v, hi: F.greatest(F.lit(0.0), F.least(v, hi))
    w, h = width.cast("double"), height.cast("double")
    x, y = clamp((cx - nw / 2.0) * w, w), clamp((cy - nh / 2.0) * h, h)
    return F.array(x, y, clamp(nw * w, w - x), clamp(nh * h, h - y))


def coco_box(bbox: Column) -> Column:
    """A box with its corner raised to 0; null unless it has four numbers and no negative size. Nothing is cut at the far sides."""
    ok = (F.size(bbox) == 4) & ~F.exists(bbox, lambda v: v.isNull()) & (F.get(bbox, 2) >= 0) & (F.get(bbox, 3) >= 0)
    lift = F.transform(bbox, lambda v, i: F.when(i < 2, F.greatest(v, F.lit(0.0))).otherwise(v))
    return F.when(ok, lift)


def has_box(bbox: Column) -> Column:
    return F.coalesce((F.size(bbox) == 4) & (F.get(bbox, 2) > 0) & (F.get(bbox, 3) > 0), F.lit(False))


def has_polygon(segmentation: Column) -> Column:
    return F.coalesce(F.size(segmentation) > 0, F.lit(False))
