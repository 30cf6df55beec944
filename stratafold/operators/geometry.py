"""Rectangles: anchors, footprints, bounds, fitting and layout, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def anchor(pivot: Column, full: Column, offset: Column, cut: Column, flip: bool = False) -> Column:
    """A pivot of the full length (0..1) as a share of the cut length that starts at ``offset``; ``flip`` counts from the far end. Null if nothing is left."""
    share = F.try_divide(pivot * full - offset, cut)
    return 1 - share if flip else share


def footprint(w: Column, h: Column, turn: Column) -> tuple[Column, Column]:
    """Width and height on the page of a box that is turned by ``turn`` degrees; 90 and 270 swap the two."""
    side = F.pmod(turn, F.lit(180)) == 90
    return F.when(side, h).otherwise(w), F.when(side, w).otherwise(h)


def on_page(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Whether a box with an area lies on its page."""
    return (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= page_w) & (y + h <= page_h)


def fit_scale(declared_w: Column, declared_h: Column, real_w: Column, real_h: Column, slack: float = 0.01) -> Column:
    """The one scale from declared to real size; null where the axes differ by more than ``slack``."""
    sx, sy = F.try_divide(real_w, declared_w), F.try_divide(real_h, declared_h)
    return F.when(F.abs(sx - sy) <= slack * F.greatest(sx, sy), sx)


def placed_size(w: Column, h: Column, box_w: Column, box_h: Column) -> tuple[Column, Column]:
    """The largest size with the aspect of (w, h) inside a box; null for a picture without area."""
    scale = F.least(F.try_divide(box_w, w), F.try_divide(box_h, h))
    return w * scale, h * scale


def child_span(parent: Column, low: Column, high: Column, size: Column, at: Column, pivot: Column) -> tuple[Column, Column]:
    """(start, length) on one axis of a child between anchors ``low`` and ``high`` of its parent's length.

    The length is the anchors' distance and ``size``; the pivot sits ``at`` beyond its share of the anchors.
    """
    length = parent * (high - low) + size
    return parent * (low + (high - low) * pivot) + at - length * pivot, length
