"""Column expressions for boxes, segments and tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(high, value))


def round_half_even(value: Column) -> Column:
    return F.bround(value, 0)


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def span(low: Column, high: Column) -> Column:
    """``low..high`` as an array, NULL (so no rows after explode) when empty."""
    return F.when(low <= high, F.sequence(low, high))


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def box_iou(a: str, b: str) -> Column:
    """IoU of two boxes with columns ``{a}x1`` .. ``{b}y2``; 0 without overlap."""
    ax1, ay1, ax2, ay2 = (F.col(f"{a}{c}") for c in ("x1", "y1", "x2", "y2"))
    bx1, by1, bx2, by2 = (F.col(f"{b}{c}") for c in ("x1", "y1", "x2", "y2"))
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(
        zero, F.least(ay2, by2) - F.greatest(ay1, by1)
    )
    union = box_area(ax1, ay1, ax2, ay2) + box_area(bx1, by1, bx2, by2) - inter
    return F.when((inter == 0) | (union <= 0), zero).otherwise(inter / union)


def inner_box(
    x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float
) -> Column:
    """Struct of the box shrunk by ``margin`` of its sides, in pixel bounds [x0, x1) × [y0, y1).

    A collapsed region falls back to the full box; a degenerate one is NULL.
    """
    w, h = F.greatest(F.lit(0.0), x2 - x1), F.greatest(F.lit(0.0), y2 - y1)
    m = F.lit(float(margin))
    zero = F.lit(0)

    def edge(v: Column, limit: Column) -> Column:
        return clip(round_half_even(v).cast("int"), zero, limit)

    ix1, iy1 = edge(x1 + w * m, width), edge(y1 + h * m, height)
    ix2, iy2 = edge(x2 - w * m, width), edge(y2 - h * m, height)
    fx1, fy1 = F.greatest(zero, x1.cast("int")), F.greatest(zero, y1.cast("int"))
    fx2, fy2 = F.least(width, x2.cast("int") + 1), F.least(height, y2.cast("int") + 1)

    def bounds(a, b, c, d, collapsed):
        return F.struct(
            a.alias("ix1"), b.alias("iy1"), c.alias("ix2"), d.alias("iy2"), F.lit(collapsed).alias("collapsed")
        )

    return (
        F.when((w <= 0) | (h <= 0), None)
        .when((ix2 > ix1) & (iy2 > iy1), bounds(ix1, iy1, ix2, iy2, False))
        .when((fx2 > fx1) & (fy2 > fy1), bounds(fx1, fy1, fx2, fy2, True))
    )


def within_stroke(px: Column, py: Column, thickness: int) -> Column:
    """True when pixel (px, py) lies within thickness/2 of segment (x1,y1)-(x2,y2).

    Integer arithmetic only, so the answer does not depend on the engine. The
    brush is round: pixels on the rim may differ from a polygon-filled stroke.
    """
    x1, y1, x2, y2 = (F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    dot = (px - x1) * dx + (py - y1) * dy
    t2 = F.lit(thickness * thickness)
    cross = (px - x1) * dy - (py - y1) * dx
    near1 = 4 * ((px - x1) * (px - x1) + (py - y1) * (py - y1)) <= t2
    near2 = 4 * ((px - x2) * (px - x2) + (py - y2) * (py - y2)) <= t2
    return F.when(dot <= 0, near1).when(dot >= len2, near2).otherwise(4 * cross * cross <= t2 * len2)


def fit_scale(width: Column, height: Column, long_side: int) -> Column:
    """Factor that brings the long side down to ``long_side``; small images keep 1."""
    return F.least(F.lit(1.0), F.lit(float(long_side)) / F.greatest(width, height))


def tile_count(side: Column, tile: int, stride: int) -> Column:
    """Number of tile origins along a side; a side shorter than a tile has one."""
    over = F.greatest(side - tile, F.lit(0))
    return F.greatest(F.lit(1), (F.ceil(over / F.lit(stride)) + 1).cast("int"))


def tile_origin(k: Column, side: Column, tile: int, stride: int) -> Column:
    return F.least(k * stride, F.greatest(F.lit(0), side - tile)).cast("int")


def covering_tiles(pos: Column, side: Column, tile: int, stride: int) -> Column:
    """Array of tile numbers along one axis whose extent contains ``pos``.

    They follow one another: the regular tiles, then the clamped last one where it reaches.
    """
    n = tile_count(side, tile, stride)
    first = F.greatest(F.lit(0), (F.floor((pos - tile) / F.lit(stride)) + 1).cast("int"))
    last = F.least(n - 2, F.floor(pos / F.lit(stride)).cast("int"))
    end = F.when(pos >= F.greatest(F.lit(0), side - tile), n - 1).otherwise(last)
    return F.coalesce(span(F.least(first, n - 1), end), F.array().cast("array<int>"))
