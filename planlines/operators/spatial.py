"""Distance and overlap joins through grid cells.

The probing side keeps exactly one cell per row and the other side visits the
neighbouring cells, so matches appear once and no ``distinct`` is needed. Keys are
(image, cell): a busy image spreads over its cells, and AQE splits a busy cell. Sides
grow by their cells, which a planner does not see: they are merged, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planlines.functions import geometry as G


def _offsets(reach: int):
    steps = range(-reach, reach + 1)
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in steps for b in steps])


def with_cell(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumn("cx", G.cell(F.col(x), size)).withColumn("cy", G.cell(F.col(y), size))


def near_cells(df: DataFrame, x: str, y: str, size: float, reach: int = 1) -> DataFrame:
    """Rows repeated for the cells within ``reach`` cells of their own."""
    spread = df.select("*", F.explode(_offsets(reach)).alias("o"))
    return (
        spread.withColumn("cx", G.cell(F.col(x), size) + F.col("o.a"))
        .withColumn("cy", G.cell(F.col(y), size) + F.col("o.b"))
        .drop("o")
    )


def distance2(ax: str, ay: str, bx: str, by: str):
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def within_radius(
    left: DataFrame, right: DataFrame, radius: float, on: list[str], lxy: tuple[str, str], rxy: tuple[str, str]
) -> DataFrame:
    """Rows of ``left`` with rows of ``right`` at most ``radius`` away (inclusive).

    ``right`` visits the neighbouring cells, so pass the smaller table there.
    """
    close = distance2(*lxy, *rxy) <= F.lit(float(radius) ** 2)
    pairs = with_cell(left, *lxy, radius).hint("merge").join(near_cells(right, *rxy, radius), [*on, "cx", "cy"])
    return pairs.filter(close).drop("cx", "cy")


def overlapping_boxes(left: DataFrame, right: DataFrame, on: list[str], size: float) -> DataFrame:
    """Pairs of boxes with a common area; columns ``ax1..ay2`` and ``bx1..by2``.

    Both sides visit the cells they cover; the cell holding the top-left corner of
    the overlap reports the pair.
    """

    def cover(df: DataFrame, p: str) -> DataFrame:
        cols = F.sequence(G.cell(F.col(f"{p}x1"), size), G.cell(F.col(f"{p}x2"), size))
        rows = F.sequence(G.cell(F.col(f"{p}y1"), size), G.cell(F.col(f"{p}y2"), size))
        return df.select("*", F.explode(cols).alias("cx")).select("*", F.explode(rows).alias("cy"))

    pairs = cover(left, "a").hint("merge").join(cover(right, "b"), [*on, "cx", "cy"])
    ox1, oy1 = F.greatest("ax1", "bx1"), F.greatest("ay1", "by1")
    overlap = (ox1 < F.least("ax2", "bx2")) & (oy1 < F.least("ay2", "by2"))
    home = (G.cell(ox1, size) == F.col("cx")) & (G.cell(oy1, size) == F.col("cy"))
    return pairs.filter(overlap & home).drop("cx", "cy")
