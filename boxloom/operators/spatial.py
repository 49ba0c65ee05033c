"""Joins of boxes that overlap inside the same image, hashed by grid cell.

A plain join on the image would compare every pair of an image in one task. Here each box goes to
the cells it covers, the equi-join runs on (keys, cell), and a pair is kept only in the cell that
holds the top-left corner of its intersection, so no pair is lost or repeated and a crowded image
spreads over as many tasks as it has cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions.boxes import Box, box, overlaps


CELL = ["_cx", "_cy"]


def with_cells(df: DataFrame, b: Box, cell: int) -> DataFrame:
    """One row per covered cell; an empty box sits in the cell of its corner."""

    def span(lo: Column, hi: Column) -> Column:
        first = F.floor(lo / cell).cast("long")
        last = F.greatest(first, (F.ceil(hi / cell) - 1).cast("long"))
        return F.sequence(first, last)

    return df.withColumn("_cx", F.explode(span(b.x1, b.x2))).withColumn("_cy", F.explode(span(b.y1, b.y2)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_prefix: str = "",
    right_prefix: str = "r_",
    cell: int = 128,
) -> DataFrame:
    """Pairs of boxes with positive intersection. ``right`` columns other than the keys must
    already carry ``right_prefix``."""
    a, b = box(left_prefix), box(right_prefix)
    lhs = with_cells(left, a, cell)
    rhs = with_cells(right, b, cell)
    corner = (F.col("_cx") == F.floor(F.greatest(a.x1, b.x1) / cell)) & (F.col("_cy") == F.floor(F.greatest(a.y1, b.y1) / cell))
    return lhs.join(rhs, [*keys, *CELL]).filter(overlaps(a, b) & corner).drop(*CELL)


def points_in_boxes(
    points: DataFrame, boxes: DataFrame, keys: list[str], x: str = "px", y: str = "py", cell: int = 128
) -> DataFrame:
    """Every (point, box) where the half-open box holds the point; one cell per point."""
    b = box()
    lhs = points.withColumn("_cx", F.floor(F.col(x) / cell).cast("long")).withColumn("_cy", F.floor(F.col(y) / cell).cast("long"))
    rhs = with_cells(boxes, b, cell)
    inside = (F.col(x) >= b.x1) & (F.col(x) < b.x2) & (F.col(y) >= b.y1) & (F.col(y) < b.y2)
    return lhs.join(rhs, [*keys, *CELL]).filter(inside).drop(*CELL)


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Rename every column but ``keep``."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])
