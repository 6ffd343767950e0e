"""Finer cells where many edges crowd into one.

A single cell side cannot suit a table in which a large part of the polygons
is tiny and sits in one place, or has all its vertices there: every point of
the cell would be tested against all of them.  Such cells are cut to the cells
of a finer grid, and these again, until none holds too many edges or the side
cannot be divided any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import pack, unpack
from tidemark.operators.cover import edge_cells

CROWD, MOST_LISTED = 4096, 100_000
# The first of these that divides a side cuts it.
STEPS = (10, 8, 5, 4, 7, 3, 2, 11, 13)


def cell_around(cell: str, times: int) -> str:
    """Id of the cell ``times`` as wide that contains ``cell``."""
    col, row = unpack(cell)
    return pack(f"floor({col} / {times})", f"floor({row} / {times})")


def crowded_cells(polygons: DataFrame, size: int, crowd: int, feature: str = "feature_id") -> DataFrame:
    """All cells with more than ``crowd`` edges."""
    edges = edge_cells(polygons, size, feature)
    counts = edges.groupBy("cell_id").agg(F.expr("count(1) as n")).where(f"n > {crowd}")
    return counts.selectExpr("cell_id as _crowded")


def crowded_grids(polygons: DataFrame, size: int, crowd: int, feature: str = "feature_id") -> list[tuple[int, DataFrame]]:
    """Sides from ``size`` down, each with its cells that hold more than ``crowd`` edges and are to be cut.

    A side is looked at only if the one before has such cells, and then for
    the features with edges in them.  What cannot be cut is not listed.  Up to
    ``MOST_LISTED`` cells of a side are broadcast as a list; more are found by
    a join each time.
    """
    out: list[tuple[int, DataFrame]] = []
    some = polygons
    while step := next((s for s in STEPS if size % s == 0), None):
        cells = crowded_cells(some, size, crowd, feature)
        if out:
            wider, known = out[-1]
            cells = cells.join(known.withColumnRenamed("_crowded", "_wide"), F.expr(f"{cell_around('_crowded', wider // size)} = _wide"), "left_semi")
        found = cells.limit(MOST_LISTED + 1).collect()
        if not found:
            break
        if len(found) <= MOST_LISTED:
            cells = F.broadcast(polygons.sparkSession.createDataFrame(found, "_crowded bigint"))
        out.append((size, cells))
        touching = edge_cells(some, size, feature, ["_feature"]).join(cells, F.expr("cell_id = _crowded"), "left_semi")
        some = some.join(touching.select(F.col("_feature").alias(feature)).distinct(), feature, "left_semi")
        size //= step
    return out
