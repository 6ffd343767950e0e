"""Which polygons hold each point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import cell_of
from tidemark.functions.outline import flat_crossings, flat_edges
from tidemark.operators.cover import WIDER, attributes, layered_pieces, pieces_size, wider_levels, widest
from tidemark.operators.crowd import CROWD, STEPS, crowded_grids
from tidemark.operators.skew import HOT_ROWS, size_and_crowd, skew_join

BROADCAST_BYTES = 128 << 20
FLAT_EDGES = 4
WORTH_LOOKING = 32
HOWS = ("inner", "left", "semi", "anti")


def points_in_polygons(
    points: DataFrame,
    polygons: DataFrame,
    size: int,
    how: str = "inner",
    x: str = "x",
    y: str = "y",
    feature: str = "feature_id",
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    crowd: int = CROWD,
    on: str | None = None,
) -> DataFrame:
    """Join points to the polygons that contain them, exactly.

    Both sides meet on a grid cell of side ``size``: a plain equi-join, with
    one row per point whatever ``how`` is, since a point lies in one cell.
    Polygons are cut to cells first (see ``pieces``); a point in a full cell is
    settled at once and one in an edge cell walks that cell's edges only.
    Polygons many cells wide have their full cells on wider grids (see
    ``layered_pieces``), which a point probes one after the other.

    ``strategy`` is ``broadcast`` (points are not shuffled), ``shuffle``
    (points are shuffled by cell, hot cells cut into parts) or ``auto``, which
    bounds the size of the cut polygons in one pass and broadcasts them up to
    ``broadcast_bytes``; the pieces of several grids are measured.  Cells with
    more than ``crowd`` edges are cut finer and finer, see ``crowded_grids``;
    for a broadcast they are looked for only if there are enough edges for it
    to matter.  The result has the point columns, and for ``inner``
    and ``left`` the feature id and attributes, whose names must be free.
    ``on`` is a further SQL condition on point and attribute columns.
    """
    if how not in HOWS:
        raise ValueError(f"how must be one of {HOWS}")
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError("strategy must be auto, broadcast or shuffle")
    gained = [feature, *attributes(polygons, feature)]
    taken = sorted(set(gained) & set(points.columns))
    if taken:
        raise ValueError(f"rename these columns on one side first: {taken}")

    inside = (
        f"(_full or ({x} >= _lo_x and {x} < _hi_x and {y} >= _lo_y and {y} < _hi_y"
        f" and {flat_crossings(x, y, FLAT_EDGES)} % 2 = 1))"
    )
    auto = strategy == "auto"
    edges, size_bytes, side = pieces_size(polygons, size, feature) if auto else (0, 0, widest(polygons))
    wider = [size * WIDER**i for i in range(1, wider_levels(side, size) + 1)]
    look = strategy == "shuffle" or (auto and (size_bytes > broadcast_bytes or edges > WORTH_LOOKING * crowd))
    crowded = crowded_grids(polygons, size, crowd, feature) if look else []
    finer = [s // next(step for step in STEPS if s % step == 0) for s, _ in crowded]
    sides = [*finer[::-1], size, *wider]
    cuts = [
        cut.withColumnsRenamed(
            {"full": "_full", "edges": "_edges", "lo_x": "_lo_x", "hi_x": "_hi_x", "lo_y": "_lo_y", "hi_y": "_hi_y"}
        )
        for cut in layered_pieces(polygons, sides, feature, dict(crowded))
    ]
    even = [False] * len(sides)
    if auto:
        # The bound by boxes says little of several grids, so their pieces are measured.
        small = size_bytes <= broadcast_bytes
        if len(sides) > 1:
            # The first that is too large settles it; the rest of a crowd is counted by the join.
            small = True
            for level, cut in enumerate(cuts):
                bytes_of, most = size_and_crowd(cut, "cell_id")
                even[level], small = most <= hot_rows, bytes_of <= broadcast_bytes // len(cuts)
                if not small:
                    break
        strategy = "broadcast" if small else "shuffle"

    def met(left: DataFrame, level: int, kind: str) -> DataFrame:
        """Points joined to the pieces of one grid; of wider grids there are full cells only."""
        cut = cuts[level]
        placed = left.withColumn("cell_id", F.expr(cell_of(x, y, sides[level])))
        tests = [f"({on})"] if on is not None else []
        if sides[level] > size:
            cut = cut.drop("_full", "_edges", "_lo_x", "_hi_x", "_lo_y", "_hi_y")
        else:
            tests.append(inside)
            cut = cut.selectExpr(*(f"`{c}`" for c in cut.columns if c != "_edges"), *flat_edges("_edges", FLAT_EDGES))
        if strategy == "broadcast":
            right = F.broadcast(cut.withColumnRenamed("cell_id", "_r_cell_id"))
            joined = placed.join(right, F.expr(" and ".join(["cell_id = _r_cell_id", *tests])), kind)
        else:
            joined = skew_join(placed, cut, ["cell_id"], kind, " and ".join(tests) or "true", hot_rows, both=kind == "inner" and not even[level])
        return joined.select(*(points.columns if kind in ("left_semi", "left_anti") else [*points.columns, *gained]))

    if len(sides) == 1:
        return met(points, 0, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))
    # A point is held on one grid by each polygon, so hits of the grids add up; the others are in none of them.
    grids = range(len(sides))
    found, left = [], points
    if how in ("inner", "left"):
        found = [met(points, level, "inner") for level in grids]
    if how != "inner":
        for level in grids:
            if how == "semi":
                found.append(met(left, level, "left_semi"))
            left = met(left, level, "left_anti")
    if how == "anti":
        return left
    if how == "left":
        kinds = {f.name: f.dataType for f in found[0].schema.fields}
        found.append(left.select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in gained)))
    return reduce(DataFrame.unionByName, found)
