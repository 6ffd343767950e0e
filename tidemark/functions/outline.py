"""Expressions over polygon rings and edges."""

from __future__ import annotations

from tidemark.functions.cells import axis

EDGE_TYPE = "struct<xa:bigint,ya:bigint,xb:bigint,yb:bigint>"
ENDS = ("xa", "ya", "xb", "yb")
SHAPE_COLUMNS = ("part", "ring", "verts", "x0", "y0", "x1", "y1")


def box(verts: str) -> list[str]:
    """Bounding box columns of an array of vertices."""
    return [
        f"{pick}(transform({verts}, v -> v.{axis_name})) as {name}"
        for name, pick, axis_name in (
            ("x0", "array_min", "x"), ("y0", "array_min", "y"), ("x1", "array_max", "x"), ("y1", "array_max", "y"),
        )
    ]


def corners(verts: str) -> str:
    """Array of each vertex with the one before and the one after it."""
    n = f"size({verts})"
    before = f"concat(slice({verts}, {n}, 1), slice({verts}, 1, {n} - 1))"
    after = f"concat(slice({verts}, 2, {n} - 1), slice({verts}, 1, 1))"
    return f"arrays_zip({verts}, {before}, {after})"


def crosses(x: str, y: str, prefix: str) -> str:
    """Does a ray from the point towards growing x cross the edge?

    Edges run upwards (``ya < yb``) and own their lower end only, so a point on
    a border shared by two polygons lies in exactly one of them.  Both sides of
    the comparison are products of integers: nothing is rounded.
    """
    xa, ya, xb, yb = (prefix + end for end in ENDS)
    return f"({ya} <= {y} and {y} < {yb} and ({x} - {xa}) * ({yb} - {ya}) < ({xb} - {xa}) * ({y} - {ya}))"


def crossings(x: str, y: str, edges: str) -> str:
    """Number of edges of an array that the ray crosses."""
    return f"aggregate({edges}, 0, (n, e) -> if({crosses(x, y, 'e.')}, n + 1, n))"


def flat_edges(edges: str, count: int) -> list[str]:
    """The first edges of an array as columns, and the others in ``_rest``.

    Most pieces have few edges, and arithmetic on columns is compiled, while a
    walk over an array is not.
    """
    columns = [f"get({edges}, {i}).{end} as _e{i}{end}" for i in range(count) for end in ENDS]
    others = f"slice({edges}, {count + 1}, size({edges}))"
    return [*columns, f"if(size({edges}) > {count}, {others}, null) as _rest"]


def flat_crossings(x: str, y: str, count: int) -> str:
    """Number of crossings from the columns of ``flat_edges``."""
    flat = " + ".join(f"if({crosses(x, y, f'_e{i}')}, 1, 0)" for i in range(count))
    return f"({flat} + if(_rest is null, 0, {crossings(x, y, '_rest')}))"


def upward(a: str, b: str, prefix: str = "") -> list[str]:
    """The ends of the edge between two vertices: lower end first, then left."""
    up = f"({a}.y < {b}.y or ({a}.y = {b}.y and {a}.x <= {b}.x))"
    return [
        f"if({up}, {a}.x, {b}.x) as {prefix}xa", f"least({a}.y, {b}.y) as {prefix}ya",
        f"if({up}, {b}.x, {a}.x) as {prefix}xb", f"greatest({a}.y, {b}.y) as {prefix}yb",
    ]


def strip_column(row: str, size: int, last: bool = False, prefix: str = "") -> str:
    """First (or last) grid column that an upward edge may touch within a row.

    The edge is cut to the row and its x at the cut is found by division, off
    by less than one; one unit of slack therefore never leaves a touched
    column out.  A level edge keeps the columns between its ends.
    """
    xa, ya, xb, yb = (prefix + end for end in ENDS)
    leans = f"{xb} < {xa}" if last else f"{xb} >= {xa}"
    cut = f"if({leans}, greatest({ya}, {row} * {size}), least({yb}, ({row} + 1) * {size}) - 1)"
    x = f"{xa} + floor(cast(({xb} - {xa}) * ({cut} - {ya}) as double) / ({yb} - {ya}))"
    if last:
        x = f"if({ya} = {yb}, {xb}, least(greatest({xa}, {xb}), {x} + 1))"
    else:
        x = f"if({ya} = {yb}, {xa}, greatest(least({xa}, {xb}), {x} - 1))"
    return axis(x, size)
