"""Square grid cells over the integer plane.

A cell of side ``size`` holds the points ``col*size <= x < (col+1)*size`` and
likewise for rows.  Its id packs column and row into one bigint, so a join on
cells is a join on a single long.  Cell columns and rows must stay below 2**30,
and so must coordinates below 2**52.  Containment and distance multiply two
differences of coordinates in a bigint: a polygon, with the points near it, and
a radius must span less than 2**31, which leaves room for the whole globe in
1e-6 degrees.  Beyond that Spark raises an overflow error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF = 1 << 30
SPAN = 1 << 31


def axis(v: str, size: int) -> str:
    """Column or row number of a coordinate."""
    return f"floor(({v}) / {size})"


def pack(col: str, row: str) -> str:
    """Cell id of a column and row number."""
    return f"(({col} + {HALF}) * {SPAN} + {row} + {HALF})"


def unpack(cell: str) -> tuple[str, str]:
    """Column and row number of a cell id."""
    return f"(shiftright({cell}, 31) - {HALF})", f"(({cell} & {SPAN - 1}) - {HALF})"


def cell_of(x: str, y: str, size: int) -> str:
    """Id of the cell holding a point; null when a coordinate is null."""
    return pack(axis(x, size), axis(y, size))


def parent(cell: str, k: int) -> str:
    """Id of the cell ``2**k`` times as wide that contains ``cell``."""
    if not 0 <= k < 30:
        raise ValueError("k must be from 0 to 29")
    col, row = unpack(cell)
    return pack(f"shiftright({col}, {k})", f"shiftright({row}, {k})")


def with_cell(df: DataFrame, x: str = "x", y: str = "y", size: int = 10_000, name: str = "cell_id") -> DataFrame:
    """Add the id of the cell of side ``size`` that holds each row's point."""
    check_size(size)
    return df.withColumn(name, F.expr(cell_of(x, y, size)))


def with_parent(df: DataFrame, k: int, cell: str = "cell_id", name: str = "parent_id") -> DataFrame:
    """Add the id of the cell ``2**k`` times as wide around each row's cell."""
    return df.withColumn(name, F.expr(parent(cell, k)))


def check_size(size: int) -> None:
    if int(size) != size or size < 1:
        raise ValueError("cell size must be a whole number of at least 1")
