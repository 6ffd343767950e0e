"""Vertex rows to polygon rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.outline import box


def rings_from_vertices(
    df: DataFrame,
    id: str = "feature_id",
    part: str = "part",
    ring: str = "ring",
    seq: str = "seq",
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """One row per ring, its vertices in the order of ``seq``, with its box.

    A ring becomes one array because that is the unit of the polygon table.
    """
    rings = df.groupBy(
        F.col(id).alias("feature_id"), F.col(part).cast("int").alias("part"), F.col(ring).cast("int").alias("ring")
    ).agg(
        F.expr(
            "array_sort(collect_list(named_struct("
            f"'s', {seq}, 'x', cast({x} as bigint), 'y', cast({y} as bigint)))) as steps"
        )
    )
    verts = "transform(steps, s -> named_struct('x', s.x, 'y', s.y)) as verts"
    return rings.selectExpr("feature_id", "part", "ring", verts).selectExpr("*", *box("verts"))
