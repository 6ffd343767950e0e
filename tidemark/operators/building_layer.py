"""One wide row per building."""

from __future__ import annotations

from pyspark.sql import DataFrame


def building_layer(
    buildings: DataFrame,
    outlines: DataFrame | None = None,
    hits: DataFrame | None = None,
    nearest: DataFrame | None = None,
    panels: DataFrame | None = None,
) -> DataFrame:
    """Put together what is known of each building.

    Every side has at most one row per ``building_id`` (see ``pick_one`` and
    ``check``): ``outlines`` has ``verts``; ``hits`` ``zone_id``, ``zone_code``
    and ``severity``; ``nearest`` the ``near_`` columns of an elevation; and
    ``panels`` ``panel_id`` and ``version``.  All joins share one key, so the
    buildings are shuffled once for the lot.  A side may be left out when the
    buildings carry its columns already: the operators keep the columns of
    their points, so running them one after the other saves its join.
    ``above_mm`` is the height of the first floor over the flood, null unless
    both are in the same datum.
    """
    sides = (
        (outlines, ["verts as outline"]),
        (hits, ["zone_id", "zone_code", "severity"]),
        (nearest, ["near_bfe_id", "near_bfe_mm", "near_datum", "near_d2"]),
        (panels, ["panel_id", "version as panel_version"]),
    )
    wide = buildings
    for side, columns in sides:
        if side is not None:
            wide = wide.join(side.selectExpr("building_id", *columns), "building_id", "left")
    return wide.selectExpr("*", "if(datum = near_datum, first_floor_mm - near_bfe_mm, null) as above_mm")
