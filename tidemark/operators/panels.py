"""Map panels as of a date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.contain import points_in_polygons


def panel_versions(panels: DataFrame) -> DataFrame:
    """Panels with the day ``valid_to`` on which the next version takes over.

    Of two versions effective on one day the higher holds and the lower never
    does.  The versions of a panel, of which there are few, are put in one
    array, combined before the shuffle however many rows the panel has.  Rows
    without a ``panel_id`` are versions of nothing and stay valid.
    """
    all_versions = panels.groupBy("panel_id").agg(F.expr("collect_set(struct(effective_date, version)) as _all"))
    later = "array_min(filter(_all, v -> v > struct(effective_date, version))).effective_date as valid_to"
    return panels.join(all_versions, "panel_id", "left").selectExpr(*(f"`{c}`" for c in panels.columns), later)


def panel_as_of(
    points: DataFrame, panels: DataFrame, as_of: date | str, size: int, how: str = "left", **options
) -> DataFrame:
    """Add to each point the panel that contained it on a date.

    ``as_of`` is a date for all points, or the name of a point column with a
    date for each.  A panel counts in the version that was the latest to take
    effect on or before that date; a point with none keeps nulls (``left``).
    """
    versions = panel_versions(panels)
    if isinstance(as_of, date):
        day = f"date'{as_of.isoformat()}'"
        current = versions.where(f"effective_date <= {day} and (valid_to is null or {day} < valid_to)")
        return points_in_polygons(points, current.drop("valid_to"), size, how, **options)
    holds = f"effective_date <= `{as_of}` and (valid_to is null or `{as_of}` < valid_to)"
    found = points_in_polygons(points, versions, size, how, on=holds, **options)
    return found.drop("valid_to")
