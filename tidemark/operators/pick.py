"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_one(df: DataFrame, key: str | list[str], rank: list[Column | str]) -> DataFrame:
    """The first row of each key in the order of ``rank``.

    ``rank`` should end in a unique column, such as the lowest id, so that the
    choice does not depend on the order of the input.  Spark cuts each key to
    its first row before the shuffle, so a hot key costs one row per task.
    """
    keys = [key] if isinstance(key, str) else key
    first = Window.partitionBy(*keys).orderBy(*rank)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def top_rows(df: DataFrame, keys: list[str], rank: list[Column | str], k: int, name: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key, with their place in ``name`` if given."""
    order = Window.partitionBy(*keys).orderBy(*rank)
    ranked = df.withColumn(name or "_rank", F.row_number().over(order)).where(f"{name or '_rank'} <= {k}")
    return ranked if name else ranked.drop("_rank")
