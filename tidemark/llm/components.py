"""Connected components of links that may be many and uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import saved


def components(links: DataFrame) -> DataFrame:
    """Rows (``node``, ``label``) for the ends of ``links`` (``a``, ``b``); the label is the least node reachable.

    Each round takes the least label of the neighbours, combined before the
    shuffle, and then the label's own label, so chains shorten by halves.
    Only a count reaches the driver.  Null ends are no links.
    """
    both = links.where("a <> b").select("a", "b")
    both = saved(both.unionByName(both.selectExpr("b as a", "a as b")).distinct())
    labels = saved(both.groupBy("a").agg(F.expr("least(min(b), a) as label")).withColumnRenamed("a", "node"))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.expr("min(label) as _near"))
            .withColumnRenamed("a", "node")
        )
        lower = labels.join(near, "node", "left").selectExpr("node", "label as _was", "least(label, _near) as label")
        heads = lower.selectExpr("node as label", "label as _head")
        new = saved(
            lower.join(heads, "label", "left").selectExpr("node", "least(label, _head) as label", "_was")
        )
        changed = new.where("label <> _was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
