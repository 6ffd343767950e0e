"""How common each category is within each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prevalence(
    df: DataFrame,
    by: list[str],
    category: str,
    weight: str | None = None,
    levels: str | None = None,
) -> DataFrame:
    """Amount of each category in each group, the group's total and its share.

    ``amount`` is the number of rows, or the sum of ``weight``; ``share_ppm``
    is its whole parts per million of ``total``, null where the total is zero.
    Whole-number and decimal weights are summed and divided exactly, with their
    scale; for floating-point weights the quotient is rounded down.
    ``levels`` may be ``rollup`` or ``cube`` to add subtotals over ``by`` and
    ``category``; ``level`` is then Spark's ``grouping_id``, and the total is
    that of the same values of ``by`` with all categories.

    Rows are summed to (group, category) first.  Subtotals expand those sums,
    not the input, and totals are taken over them, too.
    """
    amount = "count(1)" if weight is None else f"coalesce(sum({weight}), 0)"
    keys = [*by, category]
    sums = df.groupBy(*keys).agg(F.expr(f"{amount} as amount"))
    if levels is None:
        extra: list[str] = []
        total = f"sum(amount) over (partition by {', '.join(by) or '1'})"
    elif levels in ("rollup", "cube"):
        extra = ["level"]
        grouped = sums.rollup(*keys) if levels == "rollup" else sums.cube(*keys)
        sums = grouped.agg(F.expr("sum(amount) as amount"), F.expr("grouping_id() as level"))
        group = ", ".join([*by, "level div 2"])
        total = f"max(if(level % 2 = 1, amount, null)) over (partition by {group})"
    else:
        raise ValueError("levels must be rollup or cube")
    kind = sums.schema["amount"].dataType.typeName()
    if kind in ("float", "double"):
        parts = "floor(amount * 1000000D / total)"
    else:
        exact = "amount" if kind == "decimal" else "cast(amount as decimal(28, 0))"
        parts = f"{exact} * cast(1000000 as decimal(7, 0)) div total"
    share = f"cast(if(total = 0, null, {parts}) as bigint)"
    return sums.selectExpr(*keys, *extra, "amount", f"{total} as total").selectExpr("*", f"{share} as share_ppm")
