"""Rules a layer must meet before it is published."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORM = "rule string, columns string, violations bigint, sample string"


@dataclass(frozen=True)
class Rule:
    """One requirement; make it with the functions below."""

    kind: str
    columns: tuple[str, ...]
    type: str | None = None
    bad: Column | None = field(default=None, compare=False)
    other: DataFrame | None = field(default=None, compare=False)
    other_columns: tuple[str, ...] = ()


def required(column: str, type: str) -> Rule:
    """The column is there and has this Spark SQL type, such as ``bigint``."""
    return Rule("required", (column,), type=type)


def not_null(column: str) -> Rule:
    return Rule("not_null", (column,), bad=F.col(f"`{column}`").isNull())


def in_range(column: str, low: object = None, high: object = None) -> Rule:
    """Values, such as numbers or dates, from ``low`` to ``high``, both included; nulls pass."""
    value, bad = F.col(f"`{column}`"), F.lit(False)
    if low is not None:
        bad = bad | (value < F.lit(low))
    if high is not None:
        bad = bad | (value > F.lit(high))
    return Rule("range", (column,), bad=bad)


def allowed(column: str, values: list) -> Rule:
    """Values from a short list; nulls pass."""
    return Rule("allowed", (column,), bad=~F.col(f"`{column}`").isin(*values))


def unique(*columns: str) -> Rule:
    """No two rows with the same values; rows with a null among them pass."""
    return Rule("unique", columns)


def foreign_key(columns: list[str], other: DataFrame, other_columns: list[str] | None = None) -> Rule:
    """The values are those of some row of ``other``; rows with a null pass."""
    return Rule("foreign_key", tuple(columns), other=other, other_columns=tuple(other_columns or columns))


def check(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """The rules that ``df`` breaks: one row each, none if all hold.

    ``violations`` counts rows, or for ``unique`` the values that occur more
    than once, and ``sample`` is the least ``key`` (or value) among them.  All
    row-wise rules share one pass.  Keys are counted before they are compared,
    so a value held by much of the table costs one row per task.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    broken = [
        ("required", r.columns[0], 1, types.get(r.columns[0], "missing"))
        for r in rules
        if r.kind == "required" and types.get(r.columns[0]) != r.type
    ]
    broken += [
        ("required", c, 1, "missing")
        for c in dict.fromkeys(c for r in rules if r.kind != "required" for c in r.columns)
        if c not in types and not any(b[1] == c for b in broken)
    ]
    found = [df.sparkSession.createDataFrame(broken, FORM)]
    usable = [r for r in rules if all(c in types for c in r.columns)]

    rowwise = [r for r in usable if r.bad is not None]
    if rowwise:
        counts = df.agg(
            *(F.count_if(r.bad).alias(f"n{i}") for i, r in enumerate(rowwise)),
            *(F.min(F.when(r.bad, F.col(f"`{key}`"))).cast("string").alias(f"s{i}") for i, r in enumerate(rowwise)),
        )
        rows = ", ".join(f"'{r.kind}', '{r.columns[0]}', n{i}, s{i}" for i, r in enumerate(rowwise))
        found.append(counts.selectExpr(f"stack({len(rowwise)}, {rows}) as (rule, columns, violations, sample)"))
    for r in usable:
        if r.kind not in ("unique", "foreign_key"):
            continue
        cols = [f"`{c}`" for c in r.columns]
        counted = df.where(" and ".join(f"{c} is not null" for c in cols)).groupBy(*r.columns)
        counted = counted.agg(F.expr("count(1) as _n"))
        if r.kind == "unique":
            bad, total = counted.where("_n > 1"), "count(1)"
        else:
            known = r.other.select(*(F.col(o).alias(c) for o, c in zip(r.other_columns, r.columns))).distinct()
            bad, total = counted.join(known, list(r.columns), "left_anti"), "coalesce(sum(_n), 0L)"
        least = f"min(struct({', '.join(cols)}))"
        sample = f"cast(min({cols[0]}) as string)" if len(cols) == 1 else f"to_json({least})"
        found.append(bad.selectExpr(
            f"'{r.kind}' as rule", f"'{','.join(r.columns)}' as columns", f"{total} as violations", f"{sample} as sample"
        ))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result.where("violations > 0")
