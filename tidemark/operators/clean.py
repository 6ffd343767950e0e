"""Usable rows and the reasons for the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pick import pick_one
from tidemark.operators.skew import HOT_ROWS, has_map, hot_keys, skew_join


def clean(
    df: DataFrame,
    key: str | list[str],
    order: list[str],
    required: list[str] | None = None,
    verts: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Split rows into kept ones and rejected ones with a ``reason``.

    Rejected are rows with a null key (``null key``), with a null in one of the
    ``required`` columns (``null coordinate``), with a null vertex or a ring of
    fewer than three distinct vertices (``degenerate ring``), and of those with
    the same key all but the newest (``superseded``).  ``order`` lists the
    columns that rank the rows of a key, highest first wins; rows equal in
    those are ranked by their other columns.  Superseded rows equal in every
    column come once, with their number in ``copies`` (otherwise 1), so the
    rows kept and the copies rejected add up to the input.

    Neither result gathers the rows of a key in one task: each task cuts a key
    to its newest row before the shuffle, equal rows are counted before theirs,
    and hot keys are cut into parts in the join back.
    """
    keys = [key] if isinstance(key, str) else list(key)
    judged = _judged(df, keys, required, verts)
    usable = judged.where("reason is null").drop("reason")
    maps, value = _comparable(df)
    kept = _newest(usable, keys, order)

    told = [F.expr(value[c]).alias(f"_json_{c}" if c in maps else c) for c in df.columns]
    counted = usable.groupBy(*told).agg(F.expr("count(1) as copies"), *(F.first(c).alias(c) for c in maps))
    counted = counted.select(*df.columns, "copies")
    newest = kept.withColumnsRenamed({c: f"_new_{c}" for c in df.columns if c not in keys})
    same = (f"{value[c]} <=> {value[c].replace(f'`{c}`', f'`_new_{c}` as `{c}`' if c in maps else f'`_new_{c}`')}" for c in df.columns if c not in keys)
    is_newest = " and ".join(same) or "true"
    hot = hot_keys(usable, keys, hot_rows)
    older = skew_join(counted, newest, keys, "inner", hot=hot).selectExpr(
        *(f"`{c}`" for c in df.columns), "'superseded' as reason", f"copies - if({is_newest}, 1L, 0L) as copies"
    )
    faulty = judged.where("reason is not null").withColumn("copies", F.lit(1).cast("bigint"))
    return kept, faulty.unionByName(older.where("copies > 0"))


def kept_rows(
    df: DataFrame, key: str | list[str], order: list[str], required: list[str] | None = None, verts: str | None = None
) -> DataFrame:
    """The rows that ``clean`` keeps, without the pass over the input that the rejected ones take."""
    keys = [key] if isinstance(key, str) else list(key)
    return _newest(_judged(df, keys, required, verts).where("reason is null").drop("reason"), keys, order)


def _judged(df: DataFrame, keys: list[str], required: list[str] | None, verts: str | None) -> DataFrame:
    faults = [(" or ".join(f"`{k}` is null" for k in keys), "null key")]
    if required:
        faults.append((" or ".join(f"`{c}` is null" for c in required), "null coordinate"))
    if verts:
        gap = f"{verts} is null or exists({verts}, v -> v is null or v.x is null or v.y is null)"
        faults.append((f"{gap} or size(array_distinct({verts})) < 3", "degenerate ring"))
    reason = "case " + " ".join(f"when {test} then '{name}'" for test, name in faults) + " end"
    return df.withColumn("reason", F.expr(reason))


def _comparable(df: DataFrame) -> tuple[list[str], dict[str, str]]:
    """The columns with maps, and SQL for a value of each column that can be compared."""
    # Maps cannot be compared; their entries in order can, as text.
    maps = [f.name for f in df.schema.fields if has_map(f.dataType)]
    return maps, {c: f"to_json(struct(`{c}`), map('sortKeys', 'true'))" if c in maps else f"`{c}`" for c in df.columns}


def _newest(usable: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    value = _comparable(usable)[1]
    ties = [c for c in usable.columns if c not in keys and c not in order]
    return pick_one(usable, keys, [F.expr(value[c]).desc_nulls_last() for c in [*order, *ties]])
