"""Joins that survive a key holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 1_000_000
# A hot key and its number of parts take some 30 bytes.
MOST_BROADCAST_KEYS = 1_000_000
NULL_PARTS = 4096


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> str:
    """SQL for the size of a row: fixed widths, and lengths where they vary."""
    fixed, varying = 32, []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        kind = f.dataType.typeName()
        fixed += 16
        if kind in ("string", "binary", "varchar", "char"):
            varying.append(f"coalesce(octet_length(`{f.name}`), 0)")
        elif kind in ("array", "map", "struct", "variant"):
            varying.append(f"coalesce(octet_length(to_json(struct(`{f.name}`))), 0) * 2")
    return " + ".join([str(fixed), *varying])


def fits(df: DataFrame, limit: int) -> bool:
    """Is the whole of ``df`` at most ``limit`` bytes?  Runs one aggregate."""
    return (df.selectExpr(f"sum(cast({row_bytes(df)} as double))").first()[0] or 0) <= limit


def size_and_crowd(df: DataFrame, key: str) -> tuple[float, int]:
    """Bytes of the whole of ``df`` and the most rows of one key, in one aggregate combined before the shuffle."""
    sums = df.groupBy(key).agg(F.expr(f"sum(cast({row_bytes(df)} as double)) as b"), F.expr("count(1) as n"))
    size, crowd = sums.selectExpr("coalesce(sum(b), 0D)", "coalesce(max(n), 0L)").first()
    return size, crowd


def has_map(kind: T.DataType) -> bool:
    """Is there a map or variant anywhere in the type, so that values cannot be compared?"""
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return kind.typeName() in ("map", "variant")


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every key with more than ``hot_rows`` rows and the number of parts to cut it into.

    Counts are combined before they are shuffled.
    """
    return hottest(df.where(_present(keys)).groupBy(*keys).agg(F.expr("count(1) as _n")), keys, hot_rows)


def hottest(counts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same from counts ``_n`` by key that are there already."""
    return counts.where(f"_n > {hot_rows}").selectExpr(*keys, f"cast(ceil(_n / {hot_rows}) as int) as _parts")


def listed(keys: DataFrame, most: int = MOST_BROADCAST_KEYS) -> DataFrame:
    """A list of keys marked for broadcast if it has at most ``most`` rows, which are counted.

    An empty list is not made again when it is joined.
    """
    found = keys.limit(most + 1).count()
    if not found:
        return keys.sparkSession.createDataFrame([], keys.schema)
    return F.broadcast(keys) if found <= most else keys


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    condition: str = "true",
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
    both: bool = False,
) -> DataFrame:
    """Shuffled equi-join in which hot keys of ``left`` are cut into parts.

    A row of a hot key goes to a part by the hash of its values; the rows of
    ``right`` for that key go to every part, so each left row still meets all
    of its partners and all join types from the left keep their meaning.  Left
    rows with a null key meet nothing and are spread over many parts.
    ``condition`` is SQL over the columns of both sides, whose names must
    differ apart from the keys.  ``left`` is read once more to count its keys,
    unless ``hot`` gives them; the list of hot keys is broadcast up to a
    counted size, and joined otherwise.

    With ``both``, for inner joins, the hot keys of ``right`` are counted and
    cut as well: the parts of both sides make a grid, a row of either side goes
    to one line of it, and each pair of rows meets in one place.
    """
    spread = ", ".join(f"`{f.name}`" for f in left.schema.fields if not has_map(f.dataType))
    hot = listed(hot_keys(left, keys, hot_rows) if hot is None else hot)
    part = (
        f"case when not ({_present(keys)}) then pmod(xxhash64({spread}), {NULL_PARTS}) "
        f"when _parts > 1 then pmod(xxhash64({spread}), _parts) else 0 end"
    )
    cut = left.join(hot, keys, "left").selectExpr(
        *(f"`{c}`" for c in left.columns), f"cast({part} as int) as _sent_to",
    )
    copied = (
        right.where(_present(keys))
        .join(hot, keys, "left")
        .selectExpr("*", "explode_outer(sequence(0, coalesce(_parts, 1) - 1)) as _copied_to")
        .drop("_parts")
        .withColumnsRenamed({k: f"_r_{k}" for k in keys})
    )
    meets = ["_sent_to = _copied_to"]
    if both:
        if how != "inner":
            raise ValueError("both sides are cut for inner joins only")
        across = listed(hot_keys(right, keys, hot_rows)).withColumnRenamed("_parts", "_lines")
        values = ", ".join(f"`{f.name}`" for f in right.schema.fields if not has_map(f.dataType))
        cut = cut.join(across, keys, "left").selectExpr("*", "explode_outer(sequence(0, coalesce(_lines, 1) - 1)) as _sent_across")
        lines = across.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        copied = copied.join(lines, [f"_r_{k}" for k in keys], "left").selectExpr(
            "*", f"cast(if(_lines > 1, pmod(xxhash64({_renamed(values, keys)}), _lines), 0) as int) as _copied_across"
        )
        cut, copied = cut.drop("_lines"), copied.drop("_lines")
        meets.append("_sent_across = _copied_across")
    match = " and ".join([*(f"{k} = _r_{k}" for k in keys), *meets, f"({condition})"])
    joined = cut.join(copied.hint("merge"), F.expr(match), how)
    return joined.drop("_sent_to", "_copied_to", "_sent_across", "_copied_across", *(f"_r_{k}" for k in keys))


def _renamed(columns: str, keys: list[str]) -> str:
    return ", ".join(f"`_r_{c.strip('`')}`" if c.strip("`") in keys else c for c in columns.split(", "))


def _present(keys: list[str]) -> str:
    return " and ".join(f"{k} is not null" for k in keys)
