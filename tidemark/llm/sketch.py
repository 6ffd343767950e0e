"""Bottom-k sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import shingles, words

SIZE = 128
MOST_RANGES = 10_000


def sketch(w: str, k: int = SIZE) -> str:
    """SQL for the ``k`` smallest distinct shingle hashes of the words ``w``, in order; no words give none."""
    return f"slice(sort_array({shingles(w)}), 1, {k})"


def merged(a: str, b: str, k: int = SIZE) -> str:
    """SQL for the sketch of two parts together."""
    return f"slice(sort_array(array_union({a}, {b})), 1, {k})"


def distinct(s: str, k: int = SIZE) -> str:
    """SQL for the number of distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    place = f"((element_at({s}, -1) + 9223372036854775808D) / 18446744073709551616D)"
    return f"if(size({s}) < {k}, cast(size({s}) as double), ({k} - 1) / {place})"


def resemblance(a: str, b: str, k: int = SIZE) -> str:
    """SQL for the share of the merged sketch that both have; two empty sketches are alike."""
    both = f"size(array_intersect({merged(a, b, k)}, array_intersect({a}, {b})))"
    return f"if({a} = {b}, 1D, cast({both} as double) / size({merged(a, b, k)}))"


def containment(a: str, b: str, k: int = SIZE) -> str:
    """SQL for the share of a's shingles that b has, from resemblance and sizes; 1 if a has none."""
    union = distinct(merged(a, b, k), k)
    return f"if(size({a}) = 0, 1D, least(1D, {resemblance(a, b, k)} * {union} / {distinct(a, k)}))"


def shown(s: str) -> str:
    """SQL for a sketch as text: 16 hexadecimal digits for each hash."""
    return f"array_join(transform({s}, h -> lpad(hex(h), 16, '0')), '')"


def merge_groups(df: DataFrame, keys: list[str], column: str, k: int = SIZE) -> DataFrame:
    """One sketch per group, as if made of all its parts.

    Hashes are cut to distinct ones before the shuffle and ranked in parts of a
    group first, so no task sees more than its parts times ``k`` hashes.
    """
    parts = df.selectExpr(*keys, f"explode({column}) as _h").distinct()
    small = parts.selectExpr("*", "pmod(xxhash64(_h), 64) as _part")
    for by in ([*keys, "_part"], keys):
        rank = f"row_number() over (partition by {', '.join(by)} order by _h) as _rank"
        small = small.selectExpr("*", rank).where(f"_rank <= {k}").drop("_rank")
    return small.groupBy(*keys).agg(F.expr(f"sort_array(collect_list(_h)) as {column}"))


def with_sketch(df: DataFrame, text: str, name: str, k: int = SIZE) -> DataFrame:
    """Add the sketch of a text column; null counts as empty.  No shuffle."""
    split = df.selectExpr("*", f"{words(f'`{text}`')} as _w")
    return split.selectExpr("*", f"{sketch('_w', k)} as {name}").drop("_w")


def followed(df: DataFrame, key: str, column: str, name: str, rows_each: int = 512) -> DataFrame:
    """Add the column's value in the next row by ``key`` (after the last row, the first), and no task sees all rows.

    The numeric key is cut by approximate quantiles into ranges of about
    ``rows_each`` rows, at most ``MOST_RANGES`` of them, so the cuts fit in the
    plan.  Within a range a window looks up the next row; at its end that is
    the first row of the next range, one row a range.  Null keys come first;
    rows with equal keys follow each other by the column's hash.
    """
    ranges = max(1, min(MOST_RANGES, -(-df.count() // rows_each)))
    place = f"coalesce(cast(`{key}` as double), -1.7976931348623157E308D)"
    cuts = []
    if ranges > 1:
        at = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
        cuts = sorted(set(df.selectExpr(f"percentile_approx({place}, array({at}), {max(10_000, 10 * ranges)})").first()[0]))
    # Two steps of about a root of the cuts each, in place of one look at all.
    step = max(1, round(len(cuts) ** 0.5))
    fine = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    array = lambda xs: f"cast(array({', '.join(f'{x!r}D' for x in xs)}) as array<double>)"
    coarse = f"size(filter({array([f[-1] for f in fine if f])}, c -> c < {place}))"
    within = f"array({', '.join(array(f) for f in [*fine, []])})"
    dealt = (
        df.selectExpr("*", f"xxhash64(`{column}`) as _tie", f"{coarse} as _coarse")
        .selectExpr("*", f"_coarse * {step} + size(filter({within}[_coarse], c -> c < {place})) as _range")
        .drop("_coarse")
    )
    inside = dealt.selectExpr(
        "*", f"lead(struct(`{column}` as v)) over (partition by _range order by `{key}` nulls first, _tie) as _next"
    )
    starts = dealt.groupBy("_range").agg(F.expr(f"min(struct(`{key}` as k, _tie as t)) as _least")).selectExpr(
        "_range as _of", "_least",
        "coalesce(lag(_range) over (order by _range), last(_range) over (order by _range rows between "
        "unbounded preceding and unbounded following)) as _before",
    )
    firsts = (
        dealt.join(F.broadcast(starts), F.expr(f"_range = _of and `{key}` <=> _least.k and _tie = _least.t"))
        .selectExpr("_before", f"struct(`{column}` as v) as _first")
        .dropDuplicates(["_before"])
    )
    joined = inside.join(firsts, F.expr("_range = _before and _next is null"), "left")
    return joined.selectExpr(*(f"`{c}`" for c in df.columns), f"coalesce(_next, _first).v as {name}")
