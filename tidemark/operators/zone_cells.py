"""Polygons and rows summed up by grid cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import axis, cell_of, check_size, pack
from tidemark.functions.outline import SHAPE_COLUMNS, crossings
from tidemark.operators.cover import outline_cells
from tidemark.operators.skew import HOT_ROWS, skew_join

# Thousandths of a cell's rows between the bounds of its median, ten times what the sketch may be off
# to either side; cells of so few rows are ranked as a whole.
MIDDLE, RANKED_WHOLE = 2, 1_000


def zone_cells(zones: DataFrame, size: int, sub: int = 1, feature: str = "feature_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """How much of each cell each zone takes, by ``sub`` x ``sub`` sample points.

    Zones are cut at the side of a sample square, whose centre is the point.
    An edge square is tested on its own edges; a run of full squares adds its
    length to each cell it crosses without being listed.  There is no join,
    and counts are combined before they are shuffled.  Every zone of a cell is
    kept; a zone that holds no sample point of a cell has no row there.
    ``keep`` names attributes of the zones that go along, so that nothing has
    to be joined to get them.
    """
    check_size(size)
    check_size(sub)
    if size % sub:
        raise ValueError("size must be a multiple of sub")
    step = size // sub
    centre_x, centre_y = f"(_col * {step} + {step // 2})", f"(_row * {step} + {step // 2})"
    first, last = axis("run_from", sub), axis("run_to", sub)
    at_edge = f"named_struct('c', {axis('_col', sub)}, 'n', cast({crossings(centre_x, centre_y, 'edges')} % 2 as bigint))"
    in_run = (
        f"transform(sequence({first}, {last}), p -> named_struct('c', p, 'n', "
        f"least(run_to, (p + 1) * {sub} - 1) - greatest(run_from, p * {sub}) + 1))"
    )
    shape = [f"`{c}`" for c in zones.columns if c == feature or c in SHAPE_COLUMNS or c in keep]
    about = [f"_about.`{c}` as `{c}`" for c in keep]
    counted = outline_cells(zones.selectExpr(*shape), step, feature).selectExpr(
        feature, *about, f"{axis('_row', sub)} as r",
        f"inline_outer(if(run_from is null, array({at_edge}), concat(array({at_edge}), {in_run})))",
    )
    return (
        counted.where("n > 0")
        .selectExpr(feature, *(f"`{c}`" for c in keep), f"{pack('c', 'r')} as cell_id", "n")
        .groupBy("cell_id", feature)
        .agg(F.expr("sum(n) as samples"), *(F.expr(f"first(`{c}`) as `{c}`") for c in keep))
        .selectExpr("cell_id", feature, "samples", f"samples * 1000000 div {sub * sub} as share_ppm", *(f"`{c}`" for c in keep))
    )


def coverage(df: DataFrame, size: int, x: str = "x", y: str = "y") -> DataFrame:
    """The cells a layer of points covers, with its number of rows in each."""
    check_size(size)
    return (
        df.selectExpr(f"{cell_of(x, y, size)} as cell_id")
        .where("cell_id is not null")
        .groupBy("cell_id")
        .agg(F.expr("count(1) as rows"))
    )


def cell_summary(
    df: DataFrame, cell: str, value: str, approximate: bool = False, by: tuple[str, ...] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Count, least, greatest, mean and median of ``value`` in each cell.

    ``by`` names further columns to keep apart, such as the datum of heights,
    which must not be compared across datums.
    Nulls are left out.  The exact median ranks only the middle of a cell: a
    bounded sketch, combined before the shuffle, gives two values between which
    the median must lie; equal values are counted, those below the first become
    one count, and what is left, some ``MIDDLE`` thousandths of a large cell, is
    ranked.  Hot cells are cut into parts for the join with their bounds.
    ``approximate`` takes ``percentile_approx`` instead: one grouping.
    """
    keys = ["cell_id", *by]
    rows = df.selectExpr(f"{cell} as cell_id", f"{value} as v", *(f"`{c}`" for c in by))
    rows = rows.where("cell_id is not null and v is not null")
    totals = ["sum(n) as n_values", "min(v) as min_value", "max(v) as max_value",
              "sum(v * n) / sum(n) as mean_value"]
    if approximate:
        return rows.selectExpr("*", "1L as n").groupBy(*keys).agg(
            *(F.expr(t) for t in totals), F.expr("cast(percentile_approx(v, 0.5, 10000) as double) as median_value")
        )
    # A struct is never null, so groups with a null among their columns meet, too.
    grouped = rows.selectExpr(f"struct({', '.join(f'`{k}`' for k in keys)}) as _group", "v", "cast(v as double) as _d", "1L as n")
    bounds = f"percentile_approx(_d, array({0.5 - MIDDLE / 2000}D, {0.5 + MIDDLE / 2000}D), 10000) as _q"
    stats = grouped.groupBy("_group").agg(*(F.expr(t) for t in totals), F.expr(bounds), F.expr("min(_d) as _lo"), F.expr("max(_d) as _hi"))
    names = ["n_values", "min_value", "max_value", "mean_value"]
    small = f"n_values <= {RANKED_WHOLE}"
    stats = stats.selectExpr(
        "_group", f"struct({', '.join(names)}) as _all", f"if({small}, _lo, _q[0]) as _from", f"if({small}, _hi, _q[1]) as _upto"
    )
    counts = grouped.groupBy("_group", "v", "_d").agg(F.expr("count(1) as n"))
    middle = (
        skew_join(counts, stats, ["_group"], "inner", "_d <= _upto", hot_rows)
        .groupBy("_group", "_all", F.expr("if(_d < _from, null, v) as v")).agg(F.expr("sum(n) as n"))
    )
    upto = "sum(n) over (partition by _group order by v nulls first rows between unbounded preceding and current row) as upto"
    first, second = "(_all.n_values + 1) div 2", "_all.n_values div 2 + 1"
    reached = f"if(v is null and upto >= {first}, raise_error('the median lies below its bound'), v)"
    ranked = middle.selectExpr("_group", "_all", "v", "n", upto).selectExpr("_group", "_all", f"{reached} as v", "upto")
    found = ranked.groupBy("_group", "_all").agg(
        F.expr(f"(min(if(upto >= {first}, v, null)) + min(if(upto >= {second}, v, null))) / 2 as median_value")
    )
    return found.selectExpr("_group.*", "_all.*", "median_value")
