"""Polygons to grid cells.

``cover`` lists the cells of each bounding box.  ``pieces`` goes further and
cuts each polygon into what a single cell needs to know to place a point:

* a *full* cell lies wholly inside, so no edge has to be looked at;
* an *edge* cell holds only the edges that pass through it.

Edges to the right of a cell matter to a ray that leaves it, too.  Within one
grid row they are summed up once: an edge that spans the foot of the row flips
the state of every cell to its left, and a vertex flips the cells between its
two edges.  What is left for a cell is written as upright edges on its right
border, so the answer from a piece equals the answer from the whole polygon,
while the number of edges kept grows with the length of the border only.  A
polygon with a million vertices is spread over its cells and never copied.

The generators are the ``_outer`` kind: for the others Spark adds a filter on
the array and pushes it down, which repeats the whole expression under it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import axis, check_size, pack, unpack
from tidemark.functions.outline import EDGE_TYPE, ENDS, SHAPE_COLUMNS, corners, strip_column, upward
from tidemark.operators.skew import row_bytes

EDGE_BYTES = 64
PIECE_BYTES = 320
WIDER = 8
WIDEST = "max(least(x1 - x0, y1 - y0))"


def cover(polygons: DataFrame, size: int) -> DataFrame:
    """One row per polygon row and cell that its bounding box touches."""
    check_size(size)
    spans = polygons.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    by_col = spans.selectExpr("*", f"explode_outer(sequence({axis('x0', size)}, {axis('x1', size)})) as _col")
    by_row = by_col.selectExpr("*", f"explode_outer(sequence({axis('y0', size)}, {axis('y1', size)})) as _row")
    return by_row.selectExpr(*(f"`{c}`" for c in polygons.columns), f"{pack('_col', '_row')} as cell_id")


def attributes(polygons: DataFrame, feature: str = "feature_id") -> list[str]:
    """Columns of a polygon table that describe the feature, not its shape."""
    return [c for c in polygons.columns if c not in SHAPE_COLUMNS and c != feature]


def _about(polygons: DataFrame, feature: str) -> str:
    kept = attributes(polygons, feature)
    return f"struct({', '.join(f'`{c}`' for c in kept)})" if kept else "cast(null as string)"


def _strips(polygons: DataFrame, size: int, feature: str) -> DataFrame:
    """Edges and vertex flips by grid row, with the span of columns they touch."""
    points = polygons.where("size(verts) >= 3").selectExpr(
        f"{feature} as _feature", f"{_about(polygons, feature)} as _about", f"inline_outer({corners('verts')}) as (v, before, after)"
    )
    ends = points.selectExpr(
        "_feature", "_about", "v.y as y", f"{axis('v.y', size)} as _row_of_y",
        *upward("before", "v", "p_"), *upward("v", "after"),
    )
    in_row = f"pmod(y, {size}) <> 0"
    seen = ends.selectExpr(
        "*",
        f"if({in_row}, {strip_column('_row_of_y', size, prefix='p_')}, null) as _seen_before",
        f"if({in_row}, {strip_column('_row_of_y', size)}, null) as _seen_after",
    )
    nothing = "cast(null as bigint)"
    whole = (
        "named_struct('real', true, 'xa', xa, 'ya', ya, 'xb', xb, 'yb', yb, "
        f"'first_row', {axis('ya', size)}, 'last_row', {axis('yb - 1', size)}, 'left', {nothing}, 'right', {nothing})"
    )
    flip = (
        f"named_struct('real', false, 'xa', {nothing}, 'ya', y, 'xb', {nothing}, 'yb', (_row_of_y + 1) * {size}, "
        "'first_row', _row_of_y, 'last_row', _row_of_y, "
        "'left', least(_seen_before, _seen_after), 'right', greatest(_seen_before, _seen_after) - 1)"
    )
    moves = (
        f"case when ya < yb and _seen_before <> _seen_after then array({whole}, {flip}) "
        f"when ya < yb then array({whole}) when _seen_before <> _seen_after then array({flip}) end"
    )
    strips = (
        seen.selectExpr("_feature", "_about", f"{moves} as moves")
        .selectExpr("_feature", "_about", "inline_outer(moves)")
        .where("first_row is not null")
        .selectExpr("*", "explode_outer(sequence(first_row, last_row)) as _row")
    )
    return strips.selectExpr(
        "_feature", "_about", "_row", "real", *ENDS,
        f"coalesce(left, {strip_column('_row', size)}) as _left",
        f"coalesce(right, {strip_column('_row', size, last=True)}) as _right",
        f"real and ya <= _row * {size} as _spans_foot",
    )


def edge_cells(polygons: DataFrame, size: int, feature: str = "feature_id", keep: list[str] = ()) -> DataFrame:
    """One row per edge and cell it touches, only the cell and what to ``keep`` (``_feature``): for counting."""
    touched = _strips(polygons, size, feature).selectExpr(*keep, "_row", "explode_outer(sequence(_left, _right)) as _col")
    return touched.selectExpr(*keep, f"{pack('_col', '_row')} as cell_id")


def outline_cells(polygons: DataFrame, size: int, feature: str = "feature_id") -> DataFrame:
    """Edge cells, each with the run of full cells that follows on its left.

    One shuffle, by feature and grid row, serves both the grouping by cell and
    the walk along the row.  Hot features spread over their rows.
    """
    check_size(size)
    atoms = _strips(polygons, size, feature).selectExpr("*", "explode_outer(sequence(_left, _right)) as _col")
    border = f"(_col + 1) * {size}"
    atoms = atoms.selectExpr(
        "_feature", "_about", "_row", "_col",
        f"named_struct('xa', coalesce(xa, {border}), 'ya', ya, 'xb', coalesce(xb, {border}), 'yb', yb) as edge",
        "if(real, least(xa, xb), null) as _min_x",
        "cast(_spans_foot and _col = _left as bigint) as _foot",
    )
    cells = (
        atoms.repartition("_feature", "_row")
        .groupBy("_feature", "_row", "_col")
        .agg(
            F.expr("first(_about) as _about"), F.expr("collect_list(edge) as edges"),
            F.expr("min(_min_x) as _min_x"), F.expr("sum(_foot) as _foot"),
        )
    )
    leftwards = "partition by _feature, _row order by _col desc"
    walked = cells.selectExpr(
        "*",
        f"coalesce(sum(_foot) over ({leftwards} rows between unbounded preceding and 1 preceding), 0) as _foot_right",
        f"lead(_col) over ({leftwards}) as _next",
    ).selectExpr("*", "min(_min_x) over (partition by _feature, _row) as lo_x")
    upright = (
        f"array(named_struct('xa', {border}, 'ya', _row * {size}, 'xb', {border}, 'yb', (_row + 1) * {size}))"
    )
    inside_gap = "(_foot_right + _foot) % 2 = 1 and _next < _col - 1"
    return walked.selectExpr(
        f"_feature as {feature}", "_about", "_row", "_col", "lo_x",
        f"if(_foot_right % 2 = 1, concat(edges, {upright}), edges) as edges",
        f"if({inside_gap}, _next + 1, null) as run_from",
        f"if({inside_gap}, _col - 1, null) as run_to",
    )


NOTHING = "cast(null as bigint)"
PIECE = (
    "named_struct('c', {c}, 'full', {full}, 'edges', {edges}, 'lo_x', {lo_x}, 'hi_x', {hi_x}, 'lo_y', {lo_y}, 'hi_y', {hi_y})"
)
EDGE_PIECE = PIECE.format(
    c="_col", full="false", edges="edges", lo_x="lo_x", hi_x="array_max(transform(edges, e -> greatest(e.xa, e.xb)))",
    lo_y="array_min(transform(edges, e -> e.ya))", hi_y="array_max(transform(edges, e -> e.yb))",
)
FULL_PIECE = PIECE.format(
    c="c", full="true", edges=f"cast(null as array<{EDGE_TYPE}>)", lo_x=NOTHING, hi_x=NOTHING, lo_y=NOTHING, hi_y=NOTHING
)


def pieces(polygons: DataFrame, size: int, feature: str = "feature_id") -> DataFrame:
    """One row per feature and cell that holds some of it: a full or an edge cell.

    ``lo_x``, ``hi_x``, ``lo_y``, ``hi_y`` bound the points an edge cell can
    accept, as a cheap test before its edges are walked.
    """
    return layered_pieces(polygons, [size], feature)[0]


def layered_pieces(
    polygons: DataFrame, sides: list[int], feature: str = "feature_id", cut: dict[int, DataFrame] | None = None
) -> list[DataFrame]:
    """Pieces of several grids, whose ``sides`` grow and divide each other.

    A full cell is listed on the widest grid on which it is full and on no
    other, so the rows of a large polygon grow with its border and not with
    its area.  Grids are cut for the features that are wide enough to have a
    full cell there.  A run of full cells leaves out the runs of the next
    wider grid, which are joined to it by feature and row.

    ``cut`` has, by side, the crowded cells ``_crowded`` that go on to the
    next finer grid: they keep no edges, and finer grids hold nothing outside
    them.  Edges are kept on the widest grid in ``cut`` and on finer ones, or
    else on the first grid alone.
    """
    cut = cut or {}
    base = max(cut, default=sides[0])
    about = ["_about.*"] if attributes(polygons, feature) else []
    out, wider, times = [], None, 1
    for i in range(len(sides) - 1, -1, -1):
        side, some = sides[i], polygons
        if side > base:
            wide = polygons.where(f"least(x1 - x0, y1 - y0) >= {side}").select(feature).distinct()
            some = polygons.join(wide, feature, "left_semi")
        elif side < base:
            col, row = unpack("cell_id")
            near = edge_cells(polygons, sides[i + 1], feature, ["_feature"]).join(cut[sides[i + 1]], F.expr("cell_id = _crowded"), "left_semi")
            some = polygons.join(near.select(F.col("_feature").alias(feature)).distinct(), feature, "left_semi")
        cells = outline_cells(some, side, feature)
        own = cells.where("run_from is not null") if i else None
        runs = "array(named_struct('f', run_from, 't', run_to))"
        if wider is not None:
            cells = cells.join(wider, F.expr(f"{feature} = _of and floor(_row / {times}) = _wide_row"), "left")
            within = f"filter(coalesce(_wide, array()), w -> w.f * {times} >= run_from and (w.t + 1) * {times} <= run_to + 1)"
            runs = (
                f"flatten(transform(array({within}), w -> zip_with(concat(array(run_from), transform(w, r -> (r.t + 1) * {times})), "
                f"concat(transform(w, r -> r.f * {times} - 1), array(run_to)), (f, t) -> named_struct('f', f, 't', t))))"
            )
        full = f"flatten(transform(filter({runs}, r -> r.f <= r.t), r -> transform(sequence(r.f, r.t), c -> {FULL_PIECE})))"
        edge = f"array({EDGE_PIECE})"
        listed = f"if(run_from is null, {edge}, concat({edge}, {full}))" if side <= base else f"if(run_from is null, null, {full})"
        found = cells.selectExpr(feature, "_about", "_row", f"inline_outer({listed})")
        found = (found.where("full") if side > base else found).selectExpr(
            feature, *about, f"{pack('c', '_row')} as cell_id", "full", "edges", "lo_x", "hi_x", "lo_y", "hi_y"
        )
        if side < base:
            around = pack(f"floor({col} / {times})", f"floor({row} / {times})")
            found = found.join(cut[sides[i + 1]], F.expr(f"{around} = _crowded"), "left_semi")
        if side in cut and i:
            kept = found.where("not full").join(cut[side], F.expr("cell_id = _crowded"), "left_anti")
            found = found.where("full").unionByName(kept)
        out.append(found)
        if i:
            times = side // sides[i - 1]
            wider = own.groupBy(feature, "_row").agg(
                F.expr("array_sort(collect_list(named_struct('f', run_from, 't', run_to))) as _wide")
            ).selectExpr(f"{feature} as _of", "_row as _wide_row", "_wide")
    return out[::-1]


def wider_levels(side: int | None, size: int) -> int:
    """How many wider grids a polygon can have a full cell on whose box has this shorter side."""
    levels = 0
    while size * WIDER ** (levels + 1) <= (side or 0):
        levels += 1
    return levels


def widest(polygons: DataFrame) -> int:
    """The greatest shorter side of the boxes; one pass."""
    return polygons.where("size(verts) >= 3").selectExpr(WIDEST).first()[0] or 0


def median_side(polygons: DataFrame) -> int:
    """A cell side to start from: the median longer side of the boxes."""
    side = polygons.selectExpr("percentile_approx(greatest(x1 - x0, y1 - y0), 0.5)").first()[0]
    return max(int(side or 1), 1)


def pieces_size(polygons: DataFrame, size: int, feature: str = "feature_id") -> tuple[int, int, int]:
    """Number of edges, a bound on the bytes of the pieces of one grid, and what ``widest`` gives, in one pass.

    An edge touches no more cells than its own bounding box has, nor more than
    a walk along it meets; full cells are bounded by the polygon's box.
    """
    after = "concat(slice(verts, 2, size(verts) - 1), slice(verts, 1, 1))"
    cols, rows = (f"abs({axis(f'w.{a}', size)} - {axis(f'v.{a}', size)})" for a in ("x", "y"))
    touched = f"least(({cols} + 1) * ({rows} + 1), {cols} + 3 * {rows} + 3) + {cols} + 1"
    touches = f"aggregate(zip_with(verts, {after}, (v, w) -> cast({touched} as double)), 0D, (s, n) -> s + n)"
    width = row_bytes(polygons, attributes(polygons, feature))
    cells = (
        f"cast({axis('x1', size)} - {axis('x0', size)} + 1 as double) * ({axis('y1', size)} - {axis('y0', size)} + 1)"
    )
    bound = f"coalesce({touches}, 0D) * {EDGE_BYTES} + coalesce({cells}, 0D) * ({PIECE_BYTES} + {width})"
    usable = polygons.where("size(verts) >= 3")
    edges, total, side = usable.selectExpr("sum(size(verts))", f"sum({bound})", WIDEST).first()
    return edges or 0, int(total or 0), side or 0
