"""Nearest targets of each point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import axis, cell_of, check_size, pack, parent, unpack
from tidemark.operators.pick import top_rows
from tidemark.operators.skew import HOT_ROWS, hottest, listed, row_bytes, skew_join

BROADCAST_BYTES = 32 << 20
FINER = 8
GRIDS = 3
BOX = ("x0", "y0", "x1", "y1")
FAR = "((x - n.x) * (x - n.x) + (y - n.y) * (y - n.y))"
# Targets of a leaf, branches that a place meets in one row, and targets of a widest cell that points may all look at.
LEAF, BRANCHES_EACH, CROWD = 8, 64, 256


def nearest(
    points: DataFrame,
    targets: DataFrame,
    radius: int,
    k: int = 1,
    key: str = "building_id",
    target_id: str = "bfe_id",
    prefix: str = "near_",
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    grids: int = GRIDS,
    match: list[str] = (),
    leaf: int = LEAF,
) -> DataFrame:
    """The ``k`` nearest targets within ``radius`` of each point, exactly.

    Distance is measured in the plane of the coordinates ``x`` and ``y``; equal
    distances go to the lower target id.  Target columns come back with
    ``prefix``, next to ``<prefix>d2``, the squared distance, and
    ``<prefix>rank``.  A point without a target in reach is kept with nulls.
    ``match`` names columns of both sides, such as the datum of heights, that
    must be equal for a target to count; null equals nothing.
    ``target_id`` must be unique in ``targets``.  Every row of ``points`` is
    answered by its own place, so keys may repeat or be null; ``key`` only
    names what a row is about and does not change the result.

    Points and targets meet on grid cells: a point searches the 3 x 3 cells
    around its own.  Which of the ``grids`` grids it searches follows the
    density of targets: where a small cell already has ``k`` of them, the
    nearest ``k`` are no further away than its diagonal, and the next wider
    grid is enough; elsewhere the widest is used, whose side is at least the
    radius.  Each grid more makes the finest one eight times finer, for targets
    that crowd together.  Of targets on one spot only the ``k`` lowest ids can ever count,
    so the others are left out at the start.

    ``broadcast`` keeps the points where they are and needs no shuffle at all:
    the targets are broadcast by the cell they lie in, once for each grid that
    is searched, and a point looks up the cells around its own.  ``shuffle``
    sends each distinct place once to the cell it searches.  There wait the
    targets around, in leaves, squares as small as it takes to hold ``leaf``
    of them at most (see ``target_leaves``), and these in branches, the next
    wider squares.  A target is listed in nine cells of a grid at most,
    however many points there are.  A place ranks the targets of
    the branch with ``k`` of them whose far side is nearest, and then those of
    all leaves that are no further than the ``k``-th of these, within one row:
    pairs never become rows, however targets crowd together.
    The answers go back to the points, with hot cells and places cut into
    parts.  ``auto`` measures the targets and broadcasts up to
    ``broadcast_bytes``, if no cell of the widest grid holds a crowd.
    """
    check_size(radius)
    check_size(k)
    check_size(grids)
    if strategy not in ("auto", "broadcast", "shuffle"):
        raise ValueError("strategy must be auto, broadcast or shuffle")
    if strategy == "auto":
        strategy = "broadcast" if _sparse(targets, radius, broadcast_bytes // max(1, grids - 1)) else "shuffle"

    useful = targets.where("x is not null and y is not null")
    useful = top_rows(useful, ["x", "y", *match], [target_id], k)
    rest = [c for c in targets.columns if c not in ("x", "y", target_id)]
    hit = ", ".join(
        [f"'{prefix}{target_id}', `{target_id}`", f"'{prefix}x', x", f"'{prefix}y', y"]
        + [f"'{prefix}{c}', `{c}`" for c in rest]
    )
    if strategy == "broadcast":
        return _by_lists(points, targets, useful, radius, k, prefix, target_id, hit, match, grids)
    return _by_leaves(points, useful, radius, k, prefix, target_id, hit, match, grids, hot_rows, leaf)


def _by_lists(
    points: DataFrame, targets: DataFrame, useful: DataFrame, radius: int, k: int, prefix: str, target_id: str,
    hit: str, match: list[str], grids: int,
) -> DataFrame:
    """The search without a shuffle of points: the targets around each cell, listed and broadcast."""
    finest = -(-radius // FINER ** (grids - 1))
    sides = [finest * FINER**i for i in range(grids)]
    searched = sides[1:] + sides[-1:]
    same = [f"_same{j}" for j in range(len(match))]
    as_same = [f"`{c}` as {s}" for c, s in zip(match, same)]
    graded = points
    for i in range(grids - 1):
        known = F.broadcast(_rich(targets, sides[i], k, f"_rich{i}", match))
        equal = "".join(f" and `{c}` = _rich{i}_{j}" for j, c in enumerate(match))
        graded = graded.join(known, F.expr(f"{cell_of('x', 'y', sides[i])} = _rich{i}{equal}"), "left")
    col, row = (_choose([axis(c, s) for s in searched]) for c in ("x", "y"))
    found = graded.selectExpr(
        *_each(points), *as_same, f"{_choose(searched)} as _own_side", f"{col} as _own_col", f"{row} as _own_row"
    )
    grouped = F.broadcast(
        useful.selectExpr(f"named_struct({hit}) as t", "x", "y", *as_same, f"explode({_own(searched)}) as _at")
        .groupBy("_at", *same).agg(F.expr("collect_list(named_struct('t', t, 'x', x, 'y', y)) as _in"))
        .selectExpr("_at.side as _side", "_at.cell as _cell", *(f"{s} as _r{s}" for s in same), "_in")
    )
    # The same list is looked up nine times, and broadcast once.
    equal = "".join(f" and {s} = _r{s}" for s in same)
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    for n, (i, j) in enumerate(around):
        meets = f"_own_side = _side and {pack(f'_own_col + {i}', f'_own_row + {j}')} = _cell{equal}"
        found = found.join(grouped, F.expr(meets), "left").drop("_side", "_cell", *(f"_r{s}" for s in same))
        found = found.withColumnRenamed("_in", f"_in{n}")
    lists = ", ".join(f"_in{n}" for n in range(len(around)))
    found = found.selectExpr(*_each(points), f"flatten(filter(array({lists}), l -> l is not null)) as _near")
    return _ranked(found, _each(points), k, radius * radius, prefix, target_id).selectExpr(
        *_each(points), "_hit.t.*", f"_hit.d2 as {prefix}d2", f"if(_hit.d2 is null, null, _pos + 1) as {prefix}rank"
    )


def _by_leaves(
    points: DataFrame, useful: DataFrame, radius: int, k: int, prefix: str, target_id: str, hit: str,
    match: list[str], grids: int, hot_rows: int, leaf: int,
) -> DataFrame:
    """The shuffled search: what may count for each place, ranked and sent back to the points."""
    same = [f"_same{j}" for j in range(len(match))]
    as_same = [f"`{c}` as {s}" for c, s in zip(match, same)]
    near = candidates(points, useful, radius, k, hit, match, grids, hot_rows, leaf)
    best = top_rows(
        _ranked(near, ["x", "y", *same], k, radius * radius, prefix, target_id).where("_hit.d2 is not null")
        .selectExpr("x", "y", *same, "_hit.t as _t", f"_hit.d2 as {prefix}d2"),
        ["x", "y", *same], [f"{prefix}d2", f"_t.{prefix}{target_id}"], k, f"{prefix}rank",
    )
    found = skew_join(points.selectExpr("*", *as_same), best, ["x", "y", *same], "left", hot_rows=hot_rows)
    return found.selectExpr(*_each(points), "_t.*", f"{prefix}d2", f"{prefix}rank")


def candidates(
    points: DataFrame, useful: DataFrame, radius: int, k: int, hit: str, match: list[str] = (), grids: int = GRIDS,
    hot_rows: int = HOT_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """Each distinct place with the targets ``_near`` that may be among its ``k`` nearest.

    Branches of targets meet cells of points, then places; ``hit`` is SQL for
    the fields of a target.
    """
    base, depth = tree(radius, grids)
    finest = base * FINER**depth
    sides = [finest * FINER**i for i in range(grids)]
    searched = sides[1:] + sides[-1:]
    reach = radius * radius
    bounds = [*(min(reach, 2 * s * s) for s in sides[:-1]), reach]
    same = [f"_same{j}" for j in range(len(match))]
    as_same = [f"`{c}` as {s}" for c, s in zip(match, same)]
    leaves = target_leaves(
        useful.selectExpr(f"named_struct({hit}) as t", "x", "y", *as_same), base, depth, leaf, same, hot_rows
    )
    offered = _branches(leaves, base, depth, same).selectExpr("*", f"explode({_own(searched, 'x0', 'y0')}) as _at")
    offered = offered.selectExpr(*same, *BOX, "n", "leaves", "_at.side as _side", "_at.cell as _cell")
    crowds = useful.selectExpr(*as_same, f"explode({_own(searched)}) as _at").selectExpr(*same, "_at.side as _side", "_at.cell as _cell")
    crowds = crowds.groupBy("_side", "_cell", *same).agg(F.expr("count(1) as _n"))

    known = [listed(_rich(useful, sides[i], k, f"_rich{i}", match)) for i in range(grids - 1)]

    def graded(rows: DataFrame) -> DataFrame:
        """Rows with the cell that each searches, and the grade it was chosen by."""
        for i, rich in enumerate(known):
            equal = "".join(f" and {s} = _rich{i}_{j}" for j, s in enumerate(same))
            rows = rows.join(rich, F.expr(f"{cell_of('x', 'y', sides[i])} = _rich{i}{equal}"), "left")
        return rows.selectExpr(
            "x", "y", *same, f"{_choose([cell_of('x', 'y', s) for s in searched])} as _fine", f"{_choose(list(range(grids)))} as _grade"
        )

    # What may count for a cell is settled once per cell that has points.
    at_spot = ["_fine", "_grade", *same]
    places = points.selectExpr("x", "y", *as_same).dropna()
    spots = graded(places).groupBy(*at_spot).agg(F.expr("count(1) as _n"))
    col, row = unpack("_fine")
    side = f"element_at(array({', '.join(f'{s}L' for s in searched)}), _grade + 1)"
    wanted = spots.selectExpr(
        *at_spot, f"{side} as _side", f"element_at(array({', '.join(f'{b}L' for b in bounds)}), _grade + 1) as _bound",
        f"{col} as _fx", f"{row} as _fy",
    ).selectExpr(
        *at_spot, "_side", "_bound", "_fx * _side as cx0", "_fy * _side as cy0",
        "(_fx + 1) * _side - 1 as cx1", "(_fy + 1) * _side - 1 as cy1",
        f"explode({_around('_fx', '_fy')}) as _cell",
    )
    cell = ("cx0", "cy0", "cx1", "cy1")
    offers = skew_join(
        offered, wanted, ["_side", "_cell", *same], "inner", f"{_least_d2(cell, BOX)} <= _bound", hot_rows,
        hot=hottest(crowds, ["_side", "_cell", *same], hot_rows),
    )
    # A branch with k targets bounds the k-th distance of every place in the cell.
    by_cell = f"partition by {', '.join(at_spot)}"
    offers = offers.selectExpr(
        *at_spot, f"named_struct({', '.join(f'{c!r}, {c}' for c in (*BOX, 'n', 'leaves'))}) as _branch", f"{_least_d2(cell, BOX)} as _least",
        f"min(if(n >= {k}, {_most_d2(cell, BOX)}, null)) over ({by_cell}) as _most",
    ).where("_most is null or _least <= _most")
    blocks = (
        offers.selectExpr("*", f"pmod(xxhash64(_branch.x0, _branch.y0), (count(1) over ({by_cell})) div {BRANCHES_EACH} + 1) as _block")
        .groupBy(*at_spot, "_block").agg(F.expr("collect_list(_branch) as _near"))
    )
    met = skew_join(
        graded(places.distinct()), blocks.drop("_block"), at_spot, "inner", hot_rows=hot_rows, hot=hottest(spots, at_spot, hot_rows)
    )
    return met.selectExpr("x", "y", *same, f"{_within_reach(k, reach)} as _near")


def _within_reach(k: int, reach: int) -> str:
    """The targets of the branches ``_near`` whose leaves are no further from a place than its ``k``-th in one branch.

    That branch is the one with ``k`` targets whose far side is nearest.
    """
    here, there = ("x", "y", "x", "y"), tuple(f"b.{c}" for c in BOX)
    least = _least_d2(here, there)
    first = f"array_min(transform(_near, (b, i) -> if(b.n >= {k}, named_struct('d2', {_most_d2(here, there)}, 'i', i), null))).i"
    far = f"transform(flatten(transform(_near[{first}].leaves, l -> l.ts)), n -> {FAR})"
    nearest_there = f"array_min({far})" if k == 1 else f"element_at(array_sort({far}), {k})"
    # An array of one value binds it, so that it is found once and not for each box.
    upto = f"array(least(coalesce({nearest_there}, {reach}), {reach}))"
    leaves = f"transform(filter(_near, b -> {least} <= upto), a -> filter(a.leaves, b -> {least} <= upto))"
    return f"flatten(transform({upto}, upto -> flatten(transform(flatten({leaves}), l -> l.ts))))"


def _branches(leaves: DataFrame, base: int, depth: int, same: list[str]) -> DataFrame:
    """Leaves grouped by the next wider square, up to the widest."""
    step = FINER.bit_length() - 1
    up = f"if(_level < {depth}, {parent('_node', step)}, _node)"
    leaf = f"named_struct({', '.join(f'{c!r}, {c}' for c in (*BOX, 'n', 'ts'))}) as _leaf"
    named = leaves.selectExpr(f"least(_level + 1, {depth}) as _over", f"{up} as _branch", *same, *BOX, "n", leaf)
    return named.groupBy("_over", "_branch", *same).agg(
        *(F.expr(f"{f}({c}) as {c}") for c, f in zip(BOX, ("min", "min", "max", "max"))),
        F.expr("sum(n) as n"), F.expr("collect_list(_leaf) as leaves"),
    ).drop("_over", "_branch")


def tree(radius: int, grids: int) -> tuple[int, int]:
    """Side of the smallest squares, at most 4, and the steps of ``FINER`` from it to the finest grid."""
    steps = grids - 1
    while -(-radius // FINER**steps) > 4:
        steps += 1
    return -(-radius // FINER**steps), steps - grids + 1


def target_leaves(targets: DataFrame, base: int, depth: int, most: int, same: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Targets in leaves: squares with at most ``most`` of them, or else the smallest squares of side ``base``.

    Squares of ``depth + 1`` sides are counted, combined before the shuffle;
    the leaves are those that hold few enough while the next wider one does
    not.  A target finds its leaf by joining all its squares to them, where
    crowded squares are cut into parts.  Rows have the leaf's tight box
    ``x0 y0 x1 y1``, its number ``n`` and its targets ``ts``, next to its
    ``_level`` and ``_node``.
    """
    squares = [f"named_struct('level', {i}, 'node', {cell_of('x', 'y', base * FINER**i)})" for i in range(depth + 1)]
    named = targets.selectExpr("t", "x", "y", *same, f"explode(array({', '.join(squares)})) as _s").selectExpr(
        "t", "x", "y", *same, "_s.level as _level", "_s.node as _node"
    )
    at = ["_level", "_node", *same]
    counts = named.groupBy(*at).agg(F.expr("count(1) as _n"))
    full = counts.where(f"_n > {most} and _level > 0")
    # Below a full square all are open; a leaf is open, or the widest, and not full itself.
    wider = full.selectExpr("_level - 1 as _level", "_node as _wide", *same)
    step = FINER.bit_length() - 1
    tops = counts.where(f"_level = {depth} and (_n <= {most} or _level = 0)").select(*at)
    inner = counts.where(f"_level < {depth} and (_n <= {most} or _level = 0)").withColumn("_wide", F.expr(parent("_node", step)))
    inner = inner.join(wider, ["_level", "_wide", *same], "left_semi").select(*at)
    found = skew_join(named, tops.unionByName(inner), at, "inner", hot_rows=hot_rows, hot=hottest(counts, at, hot_rows))
    return found.groupBy(*at).agg(
        *(F.expr(f"{f}({c}) as {c}{i}") for i, f in ((0, "min"), (1, "max")) for c in ("x", "y")),
        F.expr("count(1) as n"), F.expr("collect_list(named_struct('t', t, 'x', x, 'y', y)) as ts"),
    )


def _least_d2(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    """Least squared distance between two boxes."""
    x, y = (f"greatest({b[i]} - {a[i + 2]}, {a[i]} - {b[i + 2]}, 0L)" for i in (0, 1))
    return f"({x} * {x} + {y} * {y})"


def _most_d2(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    """Greatest squared distance between two boxes."""
    x, y = (f"greatest({b[i + 2]} - {a[i]}, {a[i + 2]} - {b[i]})" for i in (0, 1))
    return f"({x} * {x} + {y} * {y})"


def _ranked(df: DataFrame, keep: list[str], k: int, reach: int, prefix: str, target_id: str) -> DataFrame:
    """The first ``k`` of the array ``_near`` as rows ``_pos`` and ``_hit``, one with nulls if there is none.

    Only distance, id and place in the list are compared; the rest may be of any type.
    """
    hits = (
        f"filter(transform(_near, (n, i) -> named_struct('d2', {FAR}, 'id', n.t.`{prefix}{target_id}`, 'i', i)), "
        f"h -> h.d2 <= {reach})"
    )
    best = f"filter(array(array_min({hits})), h -> h is not null)" if k == 1 else f"slice(array_sort({hits}), 1, {k})"
    return df.selectExpr(*keep, "_near", f"{best} as _best").selectExpr(
        *keep, "posexplode_outer(transform(_best, h -> named_struct('d2', h.d2, 't', _near[h.i].t))) as (_pos, _hit)"
    )


def _sparse(targets: DataFrame, radius: int, limit: int) -> bool:
    """Are the targets at most ``limit`` bytes, with no crowd in one cell of the widest grid?"""
    cells = targets.selectExpr(f"{cell_of('x', 'y', radius)} as c", f"cast({row_bytes(targets)} as double) as b")
    crowds = cells.groupBy("c").agg(F.expr("count(c) as n"), F.expr("sum(b) as b"))
    size, crowd = crowds.selectExpr("coalesce(sum(b), 0D)", "coalesce(max(n), 0L)").first()
    return size <= limit and crowd <= CROWD


def _each(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def _around(col: str, row: str) -> str:
    """Array of the 3 x 3 cells around one."""
    return f"array({', '.join(pack(f'{col} + {i}', f'{row} + {j}') for i in (-1, 0, 1) for j in (-1, 0, 1))})"


def _own(sides: list[int], x: str = "x", y: str = "y") -> str:
    """Array of the cells of each grid that hold a point."""
    cells = [f"named_struct('side', {s}L, 'cell', {cell_of(x, y, s)})" for s in dict.fromkeys(sides)]
    return f"array({', '.join(cells)})"


def _rich(targets: DataFrame, side: int, k: int, name: str, match: list[str]) -> DataFrame:
    """The cells of a grid that hold at least ``k`` targets, by the columns that must match."""
    keys = [name, *(f"{name}_{j}" for j in range(len(match)))]
    same = [f"`{c}` as {s}" for c, s in zip(match, keys[1:])]
    counts = targets.where("x is not null and y is not null").selectExpr(f"{cell_of('x', 'y', side)} as {name}", *same).groupBy(*keys).agg(F.expr("count(1) as n"))
    return counts.where(f"n >= {k}").select(*keys)


def _choose(values: list) -> str:
    """The value for the finest grid whose cell is rich, or else the last one."""
    *graded, other = values
    if not graded:
        return str(other)
    return "case " + " ".join(f"when _rich{i} is not null then {v}" for i, v in enumerate(graded)) + f" else {other} end"
