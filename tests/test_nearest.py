import random

import pytest

from helpers import plan, points
from tidemark.operators.nearest import candidates, nearest, target_leaves


def elevations(spark, rows):
    return spark.createDataFrame(
        [(i, x, y, 1000 + i) for i, x, y in rows], "bfe_id bigint, x bigint, y bigint, bfe_mm bigint"
    )


def brute(spots, targets, radius, k):
    rows = set()
    for i, (x, y) in enumerate(spots):
        reached = [] if x is None else sorted(
            (d2, t) for t, tx, ty in targets if (d2 := (x - tx) ** 2 + (y - ty) ** 2) <= radius * radius
        )[:k]
        rows |= {(i, n, t, d2) for n, (d2, t) in enumerate(reached, 1)} or {(i, None, None, None)}
    return rows


@pytest.mark.parametrize("strategy", ("broadcast", "shuffle"))
@pytest.mark.parametrize("k", (1, 3))
@pytest.mark.parametrize("radius", (1, 60, 400))
def test_equals_brute_force(spark, strategy, k, radius):
    rng = random.Random(radius + k)
    clustered = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(60)]
    wide = [(rng.randint(-1000, 1000), rng.randint(-1000, 1000)) for _ in range(60)]
    copies = [(40, 40)] * 30
    targets = [(i, x, y) for i, (x, y) in enumerate(clustered + wide + copies)]
    rng.shuffle(targets)
    spots = [(rng.randint(-50, 80), rng.randint(-50, 80)) for _ in range(150)]
    spots += [(rng.randint(-1500, 1500), rng.randint(-1500, 1500)) for _ in range(100)]
    spots += [(40, 40)] * 20 + [(40 + radius, 40), (None, 5)]
    found = nearest(points(spark, spots), elevations(spark, targets), radius, k, strategy=strategy, hot_rows=5)
    rows = [(r.building_id, r.near_rank, r.near_bfe_id, r.near_d2) for r in found.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(spots, targets, radius, k)
    for grids in (1, 4):
        other = nearest(points(spark, spots), elevations(spark, targets), radius, k, strategy=strategy, grids=grids)
        assert sorted(map(str, other.collect())) == sorted(map(str, found.collect()))


@pytest.mark.parametrize("strategy", ("broadcast", "shuffle"))
def test_ties_edge_of_reach_and_none(spark, strategy):
    targets = elevations(spark, [(9, 0, 0), (4, 20, 0), (5, 500, 0)])
    spots = points(spark, [(10, 0), (400, 0), (300, 0)])
    rows = {r.building_id: r for r in nearest(spots, targets, 100, strategy=strategy).collect()}
    assert rows[0].near_bfe_id == 4
    assert (rows[1].near_bfe_id, rows[1].near_d2, rows[1].near_bfe_mm) == (5, 10_000, 1005)
    assert rows[2].near_bfe_id is None and rows[2].near_rank is None
    assert list(rows[0].asDict()) == [
        "building_id", "x", "y", "near_bfe_id", "near_x", "near_y", "near_bfe_mm", "near_d2", "near_rank",
    ]


def test_plans(spark):
    targets, spots = elevations(spark, [(1, 0, 0)]), points(spark, [(1, 1)])
    kept = nearest(spots, targets, 100)
    moved = nearest(spots, targets, 100, broadcast_bytes=0)
    assert "SortMergeJoin [_fine" in plan(moved)
    assert "SortMergeJoin" not in plan(kept)
    for text in (plan(kept), plan(moved)):
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_empty_inputs(spark):
    targets, spots = elevations(spark, [(1, 0, 0)]), points(spark, [(1, 1)])
    for strategy in ("auto", "broadcast", "shuffle"):
        assert nearest(spots.limit(0), targets, 9, strategy=strategy).count() == 0
        assert nearest(spots, targets.limit(0), 9, strategy=strategy).first().near_bfe_id is None


def test_crowded_targets_are_not_all_ranked(spark):
    rng = random.Random(9)
    targets = sorted({(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(700)})
    spots = [(20_000 + rng.randint(0, 700), rng.randint(0, 700)) for _ in range(4_000)]
    near = candidates(points(spark, spots), elevations(spark, [(i, *t) for i, t in enumerate(targets)]), 50_000, 1, "'id', bfe_id")
    found = near.selectExpr("x", "y", "size(_near) as n", "array_min(transform(_near, t -> (x - t.x) * (x - t.x) + (y - t.y) * (y - t.y))) as d2")
    rows = found.collect()
    assert len(rows) == len(set(spots)) and sum(r.n for r in rows) < len(set(spots)) * len(targets) / 20
    least = {s: min((s[0] - x) ** 2 + (s[1] - y) ** 2 for x, y in targets) for s in set(spots)}
    assert {(r.x, r.y): r.d2 for r in rows} == least


@pytest.mark.parametrize("most", (1, 4))
def test_leaves_hold_few_targets_each_once(spark, most):
    rng = random.Random(10)
    spots = {(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(200)} | {(rng.randint(-5000, 5000), -7) for _ in range(80)}
    rows = elevations(spark, [(i, *t) for i, t in enumerate(sorted(spots))]).selectExpr("struct(bfe_id) as t", "x", "y")
    leaves = target_leaves(rows, 2, 4, most, [], hot_rows=5).collect()
    assert sorted((t.x, t.y) for r in leaves for t in r.ts) == sorted(spots)
    for r in leaves:
        assert r.n == len(r.ts) and (r.n <= most or (r.x0 // 2, r.y0 // 2) == (r.x1 // 2, r.y1 // 2))
        assert (r.x0, r.y0, r.x1, r.y1) == (
            min(t.x for t in r.ts), min(t.y for t in r.ts), max(t.x for t in r.ts), max(t.y for t in r.ts)
        )


def test_auto_shuffles_where_targets_crowd(spark):
    spots, targets = points(spark, [(0, 0)]), elevations(spark, [(i, i % 20, i // 20) for i in range(300)])
    assert "_leaf" in plan(nearest(spots, targets, 50)) and "_leaf" not in plan(nearest(spots, targets.limit(100), 50))


def test_auto_broadcasts_targets_that_are_listed_once_for_each_grid(spark):
    spots, targets = points(spark, [(0, 0)]), elevations(spark, [(i, i * 40, i * 7) for i in range(200)])
    assert "_leaf" not in plan(nearest(spots, targets, 50, broadcast_bytes=60_000))
    assert "_leaf" in plan(nearest(spots, targets, 50, broadcast_bytes=20_000))


def joined_rows(node):
    """The most rows that a sort-merge join of an executed plan made."""
    name, below = node.nodeName(), [node.children().apply(i) for i in range(node.children().size())]
    if name == "AdaptiveSparkPlan":
        below = [node.executedPlan()]
    elif "QueryStage" in name:
        below = [node.plan()]
    own = node.metrics().apply("numOutputRows").value() if name == "SortMergeJoin" else 0
    return max([own, *map(joined_rows, below)])


def test_lists_of_targets_do_not_grow_with_points(spark):
    rng = random.Random(11)
    targets = [(i, rng.randint(0, 40_000), rng.randint(0, 40_000)) for i in range(40)]
    spots = sorted({(rng.randint(0, 40_000), rng.randint(0, 40_000)) for _ in range(3_000)})
    found = nearest(points(spark, spots), elevations(spark, targets), 20_000, 3, strategy="shuffle")
    rows = {(r.building_id, r.near_rank, r.near_bfe_id, r.near_d2) for r in found.collect()}
    assert rows == brute(spots, targets, 20_000, 3)
    assert joined_rows(found._jdf.queryExecution().executedPlan()) <= 3 * len(spots)


def shuffled_bytes(node):
    """What the exchanges of an executed plan have written; one that is used again counts once."""
    name, below = node.nodeName(), [node.children().apply(i) for i in range(node.children().size())]
    if name == "AdaptiveSparkPlan":
        below = [node.executedPlan()]
    elif "QueryStage" in name:
        below = [node.plan()]
    own = node.metrics().apply("shuffleBytesWritten").value() if name == "Exchange" else 0
    return own + sum(map(shuffled_bytes, below))


def test_clustered_targets_are_not_sent_again_for_more_points(spark):
    rng = random.Random(12)
    centres = [(100_000 + 200_000 * i, 100_000 + 200_000 * j) for i in (0, 1) for j in (0, 1)]
    targets = [(c, x + rng.randint(0, 700), y + rng.randint(0, 900)) for c, (x, y) in enumerate(centres * 40)]
    many = sorted({(rng.randint(0, 400_000), rng.randint(0, 400_000)) for _ in range(8_000)})
    rng.shuffle(many)
    sent = []
    for spots in (many[:2_000], many):
        found = nearest(points(spark, spots), elevations(spark, targets), 50_000, strategy="shuffle")
        rows = {(r.building_id, r.near_rank, r.near_bfe_id, r.near_d2) for r in found.collect()}
        assert rows == brute(spots, targets, 50_000, 1)
        sent.append(shuffled_bytes(found._jdf.queryExecution().executedPlan()))
    # A place and its answer are sent a few times; lists of targets would take hundreds of bytes for each.
    assert sent[1] - sent[0] < 150 * (len(many) - 2_000)
