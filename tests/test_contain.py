import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpers import inside, plan, points, polygons, square
from tidemark.operators.contain import points_in_polygons
from tidemark.operators.cover import cover, layered_pieces, median_side, pieces, pieces_size, wider_levels, widest
from tidemark.operators.crowd import STEPS, crowded_cells, crowded_grids
from tidemark.operators.pick import pick_one
from tidemark.operators.zone_cells import zone_cells

STRATEGIES = ("broadcast", "shuffle")


def random_features(seed):
    """Rings of all sorts: tiny, wide, self-crossing, with level edges, on grid lines."""
    rng = random.Random(seed)
    features = {}
    for fid in range(40):
        rings = []
        for _ in range(rng.choice((1, 1, 1, 2, 3))):
            reach = rng.choice((2, 8, 30, 90))
            cx, cy = rng.randint(-60, 60), rng.randint(-60, 60)
            ring = [
                (cx + rng.randint(-reach, reach), cy + rng.randint(-reach, reach)) for _ in range(rng.randint(3, 9))
            ]
            if rng.random() < 0.5:
                ring = [(x // 5 * 5, y // 5 * 5) for x, y in ring]
            if rng.random() < 0.3:
                ring.append(ring[0])
            rings.append(ring)
        features[fid] = rings
    features[100] = [square(-50, -50, 100), square(-20, -20, 40)]
    features[101] = [[(-90, 7), (90, 7), (90, 8), (-90, 8)]]
    features[102] = [[(x, 3 * (x % 2)) for x in range(-40, 40)] + [(40, 20), (-40, 20)]]
    return features


@pytest.mark.parametrize("size", (1, 5, 7, 40, 1000))
@pytest.mark.parametrize("strategy", (*STRATEGIES, "auto"))
def test_equals_brute_force_whatever_the_size(spark, size, strategy):
    features = random_features(size)
    rng = random.Random(1)
    spots = [(rng.randint(-150, 150), rng.randint(-150, 150)) for _ in range(400)]
    spots += [(x, y) for x in range(-20, 21, 5) for y in range(-20, 21, 5)]
    found = points_in_polygons(points(spark, spots), polygons(spark, features), size, strategy=strategy, hot_rows=3, crowd=2)
    expected = {(i, fid) for i, (x, y) in enumerate(spots) for fid, rings in features.items() if inside(x, y, rings)}
    rows = [(r.building_id, r.feature_id) for r in found.collect()]
    assert len(rows) == len(expected)
    assert set(rows) == expected


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_join_types(spark, strategy):
    pts = points(spark, [(5, 5), (50, 50), (15, 15), (None, 3)])
    zones = polygons(spark, {1: [square(0, 0, 20)], 2: [square(10, 10, 20)]}).withColumn("code", F.lit("A"))

    def ids(how):
        return sorted(r[0] for r in points_in_polygons(pts, zones, 10, how, strategy=strategy).collect())

    assert ids("inner") == [0, 2, 2]
    assert ids("semi") == [0, 2]
    assert ids("anti") == [1, 3]
    assert ids("left") == [0, 1, 2, 2, 3]
    left = points_in_polygons(pts, zones, 10, "left", strategy=strategy)
    assert left.columns == ["building_id", "x", "y", "feature_id", "code"]
    assert {r.code for r in left.where("building_id in (1, 3)").collect()} == {None}


@pytest.mark.parametrize("size", (3, 10, 20))
def test_shared_borders_give_one_hit(spark, size):
    tiles = {i * 10 + j: [square(i * 10, j * 10, 10)] for i in range(4) for j in range(4)}
    reverse = {k: [list(reversed(r[0]))] for k, r in tiles.items()}
    spots = [(x, y) for x in range(0, 40) for y in range(0, 40)]
    for shapes in (tiles, reverse):
        found = points_in_polygons(points(spark, spots), polygons(spark, shapes), size, strategy="broadcast")
        counts = found.groupBy("building_id").count()
        assert counts.count() == len(spots) and counts.where("count <> 1").count() == 0


def test_hole_second_part_and_empty_middle(spark):
    zones = polygons(spark, {1: [square(0, 0, 100), square(40, 40, 20), square(200, 0, 10)]})
    spots = [(50, 50), (205, 5), (20, 20), (99, 99), (100, 50)]
    for size in (4, 10, 64):
        found = points_in_polygons(points(spark, spots), zones, size, strategy="broadcast")
        assert sorted(r[0] for r in found.collect()) == [1, 2, 3]


def test_empty_inputs_keep_their_schema(spark):
    pts, zones = points(spark, [(1, 1)]), polygons(spark, {1: [square(0, 0, 5)]})
    for strategy in (*STRATEGIES, "auto"):
        assert points_in_polygons(pts.limit(0), zones, 10, strategy=strategy).collect() == []
        none = points_in_polygons(pts, zones.limit(0), 10, "left", strategy=strategy)
        assert none.columns == ["building_id", "x", "y", "feature_id"] and none.count() == 1


def test_plans_are_equi_joins_and_large_sides_are_not_broadcast(spark):
    pts, zones = points(spark, [(1, 1)] * 50), polygons(spark, {1: [square(0, 0, 5)]})
    small = plan(points_in_polygons(pts, zones, 10))
    large = plan(points_in_polygons(pts, zones, 10, broadcast_bytes=10))
    assert "BroadcastHashJoin [cell_id" in small
    assert "SortMergeJoin [cell_id" in large
    for text in (small, large):
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_size_bound_holds(spark):
    zones = polygons(spark, random_features(3))
    for size in (5, 40):
        cut = pieces(zones, size).selectExpr("sum(64 * coalesce(size(edges), 0) + 160)").first()[0]
        assert cut <= pieces_size(zones, size)[1]


def test_names_must_be_free(spark):
    pts = points(spark, [(1, 1)]).withColumn("feature_id", F.lit(1))
    with pytest.raises(ValueError):
        points_in_polygons(pts, polygons(spark, {1: [square(0, 0, 5)]}), 10)
    with pytest.raises(ValueError):
        points_in_polygons(points(spark, [(1, 1)]), polygons(spark, {1: [square(0, 0, 5)]}), 10, how="outer")


def test_cover_lists_the_cells_of_the_box(spark):
    zones = polygons(spark, {1: [square(-5, 0, 10)], 2: [square(30, 30, 3)]})
    cells = cover(zones, 10).groupBy("feature_id").count().collect()
    assert {r.feature_id: r["count"] for r in cells} == {1: 4, 2: 1}


@pytest.mark.parametrize("sub", (1, 4))
def test_zone_cells_equal_brute_force(spark, sub):
    features = random_features(9)
    size, step = 20, 20 // sub
    expected = {}
    for fid, rings in features.items():
        for c in range(-200 // step, 200 // step):
            for r in range(-200 // step, 200 // step):
                if inside(c * step + step // 2, r * step + step // 2, rings):
                    at = (c // sub, r // sub, fid)
                    expected[at] = expected.get(at, 0) + 1
    rows = zone_cells(polygons(spark, features), size, sub).selectExpr(
        "shiftright(cell_id, 31) - 1073741824 as c", "(cell_id & 2147483647) - 1073741824 as r", "feature_id",
        "samples", "share_ppm",
    ).collect()
    assert {(r.c, r.r, r.feature_id): r.samples for r in rows} == expected
    assert all(r.share_ppm == r.samples * 1_000_000 // (sub * sub) for r in rows)


def test_zone_cells_need_a_whole_step(spark):
    with pytest.raises(ValueError):
        zone_cells(polygons(spark, {1: [square(0, 0, 5)]}), 10, 3)


def test_small_polygon_without_a_centre_has_no_cell(spark):
    assert zone_cells(polygons(spark, {1: [square(1, 1, 2)]}), 10, 1).count() == 0


def test_best_zone_ties_go_to_the_lower_id(spark):
    hits = spark.createDataFrame([(1, 7, 2), (1, 3, 2), (1, 5, 1)], "building_id int, zone_id int, severity int")
    best = pick_one(hits, "building_id", [F.desc("severity"), F.asc("zone_id")])
    assert [tuple(r) for r in best.collect()] == [(1, 3, 2)]
    assert "WindowGroupLimit" in plan(best)


def test_crowded_cell_is_cut_finer(spark):
    tiny = {i: [square(i % 40 * 25, i // 40 * 25, 20)] for i in range(1600)}
    tiny[5000] = [square(-500, -500, 3000)]
    spots = [(x, y) for x in range(3, 1000, 50) for y in range(3, 1000, 40)]
    expected = {(i, f) for i, (x, y) in enumerate(spots) for f, r in tiny.items() if inside(x, y, r)}
    assert [r[0] for r in crowded_cells(polygons(spark, tiny), 1000, 100).collect()] == [(2**30) * 2**31 + 2**30]
    for strategy in ("shuffle", "auto"):
        found = points_in_polygons(points(spark, spots), polygons(spark, tiny), 1000, strategy=strategy, crowd=100)
        rows = [(r.building_id, r.feature_id) for r in found.collect()]
        assert len(rows) == len(expected) and set(rows) == expected


def test_crowds_within_crowds(spark):
    """Hundreds of polygons in one square of a square, some long edges, and polygons that hold them all."""
    rng = random.Random(22)
    tiny = {i: [square(rng.randint(3, 40), rng.randint(3, 40), rng.randint(1, 3))] for i in range(500)}
    tiny |= {600 + i: [[(0, i), (900, 37 * i % 50), (5, 48 - i)]] for i in range(12)}
    tiny |= {700: [square(-5000, -5000, 9000)], 701: [square(-3, -3, 90), square(8, 8, 20)], 702: [square(900, 900, 80)]}
    zones = polygons(spark, tiny)
    grids = crowded_grids(zones, 1000, 60)
    assert [s for s, _ in grids][:2] == [1000, 100] and len(grids) >= 3
    sides = [s // next(t for t in STEPS if s % t == 0) for s, _ in grids][::-1] + [1000]
    cuts = [c.selectExpr("cell_id", f"{side} as side", "size(edges) as n") for side, c in zip(sides, layered_pieces(zones, sides, cut=dict(grids)))]
    cells = reduce(DataFrame.unionByName, cuts).groupBy("side", "cell_id").agg(F.expr("sum(coalesce(n, 0)) as n"))
    assert {r.side for r in cells.where("n > 2 * 60").select("side").distinct().collect()} <= {1}
    spots = [(x, y) for x in range(-1, 45) for y in range(-1, 45)] + [(rng.randint(-50, 1100), rng.randint(-50, 1100)) for _ in range(300)]
    expected = sorted((i, f) for i, (x, y) in enumerate(spots) for f, r in tiny.items() if inside(x, y, r))
    found = points_in_polygons(points(spark, spots), zones, 1000, strategy="shuffle", crowd=60)
    assert sorted((r.building_id, r.feature_id) for r in found.collect()) == expected


def test_rows_of_a_large_polygon_grow_with_its_border(spark):
    rows = {}
    for side in (500, 2_000):
        ring = [(3, 3), (side * 10, 7), (side * 10 - 5, side * 10), (side * 5, side * 4), (1, side * 10 - 9)]
        zones = polygons(spark, {1: [ring, square(side * 2, side * 2, side)]})
        levels = wider_levels(widest(zones), 10)
        assert levels == (2 if side == 500 else 3)
        rows[side] = sum(cut.count() for cut in layered_pieces(zones, [10 * 8**i for i in range(levels + 1)]))
    assert rows[2_000] < 5 * rows[500] and rows[2_000] < 150_000 < 2_000**2 / 20


@pytest.mark.parametrize("strategy", ("broadcast", "shuffle", "auto"))
def test_large_and_small_polygons_on_several_grids(spark, strategy):
    rng = random.Random(21)
    features = {
        1: [[(-2000, -2000), (2500, -1900), (2400, 2600), (100, 300), (-1900, 2400)], square(-900, -900, 777)],
        2: [square(-1000, -1000, 640)], 3: [square(5, 5, 3)], 4: [square(-4000, 3000, 500)],
        5: [square(0, 0, 90), square(-1200, -1200, 2000)],
    }
    spots = [(rng.randint(-2300, 2700), rng.randint(-2300, 3700)) for _ in range(700)] + [(None, 1)]
    spots += [(x, y) for x in (-2000, -1280, -640, 0, 640) for y in (-1000, -360, 0, 1640)]
    hits = {i: {f for f, r in features.items() if inside(x, y, r)} if x is not None else set() for i, (x, y) in enumerate(spots)}
    pts, zones = points(spark, spots), polygons(spark, features).withColumn("name", F.expr("concat('z', feature_id)"))
    run = lambda how: points_in_polygons(pts, zones, 10, how, strategy=strategy, hot_rows=50)
    inner = [(r.building_id, r.feature_id, r.name) for r in run("inner").collect()]
    assert sorted(inner) == sorted((i, f, f"z{f}") for i, fs in hits.items() for f in fs)
    left = [(r.building_id, r.feature_id) for r in run("left").collect()]
    assert sorted(left, key=str) == sorted(((i, f) for i, fs in hits.items() for f in fs or {None}), key=str)
    assert sorted(r.building_id for r in run("semi").collect()) == [i for i, fs in hits.items() if fs]
    assert sorted(r.building_id for r in run("anti").collect()) == [i for i, fs in hits.items() if not fs]


def test_median_side(spark):
    zones = polygons(spark, {1: [square(0, 0, 5)], 2: [square(0, 0, 9)], 3: [[(0, 0), (50, 0), (0, 70)]]})
    assert median_side(zones) == 9 and median_side(zones.limit(0)) == 1
