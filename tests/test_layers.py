import random
import statistics
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import plan, points, polygons, square
from tidemark.functions.cells import with_cell, with_parent
from tidemark.operators.building_layer import building_layer
from tidemark.operators.check import allowed, check, foreign_key, in_range, not_null, required, unique
from tidemark.operators.clean import clean, kept_rows
from tidemark.operators.panels import panel_as_of
from tidemark.operators.prevalence import prevalence
from tidemark.operators.rings import rings_from_vertices
from tidemark.operators.skew import hot_keys, skew_join
from tidemark.operators import zone_cells
from tidemark.operators.zone_cells import cell_summary, coverage
from tidemark.sources.geojson import polygons_from_geojson, read_geojson_lines
from tidemark.sources.layers import LayerRefused, layers, publish, read_layer


def test_cells_and_parents_with_negative_coordinates(spark):
    df = points(spark, [(-1, 0), (-80, 79), (79, -80), (0, 0)])
    for k in (0, 1, 3):
        both = with_parent(with_cell(df, size=10), k)
        wide = with_cell(both, size=10 * 2**k, name="wide")
        assert wide.where("parent_id <> wide").count() == 0
    assert with_cell(points(spark, [(None, 1)])).first().cell_id is None
    with pytest.raises(ValueError):
        with_cell(df, size=0)


def test_rings_follow_the_sequence(spark):
    rows = [(1, 0, 0, 3, 5, 5), (1, 0, 0, 1, 0, 0), (1, 0, 0, 2, 5, 0), (1, 1, 0, 1, 9, 9)]
    df = spark.createDataFrame(rows, "feature_id long, part int, ring int, seq int, x long, y long")
    out = {(r.feature_id, r.part): r for r in rings_from_vertices(df).collect()}
    assert [tuple(v) for v in out[1, 0].verts] == [(0, 0), (5, 0), (5, 5)]
    assert (out[1, 0].x0, out[1, 0].y0, out[1, 0].x1, out[1, 0].y1) == (0, 0, 5, 5)
    assert len(out[1, 1].verts) == 1


def test_clean_accounts_for_every_row(spark):
    rows = [
        (1, 5, datetime(2020, 1, 1), "old"), (1, 6, datetime(2021, 1, 1), "new"), (None, 1, None, "nokey"),
        (2, None, datetime(2020, 1, 1), "nocoord"), (3, 1, None, "undated"), (3, 2, datetime(1999, 1, 1), "dated"),
        *[(4, 7, datetime(2020, 1, 1), "copy")] * 5,
    ]
    df = spark.createDataFrame(rows, "id int, x int, at timestamp, note string")
    kept, rejected = clean(df, "id", ["at"], required=["x"], hot_rows=2)
    assert {r.id: r.note for r in kept.collect()} == {1: "new", 3: "dated", 4: "copy"}
    assert {(r.note, r.reason, r.copies) for r in rejected.collect()} == {
        ("old", "superseded", 1), ("nokey", "null key", 1), ("nocoord", "null coordinate", 1),
        ("undated", "superseded", 1), ("copy", "superseded", 4),
    }
    assert kept.count() + rejected.agg(F.sum("copies")).first()[0] == len(rows)
    none = clean(df.limit(0), "id", ["at"])
    assert none[0].count() == 0 and none[1].count() == 0 and none[0].schema == df.schema


def test_clean_rings(spark):
    line = [(0, 0), (5, 5), (0, 0)]
    zones = polygons(spark, {1: [square(0, 0, 5)], 2: [line]})
    gap = spark.createDataFrame([(3, 0, 0, [(0, 0), (None, 1), (2, 2)], 0, 0, 2, 2)], zones.schema)
    kept, rejected = clean(zones.union(gap), ["feature_id", "part", "ring"], ["x0"], verts="verts")
    assert [r.feature_id for r in kept.collect()] == [1]
    assert {(r.feature_id, r.reason) for r in rejected.collect()} == {(2, "degenerate ring"), (3, "degenerate ring")}


@pytest.mark.parametrize("how", ("inner", "left", "left_semi", "left_anti"))
def test_skew_join_equals_plain_join(spark, how):
    left = spark.range(300).selectExpr("id", "if(id % 3 = 0, 1, if(id % 50 = 1, null, id % 40)) as k", "id % 7 as v")
    right = spark.range(60).selectExpr("id % 30 as k", "id as w")
    hot = {r.k: r._parts for r in hot_keys(left, ["k"], 20).collect()}
    assert hot == {1: 6}
    mine = skew_join(left, right, ["k"], how, "(v + w) % 2 = 0", hot_rows=20)
    a, b = left.alias("a"), right.alias("b")
    theirs = a.join(b, F.expr("a.k = b.k and (v + w) % 2 = 0"), how)
    columns = ["a.id", "w"] if how in ("inner", "left") else ["a.id"]
    mine = mine.select(*(c.split(".")[-1] for c in columns))
    assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, theirs.select(*columns).collect()), key=str)


def test_prevalence_counts_weights_and_levels(spark):
    rows = [("p", 1, 10), ("p", 1, 20), ("p", 2, 30), ("q", 1, 0), (None, 2, 5)]
    df = spark.createDataFrame(rows, "panel string, zone int, w long")
    flat = {(r.panel, r.zone): (r.amount, r.total, r.share_ppm) for r in prevalence(df, ["panel"], "zone").collect()}
    assert flat == {
        ("p", 1): (2, 3, 666_666), ("p", 2): (1, 3, 333_333), ("q", 1): (1, 1, 1_000_000), (None, 2): (1, 1, 1_000_000),
    }
    weighted = {(r.panel, r.zone): r.share_ppm for r in prevalence(df, ["panel"], "zone", "w").collect()}
    assert weighted == {("p", 1): 500_000, ("p", 2): 500_000, ("q", 1): None, (None, 2): 1_000_000}
    rolled = prevalence(df, ["panel"], "zone", levels="rollup").collect()
    assert {(r.panel, r.amount, r.total) for r in rolled if r.level == 1} == {("p", 3, 3), ("q", 1, 1), (None, 1, 1)}
    assert [(r.amount, r.total) for r in rolled if r.level == 3] == [(5, 5)]
    cube = prevalence(df, ["panel"], "zone", levels="cube").collect()
    assert {(r.zone, r.amount, r.total) for r in cube if r.level == 2} == {(1, 3, 5), (2, 2, 5)}
    assert {(r.zone, r.share_ppm) for r in prevalence(df, [], "zone").collect()} == {(1, 600_000), (2, 400_000)}
    with pytest.raises(ValueError):
        prevalence(df, ["panel"], "zone", levels="other")


def panels(spark):
    rows = [(1, 1, 1, date(2010, 1, 1)), (2, 1, 2, date(2015, 1, 1)), (3, 1, 3, date(2015, 1, 1)), (4, 2, 1, date(2012, 1, 1))]
    shapes = {1: [square(0, 0, 10)], 2: [square(0, 0, 10)], 3: [square(0, 0, 6)], 4: [square(10, 0, 10)]}
    about = spark.createDataFrame(rows, "feature_id long, panel_id long, version int, effective_date date")
    return polygons(spark, shapes).join(about, "feature_id")


def test_panel_as_of(spark):
    pts = points(spark, [(5, 5), (8, 8), (15, 5)])

    def on(day):
        found = panel_as_of(pts, panels(spark), day, 10, strategy="broadcast")
        return {r.building_id: (r.panel_id, r.version) for r in found.collect()}

    assert on(date(2009, 1, 1)) == {0: (None, None), 1: (None, None), 2: (None, None)}
    assert on(date(2014, 12, 31)) == {0: (1, 1), 1: (1, 1), 2: (2, 1)}
    assert on(date(2015, 1, 1)) == {0: (1, 3), 1: (None, None), 2: (2, 1)}
    dated = pts.withColumn("day", F.expr("date_add(date'2009-06-01', cast(building_id * 1000 as int))"))
    for strategy in ("broadcast", "shuffle"):
        found = panel_as_of(dated, panels(spark), "day", 10, strategy=strategy)
        assert {r.building_id: r.version for r in found.collect()} == {0: None, 1: 1, 2: 1}


@pytest.mark.parametrize("kind", ("bigint", "double", "decimal(20,3)"))
def test_median_ranks_only_the_middle(spark, monkeypatch, kind):
    monkeypatch.setattr(zone_cells, "RANKED_WHOLE", 20)
    rng = random.Random(3)
    spread = [rng.randint(-(10**9), 10**9) for _ in range(3_001)]
    groups = {1: spread, 2: spread[:-1], 3: [5] * 2_000 + [9] * 2_000, 4: [7], 5: [1, 2], 6: [0] * 999 + spread[:999], None: []}
    rows = [(c, rng.choice(("a", None)), v) for c, vs in groups.items() for v in vs] + [(None, "a", 1), (1, "a", None)]
    df = spark.createDataFrame(rows, "cell bigint, datum string, v bigint").selectExpr("cell", "datum", f"cast(v as {kind}) as v")
    got = {(r.cell_id, r.datum): r for r in cell_summary(df, "cell", "v", by=("datum",), hot_rows=100).collect()}
    want = {}
    for c, d, v in rows:
        if c is not None and v is not None:
            want.setdefault((c, d), []).append(v)
    assert got.keys() == want.keys()
    for key, values in want.items():
        r = got[key]
        assert (r.n_values, r.min_value, r.max_value) == (len(values), min(values), max(values))
        assert float(r.median_value) == statistics.median(values)
    assert cell_summary(df.limit(0), "cell", "v").collect() == []


def test_cell_summary_and_coverage(spark):
    rows = [(1, 5), (1, 1), (1, 2), (1, 8), (2, 7), (2, 7), (2, 9), (3, None), (None, 4)]
    df = spark.createDataFrame(rows, "cell long, v long")
    exact = {r.cell_id: tuple(r)[1:] for r in cell_summary(df, "cell", "v").collect()}
    assert exact == {1: (4, 1, 8, 4.0, 3.5), 2: (3, 7, 9, 23 / 3, 7.0)}
    rough = {r.cell_id: r.median_value for r in cell_summary(df, "cell", "v", approximate=True).collect()}
    assert rough == {1: 2.0, 2: 7.0}
    cells = coverage(points(spark, [(1, 1), (2, 2), (11, 1), (None, 1)]), 10)
    assert sorted(r["rows"] for r in cells.collect()) == [1, 2]


def test_building_layer_needs_the_same_datum(spark):
    buildings = spark.createDataFrame(
        [(1, 500, "A"), (2, 500, "B"), (3, 500, None)], "building_id long, first_floor_mm long, datum string"
    )
    near = spark.createDataFrame(
        [(i, 9, 200, "A", 1) for i in (1, 2, 3)],
        "building_id long, near_bfe_id long, near_bfe_mm long, near_datum string, near_d2 long",
    )
    wide = building_layer(buildings, nearest=near)
    assert {r.building_id: r.above_mm for r in wide.collect()} == {1: 300, 2: None, 3: None}


RULED = "id long, code string, height long"


def test_check_finds_each_fault_once(spark):
    df = spark.createDataFrame([(1, "A", 5), (1, "B", 500), (2, None, 7), (7, "Z", None)], RULED)
    known = spark.createDataFrame([(1,), (2,)], "key long")
    rules = [
        required("id", "bigint"), required("height", "int"), required("gone", "string"), not_null("code"),
        not_null("id"), in_range("height", 0, 100), allowed("code", ["A", "B", "it's"]), unique("id"),
        unique("id", "code"), foreign_key(["id"], known, ["key"]),
    ]
    rows = {(r.rule, r.columns): (r.violations, r.sample) for r in check(df, rules, "id").collect()}
    assert rows == {
        ("required", "height"): (1, "bigint"), ("required", "gone"): (1, "missing"), ("not_null", "code"): (1, "2"),
        ("range", "height"): (1, "1"), ("allowed", "code"): (1, "7"), ("unique", "id"): (1, "1"),
        ("foreign_key", "id"): (1, "7"),
    }
    assert check(df.limit(0), [not_null("id"), unique("id")], "id").count() == 0
    assert [tuple(r) for r in check(df, [not_null("lost")], "id").collect()] == [("required", "lost", 1, "missing")]


def test_publish_and_read_back(spark, tmp_path):
    root = str(tmp_path)
    assert layers(spark, root).count() == 0
    df = spark.createDataFrame([(i, f"0{i % 3}", i * 10) for i in range(50)], RULED)
    rules = [required("id", "bigint"), not_null("code"), unique("id")]
    publish(df, root, "heights", "main", "id", rules, ["code"], contract="7.1")
    publish(df.limit(3), root, "helper", "dependent", "id")
    back = read_layer(spark, root, "heights")
    assert back.columns == df.columns and sorted(back.collect()) == sorted(df.collect())
    part = read_layer(spark, root, "heights", ["id"], "code = '01' and height > 100")
    assert sorted(r.id for r in part.collect()) == [i for i in range(50) if i % 3 == 1 and i * 10 > 100]
    text = plan(part)
    assert "PartitionFilters: [isnotnull(code" in text and "GreaterThan(height,100)" in text
    assert "ReadSchema: struct<id:bigint,height:bigint>" in text
    entry = layers(spark, root, "main").collect()
    assert [(r.name, r.contract, r.rows) for r in entry] == [("heights", "7.1", 50)]

    with pytest.raises(LayerRefused) as refused:
        publish(df.union(df.limit(1)), root, "heights", "main", "id", rules, ["code"])
    assert [r.rule for r in refused.value.violations] == ["unique"]
    assert read_layer(spark, root, "heights").count() == 50
    publish(df.where("id < 9"), root, "heights", "main", "id", rules)
    assert read_layer(spark, root, "heights").count() == 9
    assert layers(spark, root).count() == 2
    with pytest.raises(LookupError):
        read_layer(spark, root, "other")
    with pytest.raises(ValueError):
        publish(df, root, "manifest", "main", "id")


def test_geojson_lines(spark, tmp_path):
    good = '{"type":"Feature","id":%d,"properties":{"z":"AE","n":3},"geometry":{"type":"%s","coordinates":%s}}'
    ring = "[[-82.1234565,27.5],[-82.0,27.5],[-82.0,28.0000001],[-82.1234565,27.5]]"
    hole = "[[-82.05,27.6],[-82.04,27.6],[-82.04,27.7]]"
    lines = [
        good % (7, "Polygon", f"[{ring},{hole}]"), good % (8, "MultiPolygon", f"[[{ring}],[{hole}]]"), "",
        good % (9, "Point", "[1,2]"), good % (10, "Polygon", "[]"), good % (11, "Polygon", "[[[1],[2,3],[4,5]]]"),
        '{"type":"Feature","id":"x","geometry":null}', "{oops", '{"type":"FeatureCollection","features":[]}',
    ]
    (tmp_path / "a.geojsonl").write_text("\n".join(lines))
    kept, rejected = read_geojson_lines(spark, str(tmp_path / "a.geojsonl"))
    rows = {(r.feature_id, r.part, r.ring): r for r in kept.collect()}
    assert set(rows) == {(7, 0, 0), (7, 0, 1), (8, 0, 0), (8, 1, 0)}
    outer = rows[7, 0, 0]
    assert [tuple(v) for v in outer.verts] == [(-82123457, 27500000), (-82000000, 27500000), (-82000000, 28000000)]
    assert (outer.x0, outer.y1, outer.properties["z"], outer.properties["n"]) == (-82123457, 28000000, "AE", "3")
    assert len(rows[8, 1, 0].verts) == 3
    reasons = sorted(r.reason for r in rejected.collect())
    assert reasons == [
        "bad coordinates", "bad coordinates", "malformed line", "no whole-number id", "not a feature", "not a polygon",
    ]
    again, _ = polygons_from_geojson(spark.createDataFrame([(lines[0],)], "value string"), "$.properties.n", 10)
    assert {r.feature_id for r in again.collect()} == {3}
    assert float(Decimal(again.first().x1)) == -820


def test_keys_hot_on_both_sides_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        n = 100_000
        left = spark.range(n).selectExpr("if(id < 10, cast(null as bigint), if(id < 100, id, 7L)) as k", "id as a")
        right = spark.range(n).selectExpr("if(id < 10, id, 7L) as k", "id as b", "map(1, id) as m")
        joined = skew_join(left, right, ["k"], "inner", "a = b", hot_rows=20_000, both=True)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert joined.columns == ["k", "a", "b", "m"] and sum(r.n for r in parts) == n - 100
        assert max(r.n for r in parts) < n / 3 and len(parts) > 8
        pairs = skew_join(left.where("a < 300"), right.where("b < 300"), ["k"], "inner", hot_rows=20, both=True)
        want = left.where("a < 300").join(right.where("b < 300"), "k").select("k", "a", "b")
        assert sorted(map(tuple, pairs.select("k", "a", "b").collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(ValueError):
        skew_join(left, right, ["k"], "left", both=True)


def test_zone_cells_keep_attributes_without_a_join(spark):
    zones = polygons(spark, {i: [square(15 * i, 7 * i, 40)] for i in range(12)}).selectExpr("*", "cast(feature_id % 3 as int) as severity")
    kept = zone_cells.zone_cells(zones, 20, 4, keep=("severity",))
    joined = zone_cells.zone_cells(zones, 20, 4).join(zones.select("feature_id", "severity"), "feature_id")
    columns = ["cell_id", "feature_id", "samples", "share_ppm", "severity"]
    assert sorted(map(tuple, kept.select(columns).collect())) == sorted(map(tuple, joined.select(columns).collect()))
    assert "Join" not in plan(kept) and kept.columns == columns


def test_rows_that_are_kept_need_no_pass_of_their_own(spark):
    rows = spark.createDataFrame([(1, 5, 2), (1, 6, 2), (2, None, 3), (None, 7, 4)], "k bigint, x bigint, v bigint")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("kept", "kept")
    kept = kept_rows(rows, "k", ["x"], required=["x"])
    assert not jobs.getJobIdsForGroup("kept")
    spark.sparkContext.setJobGroup("others", "others")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, clean(rows, "k", ["x"], required=["x"])[0].collect())) == [(1, 6, 2)]
