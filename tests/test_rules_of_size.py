"""Results and plans that must not depend on sizes, nulls, repeated keys or unusual values."""

import datetime
import random

import pytest
from helpers import plan, points, polygons, square

from tidemark.operators.check import allowed, check, in_range
from tidemark.operators.clean import clean
from tidemark.operators.contain import points_in_polygons
from tidemark.operators.nearest import nearest
from tidemark.operators.panels import panel_as_of
from tidemark.operators.prevalence import prevalence
from tidemark.operators.skew import hot_keys, skew_join
from tidemark.sources.geojson import polygons_from_geojson
from tidemark.sources.layers import publish


def test_nearest_answers_every_row_in_both_strategies(spark):
    spots = spark.createDataFrame(
        [(1, 0, 0), (1, 0, 0), (1, 9, 9), (None, 0, 0), (None, 500, 500), (None, None, 3)], "building_id bigint, x bigint, y bigint"
    )
    targets = spark.sql("select id as bfe_id, id * 3 as x, id * 2 as y, map('a', id) as about from range(5)")
    ways = []
    for strategy in ("broadcast", "shuffle"):
        rows = nearest(spots, targets, 40, 2, strategy=strategy, hot_rows=2).collect()
        ways.append(sorted(map(repr, rows)))
    assert ways[0] == ways[1] and len(ways[0]) == 10


def test_every_hot_key_is_cut(spark):
    df = spark.range(1500 * 6).selectExpr("id % 1500 as k", "id as v")
    assert hot_keys(df, ["k"], 5).count() == 1500
    right = spark.range(1500).selectExpr("id as k", "id * 2 as w")
    joined = skew_join(df, right, ["k"], "left", hot_rows=2)
    assert joined.where("w = 2 * k").count() == 9000


def test_null_keys_are_spread(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(4000).selectExpr("cast(null as bigint) as k", "id as v")
        joined = skew_join(df, spark.range(3).selectExpr("id as k", "id as w"), ["k"], "left")
        counts = joined.groupBy("v").count().count(), [r.c for r in joined.selectExpr("spark_partition_id() as p").groupBy("p").count().withColumnRenamed("count", "c").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert counts[0] == 4000 and len(counts[1]) == 4 and max(counts[1]) < 2000


def test_crowded_cells_of_any_number_and_the_size_after_cutting(spark):
    rng = random.Random(1)
    zones = polygons(spark, {i: [square(100 * (i % 40), 100 * (i // 40), 60)] for i in range(1200)})
    spots = [(rng.randint(0, 4000), rng.randint(0, 3000)) for _ in range(300)]
    plain = points_in_polygons(points(spark, spots), zones, 100, strategy="shuffle").select("building_id", "feature_id")
    for limit in (1, 1 << 30):
        cut = points_in_polygons(points(spark, spots), zones, 100, crowd=1, broadcast_bytes=limit)
        assert sorted(map(tuple, cut.select("building_id", "feature_id").collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("kind,ppm", [("decimal(5, 2)", [400000, 600000]), ("double", [400000, 600000]), ("int", [None])])
def test_shares_of_any_weight(spark, kind, ppm):
    df = spark.sql(f"select 'g' as g, c, cast(w as {kind}) as w from values ('a', 0.40), ('b', 0.60) t(c, w)")
    shares = prevalence(df, ["g"], "c", weight="w").orderBy("c").collect()
    assert [r.share_ppm for r in shares] == (ppm if len(ppm) == 2 else [None, None])


def test_rules_take_any_literal(spark):
    df = spark.createDataFrame([(1, "a\\b", datetime.date(2021, 1, 1)), (2, "it's", datetime.date(2019, 1, 1))], "k int, s string, d date")
    rules = [allowed("s", ["a\\b", "it's"]), in_range("d", datetime.date(2020, 1, 1), datetime.date(2022, 1, 1))]
    assert [(r.rule, r.violations, r.sample) for r in check(df, rules, "k").collect()] == [("range", 1, "2")]


def test_partition_values_come_back_or_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, p string")
    path = publish(df, str(tmp_path), "layer", "main", "k", partition_by=["p"])
    assert sorted(map(repr, spark.read.schema(df.schema).parquet(path).select("k", "p").collect())) == sorted(map(repr, df.collect()))
    with pytest.raises(Exception, match="empty string"):
        publish(df.selectExpr("k", "'' as p"), str(tmp_path), "other", "main", "k", partition_by=["p"])


def test_panels_without_an_id_still_hold(spark):
    shapes = polygons(spark, {1: [square(0, 0, 10)], 2: [square(20, 0, 10)]})
    panels = shapes.selectExpr("*", "if(feature_id = 1, null, 7) as panel_id", "1 as version", "date'2000-01-01' as effective_date")
    found = panel_as_of(points(spark, [(5, 5), (25, 5)]), panels, datetime.date(2010, 1, 1), 10)
    assert sorted((r.building_id, r.version, r.panel_id) for r in found.collect()) == [(0, 1, None), (1, 1, 7)]


def test_text_ids_and_maps_through_cleaning(spark):
    line = '{{"type": "Feature", "id": "{}", "properties": {{"b": "{}", "a": "1"}}, "geometry": {{"type": "Polygon", "coordinates": [[[0,0],[4,0],[4,4],[0,0]]]}}}}'
    lines = spark.createDataFrame([(line.format("DFIRM_1", 1),), (line.format("DFIRM_1", 2),), (line.format("DFIRM_1", 2),)], "value string")
    polys, rejected = polygons_from_geojson(lines, scale=1, id_type="string")
    kept, others = clean(polys, "feature_id", ["x0"], verts="verts")
    assert rejected.count() == 0 and [r.properties["b"] for r in kept.collect()] == ["2"]
    assert sorted((r.properties["b"], r.copies) for r in others.collect()) == [("1", 1), ("2", 1)]
    inside = points_in_polygons(points(spark, [(3, 1)]), kept, 10)
    assert inside.first().feature_id == "DFIRM_1"


def test_an_empty_list_of_hot_keys_is_not_made_again(spark):
    joined = skew_join(spark.range(9).selectExpr("id as k", "id as v"), spark.range(9).selectExpr("id as k", "id as w"), ["k"], "inner", both=True)
    assert "Aggregate" not in plan(joined) and joined.count() == 9
