"""The registered queries: each runs an operator over whole given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cells import with_cell, with_parent
from tidemark.operators.building_layer import building_layer
from tidemark.operators.check import allowed, check, foreign_key, in_range, not_null, required, unique
from tidemark.operators.clean import clean, kept_rows
from tidemark.operators.contain import points_in_polygons
from tidemark.operators.cover import cover
from tidemark.operators.nearest import nearest
from tidemark.operators.panels import panel_as_of
from tidemark.operators.pick import pick_one
from tidemark.operators.prevalence import prevalence
from tidemark.operators.rings import rings_from_vertices
from tidemark.operators.zone_cells import cell_summary, coverage, zone_cells
from tidemark.plans import inputs
from tidemark.sources.geojson import polygons_from_geojson
from tidemark.sources.layers import layers, publish, read_layer

CELL = 10_000
PANEL_CELL = 200_000
RADIUS = 50_000
LATEST = date(2030, 1, 1)
MIDWAY = date(2019, 12, 31)

VERTS_AS_TEXT = "array_join(transform(verts, v -> concat(v.x, ' ', v.y)), ';') as outline"


def _places(spark: SparkSession, d: str) -> DataFrame:
    return inputs.buildings(spark, d).select("building_id", "x", "y")


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return inputs.zones(spark, d).withColumnRenamed("feature_id", "zone_id")


def _in_zones(points: DataFrame, spark: SparkSession, d: str, how: str, **options) -> DataFrame:
    return points_in_polygons(points, _zones(spark, d), CELL, how, feature="zone_id", **options)


def _best_zone(hits: DataFrame) -> DataFrame:
    return pick_one(hits, "building_id", [F.col("severity").desc_nulls_last(), F.col("zone_id").asc()])


def _panel(points: DataFrame, spark: SparkSession, d: str, as_of, **options) -> DataFrame:
    return panel_as_of(points, inputs.panels(spark, d), as_of, PANEL_CELL, **options).drop("feature_id")


def _zoned_and_panelled(spark: SparkSession, d: str) -> DataFrame:
    """Each building with its worst zone (severity 0 outside) and its panel."""
    places = inputs.buildings(spark, d).select("building_id", "x", "y", "first_floor_mm")
    zoned = _best_zone(_in_zones(places, spark, d, "left"))
    panelled = _panel(zoned, spark, d, LATEST)
    return panelled.selectExpr("building_id", "panel_id", "coalesce(severity, 0) as severity", "first_floor_mm")


def points_in_zones(spark: SparkSession, d: str, **options) -> DataFrame:
    return _in_zones(_places(spark, d), spark, d, "inner", **options).select("building_id", "zone_id", "severity")


def points_in_zones_or_none(spark: SparkSession, d: str, **options) -> DataFrame:
    return _in_zones(_places(spark, d), spark, d, "left", **options).select("building_id", "zone_id", "zone_code")


def buildings_in_zones(spark: SparkSession, d: str, **options) -> DataFrame:
    return _in_zones(_places(spark, d), spark, d, "semi", **options)


def buildings_outside_zones(spark: SparkSession, d: str, **options) -> DataFrame:
    return _in_zones(_places(spark, d), spark, d, "anti", **options)


def zone_of_building(spark: SparkSession, d: str) -> DataFrame:
    return _best_zone(points_in_zones(spark, d))


def zone_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return prevalence(_zoned_and_panelled(spark, d), ["panel_id"], "severity")


def zone_prevalence_rollup(spark: SparkSession, d: str) -> DataFrame:
    return prevalence(_zoned_and_panelled(spark, d), ["panel_id"], "severity", levels="rollup")


def zone_prevalence_weighted_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = _zoned_and_panelled(spark, d)
    return prevalence(rows, ["panel_id"], "severity", weight="first_floor_mm", levels="cube")


def panel_on_date(spark: SparkSession, d: str) -> DataFrame:
    found = _panel(_places(spark, d), spark, d, MIDWAY)
    return found.selectExpr("building_id", "panel_id", "version", "cast(effective_date as string) as effective_date")


def panel_as_of_each(spark: SparkSession, d: str, **options) -> DataFrame:
    asked = "date_add(date'2005-01-01', cast(building_id * 37 % 7000 as int)) as asked_on"
    points = _places(spark, d).selectExpr("*", asked)
    found = _panel(points, spark, d, "asked_on", **options)
    return found.selectExpr("building_id", "cast(asked_on as string) as asked_on", "panel_id", "version")


def building_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = with_parent(with_cell(_places(spark, d), size=CELL), 3)
    return cells.select("building_id", "cell_id", "parent_id")


def zone_cover(spark: SparkSession, d: str) -> DataFrame:
    return cover(_zones(spark, d), CELL).select("zone_id", "cell_id")


def zone_cells_sampled(spark: SparkSession, d: str) -> DataFrame:
    return zone_cells(_zones(spark, d), CELL, 4, feature="zone_id")


def zone_cell_centres(spark: SparkSession, d: str) -> DataFrame:
    return zone_cells(_zones(spark, d), CELL, 1, feature="zone_id").select("cell_id", "zone_id")


def coverage_cells(spark: SparkSession, d: str) -> DataFrame:
    return coverage(_places(spark, d), CELL)


def bfe_cells(spark: SparkSession, d: str) -> DataFrame:
    return cell_summary(with_cell(inputs.elevations(spark, d), size=100_000), "cell_id", "bfe_mm", by=("datum",))


def first_floor_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = with_cell(inputs.buildings(spark, d), size=100_000)
    return cell_summary(rows, "cell_id", "first_floor_mm", by=("datum",))


def first_floor_cells_approximate(spark: SparkSession, d: str) -> DataFrame:
    rows = with_cell(inputs.buildings(spark, d), size=100_000)
    return cell_summary(rows, "cell_id", "first_floor_mm", approximate=True, by=("datum",))


def nearest_bfe(spark: SparkSession, d: str, **options) -> DataFrame:
    found = nearest(_places(spark, d), inputs.elevations(spark, d), RADIUS, **options)
    return found.select("building_id", "near_bfe_id", "near_bfe_mm", "near_datum", "near_d2")


def nearest_bfe_three(spark: SparkSession, d: str, **options) -> DataFrame:
    found = nearest(_places(spark, d), inputs.elevations(spark, d), RADIUS, k=3, **options)
    return found.select("building_id", "near_rank", "near_bfe_id", "near_d2")


def nearest_bfe_same_datum(spark: SparkSession, d: str, **options) -> DataFrame:
    places = inputs.buildings(spark, d).select("building_id", "x", "y", "datum")
    found = nearest(places, inputs.elevations(spark, d), RADIUS, match=["datum"], **options)
    return found.select("building_id", "datum", "near_bfe_id", "near_bfe_mm", "near_d2")


def zone_rings(spark: SparkSession, d: str) -> DataFrame:
    rings = rings_from_vertices(inputs.zone_vertices(spark, d))
    return rings.selectExpr("feature_id", "part", "ring", "x0", "y0", "x1", "y1", VERTS_AS_TEXT)


def _clean_surveys(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return clean(inputs.surveys(spark, d), "building_id", ["measured_at", "survey_no"], required=["x", "y"])


def clean_buildings(spark: SparkSession, d: str) -> DataFrame:
    return _clean_surveys(spark, d)[0].select("building_id", "x", "y", "survey_no", "source_no")


def clean_buildings_rejected(spark: SparkSession, d: str) -> DataFrame:
    rejected = _clean_surveys(spark, d)[1]
    return rejected.select("building_id", "x", "y", "survey_no", "source_no", "reason", "copies")


def _damaged_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones of which some lack an id, a coordinate or a third vertex."""
    return _zones(spark, d).selectExpr(
        "if(zone_id % 29 = 3, null, zone_id) as zone_id", "zone_id as source_id",
        "case when zone_id % 17 = 1 then transform(verts, (v, i) -> verts[i % 2]) "
        "when zone_id % 23 = 2 then transform(verts, (v, i) -> named_struct('x', if(i = 2, null, v.x), 'y', v.y)) "
        "else verts end as verts",
    )


def clean_zones(spark: SparkSession, d: str) -> DataFrame:
    kept = kept_rows(_damaged_zones(spark, d), "zone_id", ["source_id"], verts="verts")
    return kept.selectExpr("zone_id", VERTS_AS_TEXT)


def clean_zones_rejected(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = clean(_damaged_zones(spark, d), "zone_id", ["source_id"], verts="verts")
    return rejected.select("source_id", "reason", "copies")


WIDE = (
    "building_id", "x", "y", "first_floor_mm", "datum",
    "array_join(transform(outline, v -> concat(v.x, ' ', v.y)), ';') as outline", "zone_id", "zone_code", "severity",
    "near_bfe_id", "near_bfe_mm", "near_datum", "near_d2", "panel_id", "panel_version", "above_mm",
)


def buildings_wide(spark: SparkSession, d: str) -> DataFrame:
    """One operator after the other; the buildings are shuffled once."""
    zoned = _best_zone(_in_zones(inputs.buildings(spark, d).drop("measured_at"), spark, d, "left"))
    panelled = _panel(zoned, spark, d, LATEST).withColumnRenamed("version", "panel_version")
    with_bfe = nearest(panelled, inputs.elevations(spark, d), RADIUS)
    return building_layer(with_bfe, inputs.outlines(spark, d)).selectExpr(*WIDE)


def buildings_wide_joined(spark: SparkSession, d: str) -> DataFrame:
    """The same from separate layers, joined by building."""
    places = _places(spark, d)
    wide = building_layer(
        inputs.buildings(spark, d).drop("measured_at"),
        inputs.outlines(spark, d),
        _best_zone(_in_zones(places, spark, d, "inner")),
        nearest(places, inputs.elevations(spark, d), RADIUS),
        _panel(places, spark, d, LATEST),
    )
    return wide.selectExpr(*WIDE)


def layer_violations(spark: SparkSession, d: str) -> DataFrame:
    known = _places(spark, d).where("building_id <> 1")
    rules = [
        required("building_id", "bigint"), required("x", "int"), required("height_mm", "bigint"),
        not_null("building_id"), not_null("x"), not_null("y"), in_range("y", 0, 100_000),
        allowed("survey_no", [1, 2, 3]), unique("building_id"), unique("source_no", "survey_no"),
        foreign_key(["building_id"], known),
    ]
    return check(inputs.surveys(spark, d), rules, "source_no")


def _zone_lines(spark: SparkSession, d: str) -> DataFrame:
    """Zones as GeoJSON text, with closed rings in degrees; some are damaged."""
    number = "cast(cast({} as decimal(18, 0)) / 1000000 as decimal(18, 6))"
    closed = "concat(verts, slice(verts, 1, 1))"
    ring = f"transform({closed}, v -> array({number.format('v.x')}, {number.format('v.y')}))"
    feature = (
        "to_json(named_struct('type', if(feature_id % 31 = 4, 'Topology', 'Feature'), "
        "'id', if(feature_id % 37 = 5, null, feature_id), "
        "'properties', named_struct('zone_code', zone_code, 'severity', severity), "
        "'geometry', named_struct('type', '{}', 'coordinates', {})))"
    )
    single, multi = feature.format("Polygon", f"array({ring})"), feature.format("MultiPolygon", f"array(array({ring}))")
    return inputs.zones(spark, d).selectExpr(
        f"case when feature_id % 41 = 6 then substr({single}, 1, 60) "
        f"when feature_id % 3 = 0 then {multi} else {single} end as value"
    )


def zone_geojson(spark: SparkSession, d: str) -> DataFrame:
    polygons, _ = polygons_from_geojson(_zone_lines(spark, d))
    return polygons.selectExpr(
        "feature_id", "part", "ring", "x0", "y0", "x1", "y1", "properties['zone_code'] as zone_code", VERTS_AS_TEXT
    )


def zone_geojson_rejected(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = polygons_from_geojson(_zone_lines(spark, d))
    return rejected.groupBy("reason").agg(F.expr("count(1) as lines"))


def points_in_geojson_zones(spark: SparkSession, d: str) -> DataFrame:
    """From text lines through cleaning to containment; properties stay a map all the way."""
    polygons, _ = polygons_from_geojson(_zone_lines(spark, d))
    kept = kept_rows(polygons, ["feature_id", "part", "ring"], ["x0", "y0"], verts="verts")
    hits = points_in_polygons(_places(spark, d), kept, CELL)
    return hits.selectExpr("building_id", "feature_id", "properties['zone_code'] as zone_code")


def _work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share; a temporary one on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/layers-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def _publish_both(spark: SparkSession, d: str) -> str:
    root = _work_folder(spark)
    places = inputs.buildings(spark, d).drop("measured_at")
    tagged = places.selectExpr("*", "building_id % 4 as district")
    rules = [required("building_id", "bigint"), not_null("x"), not_null("y"), unique("building_id")]
    publish(tagged, root, "first_floor", "main", "building_id", rules, ["district"])
    publish(inputs.elevations(spark, d), root, "elevation", "dependent", "bfe_id", [unique("bfe_id")])
    return root


def published_layer(spark: SparkSession, d: str) -> DataFrame:
    root = _publish_both(spark, d)
    return read_layer(spark, root, "first_floor", ["building_id", "first_floor_mm", "district"], "district = 2 and x < 500000")


def published_layers(spark: SparkSession, d: str) -> DataFrame:
    return layers(spark, _publish_both(spark, d)).select("name", "role", "contract", "rows")


def zone_area_prevalence(spark: SparkSession, d: str) -> DataFrame:
    """Share of each severity in the sampled zone area of each wider cell."""
    cells = zone_cells(_zones(spark, d), CELL, 4, feature="zone_id", keep=("severity",))
    wide = with_parent(cells, 3).selectExpr("parent_id", "severity", "cast(samples as decimal(12, 2)) / 16 as cells")
    return prevalence(wide, ["parent_id"], "severity", weight="cells").selectExpr(
        "parent_id", "severity", "cast(amount as double) as amount", "cast(total as double) as total", "share_ppm"
    )


def points_in_basins(spark: SparkSession, d: str, **options) -> DataFrame:
    """Polygons hundreds of cells wide: their full cells are on wider grids."""
    hits = points_in_polygons(_places(spark, d), inputs.basins(spark, d), 1_000, feature="basin_id", **options)
    return hits.select("building_id", "basin_id")


def points_in_town_zones(spark: SparkSession, d: str, **options) -> DataFrame:
    """Thousands of zones and all buildings in one cell, which is cut finer."""
    places = _places(spark, d).selectExpr("building_id", "x div 100 as x", "y div 100 as y")
    hits = points_in_polygons(places, inputs.town_zones(spark, d), CELL, feature="zone_id", **options)
    return hits.select("building_id", "zone_id", "severity")


def nearest_gauge(spark: SparkSession, d: str) -> DataFrame:
    """Targets in dense clusters: leaves of a tree in place of all their pairs."""
    found = nearest(_places(spark, d), inputs.gauges(spark, d), RADIUS, target_id="gauge_id", strategy="shuffle")
    return found.select("building_id", "near_gauge_id", "near_level_mm", "near_d2")


# The branches that large inputs take, over the same tables and with the same answers.
SHUFFLED = {
    f"{f.__name__}_shuffled": partial(f, strategy="shuffle")
    for f in (
        points_in_zones, points_in_zones_or_none, buildings_in_zones, buildings_outside_zones, panel_as_of_each,
        nearest_bfe, nearest_bfe_three, nearest_bfe_same_datum, points_in_basins, points_in_town_zones,
    )
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        points_in_zones, points_in_zones_or_none, buildings_in_zones, buildings_outside_zones, zone_of_building,
        zone_prevalence, zone_prevalence_rollup, zone_prevalence_weighted_cube, panel_on_date, panel_as_of_each,
        building_cells, zone_cover, zone_cells_sampled, zone_cell_centres, coverage_cells, bfe_cells,
        first_floor_cells, first_floor_cells_approximate, nearest_bfe, nearest_bfe_three, zone_rings, clean_buildings, clean_buildings_rejected,
        clean_zones, clean_zones_rejected, buildings_wide, buildings_wide_joined, layer_violations, zone_geojson, zone_geojson_rejected,
        published_layer, published_layers, zone_area_prevalence,
        points_in_geojson_zones, nearest_bfe_same_datum, points_in_basins, points_in_town_zones, nearest_gauge,
    )
} | SHUFFLED
