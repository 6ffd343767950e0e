"""GeoJSON features, one per line, to polygon rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.outline import box

FEATURE = (
    "type string, geometry struct<type: string, coordinates: string>, properties map<string, string>, malformed string"
)
# Wide enough for degrees and for metres, with no rounding before the scale is
# applied.
NUMBER = "decimal(24, 15)"


def read_geojson_lines(
    spark: SparkSession, path: str, id_path: str = "$.id", scale: int = 1_000_000, id_type: str = "bigint"
) -> tuple[DataFrame, DataFrame]:
    """Polygons and rejected lines of newline-delimited GeoJSON files."""
    return polygons_from_geojson(spark.read.text(path), id_path, scale, id_type)


def polygons_from_geojson(
    lines: DataFrame, id_path: str = "$.id", scale: int = 1_000_000, id_type: str = "bigint"
) -> tuple[DataFrame, DataFrame]:
    """Split text lines (column ``value``) into polygon rows and rejects.

    Polygon and MultiPolygon features give one row per ring, with coordinates
    times ``scale`` rounded to whole numbers, without the closing vertex, and
    with the feature's properties as a map of text.  ``id_path`` is a JSON path
    to the id, a whole number or with ``id_type`` ``string`` any text.  Any other line comes back with a ``reason``; blank
    lines are skipped.
    """
    rings = f"array<array<array<{NUMBER}>>>"
    # A generator around each parse keeps Spark from pushing the tests below
    # it and parsing the text again in every one of them.
    parsed = lines.where("trim(value) <> ''").selectExpr(
        "value", f"try_cast(get_json_object(value, '{id_path}') as {id_type}) as feature_id",
        f"inline_outer(array(from_json(value, '{FEATURE}', map('columnNameOfCorruptRecord', 'malformed'))))"
        " as (kind, geometry, properties, malformed)",
    )
    parts = (
        f"case geometry.type when 'Polygon' then array(from_json(geometry.coordinates, '{rings}')) "
        f"when 'MultiPolygon' then from_json(geometry.coordinates, 'array<{rings}>') end"
    )
    shaped = parsed.selectExpr(
        "value", "feature_id", "kind", "geometry.type as shape", "properties", "malformed",
        f"inline_outer(array(named_struct('parts', {parts})))",
    )
    gap = (
        "exists(parts, p -> p is null or size(p) = 0 or exists(p, r -> r is null or size(r) = 0 or "
        "exists(r, c -> c is null or size(c) < 2 or c[0] is null or c[1] is null)))"
    )
    judged = shaped.selectExpr(
        "*",
        "case when malformed is not null then 'malformed line' "
        "when kind is null or kind <> 'Feature' then 'not a feature' "
        f"when feature_id is null then '{'no id' if id_type == 'string' else 'no whole-number id'}' "
        "when shape is null or shape not in ('Polygon', 'MultiPolygon') then 'not a polygon' "
        f"when parts is null or size(parts) = 0 or {gap} then 'bad coordinates' end as reason",
    )
    verts = (
        f"transform(points, c -> named_struct('x', cast(round(c[0] * {scale}) as bigint), "
        f"'y', cast(round(c[1] * {scale}) as bigint)))"
    )
    polygons = (
        judged.where("reason is null")
        .selectExpr("feature_id", "properties", "posexplode_outer(parts) as (part, rings)")
        .selectExpr("feature_id", "properties", "part", "posexplode_outer(rings) as (ring, points)")
        .selectExpr("feature_id", "properties", "part", "ring", f"{verts} as closed")
        .selectExpr(
            "feature_id", "part", "ring", "properties",
            "if(size(closed) > 1 and closed[0] = element_at(closed, -1), slice(closed, 1, size(closed) - 1), closed)"
            " as verts",
        )
        .selectExpr("feature_id", "part", "ring", "verts", *box("verts"), "properties")
    )
    return polygons, judged.where("reason is not null").select("value", "reason")
