"""Flood inputs derived from the given tables by whole-number formulas.

The given tables have no geometry.  Parts become zones, orders buildings,
order lines surveys of buildings, suppliers flood elevations and nations map
panels.  The plane is made of tiles of side 1,000,000; keys beyond one tile's
share go to the next tile, so the density, and with it the work per row, stays
level as the tables grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys per tile, in the ratio of the given tables.
PARTS_PER_TILE = 20_000
ORDERS_PER_TILE = 150_000
SUPPLIERS_PER_TILE = 1_000
TILE = 1_000_000

ZONE_VERTICES = (("cx-w", "cy-w"), ("cx+w", "cy-w"), ("cx+w", "cy+w"), ("cx", "cy"), ("cx-w", "cy+w"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, key: str, per_tile: int) -> DataFrame:
    """Add ``k`` (the key), ``m`` (its place in the tile) and ``shift``."""
    k = f"cast({key} as bigint)"
    return df.selectExpr("*", f"{k} as k", f"{k} % {per_tile} as m", f"{k} div {per_tile} * {TILE} as shift")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the narrow rows of a table out by key, whatever its size and files.

    The number of parts is given: Spark would join small parts to one, but
    what is done with these rows is far more work than their bytes tell.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)


def ring(points) -> str:
    """SQL array of vertices."""
    return "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in points) + ")"


def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone_id, severity, centre and half width of each zone."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return keyed(part, "p_partkey", PARTS_PER_TILE).selectExpr(
        "k as zone_id",
        "cast(1 + k % 4 as int) as severity",
        f"(m * 48271) % {TILE} + shift as cx",
        f"(m * 16807 + 13 * m * m) % {TILE} as cy",
        "1000 + 200 * cast(p_size as bigint) as w",
    )


def zone_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vertex of each zone, a concave pentagon."""
    steps = ", ".join(
        f"named_struct('seq', {i}, 'x', {x}, 'y', {y})" for i, (x, y) in enumerate(ZONE_VERTICES, 1)
    )
    return zone_boxes(spark, sf_dir).selectExpr(
        "zone_id as feature_id", "0 as part", "0 as ring", f"inline(array({steps}))"
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone polygons: feature_id, shape, zone_code and severity."""
    return zone_boxes(spark, sf_dir).selectExpr(
        "zone_id as feature_id", "0 as part", "0 as ring", f"{ring(ZONE_VERTICES)} as verts",
        "cx - w as x0", "cy - w as y0", "cx + w as x1", "cy + w as y1",
        "concat('Z', severity) as zone_code", "severity",
    )


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return keyed(orders, "o_orderkey", ORDERS_PER_TILE).selectExpr(
        "k as building_id",
        f"(7919 * m + 3 * m * m) % {TILE} + shift as x",
        f"(104729 * m + 7 * m * m) % {TILE} as y",
        "500 + (31 * k) % 4000 as first_floor_mm",
        "if(k % 11 = 0, 'NGVD29', 'NAVD88') as datum",
        "o_orderdate as measured_at",
    )


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square outline for nine buildings in ten."""
    square = ring((("x-h", "y-h"), ("x+h", "y-h"), ("x+h", "y+h"), ("x-h", "y+h")))
    return (
        buildings(spark, sf_dir)
        .where("building_id % 10 <> 0")
        .selectExpr("building_id", "x", "y", "40 + building_id % 60 as h")
        .selectExpr("building_id", f"{square} as verts")
    )


def surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated measurements of buildings, one per order line, some unusable.

    A third of them name building 1; some have no key or no coordinate.
    """
    line = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey as bigint) as k", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        "cast(l_orderkey as bigint) + l_linenumber + l_suppkey as mixed",
    )
    return line.selectExpr(
        "case when mixed % 3 = 0 then 1 when mixed % 53 = 1 then null else k end as building_id",
        f"if(mixed % 41 = 2, null, (k % {ORDERS_PER_TILE}) * 7 % {TILE}) as x",
        f"(k % {ORDERS_PER_TILE}) * 11 % {TILE} as y",
        "l_shipdate as measured_at",
        "l_partkey * 10000 + l_suppkey * 10 + l_linenumber as survey_no",
        "k as source_no",
    )


def elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    return keyed(supplier, "s_suppkey", SUPPLIERS_PER_TILE).selectExpr(
        "k as bfe_id",
        f"(31337 * m) % {TILE} + shift as x",
        f"(71993 * m + 11 * m * m) % {TILE} as y",
        "1000 + (97 * k) % 3000 as bfe_mm",
        "if(k % 7 = 0, 'NGVD29', 'NAVD88') as datum",
    )


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square map panels, two versions each, on every tile of the plane."""
    last = table(spark, sf_dir, "supplier").selectExpr(
        f"coalesce(max(cast(s_suppkey as bigint) div {SUPPLIERS_PER_TILE}), 0) as last"
    )
    tiles = F.sequence(F.lit(0).cast("bigint"), last.scalar())
    nation = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as k")
    grid = (
        nation.withColumn("t", F.explode_outer(tiles))
        .selectExpr("k", "t", "explode_outer(array(1, 2)) as version")
        .selectExpr("*", f"(k % 5) * 200000 + t * {TILE} as x0", "k div 5 * 200000 as y0")
        .selectExpr("*", "x0 + 200000 as x1", "y0 + 200000 as y1", "k + 25 * t as panel_id")
    )
    square = ring((("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))
    return grid.selectExpr(
        "panel_id * 2 + version - 1 as feature_id", "0 as part", "0 as ring", f"{square} as verts",
        "x0", "y0", "x1", "y1", "panel_id", "version",
        "if(version = 1, date_add(date'2008-01-01', cast(10 * k as int)), "
        "date_add(date'2019-01-01', cast(30 * k as int))) as effective_date",
    )


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concave polygons hundreds of thousands of units wide, one per nation on every tile."""
    last = table(spark, sf_dir, "supplier").selectExpr(
        f"coalesce(max(cast(s_suppkey as bigint) div {SUPPLIERS_PER_TILE}), 0) as last"
    )
    nation = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as k")
    boxes = nation.withColumn("t", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), last.scalar()))).selectExpr(
        "k + 25 * t as basin_id", f"(k * 337919) % {TILE} + t * {TILE} as cx", f"(k * 570817) % {TILE} as cy", "100000 + 6000 * k as w"
    )
    return boxes.selectExpr(
        "basin_id", "0 as part", "0 as ring", f"{ring(ZONE_VERTICES)} as verts",
        "cx - w as x0", "cy - w as y0", "cx + w as x1", "cy + w as y1",
    )


def town_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones at a hundredth of their scale, so that thousands lie in one cell."""
    boxes = zone_boxes(spark, sf_dir).selectExpr("zone_id", "severity", "cx div 100 as cx", "cy div 100 as cy", "w div 100 as w")
    return boxes.selectExpr(
        "zone_id", "0 as part", "0 as ring", f"{ring(ZONE_VERTICES)} as verts",
        "cx - w as x0", "cy - w as y0", "cx + w as x1", "cy + w as y1", "severity",
    )


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges in 25 dense clusters on every tile, one per part."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    return keyed(part, "p_partkey", PARTS_PER_TILE).selectExpr(
        "k as gauge_id",
        "100000 + (m % 5) * 200000 + (m * 7919) % 700 + shift as x",
        "100000 + (m div 5 % 5) * 200000 + (m * 104729) % 900 as y",
        "(31 * k) % 5000 as level_mm",
    )
