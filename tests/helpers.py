"""Small tables and brute-force answers."""

POLYGON = (
    "feature_id bigint, part int, ring int, verts array<struct<x: bigint, y: bigint>>, "
    "x0 bigint, y0 bigint, x1 bigint, y1 bigint"
)


def polygon_rows(features):
    """Rows of a polygon table from {feature_id: [ring, ...]}."""
    rows = []
    for fid, rings in features.items():
        for i, ring in enumerate(rings):
            xs, ys = [x for x, _ in ring], [y for _, y in ring]
            rows.append((fid, 0, i, [tuple(v) for v in ring], min(xs), min(ys), max(xs), max(ys)))
    return rows


def polygons(spark, features):
    return spark.createDataFrame(polygon_rows(features), POLYGON)


def inside(px, py, rings):
    """Even-odd rule over all edges of all rings, with whole numbers."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > py) == (by > py):
                continue
            left, right = (px - ax) * (by - ay), (bx - ax) * (py - ay)
            odd ^= left < right if by > ay else left > right
    return odd


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def points(spark, rows):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(rows)], "building_id bigint, x bigint, y bigint")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
