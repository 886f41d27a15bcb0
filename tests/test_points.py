"""Points in shapes, in circles and in areas, where very many are near one another: block by block or cell by cell, and the same as all pairs."""

import math
import random

from pyspark.sql import functions as F

from parcelspark.operators import polygons


def _box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def _odd(rings, x, y):
    sides = [s for r in rings for s in zip(r, r[1:], strict=False)]
    return sum((a[1] <= y) != (b[1] <= y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in sides) % 2 == 1


def test_points_meet_shapes_in_blocks(spark):
    rng = random.Random(7)
    deg = 1 / 111320.0
    shapes = []
    for k in range(500):
        x, y, w = -6.3 + rng.uniform(0, 60) * deg, 53.3 + rng.uniform(0, 60) * deg, rng.choice([6, 9, 40, 3000]) * deg
        yard = [_box(x + w / 3, y + w / 3, w / 4, w / 4)] if k % 3 else []
        shapes.append((k, ("MultiPolygon", [("Polygon", [_box(x, y, w, w), *yard]), ("Polygon", [_box(x + 1.2 * w, y, w / 2, w / 2)]), ("LineString", [_box(x, y, 2 * w, 2 * w)])])))
    shapes += [(900, ("Polygon", [])), (901, None), (902, ("Polygon", [("Polygon", [_box(-180.0, 89.0, 360.0, 0.9)])])), (903, ("Polygon", [("Polygon", [_box(-6.3, -0.00001, 0.0001, 0.00002)])]))]
    points = [(i, 53.3 + rng.uniform(-20, 80) * deg, -6.3 + rng.uniform(-20, 80) * deg) for i in range(3000)] + [(5000, 89.5, 12.0), (5001, 0.0, -6.29995), (5002, None, 1.0)]
    schema = "k long, geometry struct<kind:string,parts:array<struct<kind:string,rings:array<array<struct<x:double,y:double>>>>>>"
    df, at = spark.createDataFrame(shapes, schema), spark.createDataFrame(points, "id long, lat double, lon double")
    got = sorted((r.id, r.r_k) for r in polygons.containing(at, df, "k").collect())
    want = sorted((i, k) for i, y, x in points if y is not None for k, g in shapes if g and any(_odd(q, x, y) for kind, q in g[1] if kind == "Polygon"))
    assert got == want and {(5000, 902), (5001, 903)} <= set(got)

    boxes = [(k, x, y, x + w, y + w) for k in range(400) for x, y, w in [(-6.3 + k % 20 * deg, 53.3 + k % 17 * deg, (4 + k % 9) * deg)]]
    flat = spark.createDataFrame(boxes, "k long, xmin double, ymin double, xmax double, ymax double")
    more = points + [(6000, boxes[3][2], boxes[3][3])]  # a corner counts
    got = sorted((r.id, r.r_k) for r in polygons.in_boxes(spark.createDataFrame(more, at.schema), flat, "k").collect())
    assert got == sorted((i, k) for i, y, x in more if y is not None for k, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    # pairs are formed within tasks: far fewer rows leave the join than there are pairs
    assert polygons._met_boxes(at, flat).count() * 20 < len(got)
    assert polygons.in_boxes(at, flat.limit(0), "k").isEmpty() and polygons.in_boxes(at.limit(0), flat, "k").isEmpty()


def test_few_large_circles_spread_points_over_cells(spark, monkeypatch):
    from parcelspark.functions import geo
    from parcelspark.operators import spatial

    def far(a, b, x, y):
        p, q, u, v = map(math.radians, (a, b, x, y))
        return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(math.sin((u - p) / 2) ** 2 + math.cos(p) * math.cos(u) * math.sin((v - q) / 2) ** 2)))

    rng = random.Random(3)
    points = [(i, lat + rng.uniform(-0.4, 0.4), (lon + rng.uniform(-d, d) + 180) % 360 - 180) for i in range(1500) for lat, lon, d in [rng.choice([(53.3, -6.3, 0.5), (-79.0, 179.9, 3.0), (89.5, 0.0, 180.0), (0.0, -179.9, 0.5)])]]
    circles = [(k, lat, lon, r) for k, (lat, lon, r) in enumerate([(53.3, -6.3, 20000.0), (53.31, -6.2, 900.0), (-79.0, 180.0, 40000.0), (89.7, 77.0, 30000.0), (89.0, -120.0, 90000.0), (0.1, 179.95, 30000.0), (20.0, 3.0, 2.0e7)])]
    at, of = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(circles, "k long, lat double, lon double, radius_m double")
    hav = geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    got = sorted((r.id, r.r_k) for r in spatial.within_own_radius(at, of, "radius_m", hav).select("id", "r_k").collect())
    assert got == sorted((i, k) for i, a, b in points for k, x, y, r in circles if far(a, b, x, y) <= r)
    # points near a circle stood on a few cells of its size, and so in a few tasks
    seen, met = [], spatial.met
    monkeypatch.setattr(spatial, "met", lambda left, right, *on: seen.append(left.select(*on).distinct().count()) or met(left, right, *on))
    spatial.within_own_radius(at.where("lat between 53 and 54"), of.where("k = 0"), "radius_m", hav)
    assert seen[0] > 50


def test_near_pairs_are_formed_within_tasks(spark, monkeypatch):
    """All pairs near one another in a crowd, over 180 degrees and around a pole; rows are sent once or little more, however many pairs there are."""
    from parcelspark.functions import geo
    from parcelspark.operators import near, polygons, spatial

    monkeypatch.setattr(polygons, "AT_ONCE", 5000)
    rng = random.Random(4)
    deg = 1 / 111320.0
    rows = [(53.3 + rng.uniform(0, 300) * deg, -6.3 + rng.uniform(0, 300) * deg) for _ in range(1500)]
    rows += [(-40.0 + rng.uniform(0, 80) * deg, (180 + rng.uniform(-60, 60) * deg + 180) % 360 - 180) for _ in range(150)]
    rows += [(s * (90 - rng.uniform(0, 90) * deg), rng.uniform(-180, 180)) for s in (1, -1) for _ in range(100)] + [(0.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None)]
    df = spark.createDataFrame([(i, lat, lon, f"k{i % 3}") for i, (lat, lon) in enumerate(rows)], "id long, lat double, lon double, kind string").repartition(3)
    x, y = geo.plane(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    want = {(r.id, r.r_id): (r.kind, r.r_kind, r.distance_m) for r in spatial.range_join(df, df, 20.0, F.sqrt(x * x + y * y)).collect()}
    got = [tuple(r) for r in near.pairs_within(df, 20.0).select("id", "r_id", "kind", "r_kind", "distance_m").collect()]
    assert len(got) == len(want) == len({r[:2] for r in got}) > 20_000
    assert all(want[r[:2]][:2] == r[2:4] and abs(want[r[:2]][2] - r[4]) < 1e-9 for r in got)
    assert near._on_cells(df.where("lat > 50 and lat < 60"), 20.0).count() < 1.8 * 1500  # nine times before
    assert near.pairs_within(df.limit(0), 20.0).isEmpty()


def test_pairs_of_a_range_are_few_rows_in_the_shuffle(spark):
    from parcelspark.plans import vector

    plan = vector.range_pairs_20m(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
