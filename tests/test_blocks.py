"""Rasters in blocks against the whole image: small blocks, so that everything crosses seams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import blocks, raster

c = F.col


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "SIDE", 8)
    monkeypatch.setattr(blocks, "HALO", 2)


def images(spark, seed, share, h=37, w=29):
    r = random.Random(seed)
    rows = [(i, y, x, r.random() < share[i]) for i in (0, 1) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image int, y int, x int, m boolean").repartition(3), {(i, y, x): m for i, y, x, m in rows}


@pytest.mark.parametrize("share", [(0.004, 0.3), (0.0, 0.05)])
def test_nearest_source_over_many_blocks(spark, small, share):
    df, at = images(spark, 3, share)
    got = {(p["image"], p["y"], p["x"]): (p["d2"], p["sy"], p["sx"]) for p in raster.nearest_source(df, c("m"), by=("image",)).collect()}
    sources = {i: [(y, x) for (j, y, x), m in at.items() if j == i and m] for i in (0, 1)}
    want = {(i, y, x): min((((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in sources[i]), default=(None, None, None)) for i, y, x in at}
    assert got == want


@pytest.mark.parametrize("eight", [False, True])
def test_components_over_seams(spark, small, eight):
    df, at = images(spark, 4, (0.55, 0.42))
    got = {(p["image"], p["y"], p["x"]): p["label"] for p in raster.components(df.where("m"), eight, by=("image",)).collect()}
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    want = {}
    for start in sorted(p for p, m in at.items() if m):
        if start not in want:
            todo, label = [start], start[1] * (1 << 20) + start[2]
            want[start] = label
            while todo:
                i, y, x = todo.pop()
                for a, b in steps:
                    q = (i, y + a, x + b)
                    if at.get(q) and q not in want:
                        want[q] = label
                        todo.append(q)
    assert got == want and len(set(want.values())) > 10


def test_a_snake_through_all_blocks_is_one_component(spark, small):
    snake = [(y, x) for y in range(0, 40, 2) for x in range(40)] + [(y, 39 if y % 4 == 1 else 0) for y in range(1, 39, 2)]
    df = spark.createDataFrame(snake + snake[:9], "y int, x int")  # some pixels twice
    out = raster.components(df).collect()
    assert len(out) == len(snake) and {r["label"] for r in out} == {0}
    assert raster.components(df.limit(0)).count() == 0 and raster.nearest_source(df.limit(0), F.lit(True)).count() == 0


def test_focal_windows_over_seams(spark, small):
    df, at = images(spark, 5, (0.5, 0.5))
    df = df.withColumn("m", c("m").cast("int"))
    h, w = 37, 29
    fold = lambda v, n: -v - 1 if v < 0 else 2 * n - 1 - v if v >= n else v
    sums = raster.box_sums(df, {"x": w, "y": h}, 3, "m", by=("image",))
    assert {(p["image"], p["y"], p["x"]): p["m"] for p in sums.collect()} == {(i, y, x): sum(at[i, fold(y + a, h), fold(x + b, w)] for a in range(-3, 4) for b in range(-3, 4)) for i, y, x in at}
    for pick, plain in ((F.max, max), (F.min, min)):
        out = raster.morph(df, "m", pick, "e", raster.ELLIPSE_7, by=("image",))
        want = {(i, y, x): plain(int(at[i, y + a, x + b]) for a, r in raster.ELLIPSE_7.items() for b in range(-r, r + 1) if (i, y + a, x + b) in at) for i, y, x in at}
        assert {(p["image"], p["y"], p["x"]): p["e"] for p in out.collect()} == want


def test_no_window_runs_along_a_whole_column(spark):
    df, _ = images(spark, 6, (0.5, 0.5))
    df = df.withColumn("n", c("m").cast("int"))
    at = {"x": 29, "y": 37}
    for out in (raster.box_sums(df, at, 3, "n"), raster.morph(df, "n", F.max, "e"), raster.gauss_sums(df, at, "n")):
        windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
        assert windows and all("_block" in x for x in windows)


def test_polygons_with_holes_and_lines_with_joints(spark):
    from parcelspark.functions.geometry import GEOMETRY

    r = random.Random(9)
    shift = lambda ring, x, y: [(a + x, b + y) for a, b in ring]
    u = [(0.3, 0.2), (20.3, 0.2), (20.3, 15.1), (14.1, 15.1), (14.1, 5.7), (6.2, 5.7), (6.2, 15.1), (0.3, 15.1), (0.3, 0.2)]
    tri, hole = [(-30.2, -4.4), (-8.1, 9.3), (-19.7, 18.6), (-30.2, -4.4)], [(-22.3, 5.2), (-18.4, 7.9), (-20.1, 11.3), (-22.3, 5.2)]
    lines = [[(r.uniform(-40, 40), r.uniform(-40, 40)) for _ in range(4)] for _ in range(2)]
    shapes = {1: ("MultiPolygon", [("Polygon", [u]), ("Polygon", [tri, hole])]), 2: ("Polygon", [("Polygon", [shift(u, 3.4, 2.2)])]), 3: ("MultiLineString", [("LineString", [x]) for x in lines]), 4: ("Point", [("Point", [[(1.0, 1.0)]])]), 5: ("Polygon", [])}
    df = spark.createDataFrame(list(shapes.items()), f"key int, geometry {GEOMETRY}")
    grid = [(y, x) for y in range(-45, 46) for x in range(-45, 46)]
    pairs = lambda ring: list(zip(ring, ring[1:], strict=False))
    odd = lambda rings, y, x: sum((a[1] <= y) != (b[1] <= y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for ring in rings for a, b in pairs(ring)) % 2

    def far(p, a, b):
        v, q = (b[0] - a[0], b[1] - a[1]), (p[0] - a[0], p[1] - a[1])
        t = max(0, min(1, (v[0] * q[0] + v[1] * q[1]) / (v[0] ** 2 + v[1] ** 2)))
        return ((q[0] - t * v[0]) ** 2 + (q[1] - t * v[1]) ** 2) ** 0.5

    filled = {(k, y, x) for k, (_, parts) in shapes.items() for y, x in grid if any(kind == "Polygon" and odd(rings, y, x) for kind, rings in parts)}
    assert {(p["key"], p["y"], p["x"]) for p in raster.fill_polygons(df, "key").collect()} == filled and len(filled) > 500
    drawn = {(3, y, x) for y, x in grid if any(far((x, y), a, b) <= 1.5 for line in lines for a, b in pairs(line))}
    assert {(p["key"], p["y"], p["x"]) for p in raster.draw_polylines(df, "key", 3.0).collect()} == drawn


def test_lines_are_drawn_along_their_length(spark):
    """Every pixel once, against all pixels of the plane; a long line takes what its length asks for, not what its box holds."""
    lines = [(1, 0.0, 0.0, 6.0, 3.0), (1, 6.0, 3.0, 0.5, 7.25), (1, 0.0, 0.0, 6.0, 3.0), (2, -3.0, 2.0, 4.0, 2.0), (2, 1.5, -4.0, 1.5, 5.0), (3, 2.0, 2.0, 2.0, 2.0), (4, -5.0, 1.0, 5.0, 1.0 + 1e-12), (5, 0.3, 0.3, 0.35, 0.32)]
    df = spark.createDataFrame(lines, "k long, ax double, ay double, bx double, by double")

    def near(x, y, ax, ay, bx, by):
        length2 = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length2)) if length2 else 0.0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) <= 1.5

    want = {(k, y, x) for k, *q in lines for y in range(-9, 12) for x in range(-9, 12) if near(x, y, *q)}
    got = [(r["k"], r["y"], r["x"]) for r in raster.draw_lines(df, "k", 3.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    far = spark.createDataFrame([(1, 0.0, 0.0, 20_000.0, 20_000.0)], df.schema)  # a box of 4 * 10^8 pixels
    assert raster.line_runs(far, "k", 3.0).agg(F.count("y"), F.sum(c("x1") - c("x0") + 1)).first()[0] == 20_003


def test_pixels_are_not_broadcast(spark):
    """Spark takes a table of pixels for as small as the file of few rows that they were made from, and would gather it at the driver."""
    from parcelspark.plans import site

    px = spark.range(40).select(c("id").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    claimed = site._claimed(px.selectExpr("'front' AS kind", "y", "x", "y AS owner"), px.selectExpr("'front' AS kind", "y", "x", "y AS owner").where("x = 0"), 10, c("by") < c("owner"))
    for df in (raster.nearest_source(px, c("x") == 5), raster.squared_distance(px, c("x") == 5), claimed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert raster.squared_distance(px, c("x") == 5).agg(F.max("d2")).first()[0] == 58**2
