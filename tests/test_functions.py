"""Functions on literals with known answers, plans, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from parcelspark.functions import geo, scoring
from parcelspark.operators import raster, spatial
from parcelspark.plans import vector

c = F.col


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_tiles_and_utm(spark):
    lat, lon = F.lit(53.375142480929455), F.lit(-6.383740530507169)
    assert one(spark, geo.tile_x(lon, F.lit(19)), geo.tile_y(lat, F.lit(19))) == (252847, 169875)
    east, north = one(spark, *geo.utm(F.lit(0.0), F.lit(-3.0)))
    assert (east, north) == (pytest.approx(500000, abs=1e-6), pytest.approx(0, abs=1e-6))
    south = one(spark, geo.utm(F.lit(-33.9), F.lit(18.4))[1])[0]
    assert south == pytest.approx(6248000, abs=5000)
    back = one(spark, geo.tile_west(F.lit(252847), F.lit(19)), geo.tile_north(F.lit(169875), F.lit(19)))
    assert back[0] <= -6.383740530507169 and back[1] >= 53.375142480929455


def test_distances(spark):
    a = one(spark, geo.haversine(F.lit(53.3), F.lit(-6.2), F.lit(53.4), F.lit(-6.3)), geo.haversine(F.lit(53.4), F.lit(-6.3), F.lit(53.3), F.lit(-6.2)))
    assert a[0] == pytest.approx(a[1]) and 12000 < a[0] < 14000
    seg = one(spark, geo.segment_distance(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), geo.segment_distance(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert seg == (1.0, 5.0)
    assert one(spark, geo.box_distance(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))[0] == 0.0


def test_scores_stay_in_range(spark):
    df = spark.range(4000).select((c("id") % 50 / 2.0).alias("b"), (c("id") % 7).cast("double").alias("r"), F.element_at(F.array(*map(F.lit, ["grass", "driveway", "paved", "odd"])), (c("id") % 4 + 1).cast("int")).alias("s"))
    df = df.select("s", scoring.simple_score(c("s"), c("b"), c("r")).alias("x"), scoring.graduated_score(c("s"), c("b") / 25, c("b"), c("b"), c("r"), c("r"), c("b") / 25, c("b") / 25).alias("y"))
    for row in df.groupBy("s").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect():
        assert 0 <= row[1] <= row[2] <= scoring.SURFACE.get(row[0], 30) and 0 <= row[3] <= row[4] <= {"grass": 100, "driveway": 75}.get(row[0], 60)


def test_comparison_and_duration(spark):
    said = scoring.comparison_text(F.lit(11308), F.lit(352))
    assert "+10956" in one(spark, said)[0] and "+3112.5%" in one(spark, said)[0]
    assert one(spark, scoring.duration_text(F.lit(59.9)), scoring.duration_text(F.lit(3599.0)), scoring.duration_text(F.lit(5400.0))) == ("~59 seconds", "~59 minutes", "~1.5 hours")


def test_range_join_is_a_hash_join_and_complete(spark):
    pts = spark.range(400).select("id", (53.35 + (c("id") * 7919 % 1009) / 1e5).alias("lat"), (-6.35 + (c("id") * 104729 % 1013) / 1e5).alias("lon"))
    dist = geo.equirectangular(c("lat"), c("lon"), F.lit(53.35), F.lit(-6.35))
    pair = F.sqrt(F.pow((c("lat") - c("r_lat")) * geo.M_PER_DEG, 2.0) + F.pow((c("lon") - c("r_lon")) * geo.M_PER_DEG * 0.5969, 2.0))
    near = spatial.range_join(pts, pts, 60.0, pair)
    assert "NestedLoop" not in near._jdf.queryExecution().toString() and "Cartesian" not in near._jdf.queryExecution().toString()
    other = pts.select(*[c(x).alias(f"r_{x}") for x in pts.columns])
    assert near.count() == pts.crossJoin(other).where(pair <= 60).count() > 400
    assert dist is not None and spatial.range_join(pts.limit(0), pts, 60.0, pair).count() == 0


def test_box_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(*[c("id").cast("double").alias(x) for x in ("xmin", "xmax", "ymin", "ymax")]).write.parquet(str(tmp_path / "b"))
    plan = vector.in_circle(spark.read.parquet(str(tmp_path / "b")))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(xmax" in plan


def test_raster_edge_cases(spark):
    empty = spark.createDataFrame([], "y long, x int, r int, g int, b int")
    assert raster.hsv(empty).count() == 0 and raster.components(empty.select("y", "x")).count() == 0
    colours = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 1, 255, 0, 0), (0, 2, 0, 255, 0), (0, 3, 0, 0, 255), (0, 4, 200, 200, 200)], empty.schema)
    assert [tuple(r) for r in raster.hsv(colours).orderBy("x").select("h", "s", "v").collect()] == [(0, 0, 0), (0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 200)]
    ring = spark.createDataFrame([(y, x, (y, x) != (2, 2)) for y in range(1, 4) for x in range(1, 4)] + [(y, x, False) for y in range(5) for x in range(5) if y in (0, 4) or x in (0, 4)], "y long, x int, m boolean")
    assert [tuple(r) for r in raster.holes(ring, "m", 5, 5).collect()] == [(2, 2)]
    spiral = [(0, x) for x in range(9)] + [(y, 8) for y in range(9)] + [(8, x) for x in range(9)] + [(y, 0) for y in range(2, 9)]
    out = raster.components(spark.createDataFrame(spiral, "y long, x int")).collect()
    assert {r["label"] for r in out} == {0}


def globe(seed, n, lat, lon, spread_m):
    import random

    r = random.Random(seed)
    k = spread_m / geo.M_PER_DEG
    place = lambda: (lat + r.uniform(-k, k), (lon + r.uniform(-k, k) / math.cos(math.radians(lat)) + 180) % 360 - 180)
    return [(i, *place()) for i in range(n)]


def _meters(a, b):
    f = math.radians
    h = math.sin(f(b[1] - a[1]) / 2) ** 2 + math.cos(f(a[1])) * math.cos(f(b[1])) * math.sin(f(b[2] - a[2]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("lat,lon,radius", [(65, 20, 50), (0, 10, 50), (-40, -70, 50), (53, 180, 50), (-80, -179.999, 60), (53, -6, 5000), (89.5, 0, 3000)])
def test_range_join_finds_all_pairs_everywhere(spark, lat, lon, radius):
    rows = globe(1, 250, lat, lon, radius * 6)
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    far = geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    got = {(r["id"], r["r_id"]) for r in spatial.range_join(df, df, radius, far).select("id", "r_id").collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if _meters(a, b) <= radius} and len(got) > 300


def test_circles_of_all_sizes_find_their_points(spark):
    points = globe(2, 300, 53, -6, 4000)
    circles = [(i, la, lo, float(10 * 3 ** (i % 9))) for i, la, lo in globe(3, 60, 53, -6, 4000)]
    p, q = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(circles, "id long, lat double, lon double, radius_m double")
    far = geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    got = {(r["id"], r["r_id"]) for r in spatial.within_own_radius(p, q, "radius_m", far).select("id", "r_id").collect()}
    assert got == {(a[0], b[0]) for a in points for b in circles if _meters(a, b) <= b[3]} and len(got) > 1000
    assert spatial.within_own_radius(p, q.limit(0), "radius_m", far).count() == 0


def test_nearest_at_any_distance(spark):
    left = globe(4, 80, 53, 179.99, 30000)
    right = globe(5, 12, 53, 179.99, 3000)
    far = geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    a, b = spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "id long, lat double, lon double")
    got = {r["id"]: r["r_id"] for r in spatial.nearest_at_any_distance(a, b, "id", 100.0, far, "r_id").collect()}
    assert got == {x[0]: min(right, key=lambda y: _meters(x, y))[0] for x in left}
    near = spatial.nearest_at_any_distance(a, b, "id", 100.0, far, "r_id", most_m=2000.0)
    assert {r["id"] for r in near.collect()} == {x[0] for x in left if min(_meters(x, y) for y in right) <= 2000}


def test_rough_ground(spark):
    """A flat image with one odd pixel and a checkered corner, against the definition; and another image beside it."""
    h, w = 21, 33
    gray = {(y, x): 100 + (40 if (y, x) == (10, 25) else 0) + (30 * ((x + y) % 2) if y < 4 and x < 4 else 0) for y in range(h) for x in range(w)}
    rows = [(i, y, x, *([v * (i == 0) + 50 * (i == 1)] * 3)) for i in (0, 1) for (y, x), v in gray.items()]
    df = spark.createDataFrame(rows, "image int, y int, x int, r int, g int, b int")
    got = {(p["image"], p["y"], p["x"]): p["rough"] for p in raster.rough(df, {"x": w, "y": h}, by=("image",)).collect()}
    fold = lambda v, n: n - 1 - abs(n - 1 - abs(v))
    weights = dict(zip(range(-2, 3), (1, 4, 6, 4, 1), strict=True))
    mean = lambda y, x: (sum(a * b * gray[fold(y + i, h), fold(x + j, w)] for i, a in weights.items() for j, b in weights.items()) + 128) // 256
    mask = {p for p, v in gray.items() if abs(v - mean(*p)) > 3}
    for _ in range(2):
        mask = {(y, x) for y, x in gray if any((y + dy, x + dx) in mask for dy, reach in raster.ELLIPSE_7.items() for dx in range(-reach, reach + 1))}
    assert {p[1:] for p, v in got.items() if v and p[0] == 0} == mask and 50 < len(mask) < h * w - 50
    assert not any(v for p, v in got.items() if p[0] == 1)


def test_one_long_road_widens_the_ring_for_itself_only(spark):
    """Nearest segments of any length against all pairs; the pairs that are looked at hardly grow by one segment of 50 km."""
    places = globe(6, 120, 53, -6, 6000)
    short = [(i, la, lo, la, lo + 0.0002, 7.0) for i, la, lo in globe(7, 150, 53, -6, 6000)]
    long_ = [(999, 53.0, -6.0, 53.0, -5.25, 25100.0)]
    x0, y0 = geo.metres(c("r_lat0"), c("r_lon0"), c("lat"), c("lon"))
    x1, y1 = geo.metres(c("r_lat1"), c("r_lon1"), c("lat"), c("lon"))
    to_road = geo.segment_distance(F.lit(0.0), F.lit(0.0), x0, y0, x1, y1)
    points = spark.createDataFrame(places, "id long, lat double, lon double")

    def roads(rows):
        df = spark.createDataFrame(rows, "road long, lat0 double, lon0 double, lat1 double, lon1 double, half double")
        return df.withColumns({"lat": (c("lat0") + c("lat1")) / 2, "lon": (c("lon0") + c("lon1")) / 2})

    def plain(p, s):
        k = math.cos(math.radians(p[1])) * geo.M_PER_DEG
        ax, ay, bx, by = (s[2] - p[2]) * k, (s[1] - p[1]) * geo.M_PER_DEG, (s[4] - p[2]) * k, (s[3] - p[1]) * geo.M_PER_DEG
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, -(ax * (bx - ax) + ay * (by - ay)) / n))
        return math.hypot(ax + t * (bx - ax), ay + t * (by - ay))

    all_ = short + long_
    seen = spark.sparkContext.accumulator(0)
    got = {r["id"]: r["r_road"] for r in spatial.nearest_at_any_distance(points, roads(all_), "id", 200.0, to_road, "r_road", reach="half").collect()}
    assert got == {p[0]: min(all_, key=lambda s: (plain(p, s), s[0]))[0] for p in places} and 999 in got.values() and len(set(got.values())) > 20

    @F.udf("double")
    def counted(d):
        seen.add(1)
        return d

    looked = []
    for rows in (short, all_):
        before = seen.value
        spatial.nearest_at_any_distance(points, roads(rows), "id", 200.0, counted(to_road), "r_road", reach="half").count()
        looked.append(seen.value - before)
    assert looked[1] <= looked[0] + 4 * len(places) < 120 * 150
    assert spatial.nearest_at_any_distance(points, roads(short).limit(0), "id", 200.0, to_road, "r_road", reach="half").count() == 0


@pytest.mark.parametrize(("lat", "lon"), [(65, 20), (0, 10), (53, 180), (-40, -179.9999)])
def test_flat_distances_hold_everywhere(spark, lat, lon):
    """The distance of the registered joins against all pairs on the sphere, to a part in a thousand."""
    rows = globe(8, 150, lat, lon, 200)
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    far = vector._plane(c("lat"), c("lon"), c("r_lat"), c("r_lon"))
    got = {(r["id"], r["r_id"]): r["distance_m"] for r in spatial.range_join(df, df, 50.0, far).collect()}
    scale = geo.M_PER_DEG / (geo.EARTH_RADIUS * math.pi / 180)
    real = {(a[0], b[0]): _meters(a, b) * scale for a in rows for b in rows}
    assert all(abs(real[p] - m) <= 0.001 * m + 1e-6 for p, m in got.items())
    assert {p for p, m in real.items() if m <= 49.9} <= set(got) and len(got) > 500
