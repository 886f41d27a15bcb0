"""Queries over buildings, roads, pins and areas."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelspark.functions import geo, scoring
from parcelspark.operators import near, polygons, spatial
from parcelspark.sources import views as V
from parcelspark.sources.views import oracle

#: Tags that are not dwellings, and roads that a front may face.
OUTBUILDINGS = ["shed", "garage", "garages", "carport", "outbuilding", "barn", "greenhouse", "hut", "cabin", "storage", "roof", "canopy", "shelter", "kiosk", "toilets", "transformer_tower", "service", "ruins"]
FRONT_ROADS = ["residential", "tertiary", "secondary", "primary", "tertiary_link", "secondary_link", "primary_link", "living_street", "unclassified"]
DWELLINGS = "^(house|residential|detached|semidetached_house|terrace|apartments|bungalow)$"
#: The circle of the examples.
LAT, LON, RADIUS = 53.356, -6.34, 400.0

c = F.col
HAV = "2 * 6371000::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a}))"


def hav_sql(lat1, lon1, lat2, lon2):
    a = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return HAV.format(a=a)


def flat_sql(lat, lon, lat0, lon0):
    return f"sqrt(power(({lon} - {lon0}) * 111320::DOUBLE * cos(radians({lat0})), 2) + power(({lat} - {lat0}) * 111320::DOUBLE, 2))"


def r(x, n=6):
    return F.round(x, n)


def in_circle(df, lat=LAT, lon=LON, radius=RADIUS):
    """Footprints that touch the circle: box first, which Parquet can use, then the distance."""
    box = geo.circle_box(lat, lon, radius)
    df = df.where((c("xmax") >= box["xmin"]) & (c("xmin") <= box["xmax"]) & (c("ymax") >= box["ymin"]) & (c("ymin") <= box["ymax"]))
    k = geo.M_PER_DEG * math.cos(math.radians(lat))
    d = geo.box_distance(F.lit(0.0), F.lit(0.0), (c("xmin") - lon) * k, (c("ymin") - lat) * geo.M_PER_DEG, (c("xmax") - lon) * k, (c("ymax") - lat) * geo.M_PER_DEG)
    return df.where(d <= radius)


def circle_count_area(spark, d):
    out = in_circle(V.buildings(spark, d)).agg(F.count(F.lit(1)).alias("building_count"), r(F.coalesce(F.sum(c("w_m") * c("h_m")), F.lit(0.0)), 2).alias("total_area_sqm"), r(F.coalesce(F.avg(c("w_m") * c("h_m")), F.lit(0.0)), 2).alias("avg_building_area_sqm"))
    return out.select(F.lit(LAT).alias("latitude"), F.lit(LON).alias("longitude"), F.lit(RADIUS).alias("radius_m"), "*")


BOX_DIST = f"""sqrt(power(greatest(0::DOUBLE, (xmin - ({LON})::DOUBLE) * 111320::DOUBLE * cos(radians({LAT}::DOUBLE)), -(xmax - ({LON})::DOUBLE) * 111320::DOUBLE * cos(radians({LAT}::DOUBLE))), 2)
 + power(greatest(0::DOUBLE, (ymin - {LAT}::DOUBLE) * 111320::DOUBLE, -(ymax - {LAT}::DOUBLE) * 111320::DOUBLE), 2))"""


def bbox_slice(spark, d):
    b = geo.circle_box(LAT, LON, RADIUS)
    df = V.buildings(spark, d).where((c("xmax") >= b["xmin"]) & (c("xmin") <= b["xmax"]) & (c("ymax") >= b["ymin"]) & (c("ymin") <= b["ymax"]))
    return df.select("building_id", r(c("lat")).alias("lat"), r(c("lon")).alias("lon"))


def haversine_topk(spark, d):
    df = V.buildings(spark, d).withColumn("m", geo.haversine(c("lat"), c("lon"), F.lit(LAT), F.lit(LON)))
    return df.orderBy("m", "building_id").limit(50).select("building_id", r(c("m"), 3).alias("distance_m"))


def equirect_within(spark, d):
    df = V.pins(spark, d).withColumn("m", geo.equirectangular(c("lat"), c("lon"), F.lit(LAT), F.lit(LON)))
    return df.where(c("m") <= 250).select("pin_id", r(c("m"), 3).alias("distance_m"))


def slippy_tiles(spark, d):
    z = F.explode(F.array(*[F.lit(x) for x in (12, 15, 17, 19)]))
    df = V.buildings(spark, d).select("building_id", "lat", "lon", z.alias("zoom"))
    return df.select("building_id", "zoom", geo.tile_x(c("lon"), c("zoom")).alias("tile_x"), geo.tile_y(c("lat"), c("zoom")).alias("tile_y"))


def tile_bounds(spark, d):
    df = V.areas(spark, d).select("area_id", "zoom", geo.tile_x(c("lon"), c("zoom")).alias("tile_x"), geo.tile_y(c("lat"), c("zoom")).alias("tile_y"))
    return df.select("area_id", "tile_x", "tile_y", r(geo.tile_west(c("tile_x"), c("zoom"))).alias("west"), r(geo.tile_west(c("tile_x") + 1, c("zoom"))).alias("east"), r(geo.tile_north(c("tile_y"), c("zoom"))).alias("north"), r(geo.tile_north(c("tile_y") + 1, c("zoom"))).alias("south"))


def tiles_for_radius(spark, d):
    df = V.areas(spark, d).withColumns({"n": geo.tiles_for_distance(c("radius_m"), c("lat"), c("zoom")), "tx": geo.tile_x(c("lon"), c("zoom")), "ty": geo.tile_y(c("lat"), c("zoom"))})
    df = df.select("area_id", "ty", "n", F.explode(F.sequence(c("tx") - c("n"), c("tx") + c("n"))).alias("tile_x"))
    return df.select("area_id", "tile_x", F.explode(F.sequence(c("ty") - c("n"), c("ty") + c("n"))).alias("tile_y"))


def zoom_options(spark, d):
    radii = V.areas(spark, d).select("radius_m").distinct().select("radius_m", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("z"))
    auto = radii.where(c("radius_m") / (F.lit(geo.CIRCUMFERENCE / 256) / F.pow(F.lit(2.0), c("z"))) < 400).groupBy("radius_m").agg(F.max("z").alias("auto"))
    df = auto.select("radius_m", "auto", F.explode(F.sequence(F.least(c("auto"), F.lit(18)), F.least(c("auto") + 4, F.lit(18)))).alias("zoom"))
    df = df.withColumn("grid", F.least(F.lit(100), F.greatest(F.lit(5), 5 * F.pow(F.lit(2.0), c("zoom") - c("auto")))).cast("int"))
    df = df.withColumn("tiles", c("grid") * c("grid"))
    return df.select("radius_m", "zoom", "grid", "tiles", (c("grid") * 256).alias("side_px"), scoring.duration_text(c("tiles") * 0.05).alias("eta"), (c("zoom") == c("auto")).alias("is_default"))


def recommended_zoom(spark, d):
    df = V.areas(spark, d).select("area_id", "lat", (c("radius_m") * 20).alias("radius_m"), F.explode(F.sequence(F.lit(15), F.lit(19))).alias("z"))
    fits = (2 * geo.tiles_for_distance(c("radius_m"), c("lat"), c("z")) + 1) * 256 <= 18000
    return df.groupBy("area_id").agg(F.coalesce(F.max(F.when(fits, c("z"))), F.lit(15)).alias("zoom"))


def utm_project(spark, d):
    e, n = geo.utm(c("lat"), c("lon"))
    return V.buildings(spark, d).select("building_id", geo.utm_zone(c("lon")).alias("zone"), r(e, 3).alias("easting"), r(n, 3).alias("northing"))


def utm_sql():
    terms = lambda f, g, v: " + ".join(f"{a!r}::DOUBLE * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    ecc = 2 * geo.N3**0.5 / (1 + geo.N3)
    return oracle("bld", f"""SELECT building_id, zone::INT AS zone, round({geo.SCALE * geo.MEAN_RADIUS!r}::DOUBLE * (eta + {terms('cos', 'sinh', 0)}) + 500000, 3) AS easting,
      round({geo.SCALE * geo.MEAN_RADIUS!r}::DOUBLE * (xi + {terms('sin', 'cosh', 0)}), 3) AS northing FROM k""", f""",
      j AS (SELECT building_id, floor((lon + 180) / 6) + 1 AS zone, radians(lon - (floor((lon + 180) / 6) * 6 - 177)) AS lam,
        sinh(atanh(sin(radians(lat))) - {ecc!r}::DOUBLE * atanh({ecc!r}::DOUBLE * sin(radians(lat)))) AS t FROM bld),
      k AS (SELECT building_id, zone, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM j)""")  # fmt: skip


def polygon_area_centroid(spark, d):
    """Shoelace area, centroid and bounds of the footprint rings, in metres around the ring's own first corner."""
    corner = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    df = V.buildings(spark, d).withColumn("ring", ring)
    k = geo.M_PER_DEG * F.cos(F.radians("lat"))
    df = df.withColumn("p", F.transform("ring", lambda q: F.struct(((q["x"] - c("xmin")) * k).alias("x"), ((q["y"] - c("ymin")) * geo.M_PER_DEG).alias("y"))))
    sides = F.arrays_zip(F.slice("p", 1, 4).alias("a"), F.slice("p", 2, 4).alias("b"))
    df = df.withColumn("s", F.transform(sides, lambda q: F.struct((q["a"]["x"] * q["b"]["y"] - q["b"]["x"] * q["a"]["y"]).alias("w"), (q["a"]["x"] + q["b"]["x"]).alias("x"), (q["a"]["y"] + q["b"]["y"]).alias("y"))))
    add = lambda f: F.aggregate("s", F.lit(0.0), lambda acc, q: acc + f(q))
    twice = add(lambda q: q["w"])
    return df.select("building_id", r(F.abs(twice / 2), 3).alias("area_m2"), r(add(lambda q: q["x"] * q["w"]) / (3 * twice), 3).alias("cx"), r(add(lambda q: q["y"] * q["w"]) / (3 * twice), 3).alias("cy"), r(F.array_max(F.transform("ring", lambda q: q["x"]))).alias("xmax"), r(F.array_min(F.transform("ring", lambda q: q["y"]))).alias("ymin"))


def point_in_polygon(spark, d):
    """Pins inside a footprint: blocks of pins and of boxes of the same cell, then the containment test."""
    b = V.buildings(spark, d).select("building_id", "xmin", "xmax", "ymin", "ymax")
    pairs = polygons.in_boxes(V.pins(spark, d).select("pin_id", "lat", "lon"), b, "building_id")
    return pairs.select("pin_id", c("r_building_id").alias("building_id"))


def building_type_filter(spark, d):
    """NOT IN that keeps rows without a tag."""
    return V.buildings(spark, d).where(c("building").isNull() | ~c("building").isin(OUTBUILDINGS)).select("building_id", "building")


def small_area_filter(spark, d):
    """Half footprints of more than 30 m2 (all of them where none is), whose box times 0.7 has 30 m2 or more."""
    df = V.buildings(spark, d).withColumn("area_m2", c("w_m") * c("h_m") / 2)
    some = df.agg(F.coalesce(F.max("area_m2") > 30, F.lit(False)).alias("some"))
    return df.crossJoin(F.broadcast(some)).where((~c("some") | (c("area_m2") > 30)) & (c("area_m2") * 0.7 >= 30)).select("building_id", "area_m2")  # one row


def front_roads(spark, d):
    return V.roads(spark, d).where(F.arrays_overlap("highway", F.array(*[F.lit(x) for x in FRONT_ROADS]))).select("road_id", F.trim("name").alias("name"))


def residential_regex(spark, d):
    return V.buildings(spark, d).where(c("building").rlike(DWELLINGS)).select("building_id", "building")


def tag_split(spark, d):
    """One scan into five branches, counted."""
    t = V.table(spark, d, "part").select("p_type", "p_brand", "p_size")
    masks = {"buildings": c("p_size") % 3 == 0, "roads": c("p_type").like("%BRASS"), "driveways": c("p_type").like("%STEEL") & c("p_brand").like("Brand#1%"), "addresses": c("p_brand").isNotNull() & (c("p_size") > 25), "boundaries": c("p_brand").isin("Brand#11", "Brand#22", "Brand#33", "Brand#44")}
    counts = t.agg(*[F.count_if(F.coalesce(m, F.lit(False))).alias(n) for n, m in masks.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in masks]), F.array(*[c(n) for n in masks]))).alias("branch", "n"))


def exclusion_union(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", "p_size")
    part = lambda mod, name: p.where(c("p_size") % mod == 0).select("p_partkey", F.lit(name).alias("exclusion_type"))
    return part(2, "landuse").unionByName(part(5, "leisure")).unionByName(part(7, "natural"))


def dedup_first(spark, d):
    first = F.min_by(F.struct("seq", "status"), "seq")
    return V.progress(spark, d).groupBy("task_id").agg(first.alias("f")).select("task_id", "f.seq", "f.status")


def to_segment(df):
    """distance_m from (lat, lon) to the road of the row, and px, py, the nearest point of it in metres from there."""
    x0, y0 = geo.metres(c("lat0"), c("lon0"), c("lat"), c("lon"))
    x1, y1 = geo.metres(c("lat1"), c("lon1"), c("lat"), c("lon"))
    ends = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    df = df.select("*", F.explode(F.array(ends)).alias("_s"))  # worked out once, which the optimizer would undo for plain columns
    x0, y0, x1, y1 = (c(f"_s.{n}") for n in ("x0", "y0", "x1", "y1"))
    vx, vy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (-x0 * vx - y0 * vy) / (vx * vx + vy * vy)))
    return df.withColumns({"distance_m": r(geo.segment_distance(F.lit(0.0), F.lit(0.0), x0, y0, x1, y1), 4), "px": x0 + t * vx, "py": y0 + t * vy}).drop("_s")


SEGMENT = ("road_id", "lat0", "lon0", "lat1", "lon1")


def _with_ends(df):
    """The ends of the road r_... in metres from (lat, lon), worked out once, and the distance of the two as distance_m."""
    x0, y0 = geo.metres(c("r_lat0"), c("r_lon0"), c("lat"), c("lon"))
    x1, y1 = geo.metres(c("r_lat1"), c("r_lon1"), c("lat"), c("lon"))
    df = spatial.once(df, "_s", F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
    return spatial.once(df, "distance_m", geo.segment_distance(F.lit(0.0), F.lit(0.0), *[c(f"_s.{n}") for n in ("x0", "y0", "x1", "y1")]))


def _road_m(pairs, most):
    return _with_ends(pairs).drop("_s")


def _own_columns(best, *keys):
    return best.select(*keys, "lat", "lon", *[c(f"r_{n}").alias(n) for n in SEGMENT])


def nearest_segment(points, roads, key):
    """The nearest road of each point, whatever its distance; the smaller road_id of equally near ones."""
    best = spatial.nearest_line(points.select(key, "lat", "lon"), roads.select(*SEGMENT), key, 200.0, _road_m, "r_road_id")
    return to_segment(_own_columns(best, key))


def street_road(spark, d):
    """The nearest road of a building's street within 150 m of its centre; none is nearer than 0.1 m."""
    rd = V.roads(spark, d).select(*SEGMENT, F.lower(F.trim("name")).alias("street_key"))
    b = V.buildings(spark, d).select("building_id", "lat", "lon", "street_key")
    best = spatial.nearest_line(b, rd, "building_id", 150.0, _road_m, "r_road_id", on=("street_key",), most_m=150.0, where=(c("distance_m") > 0.1) & (c("distance_m") < 150))
    return to_segment(_own_columns(best, "building_id"))


def seg_sql(name, points, roads, keys, where="true"):
    """name: keys, road_id, lat, lon, ax .. ey (the road's ends in metres), t (place of the nearest point) and distance_m of each point and road."""
    return f"""{name}a AS (SELECT {keys}, road_id, q.lat, q.lon, lat0, lon0, lat1, lon1, (lon0 - q.lon) * 111320::DOUBLE * cos(radians(q.lat)) AS ax, (lat0 - q.lat) * 111320::DOUBLE AS ay,
   (lon1 - q.lon) * 111320::DOUBLE * cos(radians(q.lat)) AS ex, (lat1 - q.lat) * 111320::DOUBLE AS ey FROM {points} q JOIN {roads} ON {where}),
 {name}t AS (SELECT *, CASE WHEN power(ex - ax, 2) + power(ey - ay, 2) > 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, (-ax * (ex - ax) - ay * (ey - ay)) / (power(ex - ax, 2) + power(ey - ay, 2)))) ELSE 0 END AS t FROM {name}a),
 {name} AS (SELECT *, round(sqrt(power(ax + t * (ex - ax), 2) + power(ay + t * (ey - ay), 2)), 4) AS distance_m FROM {name}t)"""


SEG = seg_sql("sd", "bld", "road", "building_id", "lower(trim(name)) = street_key")
ANY = seg_sql("ad", "bld", "road", "building_id")
NEAREST = "QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY distance_m, road_id) = 1"


def nearest_road(spark, d):
    """Of all roads the nearest, at any distance."""
    best = nearest_segment(V.buildings(spark, d), V.roads(spark, d), "building_id")
    return best.select("building_id", "road_id", "distance_m")


def nearest_driveway(spark, d, least_m=-1.0):
    """Each building's service road nearest to the edge of its footprint, within 25 m, the smaller road_id of equally near ones, with edge_m; none whose
    distance from the centre isn't above least_m."""
    ways = V.roads(spark, d).where(F.array_contains("highway", "service")).select(*SEGMENT)
    b = V.buildings(spark, d).select("building_id", "lat", "lon", "w_m", "h_m")
    half = b.agg(F.max(F.sqrt(c("w_m") * c("w_m") + c("h_m") * c("h_m")) / 2)).first()[0] or 0.0  # the largest footprint's, so none loses its driveway

    def edge(pairs, most):
        near = _with_ends(pairs).where((c("distance_m") <= most + half) & (r("distance_m", 4) > least_m))  # no edge is further from its centre than half
        # not to be worked out again for the filters that follow
        return near.withColumn("distance_m", geo.box_to_segment("w_m", "h_m", *[c(f"_s.{n}") for n in ("x0", "y0", "x1", "y1")])).drop("_s")

    best = spatial.nearest_line(b, ways, "building_id", 25.0, edge, "r_road_id", most_m=25.0, beyond_m=half, where=c("distance_m") < 25)
    return to_segment(_own_columns(best.withColumnRenamed("distance_m", "edge_m"), "building_id", "edge_m"))


def nearest_driveway_25m(spark, d):
    """The nearest driveway, measured from the edge of the footprint, within 25 m."""
    return nearest_driveway(spark, d).select("building_id", "road_id", c("edge_m").alias("distance_m"))


BOXD = "sqrt(power(greatest(-w_m / 2 - {x}, 0::DOUBLE, {x} - w_m / 2), 2) + power(greatest(-h_m / 2 - {y}, 0::DOUBLE, {y} - h_m / 2), 2))"


def corner_sql(x, y):
    t = f"greatest(0::DOUBLE, least(1::DOUBLE, (({x} - ax) * (ex - ax) + ({y} - ay) * (ey - ay)) / (power(ex - ax, 2) + power(ey - ay, 2))))"
    return f"sqrt(power({x} - ax - {t} * (ex - ax), 2) + power({y} - ay - {t} * (ey - ay), 2))"


#: dw: building_id, road_id, px, py, edge_m of driveways within 25 m of the footprint's edge.
DRIVE = ", " + seg_sql("wd", "bld", "(SELECT * FROM road WHERE list_contains(highway, 'service'))", "building_id, w_m, h_m") + f""",
 wc AS (SELECT *, ax + t * (ex - ax) AS px, ay + t * (ey - ay) AS py, CASE WHEN ex <> ax THEN (-w_m / 2 - ax) / (ex - ax) END AS u0, CASE WHEN ex <> ax THEN (w_m / 2 - ax) / (ex - ax) END AS u1, CASE WHEN ey <> ay THEN (-h_m / 2 - ay) / (ey - ay) END AS v0, CASE WHEN ey <> ay THEN (h_m / 2 - ay) / (ey - ay) END AS v1 FROM wd),
 dw AS (SELECT building_id, road_id, distance_m, px, py, round(CASE WHEN (ex <> ax OR abs(ax) <= w_m / 2) AND (ey <> ay OR abs(ay) <= h_m / 2) AND greatest(0, least(u0, u1), least(v0, v1)) <= least(1, greatest(u0, u1), greatest(v0, v1)) THEN 0
   ELSE least({BOXD.format(x='ax', y='ay')}, {BOXD.format(x='ex', y='ey')}, {', '.join(corner_sql(f'{i} * w_m / 2', f'{j} * h_m / 2') for i in (-1, 1) for j in (-1, 1))}) END, 4) AS edge_m FROM wc)"""


def address_road_direction(spark, d):
    """Unit vector from a building to the nearest segment of its street, within 150 m and longer than 0.1 m."""
    best = street_road(spark, d)
    norm = F.sqrt(c("px") * c("px") + c("py") * c("py"))
    return best.select("building_id", "road_id", "distance_m", r(c("px") / norm, 5).alias("ux"), r(c("py") / norm, 5).alias("uy"))


def neighbours(spark, d, radius=40.0, *columns):
    b = V.buildings(spark, d).select("building_id", "lat", "lon", *columns)
    pairs = near.pairs_within(b, radius + 0.0001).where(c("building_id") != c("r_building_id"))
    return spatial.once(pairs, "distance_m", r("distance_m", 4)).where(c("distance_m") <= radius)  # rounding is dear: near pairs only


def _plane(lat, lon, lat2, lon2):
    """Distance by the mean latitude, so it is the same both ways."""
    x, y = geo.plane(lat, lon, lat2, lon2)
    return F.sqrt(x * x + y * y)


PLANE = "round(sqrt(power((a.lon - b.lon) * 111320::DOUBLE * cos(radians((a.lat + b.lat) / 2)), 2) + power((a.lat - b.lat) * 111320::DOUBLE, 2)), 4)"
NB = f""", nb AS (SELECT a.building_id, b.building_id AS other, a.building, b.building AS other_building, {PLANE} AS distance_m FROM bld a JOIN bld b ON a.building_id <> b.building_id AND abs(a.lat - b.lat) < 0.001 AND abs(a.lon - b.lon) < 0.001)"""


def nearest_neighbours(spark, d, most):
    """building_id, other, distance_m, rank of the nearest other buildings within 40 m, `most` at most."""
    b = V.buildings(spark, d).select("building_id", "lat", "lon")
    far = r(_plane(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 4)
    near = spatial.nearest_few(b, b, "building_id", most, 40.0, far, c("building_id") != c("r_building_id"), "r_building_id")
    return near.select("building_id", c("r_building_id").alias("other"), "distance_m", "rank")


def neighbour_knn10(spark, d):
    return nearest_neighbours(spark, d, 10)


def range_pairs_20m(spark, d):
    return neighbours(spark, d, 20.0).select("building_id", c("r_building_id").alias("other"), "distance_m")


def neighbour_agreement(spark, d):
    """Neighbours within 20 m that agree and disagree in type; one round of correction, all rows reading the state before."""
    pairs = neighbours(spark, d, 20.0, "building").where(c("building").isNotNull() & c("r_building").isNotNull())
    out = pairs.groupBy("building_id").agg(F.count_if(c("building") == c("r_building")).alias("agree"), F.count_if(c("building") != c("r_building")).alias("disagree"))
    return out.withColumn("flip", (c("disagree") >= 2) & (c("agree") == 0))


def containing_or_nearest(spark, d):
    """The area that holds a building, smallest first; else the nearest within 900 m of its edge."""
    b, a = V.buildings(spark, d).select("building_id", "lat", "lon"), V.areas(spark, d).select("area_id", "lat", "lon", "radius_m")
    pairs = spatial.within_own_radius(b, a, "radius_m", r(_plane(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 3), extra_m=900.0)
    pairs = pairs.withColumn("outside", c("distance_m") > c("r_radius_m"))
    pairs = pairs.withColumn("by", F.when(c("outside"), c("distance_m") - c("r_radius_m")).otherwise(c("r_radius_m")))
    best = spatial.nearest(pairs.select("building_id", "outside", "by", c("r_area_id").alias("area_id")), "building_id", "outside", "by", "area_id")
    return best.select("building_id", "area_id", "outside")


def not_nearest_anti(spark, d):
    """Pins that no other building is nearer to, with a margin of 1.5."""
    own = V.pins(spark, d).join(V.buildings(spark, d).select("building_id", c("lat").alias("o_lat"), c("lon").alias("o_lon")), "building_id")
    own = own.withColumn("own_m", r(_plane(c("lat"), c("lon"), c("o_lat"), c("o_lon")), 4)).select("pin_id", "building_id", "lat", "lon", "own_m")
    b = V.buildings(spark, d).select("building_id", "lat", "lon")
    far = r(_plane(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 4)
    rivals = spatial.with_any(own.withColumn("reach_m", c("own_m") * 1.5), b, "pin_id", "reach_m", far, (c("r_building_id") != c("building_id")) & (c("distance_m") < c("own_m") * 1.5))
    return own.join(rivals, "pin_id", "left_anti").select("pin_id", "own_m")


def zone_semi(spark, d):
    """Pins whose surface occurs with a full score at their building."""
    p = V.pins(spark, d)
    zones = p.where("score >= 90").select("building_id", "surface_type").distinct()
    return p.join(zones, ["building_id", "surface_type"], "left_semi").select("pin_id", "building_id", "surface_type")


def chunk_assign(spark, d):
    """Buildings dealt to every 500 m chunk of an area whose bounds, with a halo of 100 m, their box touches; own: the centre is in the
    core. Chunks that don't touch the circle fall away."""
    a = V.areas(spark, d).withColumn("n", F.ceil(c("radius_m") / 500.0).cast("int"))
    grid = a.select("area_id", "lat", "lon", "radius_m", "n", F.explode(F.sequence(-c("n"), c("n") - 1)).alias("i")).select("*", F.explode(F.sequence(-c("n"), c("n") - 1)).alias("j"))
    near = lambda k: F.greatest(k * 500.0, F.least(F.lit(0.0), k * 500.0 + 500.0))
    grid = grid.where(near(c("i")) * near(c("i")) + near(c("j")) * near(c("j")) <= c("radius_m") * c("radius_m"))
    b = V.buildings(spark, d).select("building_id", "lat", "lon", "w_m", "h_m")
    reach = a.select("area_id", "lat", "lon", ((c("n") * 500 + 120) * 1.5).alias("reach_m"))
    pairs = spatial.within_own_radius(b, reach, "reach_m", geo.equirectangular(c("lat"), c("lon"), c("r_lat"), c("r_lon")))
    x, y = geo.metres(c("lat"), c("lon"), c("r_lat"), c("r_lon"))
    pairs = pairs.select("building_id", "w_m", "h_m", c("r_area_id").alias("area_id"), r(x, 4).alias("x"), r(y, 4).alias("y"))
    touched = lambda v, half: F.sequence(F.floor((v - half - 100) / 500.0).cast("int"), F.floor((v + half + 100) / 500.0).cast("int"))
    dealt = pairs.withColumn("i", F.explode(touched(c("x"), c("w_m") / 2))).withColumn("j", F.explode(touched(c("y"), c("h_m") / 2))).join(grid.select("area_id", "i", "j"), ["area_id", "i", "j"])
    return dealt.select("area_id", "i", "j", "building_id", ((F.floor(c("x") / 500.0) == c("i")) & (F.floor(c("y") / 500.0) == c("j"))).alias("own"))


def source_compare(spark, d):
    one = V.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("first_count"))
    two = V.table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("second_count"))
    both = one.crossJoin(two)  # two rows of one
    return both.select("first_count", "second_count", (c("first_count") - c("second_count")).alias("difference"), scoring.comparison_text(c("first_count"), c("second_count")).alias("comparison"))


def pins_filtered(spark, d):
    pins = V.pins(spark, d).where("garden_type = 'front' and score >= 40").select("pin_id", "lat", "lon", "score")
    pairs = spatial.within_own_radius(pins, V.areas(spark, d).select("area_id", "lat", "lon", "radius_m"), "radius_m", geo.haversine(c("lat"), c("lon"), c("r_lat"), c("r_lon")))
    return pairs.groupBy(c("r_area_id").alias("area_id")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("score"), 4).alias("avg_score"))


def pins_by_type(spark, d):
    return V.pins(spark, d).groupBy("garden_type", "surface_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("score") == 0).alias("no_garden"), r(F.avg("score"), 4).alias("avg_score"))


def attempt_hist(spark, d):
    df = V.pins(spark, d).select((c("pin_id") % 4).alias("attempt")).groupBy("attempt").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(F.when(c("attempt") > 0, c("n"))).over(Window.partitionBy(F.lit(1)))
    return df.select("attempt", "n", r(F.when(c("attempt") > 0, c("n") * 100.0 / total), 4).alias("pct"))


def catalog_stats(spark, d):
    df = V.areas(spark, d).withColumn("bytes", (c("radius_m") * 160).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("areas"), F.sum("bytes").alias("bytes"), r(F.sum("bytes") / 1048576.0, 4).alias("mb"), F.count_distinct("radius_m").alias("radii"), F.max("created_at").alias("latest"))


def class_stats(spark, d):
    df = V.pins(spark, d).groupBy("building_id").agg(F.count_if(c("garden_type") == "front").alias("front"), F.count_if(c("garden_type") == "back").alias("back"))
    total = c("front") + c("back")
    return df.select("building_id", "front", "back", r(F.when(total > 0, c("front") * 100.0 / total).otherwise(0.0), 4).alias("front_pct"))


def last_pins(spark, d):
    """Of the pins of a building and type the last one counts."""
    last = F.max_by(F.struct("pin_id", "lat", "lon", "score"), "pin_id")
    return V.pins(spark, d).groupBy("building_id", "garden_type").agg(last.alias("p")).select("building_id", "garden_type", "p.*")


def last_pin_per_building(spark, d):
    return last_pins(spark, d).select("building_id", "garden_type", "pin_id", "score")


def pivoted(spark, d):
    side = lambda t: [F.max(F.when(c("garden_type") == t, c(k))).alias(f"{t}_{k}") for k in ("pin_id", "lat", "lon", "score")]
    return last_pins(spark, d).groupBy("building_id").agg(*side("front"), *side("back"))


def front_back_pivot(spark, d):
    return pivoted(spark, d).select("building_id", "front_pin_id", "back_pin_id", "front_score", "back_score")


def front_back_swap(spark, d):
    """Pins swap where the front one is 1.05 times as far from its nearest road as the back one, or both are within 8 m and it is no nearer."""
    last = last_pins(spark, d)
    road = nearest_segment(last, V.roads(spark, d), "pin_id").select("pin_id", "distance_m")
    df = pivoted(spark, d).where("front_pin_id is not null and back_pin_id is not null")
    for side in ("front", "back"):
        df = df.join(road.toDF(f"{side}_pin_id", f"{side}_m"), f"{side}_pin_id")
    df = df.withColumn("apart_m", r(_plane(c("front_lat"), c("front_lon"), c("back_lat"), c("back_lon")), 4))
    swap = (c("front_m") > c("back_m") * 1.05) | ((c("apart_m") < 8) & (c("back_m") <= c("front_m")))
    return df.select("building_id", swap.alias("swap"), F.when(swap, c("back_pin_id")).otherwise(c("front_pin_id")).alias("front_pin_id"))


def nearest_building_pins(spark, d):
    """Each area centre to the building whose pins lie nearest on average, at any distance."""
    mean = V.pins(spark, d).groupBy("building_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    far = r(_plane(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 3)
    best = spatial.nearest_at_any_distance(V.areas(spark, d).select("area_id", "lat", "lon"), mean, "area_id", 50.0, far, "r_building_id")
    return best.select("area_id", c("r_building_id").alias("building_id"), "distance_m")


def point_classify_30m(spark, d):
    """Label of the nearest pin within 30 m of an area centre, else out of bounds."""
    pairs = spatial.range_join(V.areas(spark, d).select("area_id", "lat", "lon"), V.pins(spark, d).select("pin_id", "lat", "lon", "garden_type"), 30.0, r(_plane(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 3))
    best = spatial.nearest(pairs.select("area_id", c("r_pin_id").alias("pin_id"), c("r_garden_type").alias("garden_type"), "distance_m"), "area_id", "distance_m", "pin_id")
    return V.areas(spark, d).select("area_id").join(best, "area_id", "left").select("area_id", "pin_id", F.coalesce("garden_type", F.lit("out_of_bounds")).alias("classification"))


def boxed(df):
    k = c("radius_m") / geo.M_PER_DEG
    kx = k / F.cos(F.radians("lat"))
    return df.withColumns({"xmin": c("lon") - kx, "xmax": c("lon") + kx, "ymin": c("lat") - k, "ymax": c("lat") + k})


def catalog_pairs(spark, d, times):
    """Pairs of entries of the catalog, the second (r_...) with its centre within so many times its radius of the first one's."""
    a = boxed(V.areas(spark, d)).withColumn("reach_m", c("radius_m") * times)
    return spatial.within_own_radius(a, a, "reach_m", r(geo.haversine(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 4)).where("area_id <> r_area_id")


def cache_covering(spark, d):
    """Boxes within boxes: the centre of the inner one is within the outer one's half diagonal."""
    inside = (c("r_xmin") <= c("xmin")) & (c("r_xmax") >= c("xmax")) & (c("r_ymin") <= c("ymin")) & (c("r_ymax") >= c("ymax"))
    return catalog_pairs(spark, d, 1.5).where(inside).select("area_id", c("r_area_id").alias("covering"))


def cache_overlap(spark, d):
    """Boxes that touch: centres are within two half diagonals of the larger one."""
    apart = (c("r_xmin") > c("xmax")) | (c("r_xmax") < c("xmin")) | (c("r_ymin") > c("ymax")) | (c("r_ymax") < c("ymin"))
    larger = (c("r_radius_m") > c("radius_m")) | ((c("r_radius_m") == c("radius_m")) & (c("r_area_id") > c("area_id")))
    df = catalog_pairs(spark, d, 3.0).where(~apart & larger)
    return df.select(F.least("area_id", "r_area_id").alias("area_id"), F.greatest("area_id", "r_area_id").alias("other"))


def cache_circle_in_circle(spark, d):
    df = catalog_pairs(spark, d, 1.01).where(c("distance_m") + c("radius_m") <= c("r_radius_m"))
    return df.select("area_id", c("r_area_id").alias("covering"), r(c("distance_m"), 3).alias("distance_m"))


def cache_downscale(spark, d):
    """Requests of 100, 250 and 450 m around each cached area's centre: served by the smallest larger area whose centre is within 1 m, its
    pins cut to the request's radius; the area's count of pins is passed on uncut."""
    asked = V.areas(spark, d).select(c("area_id").alias("asked"), "lat", "lon", F.explode(F.array(F.lit(100.0), F.lit(250.0), F.lit(450.0))).alias("want_m"))
    areas = V.areas(spark, d).select("area_id", "lat", "lon", "radius_m")
    same = spatial.range_join(asked, areas, 1.0, r(geo.equirectangular(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 4)).where((c("distance_m") < 1) & (c("r_radius_m") > c("want_m")))
    serve = same.groupBy("asked", "want_m").agg(F.min_by(F.struct(c("r_area_id").alias("area_id"), c("r_lat").alias("lat"), c("r_lon").alias("lon"), c("r_radius_m").alias("radius_m")), F.struct("r_radius_m", "r_area_id")).alias("s")).select("asked", "want_m", "s.*")
    pins = spatial.within_own_radius(V.pins(spark, d).select("pin_id", "lat", "lon", "score"), serve, "radius_m", r(geo.equirectangular(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 4))
    near = c("distance_m") <= c("r_want_m")
    return pins.groupBy(c("r_asked").alias("asked"), c("r_want_m").alias("want_m"), c("r_area_id").alias("area_id")).agg(F.count_if(near).alias("n_pins"), F.coalesce(F.sum(F.when(near, c("score"))), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("uncut"))


def cache_estimate(spark, d):
    a = boxed(V.areas(spark, d))
    km2 = F.abs((c("ymax") - c("ymin")) * 111.32 * (c("xmax") - c("xmin")) * 111.32 * F.cos(F.radians((c("ymin") + c("ymax")) / 2)))
    n = F.floor(F.round(km2, 9) * 200).cast("long")
    return a.select("area_id", r(km2, 2).alias("area_km2"), n.alias("estimated_buildings"), (n * 160).alias("estimated_size_bytes"), r(n * 160 / 1048576.0, 2).alias("estimated_size_mb"))


def evict_oldest(spark, d):
    """The 50 latest keys stay in a cache."""
    latest = V.progress(spark, d).groupBy("task_id").agg(F.max("seq").alias("seq"))
    return latest.orderBy(F.desc("seq")).limit(50)


def ttl_filter(spark, d):
    """Events less than a day older than the last one."""
    p = V.progress(spark, d)
    last = p.agg(F.max("ts").alias("last"))
    return p.crossJoin(last).where(c("ts") > c("last") - F.expr("interval 1 day")).select("task_id", "seq")


def score_inputs(spark, d):
    p, k = V.pins(spark, d), c("pin_id")
    part = lambda a, m, s: ((k * a) % m).cast("double") / s
    return p.select("pin_id", "garden_type", "surface_type", "score", part(7, 41, 2.0).alias("to_building"), part(11, 23, 4.0).alias("to_road"), part(13, 29, 4.0).alias("to_edge"), part(17, 101, 100.0).alias("density"), part(19, 97, 1.0).alias("garden_m2"), part(23, 89, 100.0).alias("canopy"), part(29, 83, 100.0).alias("tree_share"))


SCORE_IN = """, s AS (SELECT pin_id, garden_type, surface_type, score, (pin_id * 7 % 41)::DOUBLE / 2 AS to_building, (pin_id * 11 % 23)::DOUBLE / 4 AS to_road, (pin_id * 13 % 29)::DOUBLE / 4 AS to_edge,
  (pin_id * 17 % 101)::DOUBLE / 100 AS density, (pin_id * 19 % 97)::DOUBLE AS garden_m2, (pin_id * 23 % 89)::DOUBLE / 100 AS canopy, (pin_id * 29 % 83)::DOUBLE / 100 AS tree_share FROM pin)"""


def score_simple(spark, d):
    return score_inputs(spark, d).select("pin_id", r(scoring.simple_score(c("surface_type"), c("to_building"), c("to_road"))).alias("score"))


def score_graduated(spark, d):
    s = scoring.graduated_score(c("surface_type"), c("density"), c("garden_m2"), c("to_building"), c("to_road"), c("to_edge"), c("canopy"), c("tree_share"))
    return score_inputs(spark, d).select("pin_id", r(s).alias("score"))


def score_color(spark, d):
    return V.pins(spark, d).select("pin_id", scoring.score_band(c("score")).alias("band"), F.greatest(F.lit(4), F.floor(c("score") / 15)).cast("int").alias("marker"), F.when(c("score") <= 0, "N").otherwise(F.upper(F.substring("garden_type", 1, 1))).alias("prefix"))


def candidate_fallback(spark, d):
    """Of three ever wider rules, the first that leaves a building a candidate; among those the best score, first in order on ties."""
    s = score_inputs(spark, d).join(V.pins(spark, d).select("pin_id", "building_id"), "pin_id")
    attempt = F.when((c("to_edge") >= 1.5) & (c("to_road") >= 2), 1).when(c("to_edge") >= 1.5, 2).otherwise(3)
    s = s.withColumn("attempt", attempt)
    return spatial.nearest(s.select("building_id", "attempt", (-c("score")).alias("less"), "pin_id"), "building_id", "attempt", "less", "pin_id").select("building_id", "attempt", "pin_id", (-c("less")).alias("score"))


def centroid_place(spark, d):
    """The candidate nearest to the middle of those with at least half of the best score."""
    p = V.pins(spark, d).where("score > 0")
    best = p.groupBy("building_id").agg(F.max("score").alias("best"))
    good = p.join(best, "building_id").where(c("score") >= c("best") * 0.5)
    mid = good.groupBy("building_id").agg(F.avg("lat").alias("m_lat"), F.avg("lon").alias("m_lon"))
    good = good.join(mid, "building_id").withColumn("distance_m", r(_plane(c("lat"), c("lon"), c("m_lat"), c("m_lon")), 3))
    return spatial.nearest(good.select("building_id", "pin_id", "distance_m"), "building_id", "distance_m", "pin_id")


def no_garden_placeholder(spark, d):
    """Sides of a building without a pin of 45 points or more get one of score 0, 5 m from the centre along the direction to the nearest road
    (front) or away from it (back)."""
    sides = V.buildings(spark, d).select("building_id", F.explode(F.array(F.lit("front"), F.lit("back"))).alias("garden_type"))
    left = sides.join(V.pins(spark, d).where("score >= 45").select("building_id", "garden_type").distinct(), ["building_id", "garden_type"], "left_anti")
    road = nearest_segment(V.buildings(spark, d), V.roads(spark, d), "building_id").where("distance_m > 0.1")
    norm = F.sqrt(c("px") * c("px") + c("py") * c("py"))
    out = left.join(road, "building_id").withColumn("by", F.when(c("garden_type") == "front", 5.0).otherwise(-5.0))
    return out.select("building_id", "garden_type", r(c("lat") + c("by") * c("py") / norm / geo.M_PER_DEG).alias("lat"), r(c("lon") + c("by") * c("px") / norm / (geo.M_PER_DEG * F.cos(F.radians("lat")))).alias("lon"), F.lit(0.0).alias("score"), F.lit("no_garden").alias("surface_type"))


def eircode_normalise(spark, d):
    """Postcodes: trimmed, upper-cased, without blanks; seven characters split 3 + 4."""
    raw = F.concat(F.lit(" d"), F.lpad((c("c_custkey") % 30).cast("string"), 2, "0"), F.lit(" x"), F.lpad((c("c_custkey") % 1500).cast("string"), 3, "7"), F.when(c("c_custkey") % 11 == 0, "z").otherwise(" "))
    code = F.upper(F.replace(F.trim(raw), F.lit(" "), F.lit("")))
    return V.table(spark, d, "customer").select(c("c_custkey").alias("id"), code.alias("code"), (F.length(code) == 7).alias("valid"), F.substring(code, 1, 3).alias("routing"), F.substring(code, 4, 4).alias("unit"))


def coords_parse(spark, d):
    """'lat, lon' strings; what isn't two numbers has none."""
    text = F.when(c("building_id") % 7 == 0, F.lit("53.1; -6.2")).when(c("building_id") % 5 == 0, F.lit("abc, -6.2")).otherwise(F.concat(F.lit(" 53."), (c("building_id") % 1000).cast("string"), F.lit(" , -6."), (c("building_id") % 77).cast("string")))
    parts = F.split(text, ",")
    num = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    ok = (F.size(parts) == 2) & num(0).isNotNull() & num(1).isNotNull()
    return V.buildings(spark, d).select("building_id", ok.alias("valid"), F.when(ok, num(0)).alias("lat"), F.when(ok, num(1)).alias("lon"))


QUERIES = {f.__name__: f for f in (circle_count_area, bbox_slice, haversine_topk, equirect_within, slippy_tiles, tile_bounds, tiles_for_radius, zoom_options, recommended_zoom, utm_project, polygon_area_centroid, point_in_polygon, building_type_filter, small_area_filter, front_roads, residential_regex, tag_split, exclusion_union, dedup_first, nearest_road, nearest_driveway_25m, address_road_direction, neighbour_knn10, range_pairs_20m, neighbour_agreement, containing_or_nearest, not_nearest_anti, zone_semi, chunk_assign, source_compare, pins_filtered, pins_by_type, attempt_hist, catalog_stats, class_stats, last_pin_per_building, front_back_pivot, front_back_swap, nearest_building_pins, point_classify_30m, cache_covering, cache_overlap, cache_circle_in_circle, cache_downscale, cache_estimate, evict_oldest, ttl_filter, score_simple, score_graduated, score_color, candidate_fallback, centroid_place, no_garden_placeholder, eircode_normalise, coords_parse)}


def pair_sql(a, b):
    return f"round(sqrt(power(({a}.lon - {b}.lon) * 111320::DOUBLE * cos(radians(({a}.lat + {b}.lat) / 2)), 2) + power(({a}.lat - {b}.lat) * 111320::DOUBLE, 2)), 4)"


B = geo.circle_box(LAT, LON, RADIUS)
IN_BOX = f"xmax >= {B['xmin']!r}::DOUBLE AND xmin <= {B['xmax']!r}::DOUBLE AND ymax >= {B['ymin']!r}::DOUBLE AND ymin <= {B['ymax']!r}::DOUBLE"
TX, TY = "floor((lon + 180) / 360 * power(2, {z}))::BIGINT", "floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * power(2, {z}))::BIGINT"
MPP = "(156543.03392::DOUBLE / power(2, {z}) * cos(radians(lat)))"
BOXED = """, e AS (SELECT *, lon - radius_m / 111320::DOUBLE / cos(radians(lat)) AS xmin, lon + radius_m / 111320::DOUBLE / cos(radians(lat)) AS xmax, lat - radius_m / 111320::DOUBLE AS ymin, lat + radius_m / 111320::DOUBLE AS ymax FROM area)"""
QUOTED = ", ".join(f"'{x}'" for x in OUTBUILDINGS)
LASTP = ", lp AS (SELECT * FROM pin QUALIFY row_number() OVER (PARTITION BY building_id, garden_type ORDER BY pin_id DESC) = 1)"
PIV = LASTP + """, pv AS (SELECT building_id, f.pin_id AS front_pin_id, b.pin_id AS back_pin_id, f.score AS front_score, b.score AS back_score, f.lat AS front_lat, f.lon AS front_lon, b.lat AS back_lat, b.lon AS back_lon
  FROM (SELECT * FROM lp WHERE garden_type = 'front') f FULL JOIN (SELECT * FROM lp WHERE garden_type = 'back') b USING (building_id))"""

ORACLES = {
    "circle_count_area": oracle("bld", f"SELECT {LAT}::DOUBLE AS latitude, {LON}::DOUBLE AS longitude, {RADIUS}::DOUBLE AS radius_m, count(*) AS building_count, round(coalesce(sum(w_m * h_m), 0), 2) AS total_area_sqm, round(coalesce(avg(w_m * h_m), 0), 2) AS avg_building_area_sqm FROM bld WHERE {BOX_DIST} <= {RADIUS}"),
    "bbox_slice": oracle("bld", f"SELECT building_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM bld WHERE {IN_BOX}"),
    "haversine_topk": oracle("bld", f"SELECT building_id, round(m, 3) AS distance_m FROM (SELECT building_id, {hav_sql('lat', 'lon', f'{LAT}::DOUBLE', f'({LON})::DOUBLE')} AS m FROM bld) ORDER BY m, building_id LIMIT 50"),
    "equirect_within": oracle("pin", f"SELECT pin_id, round(m, 3) AS distance_m FROM (SELECT pin_id, {flat_sql('lat', 'lon', f'{LAT}::DOUBLE', f'({LON})::DOUBLE')} AS m FROM pin) WHERE m <= 250"),
    "slippy_tiles": oracle("bld", f"SELECT building_id, z::INT AS zoom, {TX.format(z='z')} AS tile_x, {TY.format(z='z')} AS tile_y FROM bld, (VALUES (12), (15), (17), (19)) t(z)"),
    "tile_bounds": oracle("area", """SELECT area_id, tile_x, tile_y, round(tile_x / power(2, zoom) * 360 - 180, 6) AS west, round((tile_x + 1) / power(2, zoom) * 360 - 180, 6) AS east,
      round(degrees(atan(sinh(pi() * (1 - 2 * tile_y / power(2, zoom))))), 6) AS north, round(degrees(atan(sinh(pi() * (1 - 2 * (tile_y + 1) / power(2, zoom))))), 6) AS south FROM t""",
      f", t AS (SELECT area_id, zoom, {TX.format(z='zoom')} AS tile_x, {TY.format(z='zoom')} AS tile_y FROM area)"),
    "tiles_for_radius": oracle("area", "SELECT area_id, tx + i AS tile_x, ty + j AS tile_y FROM t, range(-40, 41) a(i), range(-40, 41) b(j) WHERE abs(i) <= n AND abs(j) <= n",
      f", t AS (SELECT area_id, greatest(1, ceil(radius_m / {MPP.format(z='zoom')} / 256))::BIGINT AS n, {TX.format(z='zoom')} AS tx, {TY.format(z='zoom')} AS ty FROM area)"),
    "zoom_options": oracle("area", """SELECT radius_m, zoom::INT AS zoom, grid::INT AS grid, (grid * grid)::INT AS tiles, (grid * 256)::INT AS side_px,
      CASE WHEN grid * grid * 0.05::DOUBLE < 60 THEN '~' || trunc(grid * grid * 0.05::DOUBLE)::BIGINT || ' seconds' WHEN grid * grid * 0.05::DOUBLE < 3600 THEN '~' || trunc(grid * grid * 0.05::DOUBLE / 60)::BIGINT || ' minutes' ELSE '~' || printf('%.1f', grid * grid * 0.05::DOUBLE / 3600) || ' hours' END AS eta, zoom = auto AS is_default FROM g""",
      """, u AS (SELECT radius_m, max(z) AS auto FROM (SELECT DISTINCT radius_m FROM area), range(1, 21) t(z) WHERE radius_m / (40075016.686::DOUBLE / 256 / power(2, z)) < 400 GROUP BY radius_m),
      g AS (SELECT radius_m, auto, zoom, least(100, greatest(5, 5 * power(2, zoom - auto))) AS grid FROM u, range(1, 19) t(zoom) WHERE zoom BETWEEN least(auto, 18) AND least(auto + 4, 18))"""),
    "recommended_zoom": oracle("area", f"SELECT area_id, coalesce(max(z) FILTER ((2 * greatest(1, ceil(radius_m * 20 / {MPP.format(z='z')} / 256)) + 1) * 256 <= 18000), 15)::INT AS zoom FROM area, range(15, 20) t(z) GROUP BY area_id"),
    "utm_project": utm_sql(),
    "polygon_area_centroid": oracle("bld", "SELECT building_id, round(w_m * h_m, 3) AS area_m2, round(w_m / 2, 3) AS cx, round(h_m / 2, 3) AS cy, round(xmax, 6) AS xmax, round(ymin, 6) AS ymin FROM bld"),
    "point_in_polygon": oracle("bld pin", "SELECT pin_id, b.building_id FROM pin p JOIN bld b ON p.lon BETWEEN xmin AND xmax AND p.lat BETWEEN ymin AND ymax"),
    "building_type_filter": oracle("bld", f"SELECT building_id, building FROM bld WHERE building IS NULL OR building NOT IN ({QUOTED})"),
    "small_area_filter": oracle("bld", "SELECT building_id, w_m * h_m / 2 AS area_m2 FROM bld WHERE (w_m * h_m / 2 > 30 OR NOT EXISTS (SELECT 1 FROM bld WHERE w_m * h_m / 2 > 30)) AND w_m * h_m / 2 * 0.7::DOUBLE >= 30"),
    "front_roads": oracle("road", f"SELECT road_id, trim(name) AS name FROM road WHERE list_has_any(highway, [{', '.join(repr(x) for x in FRONT_ROADS)}])"),
    "residential_regex": oracle("bld", f"SELECT building_id, building FROM bld WHERE regexp_matches(building, '{DWELLINGS}')"),
    "tag_split": """SELECT 'buildings' AS branch, count(*) AS n FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'roads', count(*) FROM part WHERE p_type LIKE '%BRASS' UNION ALL SELECT 'driveways', count(*) FROM part WHERE p_type LIKE '%STEEL' AND p_brand LIKE 'Brand#1%'
      UNION ALL SELECT 'addresses', count(*) FROM part WHERE p_brand IS NOT NULL AND p_size > 25 UNION ALL SELECT 'boundaries', count(*) FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33', 'Brand#44')""",
    "exclusion_union": "SELECT p_partkey, 'landuse' AS exclusion_type FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'leisure' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'natural' FROM part WHERE p_size % 7 = 0",
    "dedup_first": oracle("prog", "SELECT task_id, seq, status FROM prog QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq) = 1"),
    "nearest_road": oracle("bld road", f"SELECT building_id, road_id, distance_m FROM ad {NEAREST}", f", {ANY}"),
    "nearest_driveway_25m": oracle("bld road", "SELECT building_id, road_id, edge_m AS distance_m FROM dw WHERE edge_m < 25 QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY edge_m, road_id) = 1", DRIVE),
    "address_road_direction": oracle("bld road", """SELECT building_id, road_id, distance_m, round(px / sqrt(px * px + py * py), 5) AS ux, round(py / sqrt(px * px + py * py), 5) AS uy
      FROM (SELECT *, ax + t * (ex - ax) AS px, ay + t * (ey - ay) AS py FROM sd WHERE distance_m < 150 AND distance_m > 0.1) QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY distance_m, road_id) = 1""", f", {SEG}"),
    "neighbour_knn10": oracle("bld", "SELECT building_id, other, distance_m, row_number() OVER (PARTITION BY building_id ORDER BY distance_m, other)::INT AS rank FROM nb WHERE distance_m <= 40 QUALIFY rank <= 10", NB),
    "range_pairs_20m": oracle("bld", "SELECT building_id, other, distance_m FROM nb WHERE distance_m <= 20", NB),
    "neighbour_agreement": oracle("bld", "SELECT building_id, count(*) FILTER (building = other_building) AS agree, count(*) FILTER (building <> other_building) AS disagree, count(*) FILTER (building <> other_building) >= 2 AND count(*) FILTER (building = other_building) = 0 AS flip FROM nb WHERE distance_m <= 20 AND building IS NOT NULL AND other_building IS NOT NULL GROUP BY building_id", NB),
    "containing_or_nearest": oracle("bld area", """SELECT building_id, area_id, m > radius_m AS outside FROM m WHERE m <= radius_m + 900
      QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY m > radius_m, CASE WHEN m > radius_m THEN m - radius_m ELSE radius_m END, area_id) = 1""", f", m AS (SELECT b.building_id, a.area_id, a.radius_m, round({pair_sql('b', 'a')[6:-4]}, 3) AS m FROM bld b, area a)"),
    "not_nearest_anti": oracle("bld pin", "SELECT pin_id, own_m FROM o WHERE NOT EXISTS (SELECT 1 FROM bld b WHERE b.building_id <> o.building_id AND " + pair_sql("o", "b") + " < o.own_m * 1.5)",
      f", o AS (SELECT p.*, {pair_sql('p', 'b')} AS own_m FROM pin p JOIN bld b USING (building_id))"),
    "zone_semi": oracle("pin", "SELECT pin_id, building_id, surface_type FROM pin WHERE (building_id, surface_type) IN (SELECT (building_id, surface_type) FROM pin WHERE score >= 90)"),
    "chunk_assign": oracle("bld area", """SELECT area_id, i::INT AS i, j::INT AS j, building_id, floor(x / 500) = i AND floor(y / 500) = j AS own FROM g JOIN p USING (area_id)
      WHERE floor((x + w_m / 2 + 100) / 500) >= i AND floor((x - w_m / 2 - 100) / 500) <= i AND floor((y + h_m / 2 + 100) / 500) >= j AND floor((y - h_m / 2 - 100) / 500) <= j""",
      f""", g AS (SELECT area_id, i, j FROM area, range(-3, 3) a(i), range(-3, 3) b(j) WHERE i BETWEEN -ceil(radius_m / 500) AND ceil(radius_m / 500) - 1 AND j BETWEEN -ceil(radius_m / 500) AND ceil(radius_m / 500) - 1
        AND power(greatest(i * 500, least(0, i * 500 + 500)), 2) + power(greatest(j * 500, least(0, j * 500 + 500)), 2) <= radius_m * radius_m),
      p AS (SELECT building_id, w_m, h_m, area_id, round((b.lon - a.lon) * 111320::DOUBLE * cos(radians(a.lat)), 4) AS x, round((b.lat - a.lat) * 111320::DOUBLE, 4) AS y FROM bld b, area a)"""),
    "source_compare": "SELECT a AS first_count, b AS second_count, a - b AS difference, printf('first found %+d more buildings (%+.1f%%)', a - b, round((a - b) / b::DOUBLE * 100, 1)) AS comparison FROM (SELECT (SELECT count(*) FROM customer) AS a, (SELECT count(*) FROM supplier) AS b)",
    "pins_filtered": oracle("pin area", f"SELECT area_id, count(*) AS n, round(avg(score), 4) AS avg_score FROM pin p JOIN area a ON {hav_sql('p.lat', 'p.lon', 'a.lat', 'a.lon')} <= radius_m WHERE garden_type = 'front' AND score >= 40 GROUP BY area_id"),
    "pins_by_type": oracle("pin", "SELECT garden_type, surface_type, count(*) AS n, count(*) FILTER (score = 0) AS no_garden, round(avg(score), 4) AS avg_score FROM pin GROUP BY ALL"),
    "attempt_hist": oracle("pin", "SELECT attempt, n, round(CASE WHEN attempt > 0 THEN n * 100 / (SELECT count(*)::DOUBLE FROM pin WHERE pin_id % 4 > 0) END, 4) AS pct FROM (SELECT pin_id % 4 AS attempt, count(*) AS n FROM pin GROUP BY 1)"),
    "catalog_stats": oracle("area", "SELECT count(*) AS areas, sum(bytes)::BIGINT AS bytes, round(sum(bytes) / 1048576::DOUBLE, 4) AS mb, count(DISTINCT radius_m) AS radii, max(created_at) AS latest FROM (SELECT *, (radius_m * 160)::BIGINT AS bytes FROM area)"),
    "class_stats": oracle("pin", "SELECT building_id, front, back, round(front * 100::DOUBLE / (front + back), 4) AS front_pct FROM (SELECT building_id, count(*) FILTER (garden_type = 'front') AS front, count(*) FILTER (garden_type = 'back') AS back FROM pin GROUP BY 1)"),
    "last_pin_per_building": oracle("pin", "SELECT building_id, garden_type, pin_id, score FROM lp", LASTP),
    "front_back_pivot": oracle("pin", "SELECT building_id, front_pin_id, back_pin_id, front_score, back_score FROM pv", PIV),
    "front_back_swap": oracle("bld road pin", "SELECT building_id, swap, CASE WHEN swap THEN back_pin_id ELSE front_pin_id END AS front_pin_id FROM (SELECT *, f > b * 1.05::DOUBLE OR (ap < 8 AND b <= f) AS swap FROM w)",
      f"""{PIV}, {seg_sql('pd', 'lp', 'road', 'pin_id')}, nr AS (SELECT pin_id, min(distance_m) AS m FROM pd GROUP BY pin_id),
      w AS (SELECT building_id, front_pin_id, back_pin_id, x.m AS f, y.m AS b, {pair_sql('x', 'y').replace('x.l', 'front_l').replace('y.l', 'back_l')} AS ap FROM pv JOIN nr x ON x.pin_id = front_pin_id JOIN nr y ON y.pin_id = back_pin_id)"""),
    "nearest_building_pins": oracle("pin area", "SELECT area_id, building_id, m AS distance_m FROM m QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY m, building_id) = 1", f", p AS (SELECT building_id, avg(lat) AS lat, avg(lon) AS lon FROM pin GROUP BY 1), m AS (SELECT area_id, building_id, round({pair_sql('a', 'p')[6:-4]}, 3) AS m FROM area a, p)"),
    "point_classify_30m": oracle("pin area", "SELECT area_id, pin_id, coalesce(garden_type, 'out_of_bounds') AS classification FROM area LEFT JOIN (SELECT * FROM m WHERE m <= 30 QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY m, pin_id) = 1) USING (area_id)", f", m AS (SELECT area_id, pin_id, garden_type, round({pair_sql('a', 'p')[6:-4]}, 3) AS m FROM area a, pin p)"),
    "cache_covering": oracle("area", "SELECT a.area_id, b.area_id AS covering FROM e a, e b WHERE a.area_id <> b.area_id AND b.xmin <= a.xmin AND b.xmax >= a.xmax AND b.ymin <= a.ymin AND b.ymax >= a.ymax", BOXED),
    "cache_overlap": oracle("area", "SELECT a.area_id, b.area_id AS other FROM e a, e b WHERE a.area_id < b.area_id AND NOT (b.xmin > a.xmax OR b.xmax < a.xmin OR b.ymin > a.ymax OR b.ymax < a.ymin)", BOXED),
    "cache_circle_in_circle": oracle("area", "SELECT x AS area_id, y AS covering, round(m, 3) AS distance_m FROM m WHERE m + r1 <= r2", f", m AS (SELECT a.area_id AS x, b.area_id AS y, a.radius_m AS r1, b.radius_m AS r2, round({hav_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS m FROM area a, area b WHERE a.area_id <> b.area_id)"),
    "cache_downscale": oracle("pin area", f"SELECT asked, want_m, area_id, count(*) FILTER (m <= want_m) AS n_pins, coalesce(sum(score) FILTER (m <= want_m), 0) AS score, count(*) AS uncut FROM (SELECT s.*, p.score, round({flat_sql('p.lat', 'p.lon', 's.lat', 's.lon')}, 4) AS m FROM s, pin p) WHERE m <= radius_m GROUP BY ALL",
      f", s AS (SELECT q.area_id AS asked, want_m, a.* FROM area q, (VALUES (100::DOUBLE), (250::DOUBLE), (450::DOUBLE)) v(want_m), area a WHERE {flat_sql('q.lat', 'q.lon', 'a.lat', 'a.lon')} < 1 AND a.radius_m > want_m QUALIFY row_number() OVER (PARTITION BY q.area_id, want_m ORDER BY a.radius_m, a.area_id) = 1)"),
    "cache_estimate": oracle("area", "SELECT area_id, round(km2, 2) AS area_km2, n AS estimated_buildings, n * 160 AS estimated_size_bytes, round(n * 160 / 1048576::DOUBLE, 2) AS estimated_size_mb FROM (SELECT *, floor(round(km2, 9) * 200)::BIGINT AS n FROM k)", BOXED + ", k AS (SELECT area_id, abs((ymax - ymin) * 111.32::DOUBLE * (xmax - xmin) * 111.32::DOUBLE * cos(radians((ymin + ymax) / 2))) AS km2 FROM e)"),
    "evict_oldest": oracle("prog", "SELECT task_id, max(seq) AS seq FROM prog GROUP BY task_id ORDER BY seq DESC LIMIT 50"),
    "ttl_filter": oracle("prog", "SELECT task_id, seq FROM prog WHERE ts > (SELECT max(ts) FROM prog) - INTERVAL 1 DAY"),
    "score_simple": oracle("pin", "SELECT pin_id, round(greatest(0, least(100, base + reach + street, CASE WHEN surface_type = 'grass' THEN 100 ELSE base END))::DOUBLE, 6) AS score FROM (SELECT *, CASE surface_type WHEN 'grass' THEN 100 WHEN 'driveway' THEN 75 WHEN 'paved' THEN 60 WHEN 'car_parking' THEN 50 ELSE 30 END AS base, CASE WHEN to_building < 2 THEN -20 WHEN to_building > 15 THEN -least(30, (to_building - 15) * 2) ELSE 0 END AS reach, CASE WHEN to_road < 2 THEN -15 ELSE 0 END AS street FROM s)", SCORE_IN),
    "score_graduated": oracle("pin", """SELECT pin_id, round(greatest(0::DOUBLE, least(top::DOUBLE, start + reach + street - border - trees)), 6) AS score FROM (SELECT pin_id,
      CASE surface_type WHEN 'grass' THEN 70 + least(15::DOUBLE, density * 25) + least(10::DOUBLE, garden_m2 / 5) WHEN 'driveway' THEN 60::DOUBLE ELSE 40::DOUBLE END AS start, CASE surface_type WHEN 'grass' THEN 100 WHEN 'driveway' THEN 75 ELSE 60 END AS top,
      CASE WHEN to_building < 2 THEN -15 WHEN to_building < 5 THEN 5 WHEN to_building < 10 THEN 2 WHEN to_building > 15 THEN -least(20::DOUBLE, (to_building - 15) * 3) ELSE 0 END AS reach, CASE WHEN to_road < 2 THEN -10 ELSE 0 END AS street,
      CASE WHEN to_edge < 4 THEN least(20::DOUBLE, (4 - to_edge) * 7) ELSE 0 END AS border,
      CASE WHEN surface_type = 'grass' THEN least(50::DOUBLE, CASE WHEN canopy > 0.2::DOUBLE THEN least(35::DOUBLE, (canopy - 0.2::DOUBLE) * 70) ELSE 0 END + CASE WHEN tree_share > 0.4::DOUBLE THEN least(25::DOUBLE, (tree_share - 0.4::DOUBLE) * 50) ELSE 0 END) ELSE 0 END AS trees FROM s)""", SCORE_IN),
    "score_color": oracle("pin", "SELECT pin_id, CASE WHEN score <= 0 THEN 'none' WHEN score < 40 THEN 'poor' WHEN score < 60 THEN 'fair' WHEN score < 75 THEN 'good' WHEN score < 90 THEN 'very good' ELSE 'excellent' END AS band, greatest(4, trunc(score / 15))::INT AS marker, CASE WHEN score <= 0 THEN 'N' ELSE upper(garden_type[1]) END AS prefix FROM pin"),
    "candidate_fallback": oracle("pin", "SELECT building_id, attempt, pin_id, score FROM (SELECT p.building_id, s.pin_id, s.score, CASE WHEN to_edge >= 1.5 AND to_road >= 2 THEN 1 WHEN to_edge >= 1.5 THEN 2 ELSE 3 END AS attempt FROM s JOIN pin p USING (pin_id)) QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY attempt, score DESC, pin_id) = 1", SCORE_IN),
    "centroid_place": oracle("pin", "SELECT building_id, pin_id, distance_m FROM (SELECT a.building_id, pin_id, round(" + pair_sql("a", "b")[6:-4] + ", 3) AS distance_m FROM g a JOIN mid b USING (building_id)) QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY distance_m, pin_id) = 1",
      ", g AS (SELECT * FROM pin WHERE score > 0 QUALIFY score >= max(score) OVER (PARTITION BY building_id) * 0.5), mid AS (SELECT building_id, avg(lat) AS lat, avg(lon) AS lon FROM g GROUP BY 1)"),
    "no_garden_placeholder": oracle("bld road pin", "SELECT building_id, garden_type, round(lat + s * py / sqrt(px * px + py * py) / 111320::DOUBLE, 6) AS lat, round(lon + s * px / sqrt(px * px + py * py) / (111320::DOUBLE * cos(radians(lat))), 6) AS lon, 0::DOUBLE AS score, 'no_garden' AS surface_type FROM n, (VALUES ('front', 5), ('back', -5)) v(garden_type, s) WHERE (building_id, garden_type) NOT IN (SELECT (building_id, garden_type) FROM pin WHERE score >= 45)",
      f", {ANY}, n AS (SELECT *, ax + t * (ex - ax) AS px, ay + t * (ey - ay) AS py FROM (SELECT * FROM ad {NEAREST}) WHERE distance_m > 0.1)"),
    "eircode_normalise": """SELECT id, code, length(code) = 7 AS valid, substr(code, 1, 3) AS routing, substr(code, 4, 4) AS unit FROM (SELECT c_custkey AS id, upper(replace(trim(' d' || lpad((c_custkey % 30)::VARCHAR, 2, '0') || ' x' || lpad((c_custkey % 1500)::VARCHAR, 3, '7') || CASE WHEN c_custkey % 11 = 0 THEN 'z' ELSE ' ' END), ' ', '')) AS code FROM customer)""",
    "coords_parse": oracle("bld", """SELECT building_id, ok AS valid, CASE WHEN ok THEN a END AS lat, CASE WHEN ok THEN b END AS lon FROM (SELECT building_id, a, b, len(p) = 2 AND a IS NOT NULL AND b IS NOT NULL AS ok FROM (SELECT building_id, p, try_cast(trim(p[1]) AS DOUBLE) AS a, try_cast(trim(p[2]) AS DOUBLE) AS b FROM t))""",
      ", t AS (SELECT building_id, string_split(CASE WHEN building_id % 7 = 0 THEN '53.1; -6.2' WHEN building_id % 5 = 0 THEN 'abc, -6.2' ELSE ' 53.' || (building_id % 1000) || ' , -6.' || (building_id % 77) END, ',') AS p FROM bld)"),
}
