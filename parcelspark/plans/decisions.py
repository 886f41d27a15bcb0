"""Queries of the front/back decisions: directions, sides, corrections and placement."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelspark.functions import geo
from parcelspark.operators import raster as R
from parcelspark.operators import spatial
from parcelspark.operators.sequence import in_turn
from parcelspark.operators.tables import cut
from parcelspark.plans import vector as X
from parcelspark.plans.raster import EXG, VEG, box_sql, components_sql, size, source_sql
from parcelspark.sources import views as V
from parcelspark.sources.views import oracle

c = F.col
r = F.round

#: Postcode routing keys and a point of each.
ROUTING = {
    "D01": (53.3498, -6.2603), "D02": (53.3382, -6.2591), "D03": (53.3601, -6.2294), "D04": (53.3244, -6.2297), "D05": (53.3697, -6.2131), "D06": (53.3209, -6.2654),
    "D6W": (53.3102, -6.2878), "D07": (53.3567, -6.2817), "D08": (53.3387, -6.2928), "D09": (53.3782, -6.2334), "D10": (53.3519, -6.3249), "D11": (53.3867, -6.2842),
    "D12": (53.3189, -6.3172), "D13": (53.3923, -6.1968), "D14": (53.2978, -6.2478), "D15": (53.3879, -6.3892), "D16": (53.2858, -6.2108), "D17": (53.4012, -6.1521),
    "D18": (53.2689, -6.1789), "D20": (53.3492, -6.3678), "D22": (53.3189, -6.3892), "D24": (53.2889, -6.3892),
}
#: The box of the country.
COUNTRY = (51.3, 55.5, -10.7, -5.3)


def directions(spark, d):
    """building_id, ux, uy, source of the first that there is: the nearest segment of the own street within 150 m (address), the
    nearest driveway within 25 m of the footprint's edge (driveway), the nearest road (road). None is nearer than 0.1 m."""
    keep = ("building_id", "px", "py", "distance_m", "source")
    street = X.street_road(spark, d).withColumn("source", F.lit("address")).select(*keep)
    drive = X.nearest_driveway(spark, d, least_m=0.1).withColumn("source", F.lit("driveway")).select(*keep)
    road = X.nearest_segment(V.buildings(spark, d), V.roads(spark, d), "building_id").where("distance_m > 0.1").withColumn("source", F.lit("road")).select(*keep)
    first = F.min_by(F.struct("px", "py", "source"), F.when(c("source") == "address", 1).when(c("source") == "driveway", 2).otherwise(3))
    best = street.unionByName(drive).unionByName(road).groupBy("building_id").agg(first.alias("b")).select("building_id", "b.*")
    norm = F.sqrt(c("px") * c("px") + c("py") * c("py"))
    return best.select("building_id", r(c("px") / norm, 5).alias("ux"), r(c("py") / norm, 5).alias("uy"), "source")


DIR = X.DRIVE + f""", {X.SEG}, {X.ANY}, dq AS (SELECT * FROM (SELECT building_id, ax + t * (ex - ax) AS px, ay + t * (ey - ay) AS py, 1 AS k, 'address' AS source, distance_m AS m, road_id FROM sd WHERE distance_m < 150 AND distance_m > 0.1
   UNION ALL SELECT building_id, px, py, 2, 'driveway', edge_m, road_id FROM dw WHERE edge_m < 25 AND distance_m > 0.1
   UNION ALL SELECT building_id, ax + t * (ex - ax), ay + t * (ey - ay), 3, 'road', distance_m, road_id FROM (SELECT * FROM ad {X.NEAREST}) WHERE distance_m > 0.1) QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY k, m, road_id) = 1),
 dir AS (SELECT building_id, round(px / sqrt(px * px + py * py), 5) AS ux, round(py / sqrt(px * px + py * py), 5) AS uy, source FROM dq)"""


def front_direction(spark, d):
    return directions(spark, d)


def pin_offsets(spark, d):
    """Pins with their place in metres from the building's centre and the building's direction."""
    p = V.pins(spark, d).join(V.buildings(spark, d).select("building_id", c("lat").alias("b_lat"), c("lon").alias("b_lon"), "w_m", "h_m"), "building_id")
    x, y = geo.metres(c("lat"), c("lon"), c("b_lat"), c("b_lon"))
    return p.select("pin_id", "building_id", "garden_type", "score", "w_m", "h_m", r(x, 4).alias("x"), r(y, 4).alias("y")).join(directions(spark, d), "building_id")


OFF = DIR + """, off AS (SELECT p.pin_id, p.building_id, p.garden_type, p.score, w_m, h_m, round((p.lon - b.lon) * 111320::DOUBLE * cos(radians(b.lat)), 4) AS x, round((p.lat - b.lat) * 111320::DOUBLE, 4) AS y, ux, uy FROM pin p JOIN bld b USING (building_id) JOIN dir USING (building_id))"""


def correct_side(spark, d):
    """Front pins must not lie behind (dot > -0.3), back pins not before (dot < 0.3); within 1 m of the centre anything goes."""
    m = F.sqrt(c("x") * c("x") + c("y") * c("y"))
    dot = (c("x") * c("ux") + c("y") * c("uy")) / m
    ok = F.when(m < 1, F.lit(True)).when(c("garden_type") == "front", dot > -0.3).otherwise(dot < 0.3)
    return pin_offsets(spark, d).select("pin_id", ok.alias("ok"))


def lateral_corridor(spark, d):
    """Pins whose place along the front lies within the footprint's own span, 3 m more on either side."""
    half = (F.abs(c("uy")) * c("w_m") + F.abs(c("ux")) * c("h_m")) / 2
    return pin_offsets(spark, d).where(F.abs(-c("uy") * c("x") + c("ux") * c("y")) <= r(half + 3, 4)).select("pin_id")


def outlier_fix_round(spark, d):
    """Directions that oppose (dot < -0.7) the mean (longer than 0.6) of at least four of the ten nearest neighbours within 40 m take the
    mean, in tables of more than ten buildings; one round, all reading the state before."""
    dirs = directions(spark, d).select("building_id", "ux", "uy")
    near = X.neighbour_knn10(spark, d).join(dirs.toDF("other", "ox", "oy"), "other")
    mean = near.groupBy("building_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ox").alias("mx"), F.avg("oy").alias("my"))
    many = V.buildings(spark, d).agg((F.count(F.lit(1)) > 10).alias("many"))
    df = dirs.join(mean, "building_id").withColumn("norm", F.sqrt(c("mx") * c("mx") + c("my") * c("my"))).crossJoin(F.broadcast(many))  # one row
    return df.where(c("many") & (c("n") >= 4) & (c("norm") > 0.6) & ((c("ux") * c("mx") + c("uy") * c("my")) / c("norm") < -0.7)).select("building_id", r(c("mx") / c("norm"), 4).alias("ux"), r(c("my") / c("norm"), 4).alias("uy"))


def fix_outliers(dirs, links):
    """building_id and new direction of the buildings that oppose (dot < -0.7) the mean (longer than 0.6) of at least four neighbours (links:
    building_id, other), one after the other in place; directions by address or driveway stand, and so do tables of ten buildings or fewer."""

    def decide(rows, seen):
        mean = seen.groupBy("building_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("ux"), 9).alias("mx"), r(F.avg("uy"), 9).alias("my"))
        df = rows.join(mean, "building_id").withColumn("norm", F.sqrt(c("mx") * c("mx") + c("my") * c("my")))
        df = df.where(~c("source").isin("address", "driveway") & (c("n") >= 4) & (c("norm") > 0.6) & (r((c("ux") * c("mx") + c("uy") * c("my")) / c("norm"), 9) < -0.7))
        return df.select("building_id", r(c("mx") / c("norm"), 9).alias("ux"), r(c("my") / c("norm"), 9).alias("uy"))

    if dirs.count() <= 10:
        return dirs.select("building_id", "ux", "uy").limit(0)
    return in_turn(dirs, links, "building_id", ("ux", "uy"), decide)


def outlier_fix(spark, d):
    """Directions after one pass over the buildings in their order: neighbours are the nine nearest within 40 m."""
    links = X.nearest_neighbours(spark, d, 9).where("distance_m < 40").select("building_id", "other")  # the furthest ranks last
    return fix_outliers(directions(spark, d).select("building_id", "ux", "uy", "source"), links).select("building_id", r("ux", 4).alias("ux"), r("uy", 4).alias("uy"))


def flip_by_neighbours(dirs, links):
    """building_id of the buildings whose two pins change labels: two or more neighbours face another way (dot <= 0) and none the same, one after the
    other in place; a building that is `fixed` stands."""

    def decide(rows, seen):
        near = seen.select("building_id", c("dx").alias("ox"), c("dy").alias("oy")).join(rows, "building_id")
        same = r(c("dx") * c("ox") + c("dy") * c("oy"), 9) > 0
        flips = near.where(~c("fixed")).groupBy("building_id").agg(F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree")).where("disagree >= 2 and agree = 0")
        return rows.join(flips, "building_id").select("building_id", (-c("dx")).alias("dx"), (-c("dy")).alias("dy"))

    return in_turn(dirs, links, "building_id", ("dx", "dy"), decide).select("building_id")


def neighbour_flips(spark, d):
    """Buildings of which both pins have a score, from the back pin to the front one; neighbours are within 20 m, middle to middle. Labels that the
    address has put right stand."""
    df = X.pivoted(spark, d).where("front_score > 0 and back_score > 0")
    x, y = geo.plane(c("front_lat"), c("front_lon"), c("back_lat"), c("back_lon"))
    df = df.withColumns({"n": F.sqrt(x * x + y * y), "lat": (c("front_lat") + c("back_lat")) / 2, "lon": (c("front_lon") + c("back_lon")) / 2}).where("n > 0.0001")
    dirs = cut(df.select("building_id", "lat", "lon", r(x / c("n"), 9).alias("dx"), r(y / c("n"), 9).alias("dy")))
    far = r(X._plane(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 4)
    # a building is compared with later ones as they were: one of these that faces the same way keeps it as it is, so it needs no other links
    same = (c("r_building_id") > c("building_id")) & (r(c("dx") * c("r_dx") + c("dy") * c("r_dy"), 9) > 0)
    kept = spatial.with_any(dirs.withColumn("reach_m", F.lit(20.0)), dirs, "building_id", "reach_m", far, same)
    near = spatial.range_join(dirs.join(kept, "building_id", "left_anti"), dirs.select("building_id", "lat", "lon"), 20.0, far).where("building_id <> r_building_id")
    put_right = address_label_fix(spark, d).withColumn("fixed", F.lit(True))
    dirs = dirs.join(put_right, "building_id", "left").select("building_id", "dx", "dy", F.coalesce("fixed", F.lit(False)).alias("fixed"))
    return flip_by_neighbours(dirs, near.select("building_id", c("r_building_id").alias("other")))


def road_verify(spark, d):
    """Directions by address that point away (dot < 0.3) from the nearest road of all take the direction to that."""
    best = X.nearest_segment(V.buildings(spark, d), V.roads(spark, d), "building_id").where("distance_m > 0.1")
    norm = F.sqrt(c("px") * c("px") + c("py") * c("py"))
    df = best.select("building_id", "road_id", r(c("px") / norm, 4).alias("vx"), r(c("py") / norm, 4).alias("vy")).join(directions(spark, d), "building_id")
    return df.where((c("source") == "address") & (c("ux") * c("vx") + c("uy") * c("vy") < 0.3)).select("building_id", "road_id", c("vx").alias("ux"), c("vy").alias("uy"))


def front_of_other_anti(spark, d):
    """Back pins less those in front of another building: within 12 m of it, in the direction that it faces (dot > 0.5)."""
    p = V.pins(spark, d).where("garden_type = 'back'").select("pin_id", "building_id", "lat", "lon")
    b = V.buildings(spark, d).select("building_id", "lat", "lon").join(directions(spark, d), "building_id")
    x, y = geo.metres(c("lat"), c("lon"), c("r_lat"), c("r_lon"))
    before = (c("building_id") != c("r_building_id")) & (c("distance_m") > 0.001) & (r((x * c("r_ux") + y * c("r_uy")) / c("distance_m"), 4) > 0.5)
    far = r(geo.equirectangular(c("lat"), c("lon"), c("r_lat"), c("r_lon")), 4)
    near = spatial.with_any(p.withColumn("reach_m", F.lit(12.0)), b, "pin_id", "reach_m", far, before)
    return p.join(near, "pin_id", "left_anti").select("pin_id")


def same_side_detect(spark, d):
    """Buildings whose two pins lie within 8 m of each other, and which one keeps its place: the better score, front on ties."""
    df = X.pivoted(spark, d).where("front_pin_id is not null and back_pin_id is not null")
    m = r(X._plane(c("front_lat"), c("front_lon"), c("back_lat"), c("back_lon")), 4)
    return df.withColumn("apart_m", m).where("apart_m < 8").select("building_id", r("apart_m", 3).alias("apart_m"), F.when(c("front_score") >= c("back_score"), "front").otherwise("back").alias("stays"))


def address_label_fix(spark, d):
    """Pins change labels where the front one is 1.05 times as far along the building's direction from the street as the back one."""
    depth = r(c("x") * c("ux") + c("y") * c("uy"), 3)
    last = F.max_by(F.struct("pin_id", "depth"), "pin_id")
    df = pin_offsets(spark, d).where("source = 'address'").withColumn("depth", 20 - depth).groupBy("building_id", "garden_type").agg(last.alias("l"))
    sides = df.groupBy("building_id").agg(F.max(F.when(c("garden_type") == "front", c("l.depth"))).alias("f"), F.max(F.when(c("garden_type") == "back", c("l.depth"))).alias("b"))
    return sides.where(c("f") > c("b") * 1.05).select("building_id")


def specific_building_pin(spark, d):
    """The best pin of the asked side within 10 m of its own building; higher score, then smaller number."""
    p = pin_offsets(spark, d).where(F.sqrt(c("x") * c("x") + c("y") * c("y")) <= 10)
    best = F.max_by(F.struct("pin_id", "score"), F.struct("score", -c("pin_id")))
    return p.groupBy("building_id", "garden_type").agg(best.alias("m")).select("building_id", "garden_type", "m.pin_id", "m.score")


def route_key_check(spark, d):
    """Points inside the country's box whose routing key lies within 15 km; unknown keys pass."""
    keys = spark.createDataFrame([(k, *v) for k, v in ROUTING.items()], "key string, k_lat double, k_lon double")
    names = F.array(*[F.lit(k) for k in [*ROUTING, "X99", "Z00"]])
    b = V.buildings(spark, d).select("building_id", "lat", (c("lon") + (c("building_id") % 9 - 4) * 0.05).alias("lon"), F.element_at(names, (c("building_id") % (len(ROUTING) + 2) + 1).cast("int")).alias("key"))
    df = b.join(F.broadcast(keys), "key", "left")  # a fixed table of 22 rows
    y, x = F.abs(c("lat") - c("k_lat")) * 111000.0, F.abs(c("lon") - c("k_lon")) * 111000.0 * 0.6
    inside = c("lat").between(*COUNTRY[:2]) & c("lon").between(*COUNTRY[2:])
    return df.select("building_id", "key", (inside & (c("k_lat").isNull() | (F.sqrt(y * y + x * x) < 15000))).alias("plausible"))


def geocode_cascade(spark, d):
    """The first strategy that finds a point inside the country: own building, own street, routing key, area of that number, middle of the country."""
    b = V.buildings(spark, d)
    q = V.table(spark, d, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") * 2).alias("building_id"), F.concat(F.lit("street "), (c("o_orderkey") % 40).cast("string")).alias("street_key"), F.concat(F.lit("D"), F.lpad((c("o_orderkey") % 37).cast("string"), 2, "0")).alias("key"), (c("o_orderkey") % 50).alias("area_id"))
    keys = F.broadcast(spark.createDataFrame([(k, *v) for k, v in ROUTING.items()], "key string, k_lat double, k_lon double"))  # a fixed table of 22 rows
    at = lambda df, on, lat, lon, n: df.select(on, r(lat, 6).alias(f"{n}_lat"), r(lon, 6).alias(f"{n}_lon"))
    streets = b.groupBy("street_key").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    found = (("building", at(b, "building_id", "lat", "lon", "b"), "building_id", "b"), ("street", at(streets, "street_key", "lat", "lon", "s"), "street_key", "s"), ("routing_key", keys, "key", "k"), ("area", at(V.areas(spark, d), "area_id", "lat", "lon", "a"), "area_id", "a"))
    point = F.lit(None).cast("struct<strategy:string,lat:double,lon:double>")
    for name, table, on, n in found:
        q = q.join(table, on, "left")
        hit = F.struct(F.lit(name).alias("strategy"), c(f"{n}_lat").alias("lat"), c(f"{n}_lon").alias("lon"))
        point = F.coalesce(point, F.when(c(f"{n}_lat").between(*COUNTRY[:2]) & c(f"{n}_lon").between(*COUNTRY[2:]), hit))
    middle = F.struct(F.lit("country").alias("strategy"), F.lit(53.35).alias("lat"), F.lit(-7.8).alias("lon"))
    return q.select("id", F.coalesce(point, middle).alias("p")).select("id", "p.strategy", "p.lat", "p.lon")


#: How many answers of each strategy are looked at.
MOST_ANSWERS = {1: 1, 2: 5, 3: 10, 4: 6}


def geocode_first_valid(spark, d):
    """Of the answers of each strategy the first ones, in their order; the first of these, strategy by strategy, that lies in the country and within 15 km
    of the request's routing key (unknown keys pass); else the point of the key, as an approximation, if it is known."""
    names = F.array(*[F.lit(k) for k in [*ROUTING, "X99", "Z00"]])
    keys = F.broadcast(spark.createDataFrame([(k, *v) for k, v in ROUTING.items()], "key string, k_lat double, k_lon double"))  # a fixed table of 22 rows
    spots = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon")) for a, o in ROUTING.values()])
    l = V.table(spark, d, "lineitem").select(c("l_suppkey").cast("long").alias("id"), c("l_orderkey").cast("long").alias("o"), c("l_linenumber").cast("long").alias("n"), c("l_partkey").cast("long").alias("p"))  # noqa: E741
    spot = F.element_at(spots, (c("p") % len(ROUTING) + 1).cast("int"))
    l = l.select("id", (1 + c("n") % 4).cast("int").alias("strategy"), "o", "n", "p", F.when(c("o") % 13 == 0, 48.0).otherwise(spot["lat"] + (c("o") % 41 - 20) / 100.0).alias("lat"), (spot["lon"] + (c("p") % 31 - 15) / 100.0).alias("lon"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in MOST_ANSWERS.items() for x in kv]), c("strategy"))
    l = l.withColumn("rank", F.row_number().over(Window.partitionBy("id", "strategy").orderBy("o", "n", "p"))).where((c("rank") <= most) & (c("rank") <= max(MOST_ANSWERS.values())))
    asked = V.table(spark, d, "supplier").select(c("s_suppkey").cast("long").alias("id")).withColumn("key", F.element_at(names, (c("id") % (len(ROUTING) + 2) + 1).cast("int"))).join(keys, "key", "left")
    y, x = F.abs(c("lat") - c("k_lat")) * 111000.0, F.abs(c("lon") - c("k_lon")) * 111000.0 * 0.6
    valid = c("lat").between(*COUNTRY[:2]) & c("lon").between(*COUNTRY[2:]) & (c("k_lat").isNull() | (r(F.sqrt(y * y + x * x), 3) < 15000))
    best = asked.join(l, "id").where(valid).groupBy("id").agg(F.min_by(F.struct("strategy", "rank", "lat", "lon"), F.struct("strategy", "rank")).alias("b"))
    out = asked.join(best, "id", "left").select("id", "key", "b.strategy", "b.rank", F.coalesce("b.lat", "k_lat").alias("lat"), F.coalesce("b.lon", "k_lon").alias("lon"), (c("b").isNull() & c("k_lat").isNotNull()).alias("approximate"))
    return out.withColumns({"lat": r("lat", 6), "lon": r("lon", 6)})


def driveway_override(spark, d):
    """Ground of a class within 5 pixels of a driveway is front."""
    df = R.squared_distance(V.pixels(spark, d), c("r") + c("b") > 340)
    kind = F.when(c("g") < 100, 0).when(c("d2") < 25, 1).when(c("g") > 140, 2).otherwise(3)
    return df.select("y", "x", kind.alias("class"))


def shade_recovery(spark, d):
    """Dark pixels with more than 15 % vegetation in the 51 x 51 square around them, not vegetation, building or road themselves."""
    df = V.pixels(spark, d).withColumn("n", (R.excess_green() > 0.1).cast("long"))
    ratio = R.box_sums(df.select("y", "x", "n"), size(spark, d), 25, "n").select("y", "x", c("n").alias("near"))
    return df.join(ratio, ["y", "x"]).where((c("n") == 0) & (c("near") > 0.15 * 2601) & (c("r") <= 190) & (c("b") <= 190) & (R.gray() < 120)).select("y", "x")


def claim_disc(spark, d):
    """Pixels within 5 of a placed pin; pins stand where red is above 215."""
    return R.squared_distance(V.pixels(spark, d), c("r") > 215, 5).where("d2 is not null").select("y", "x", "d2")


def grass_ladder(spark, d):
    """The best tier of grass that a building has, and its pins of that tier."""
    s = X.score_inputs(spark, d).join(V.pins(spark, d).select("pin_id", "building_id"), "pin_id").where("surface_type = 'grass'")
    tier = F.when((c("to_edge") >= 4.5) & (c("garden_m2") >= 5) & (c("density") > 0.1), 1).when((c("garden_m2") >= 5) & (c("density") > 0.1), 2).when(c("density") > 0.05, 3).otherwise(4)
    s = s.withColumn("tier", tier)
    best = s.groupBy("building_id").agg(F.min("tier").alias("tier"))
    return s.join(best, ["building_id", "tier"]).select("building_id", "pin_id", "tier")


def settle_claims(pins, reach_m=5.0):
    """Of the pins (pin_id, garden_type, lat, lon), in order of their number, those that no pin of their kind placed before them is
    within reach of: the result of going through all of them one by one, over all buildings.

    In rounds: of the open pins, those without an open earlier rival are placed, and all in their reach fall away. Only the first pin of a kind in a cell
    can be placed, so a round asks few pins for rivals, and pairs are never stored: very many pins can be near one another. A pin without a place has no
    rivals.
    """
    far = geo.equirectangular(c("lat"), c("lon"), c("r_lat"), c("r_lon"))

    def rivals(left, right, order):
        near = spatial.range_join(left, right, reach_m + 0.001, far).where(f"garden_type = r_garden_type and {order}")
        return near.where(r("distance_m", 4) <= reach_m).select("pin_id").distinct()

    p = pins.select("pin_id", "garden_type", "lat", "lon")
    somewhere = F.coalesce(~F.isnan("lat") & ~F.isnan("lon"), F.lit(False))
    out, open_ = p.where(~somewhere).select("pin_id"), cut(p.where(somewhere))
    while not open_.isEmpty():
        first = spatial.cells(open_, reach_m).groupBy("garden_type", "_cy", "_cx").agg(F.min_by(F.struct("pin_id", "lat", "lon"), "pin_id").alias("f"))
        first = cut(first.select("f.*", "garden_type"))
        placed = cut(first.join(rivals(first, open_, "r_pin_id < pin_id"), "pin_id", "left_anti"))
        out = out.unionByName(placed.select("pin_id"))
        taken = rivals(open_, placed, "r_pin_id < pin_id").unionByName(placed.select("pin_id"))
        open_ = cut(open_.join(taken, "pin_id", "left_anti"))
    return out


def greedy_claims(spark, d):
    """Pins claim discs of 5 m in order, whatever their building."""
    pins = V.pins(spark, d)
    return pins.join(settle_claims(pins), "pin_id").select("building_id", "pin_id")


ORACLES = {
    "front_direction": oracle("bld road", "SELECT building_id, ux, uy, source FROM dir", DIR),
    "correct_side": oracle("bld road pin", "SELECT pin_id, CASE WHEN sqrt(x * x + y * y) < 1 THEN true WHEN garden_type = 'front' THEN (x * ux + y * uy) / sqrt(x * x + y * y) > -0.3::DOUBLE ELSE (x * ux + y * uy) / sqrt(x * x + y * y) < 0.3::DOUBLE END AS ok FROM off", OFF),
    "lateral_corridor": oracle("bld road pin", "SELECT pin_id FROM off WHERE abs(-uy * x + ux * y) <= round((abs(uy) * w_m + abs(ux) * h_m) / 2 + 3, 4)", OFF),
    "outlier_fix_round": oracle("bld road", "SELECT building_id, round(mx / nm, 4) AS ux, round(my / nm, 4) AS uy FROM z JOIN dir USING (building_id) WHERE (SELECT count(*) FROM bld) > 10 AND n >= 4 AND nm > 0.6 AND (ux * mx + uy * my) / nm < -0.7", X.NB + DIR + """, kn AS (SELECT building_id, other FROM nb WHERE distance_m <= 40 QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY distance_m, other) <= 10),
      y AS (SELECT kn.building_id, count(*) AS n, avg(ux) AS mx, avg(uy) AS my FROM kn JOIN dir ON dir.building_id = kn.other GROUP BY 1), z AS (SELECT *, sqrt(mx * mx + my * my) AS nm FROM y)"""),
    "road_verify": oracle("bld road", "SELECT building_id, road_id, vx AS ux, vy AS uy FROM v JOIN dir USING (building_id) WHERE source = 'address' AND ux * vx + uy * vy < 0.3", DIR + f""", v AS (SELECT building_id, road_id, round(px / sqrt(px * px + py * py), 4) AS vx, round(py / sqrt(px * px + py * py), 4) AS vy FROM (SELECT *, ax + t * (ex - ax) AS px, ay + t * (ey - ay) AS py FROM (SELECT * FROM ad {X.NEAREST}) WHERE distance_m > 0.1))"""),
    "front_of_other_anti": oracle("bld road pin", "SELECT pin_id FROM pin WHERE garden_type = 'back' AND pin_id NOT IN (SELECT pin_id FROM f WHERE m <= 12 AND m > 0.001 AND round((x * ux + y * uy) / m, 4) > 0.5)",
      DIR + f", f AS (SELECT pin_id, ux, uy, round({X.flat_sql('p.lat', 'p.lon', 'b.lat', 'b.lon')}, 4) AS m, (p.lon - b.lon) * 111320::DOUBLE * cos(radians(b.lat)) AS x, (p.lat - b.lat) * 111320::DOUBLE AS y FROM pin p, bld b JOIN dir USING (building_id) WHERE p.garden_type = 'back' AND b.building_id <> p.building_id AND abs(p.lat - b.lat) < 0.0002)"),
    "same_side_detect": oracle("pin", "SELECT building_id, round(m, 3) AS apart_m, CASE WHEN front_score >= back_score THEN 'front' ELSE 'back' END AS stays FROM w WHERE m < 8", X.PIV + f", w AS (SELECT *, {X.pair_sql('x', 'y').replace('x.l', 'front_l').replace('y.l', 'back_l')} AS m FROM pv WHERE front_pin_id IS NOT NULL AND back_pin_id IS NOT NULL)"),
    "address_label_fix": oracle("bld road pin", "SELECT building_id FROM l GROUP BY 1 HAVING max(dep) FILTER (garden_type = 'front') > max(dep) FILTER (garden_type = 'back') * 1.05", OFF + ", l AS (SELECT off.building_id, garden_type, 20 - round(x * off.ux + y * off.uy, 3) AS dep FROM off JOIN dir USING (building_id) WHERE source = 'address' QUALIFY row_number() OVER (PARTITION BY off.building_id, garden_type ORDER BY pin_id DESC) = 1)"),
    "specific_building_pin": oracle("bld road pin", "SELECT building_id, garden_type, pin_id, score FROM off WHERE sqrt(x * x + y * y) <= 10 QUALIFY row_number() OVER (PARTITION BY building_id, garden_type ORDER BY score DESC, pin_id) = 1", OFF),
    "route_key_check": oracle("bld", f"SELECT building_id, key, lat BETWEEN 51.3 AND 55.5 AND lon BETWEEN -10.7 AND -5.3 AND (k_lat IS NULL OR sqrt(power(abs(lat - k_lat) * 111000::DOUBLE, 2) + power(abs(lon - k_lon) * 111000::DOUBLE * 0.6::DOUBLE, 2)) < 15000) AS plausible FROM q LEFT JOIN keys USING (key)",
      f", keys(key, k_lat, k_lon) AS (VALUES {', '.join(f'({k!r}, {a}::DOUBLE, {b}::DOUBLE)' for k, (a, b) in ROUTING.items())}), q AS (SELECT building_id, lat, lon + (building_id % 9 - 4) * 0.05::DOUBLE AS lon, ({[*ROUTING, 'X99', 'Z00']})[(building_id % {len(ROUTING) + 2} + 1)::INT] AS key FROM bld)"),
    "geocode_cascade": oracle("bld area", "SELECT id, CASE WHEN b.lat IS NOT NULL THEN 'building' WHEN s_lat IS NOT NULL THEN 'street' WHEN k_lat IS NOT NULL THEN 'routing_key' WHEN a.lat IS NOT NULL THEN 'area' ELSE 'country' END AS strategy, coalesce(round(b.lat, 6), s_lat, k_lat, round(a.lat, 6), 53.35::DOUBLE) AS lat, coalesce(round(b.lon, 6), s_lon, k_lon, round(a.lon, 6), -7.8::DOUBLE) AS lon FROM q LEFT JOIN bld b USING (building_id) LEFT JOIN (SELECT street_key, round(avg(lat), 6) AS s_lat, round(avg(lon), 6) AS s_lon FROM bld GROUP BY 1) s ON s.street_key = q.street_key LEFT JOIN keys USING (key) LEFT JOIN area a ON a.area_id = q.area_id",
      f", keys(key, k_lat, k_lon) AS (VALUES {', '.join(f'({k!r}, {v[0]}::DOUBLE, {v[1]}::DOUBLE)' for k, v in ROUTING.items())}), q AS (SELECT o_orderkey AS id, o_custkey * 2 AS building_id, 'street ' || (o_orderkey % 40) AS street_key, 'D' || lpad((o_orderkey % 37)::VARCHAR, 2, '0') AS key, o_orderkey % 50 AS area_id FROM orders)"),
    "geocode_first_valid": f"""WITH keys(i, key, k_lat, k_lon) AS (VALUES {', '.join(f'({i}, {k!r}, {a}::DOUBLE, {b}::DOUBLE)' for i, (k, (a, b)) in enumerate(ROUTING.items()))}),
      q AS (SELECT s_suppkey::BIGINT AS id, ({[*ROUTING, 'X99', 'Z00']})[(s_suppkey % {len(ROUTING) + 2} + 1)::INT] AS key FROM supplier), m(strategy, most) AS (VALUES {', '.join(map(str, MOST_ANSWERS.items()))}),
      l AS (SELECT l_suppkey AS id, (1 + l_linenumber % 4)::INT AS strategy, row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 4 ORDER BY l_orderkey, l_linenumber, l_partkey)::INT AS rank, CASE WHEN l_orderkey % 13 = 0 THEN 48 ELSE k_lat + (l_orderkey % 41 - 20) / 100::DOUBLE END AS lat, k_lon + (l_partkey % 31 - 15) / 100::DOUBLE AS lon FROM lineitem JOIN keys ON i = l_partkey % {len(ROUTING)}),
      v AS (SELECT q.id, q.key, l.strategy, rank, lat, lon FROM q LEFT JOIN keys k ON k.key = q.key JOIN l ON l.id = q.id JOIN m ON m.strategy = l.strategy WHERE rank <= most AND lat BETWEEN 51.3 AND 55.5 AND lon BETWEEN -10.7 AND -5.3 AND (k_lat IS NULL OR round(sqrt(power(abs(lat - k_lat) * 111000::DOUBLE, 2) + power(abs(lon - k_lon) * 111000::DOUBLE * 0.6::DOUBLE, 2)), 3) < 15000) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY l.strategy, rank) = 1)
      SELECT q.id, q.key, strategy, rank, round(coalesce(lat, k_lat), 6) AS lat, round(coalesce(lon, k_lon), 6) AS lon, strategy IS NULL AND k_lat IS NOT NULL AS approximate FROM q LEFT JOIN v USING (id) LEFT JOIN keys k ON k.key = q.key""",
    "driveway_override": oracle("px", "SELECT y, x, CASE WHEN g < 100 THEN 0 WHEN d2 < 25 THEN 1 WHEN g > 140 THEN 2 ELSE 3 END AS class FROM px JOIN nd USING (y, x)", source_sql("r + b > 340")),
    "shade_recovery": oracle("px", "SELECT y, x FROM px JOIN vg USING (y, x) JOIN (SELECT y, x, n AS near FROM bs) USING (y, x) WHERE n = 0 AND near > 0.15::DOUBLE * 2601 AND r <= 190 AND b <= 190 AND (r * 299 + g * 587 + b * 114) / 1000::DOUBLE < 120", VEG + box_sql("bs", "vg", 25, "n")),
    "claim_disc": oracle("px", "SELECT y, x, d2 FROM nd WHERE d2 <= 25", source_sql("r > 215")),
    "grass_ladder": oracle("pin", "SELECT building_id, pin_id, tier::INT AS tier FROM (SELECT p.building_id, s.pin_id, CASE WHEN to_edge >= 4.5 AND garden_m2 >= 5 AND density > 0.1::DOUBLE THEN 1 WHEN garden_m2 >= 5 AND density > 0.1::DOUBLE THEN 2 WHEN density > 0.05::DOUBLE THEN 3 ELSE 4 END AS tier FROM s JOIN pin p USING (pin_id) WHERE s.surface_type = 'grass') QUALIFY tier = min(tier) OVER (PARTITION BY building_id)", X.SCORE_IN),
}
QUERIES = {n: globals()[n] for n in ORACLES} | {"greedy_claims": greedy_claims, "outlier_fix": outlier_fix, "neighbour_flips": neighbour_flips}
