"""Queries of keys, names, pixels and catalog lookups."""

from pyspark.sql import functions as F

from parcelspark.functions import geo
from parcelspark.sources import views as V
from parcelspark.sources.views import oracle

c = F.col
r = F.round
#: The image of the examples: bounds (north, south, east, west) and sides.
IMAGE = (53.362, 53.35, -6.33, -6.35, 1999, 1997)


def cache_keys(spark, d):
    """Keys of the caches, each with its own places: footprint, area, point and job; and the md5 of the area's."""
    a = V.areas(spark, d)
    fixed = lambda places, *names: F.format_string("_".join(f"%.{p}f" for p in places), *[c(n) for n in names])
    area = F.concat(fixed((5, 5, 0), "lat", "lon", "radius_m"), F.lit("_z"), c("zoom").cast("string"))
    return a.select("area_id", r("lat", 6).alias("lat_6"), r("lon", 6).alias("lon_6"), r("radius_m", 1).alias("radius_1"), area.alias("area_key"), fixed((5, 5), "lat", "lon").alias("point_key"), fixed((4, 4, 0), "lat", "lon", "radius_m").alias("job_key"), F.md5(area).alias("area_md5"))


def stable_ids(spark, d):
    """Names become numbers below 10^9 that are the same on every run: the first seven hex digits of their md5."""
    n = F.conv(F.substring(F.md5("c_name"), 1, 7), 16, 10).cast("long") % 1000000000
    return V.table(spark, d, "customer").select("c_custkey", n.alias("id"))


def first_name(spark, d):
    """The tag, else the street, else 'unknown'; empty counts as missing."""
    tag = F.when(c("building_id") % 4 == 0, "").otherwise(c("building"))
    street = F.when(c("building_id") % 3 == 0, "").otherwise(c("street_key"))
    return V.buildings(spark, d).select("building_id", F.coalesce(F.nullif(tag, F.lit("")), F.nullif(street, F.lit("")), F.lit("unknown")).alias("name"))


def metadata_merge(spark, d):
    """Two maps as one, the second one's values where both have a key, as JSON with sorted keys."""
    one = F.array(F.struct(F.lit("radius").alias("k"), c("radius_m").cast("int").cast("string").alias("v")), F.struct(F.lit("zoom").alias("k"), c("zoom").cast("string").alias("v")))
    two = F.array(F.struct(F.lit("zoom").alias("k"), F.lit("auto").alias("v")), F.struct(F.lit("source").alias("k"), (c("area_id") % 3).cast("string").alias("v")))
    kept = F.filter(one, lambda x: ~F.array_contains(F.transform(two, lambda y: y["k"]), x["k"]))
    return V.areas(spark, d).select("area_id", F.to_json(F.map_from_entries(F.array_sort(F.concat(kept, two)))).alias("metadata"))


def pixel_of_point(spark, d):
    """Buildings as pixels of the image and back, and as pixels of a grid of tiles."""
    px, py = geo.to_pixel(c("lat"), c("lon"), *IMAGE)
    lat, lon = geo.from_pixel(c("px"), c("py"), *IMAGE)
    gx, gy = geo.pixel_in_grid(c("lat"), c("lon"), F.lit(17), F.lit(63180.0), F.lit(42460.0))
    return V.buildings(spark, d).select("building_id", px.alias("px"), py.alias("py"), gx.alias("gx"), gy.alias("gy")).select("*", r(lat, 6).alias("lat"), r(lon, 6).alias("lon"))


def ring_pixels(spark, d):
    """Footprint rings in the image: number of corners, mean of the corners, and the ring as pixels."""
    corner = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))
    df = V.buildings(spark, d).withColumn("ring", ring)
    mean = lambda k: F.aggregate("ring", F.lit(0.0), lambda a, q: a + q[k]) / F.size("ring")
    px = F.transform("ring", lambda q: F.struct(*[v.alias(n) for n, v in zip("xy", geo.to_pixel(q["y"], q["x"], *IMAGE), strict=True)]))
    text = F.array_join(F.transform(px, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ",")
    return df.select("building_id", F.size("ring").alias("corners"), r(mean("y"), 6).alias("lat"), r(mean("x"), 6).alias("lon"), text.alias("ring_px"))


def tile_results(spark, d):
    """Fetched and failed tiles by area, and the first five errors of all in order."""
    t = V.progress(spark, d).select((c("task_id") % 25).alias("area_id"), "seq", (c("status") == "error").alias("failed"))
    first = t.where("failed").orderBy("seq").limit(5).select("seq", F.lit(True).alias("logged"))  # the feature: five errors are logged
    t = t.join(F.broadcast(first), "seq", "left")
    return t.groupBy("area_id").agg(F.count_if(~c("failed")).alias("success"), F.count_if("failed").alias("failed"), F.count_if(F.coalesce("logged", F.lit(False))).alias("logged"))


def job_rows(spark, d):
    """A row for each job: start, elapsed seconds, number of messages, whether it is done."""
    p = V.progress(spark, d).where("task_id is not null")
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000000.0
    last = F.max_by("status", "seq")
    return p.groupBy("task_id").agg(r(span, 1).alias("elapsed_s"), F.count(F.lit(1)).alias("message_count"), last.isin("complete", "error").alias("done"))


def area_limit(spark, d):
    """Areas a hundred times as wide whose box has more than 10,000 km2 are refused, with the reason."""
    km2 = r(F.pow(c("radius_m") * 200 / 1000.0, F.lit(2.0)), 4)
    return V.areas(spark, d).select("area_id", km2.alias("km2"), F.when(km2 > 10000, F.format_string("Area too large (%.0f km2). Maximum is 10,000 km2.", km2)).alias("error"))


def area_lookup(spark, d):
    """Requests by point and zoom: the area of exactly that key, else the first one made that has a zoom below, else none."""
    a = V.areas(spark, d)
    want = a.select(c("area_id").alias("request"), r("lat", 5).alias("k_lat"), r("lon", 5).alias("k_lon"), (c("zoom") + c("area_id") % 3 - 1).alias("want"))
    have = a.select("area_id", r("lat", 5).alias("k_lat"), r("lon", 5).alias("k_lon"), "zoom", "created_at")
    both = want.join(have, ["k_lat", "k_lon"], "left").where("zoom is null or zoom <= want")
    best = F.min_by(F.struct("area_id", "zoom"), F.struct(F.when(c("zoom") == c("want"), 0).otherwise(1), "created_at", "area_id"))
    found = both.groupBy("request").agg(best.alias("b")).select("request", "b.*")
    return want.join(found, "request", "left").select("request", "area_id", F.when(c("zoom").isNull(), "compute").when(c("zoom") == c("want"), "exact").otherwise("reduced").alias("how"))


N, S, E, W, WIDE, HIGH = IMAGE
PX = f"trunc((lon - ({W})::DOUBLE) / ({E}::DOUBLE - ({W})::DOUBLE) * {WIDE})::INT", f"trunc(({N}::DOUBLE - lat) / ({N}::DOUBLE - {S}::DOUBLE) * {HIGH})::INT"


def _corner(x, y):
    return f"trunc(({x} - ({W})::DOUBLE) / ({E}::DOUBLE - ({W})::DOUBLE) * {WIDE})::INT || ' ' || trunc(({N}::DOUBLE - {y}) / ({N}::DOUBLE - {S}::DOUBLE) * {HIGH})::INT"


ORACLES = {
    "cache_keys": oracle("area", "SELECT *, md5(area_key) AS area_md5 FROM (SELECT area_id, round(lat, 6) AS lat_6, round(lon, 6) AS lon_6, round(radius_m, 1) AS radius_1, printf('%.5f_%.5f_%.0f', lat, lon, radius_m) || '_z' || zoom AS area_key, printf('%.5f_%.5f', lat, lon) AS point_key, printf('%.4f_%.4f_%.0f', lat, lon, radius_m) AS job_key FROM area)"),
    "stable_ids": "SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 7))::BIGINT % 1000000000 AS id FROM customer",
    "first_name": oracle("bld", "SELECT building_id, coalesce(nullif(CASE WHEN building_id % 4 = 0 THEN '' ELSE building END, ''), nullif(CASE WHEN building_id % 3 = 0 THEN '' ELSE street_key END, ''), 'unknown') AS name FROM bld"),
    "metadata_merge": oracle("area", "SELECT area_id, '{\"radius\":\"' || radius_m::INT || '\",\"source\":\"' || (area_id % 3) || '\",\"zoom\":\"auto\"}' AS metadata FROM area"),
    "pixel_of_point": oracle("bld", f"SELECT *, round({N}::DOUBLE - py / {HIGH}::DOUBLE * ({N}::DOUBLE - {S}::DOUBLE), 6) AS lat, round(({W})::DOUBLE + px / {WIDE}::DOUBLE * ({E}::DOUBLE - ({W})::DOUBLE), 6) AS lon FROM (SELECT building_id, {PX[0]} AS px, {PX[1]} AS py, trunc(((lon + 180) / 360 * 131072 - 63180) * 256)::INT AS gx, trunc(((1 - asinh(tan(radians(lat))) / pi()) / 2 * 131072 - 42460) * 256)::INT AS gy FROM bld)"),
    "ring_pixels": oracle("bld", f"SELECT building_id, 4 AS corners, round((ymin + ymin + ymax + ymax) / 4, 6) AS lat, round((xmin + xmax + xmax + xmin) / 4, 6) AS lon, {_corner('xmin', 'ymin')} || ',' || {_corner('xmax', 'ymin')} || ',' || {_corner('xmax', 'ymax')} || ',' || {_corner('xmin', 'ymax')} AS ring_px FROM bld"),
    "tile_results": oracle("prog", "SELECT task_id % 25 AS area_id, count(*) FILTER (status <> 'error') AS success, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (seq IN (SELECT seq FROM prog WHERE status = 'error' ORDER BY seq LIMIT 5)) AS logged FROM prog GROUP BY 1"),
    "job_rows": oracle("prog", "SELECT task_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000::DOUBLE, 1) AS elapsed_s, count(*) AS message_count, arg_max(status, seq) IN ('complete', 'error') AS done FROM prog WHERE task_id IS NOT NULL GROUP BY task_id"),
    "area_limit": oracle("area", "SELECT area_id, km2, CASE WHEN km2 > 10000 THEN printf('Area too large (%.0f km2). Maximum is 10,000 km2.', km2) END AS error FROM (SELECT area_id, round(power(radius_m * 200 / 1000, 2), 4) AS km2 FROM area)"),
    "area_lookup": oracle("area", "SELECT request, area_id, CASE WHEN zoom IS NULL THEN 'compute' WHEN zoom = want THEN 'exact' ELSE 'reduced' END AS how FROM (SELECT w.*, a.area_id, a.zoom, a.created_at FROM (SELECT area_id AS request, lat, lon, zoom + area_id % 3 - 1 AS want FROM area) w LEFT JOIN area a ON round(a.lat, 5) = round(w.lat, 5) AND round(a.lon, 5) = round(w.lon, 5) AND a.zoom <= want) QUALIFY row_number() OVER (PARTITION BY request ORDER BY CASE WHEN zoom = want THEN 0 ELSE 1 END, created_at, area_id) = 1"),
}
QUERIES = {n: globals()[n] for n in ORACLES}
