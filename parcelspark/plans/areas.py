"""Queries over the persisted catalog of areas: a sequence of commits and its end, and work on chunks that is stopped and goes on."""

import uuid

from pyspark.sql import functions as F

from parcelspark.functions import geo
from parcelspark.operators import spatial
from parcelspark.operators.tables import shared_folder
from parcelspark.sources import views as V
from parcelspark.sources.catalog import Catalog, resume
from parcelspark.sources.views import oracle

c = F.col
r = F.round
AREA = "lat double, lon double, radius_m double"


def _catalog(spark):
    return Catalog(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex[:12]}", AREA)


def _within(features, key):
    """Of areas: their features of a kind, area_id and key."""

    def rows(areas):
        found = spatial.within_own_radius(features.select(key, "lat", "lon"), areas.select("area_id", "lat", "lon", "radius_m"), "radius_m", geo.haversine(c("lat"), c("lon"), c("r_lat"), c("r_lon")))
        return found.select(c("r_area_id").alias("area_id"), key, r(c("distance_m"), 3).alias("distance_m"))

    return rows


def catalog_sequence(spark, d):
    """All areas are stored with their buildings and pins; those of 300 m and more again with half the radius; those of zoom 17 go; a commit whose data
    can't be made fails and leaves no trace; areas of 100 m are used. Then what there is."""
    catalog, areas = _catalog(spark), V.areas(spark, d)
    buildings, pins = _within(V.buildings(spark, d), "building_id"), _within(V.pins(spark, d), "pin_id")
    store = lambda some, at: catalog.upsert(some.select("area_id", "lat", "lon", "radius_m"), {"buildings": buildings(some), "pins": pins(some)}, at)
    store(areas, 1.0)
    store(areas.where("radius_m >= 300").withColumn("radius_m", c("radius_m") / 2), 2.0)
    catalog.delete(areas.where("zoom = 17"))
    try:
        catalog.upsert(areas.select("area_id", "lat", "lon", F.lit(0.0).alias("radius_m")), {"buildings": areas.select("area_id", F.raise_error(F.lit("no data")).cast("long").alias("building_id"))}, 3.0)
    except Exception as failed:  # what raise_error throws is wrapped by the writer
        if "no data" not in str(failed):
            raise
    catalog.touch(areas.where("radius_m = 100").select("area_id"), 4.0)
    near = catalog.read("buildings").groupBy("area_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance_m").alias("furthest_m"))
    state = catalog.areas().join(near, "area_id", "left")
    return state.select("area_id", "radius_m", "at", "accessed", c("counts")["buildings"].alias("n_buildings"), c("counts")["pins"].alias("n_pins"), F.coalesce("n", F.lit(0)).alias("read_buildings"), "furthest_m")


def resumed_chunks(spark, d):
    """Pins of each area, area by area as chunks: a run that ends after two commits, and one that goes on from there."""
    catalog, chunks = _catalog(spark), V.areas(spark, d).select("area_id", "lat", "lon", "radius_m")
    work = _within(V.pins(spark, d), "pin_id")
    resume(catalog, chunks, work, at_a_time=5, most=2)
    return resume(catalog, chunks, work, at_a_time=10).select("area_id", "pin_id", "distance_m")


def _hav(a, b):
    return f"2 * 6371000::DOUBLE * asin(sqrt(power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2)))"


ORACLES = {
    "catalog_sequence": oracle("bld pin area", f"""SELECT area_id::VARCHAR AS area_id, radius AS radius_m, t AS "at", CASE WHEN radius_m = 100 THEN 4::DOUBLE ELSE t END AS accessed, count(building_id) AS n_buildings, any_value(n_pins) AS n_pins, count(building_id) AS read_buildings, round(max(m), 3) AS furthest_m
      FROM s LEFT JOIN (SELECT s.area_id AS a, building_id, {_hav('s', 'b')} AS m FROM s, bld b) ON a = area_id AND m <= radius JOIN (SELECT s.area_id AS k, count(*) FILTER ({_hav('s', 'p')} <= radius) AS n_pins FROM s, pin p GROUP BY 1) ON k = area_id GROUP BY area_id, radius, radius_m, t""",
        ", s AS (SELECT *, CASE WHEN radius_m >= 300 THEN radius_m / 2 ELSE radius_m END AS radius, CASE WHEN radius_m >= 300 THEN 2::DOUBLE ELSE 1::DOUBLE END AS t FROM area WHERE zoom <> 17)"),
    "resumed_chunks": oracle("pin area", f"SELECT area_id::VARCHAR AS area_id, pin_id, round(m, 3) AS distance_m FROM (SELECT area_id, pin_id, radius_m, {_hav('a', 'p')} AS m FROM area a, pin p) WHERE m <= radius_m"),
}
QUERIES = {n: globals()[n] for n in ORACLES}
