"""Feature tables derived from the star-schema tables: buildings, roads, pins, areas, rasters and progress events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metres in a degree of latitude.
M_PER_DEG = 111320.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(key, square: int, linear: int, mod: int, scale: float):
    """A number from 0 on that scatters keys evenly."""
    return ((key * key * square + key * linear) % mod).cast("double") / F.lit(float(scale))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """building_id, centre, size in metres, footprint box, street key, building tag (may be null)."""
    k = F.col("c_custkey").cast("long")
    tags = F.create_map(*[F.lit(x) for x in ("BUILDING", "house", "FURNITURE", "residential", "HOUSEHOLD", "detached", "MACHINERY", "shed")])
    df = table(spark, sf_dir, "customer").select(
        k.alias("building_id"),
        (F.lit(53.35) + spread(k, 7919, 31, 100003, 8333583)).alias("lat"),
        (F.lit(-6.35) + spread(k, 104729, 17, 100019, 5000950)).alias("lon"),
        (6 + k % 7).cast("double").alias("w_m"),
        (8 + k % 5).cast("double").alias("h_m"),
        F.concat(F.lit("street "), F.col("c_nationkey").cast("string")).alias("street_key"),
        F.try_element_at(tags, F.col("c_mktsegment")).alias("building"),
    )
    dlat, dlon = F.col("h_m") / 2 / M_PER_DEG, F.col("w_m") / 2 / (M_PER_DEG * F.cos(F.radians("lat")))
    return df.withColumns({"ymin": F.col("lat") - dlat, "ymax": F.col("lat") + dlat, "xmin": F.col("lon") - dlon, "xmax": F.col("lon") + dlon})


#: Outlines in parts of a building's width and height, as parts of rings of corners: a block, one with a yard, a U with an annex, an L, a small and a
#: large part with a yard.
BLOCK = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)]
YARD = [(-0.2, -0.2), (-0.2, 0.2), (0.2, 0.2), (0.2, -0.2)]
U = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (0.2, 0.5), (0.2, -0.1), (-0.2, -0.1), (-0.2, 0.5), (-0.5, 0.5)]
ANNEX = [(0.7, -0.2), (1.0, -0.2), (1.0, 0.2), (0.7, 0.2)]
L = [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.0), (0.0, 0.0), (0.0, 0.5), (-0.5, 0.5)]
FAR = [(-1.2, -0.5), (-0.8, -0.5), (-0.8, -0.1), (-1.2, -0.1)]
#: The kind and outline of a building by its number modulo 16; walls, posts and the like are no footprints.
SHAPES = {
    **dict.fromkeys((0, 1, 2), ("Polygon", [[BLOCK]])), **dict.fromkeys((3, 4), ("Polygon", [[BLOCK, YARD]])), **dict.fromkeys((5, 6), ("MultiPolygon", [[U], [ANNEX]])), **dict.fromkeys((7, 8), ("Polygon", [[L]])),
    **dict.fromkeys((9, 10), ("MultiPolygon", [[FAR], [BLOCK, YARD]])), 11: ("LineString", [[BLOCK[:3]]]), 12: ("MultiLineString", [[BLOCK[:2]], [ANNEX[:3]]]), 13: ("Point", [[BLOCK[:1]]]), 14: ("Polygon", []), 15: None,
}


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geometry (WKB, null for some), building_id, and nested columns as the source has them."""
    from parcelspark.functions.geometry import GEOMETRY, moved, to_wkb

    ring = lambda kind, r: [*r, *r[:1]] if kind.endswith("Polygon") else r
    known = [(k, (s[0], [(s[0].removeprefix("Multi"), [ring(s[0], x) for x in part]) for part in s[1]]) if s else None) for k, s in SHAPES.items()]
    outlines = F.broadcast(spark.createDataFrame(known, f"_shape long, _g {GEOMETRY}"))  # 16 rows
    b = buildings(spark, sf_dir).withColumn("_shape", F.col("building_id") % 16).join(outlines, "_shape")
    corner = lambda x, y: (F.col("lon") + x * F.col("w_m") / (M_PER_DEG * F.cos(F.radians("lat"))), F.col("lat") + y * F.col("h_m") / M_PER_DEG)
    b = b.withColumn("_g", moved(F.col("_g"), corner))
    nested = [F.struct(F.col("street_key").alias("primary")).alias("names"), F.array(F.struct(F.lit("open").alias("dataset"), F.col("building_id").alias("record"))).alias("sources")]
    return b.select(F.concat(F.lit("b"), F.col("building_id").cast("string")).alias("id"), to_wkb(F.col("_g")).alias("geometry"), "building_id", *nested)


def footprint_sql() -> str:
    """The corners of all rings: building_id, kind, part, ring, i, x, y (degrees); rings of polygons are closed."""
    rows = []
    for k, (kind, parts) in ((k, s) for k, s in SHAPES.items() if s):
        for p, part in enumerate(parts):
            for r, ring in enumerate(part):
                rows += [f"({k}, '{kind}', {p}, {r}, {i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(ring + ring[:1] if kind.endswith("Polygon") else ring)]
    return f"""shp AS (SELECT * FROM (VALUES {", ".join(rows)}) t(k, kind, part, ring, i, fx, fy)),
 crn AS (SELECT building_id, kind, part, ring, i, lon + fx * w_m / (111320::DOUBLE * cos(radians(lat))) AS x, lat + fy * h_m / 111320::DOUBLE AS y FROM bld0 JOIN shp ON building_id % 16 = k)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """road_id, name, highway tags, one segment from (lat0, lon0) to (lat1, lon1)."""
    s = F.col("s_suppkey").cast("long")
    kinds = F.array(*[F.array(*[F.lit(t) for t in tags]) for tags in (["residential"], ["footway"], ["tertiary", "footway"], ["service"])])
    df = table(spark, sf_dir, "supplier").select(
        s.alias("road_id"),
        F.concat(F.lit("  Street "), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("name"),
        F.element_at(kinds, (s % 4 + 1).cast("int")).alias("highway"),
        (F.lit(53.35) + ((s * 6007) % 1009).cast("double") / 84083.0).alias("lat0"),
        (F.lit(-6.35) + ((s * 3001) % 1013).cast("double") / 50650.0).alias("lon0"),
    )
    return df.withColumns({"lat1": F.col("lat0") + 0.0004 * (s_of("road_id", 3) - 1), "lon1": F.col("lon0") + 0.0006 * (2 * s_of("road_id", 2) - 1)})


def with_middle(roads: DataFrame) -> DataFrame:
    """roads with lat, lon, the middle of the segment, and half_m, how far it goes from there."""
    lat, lon = (F.col("lat0") + F.col("lat1")) / 2, (F.col("lon0") + F.col("lon1")) / 2
    x, y = (F.col("lon1") - F.col("lon0")) * M_PER_DEG * F.cos(F.radians("lat0")), (F.col("lat1") - F.col("lat0")) * M_PER_DEG
    return roads.withColumns({"lat": lat, "lon": lon, "half_m": F.sqrt(x * x + y * y) / 2 + 1})


def s_of(name: str, mod: int):
    return (F.col(name) % mod).cast("double")


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pin_id, building_id, garden_type, position, score, surface_type."""
    o = F.col("o_orderkey").cast("long")
    surface = F.element_at(F.array(*[F.lit(x) for x in ("grass", "driveway", "paved", "car_parking", "no_garden")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    orders = table(spark, sf_dir, "orders").select(
        o.alias("pin_id"), F.col("o_custkey").cast("long").alias("building_id"),
        F.when(o % 2 == 0, "front").otherwise("back").alias("garden_type"),
        ((o * 37) % 31 - 15).cast("double").alias("north"), ((o * 17) % 29 - 14).cast("double").alias("east"),
        F.least(F.lit(100.0), ((o * 37) % 113).cast("double")).alias("score"), surface.alias("surface_type"),
    )
    at = buildings(spark, sf_dir).select("building_id", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    df = orders.join(at, "building_id")
    df = df.withColumns({"lat": F.col("b_lat") + F.col("north") / M_PER_DEG, "lon": F.col("b_lon") + F.col("east") / (M_PER_DEG * F.cos(F.radians("b_lat")))})
    return df.select("pin_id", "building_id", "garden_type", "lat", "lon", "score", "surface_type")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area_id, centre, radius_m, created_at, zoom: the catalog of precomputed areas."""
    n = F.col("n_nationkey").cast("long")
    df = table(spark, sf_dir, "nation").select(n.alias("area_id"), (n * 6).alias("_at"), (100.0 * (1 + n % 6)).alias("radius_m"), n.alias("created_at"), (19 - n % 3).alias("zoom"))
    at = buildings(spark, sf_dir).select(F.col("building_id").alias("_at"), "lat", "lon")
    return df.join(at, "_at").select("area_id", "lat", "lon", "radius_m", "created_at", "zoom")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, r, g, b of a raster 64 pixels wide."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), "embedding")
    e = e.select("y", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    band = lambda shift: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 300 * F.get("embedding", (F.col("x") + shift) % 64).cast("double")))).cast("int")
    return e.select("y", "x", band(0).alias("r"), band(21).alias("g"), band(42).alias("b"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, seq, ts, progress, status."""
    status = F.create_map(*[F.lit(x) for x in ("signup", "queued", "click", "running", "view", "running", "purchase", "complete", "error", "error")])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", F.col("value").alias("progress"), F.try_element_at(status, F.col("event_type")).alias("status")
    )


#: The same views for the oracle, as common table expressions.
SQL = {
    "bld0": """SELECT c_custkey::BIGINT AS building_id,
  53.35::DOUBLE + ((c_custkey::BIGINT * c_custkey * 7919 + c_custkey::BIGINT * 31) % 100003)::DOUBLE / 8333583::DOUBLE AS lat,
  -6.35::DOUBLE + ((c_custkey::BIGINT * c_custkey * 104729 + c_custkey::BIGINT * 17) % 100019)::DOUBLE / 5000950::DOUBLE AS lon,
  (6 + c_custkey % 7)::DOUBLE AS w_m, (8 + c_custkey % 5)::DOUBLE AS h_m, 'street ' || c_nationkey AS street_key,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'house' WHEN 'FURNITURE' THEN 'residential' WHEN 'HOUSEHOLD' THEN 'detached' WHEN 'MACHINERY' THEN 'shed' END AS building
  FROM customer""",
    "bld": """SELECT *, lat - h_m / 2 / 111320::DOUBLE AS ymin, lat + h_m / 2 / 111320::DOUBLE AS ymax,
  lon - w_m / 2 / (111320::DOUBLE * cos(radians(lat))) AS xmin, lon + w_m / 2 / (111320::DOUBLE * cos(radians(lat))) AS xmax FROM bld0""",
    "road": """SELECT s_suppkey::BIGINT AS road_id, '  Street ' || s_nationkey || ' ' AS name,
  CASE s_suppkey % 4 WHEN 0 THEN ['residential'] WHEN 1 THEN ['footway'] WHEN 2 THEN ['tertiary', 'footway'] ELSE ['service'] END AS highway,
  53.35::DOUBLE + ((s_suppkey::BIGINT * 6007) % 1009)::DOUBLE / 84083::DOUBLE AS lat0, -6.35::DOUBLE + ((s_suppkey::BIGINT * 3001) % 1013)::DOUBLE / 50650::DOUBLE AS lon0,
  53.35::DOUBLE + ((s_suppkey::BIGINT * 6007) % 1009)::DOUBLE / 84083::DOUBLE + 0.0004::DOUBLE * (s_suppkey % 3 - 1) AS lat1,
  -6.35::DOUBLE + ((s_suppkey::BIGINT * 3001) % 1013)::DOUBLE / 50650::DOUBLE + 0.0006::DOUBLE * (2 * (s_suppkey % 2) - 1) AS lon1 FROM supplier""",
    "pin": """SELECT o_orderkey::BIGINT AS pin_id, building_id, CASE WHEN o_orderkey % 2 = 0 THEN 'front' ELSE 'back' END AS garden_type,
  lat + ((o_orderkey::BIGINT * 37) % 31 - 15)::DOUBLE / 111320::DOUBLE AS lat,
  lon + ((o_orderkey::BIGINT * 17) % 29 - 14)::DOUBLE / (111320::DOUBLE * cos(radians(lat))) AS lon,
  least(100::DOUBLE, ((o_orderkey::BIGINT * 37) % 113)::DOUBLE) AS score,
  ['grass', 'driveway', 'paved', 'car_parking', 'no_garden'][o_orderpriority[1]::INT] AS surface_type
  FROM orders JOIN bld0 ON o_custkey = building_id""",
    "area": """SELECT n_nationkey::BIGINT AS area_id, lat, lon, 100::DOUBLE * (1 + n_nationkey % 6) AS radius_m, n_nationkey::BIGINT AS created_at, (19 - n_nationkey % 3)::BIGINT AS zoom
  FROM nation JOIN bld0 ON building_id = n_nationkey * 6""",
    "px": """SELECT vec_id AS y, x::INT AS x,
  least(255::DOUBLE, greatest(0::DOUBLE, floor(128 + 300 * embedding[x + 1]::DOUBLE)))::INT AS r,
  least(255::DOUBLE, greatest(0::DOUBLE, floor(128 + 300 * embedding[(x + 21) % 64 + 1]::DOUBLE)))::INT AS g,
  least(255::DOUBLE, greatest(0::DOUBLE, floor(128 + 300 * embedding[(x + 42) % 64 + 1]::DOUBLE)))::INT AS b
  FROM embeddings, range(64) t(x)""",
    "prog": """SELECT user_id AS task_id, event_id AS seq, ts, value AS progress,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' END AS status FROM events""",
}


def oracle(views: str, body: str, ctes: str = "", recursive: bool = False) -> str:
    """SQL over the named views; ctes are further common table expressions, each after a comma."""
    names = views.split()
    need = [n for n in SQL if n in names or n == "bld0" and {"bld", "pin", "area"} & set(names)]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in need) + f"{ctes}\n{body}"
