"""Queries over footprints with real geometry: a stored WKB table with bbox, its parts, circles and boxes of it, pins and addresses that meet it."""

import math
import uuid

from pyspark.sql import functions as F

from parcelspark.functions import geo
from parcelspark.functions import geometry as G
from parcelspark.operators import polygons
from parcelspark.operators import raster as R
from parcelspark.operators.tables import shared_folder
from parcelspark.plans.vector import LAT, LON, RADIUS
from parcelspark.sources import footprints as S
from parcelspark.sources import views as V

c = F.col
r = F.round
#: A box of the layout query, in degrees.
BOX = {"xmin": -6.349, "ymin": 53.352, "xmax": -6.345, "ymax": 53.354}
REACH_M = 5.0


def stored(spark, d):
    """The footprints of the tables, written as a source that later queries read: its path."""
    path = f"{shared_folder(spark)}/footprints-{uuid.uuid4().hex[:12]}"
    S.write(V.footprints(spark, d), path, rows_a_file=1 << 16, group_bytes=1 << 20)
    return path


def footprint_parts(spark, d):
    """What each geometry is: kind, counts, whether it is a footprint at all, its area and that and the middle of its largest part, in UTM metres."""
    df = S.read(spark, stored(spark, d)).withColumn("g", G.from_wkb(c("geometry")))
    df = df.withColumn("p", G.moved(c("g"), lambda x, y: geo.utm(y, x))).withColumn("big", G.largest_part(c("p")))
    m = G.moments(F.get("big.rings", F.lit(0)))
    df = df.withColumns({"m": m, "o": F.get(F.get("big.rings", F.lit(0)), F.lit(0))})
    n = lambda x, name: F.coalesce(x, F.lit(0)).alias(name)
    return df.select(
        "building_id", c("g.kind").alias("kind"), n(F.size(F.filter("g.parts", lambda p: F.size(p["rings"]) > 0)), "n_parts"), n(F.size(G.rings(c("g"))), "n_rings"), n(G.n_points(c("g")), "n_points"), G.is_polygonal(c("g")).alias("is_footprint"),
        r(G.area(c("p")), 2).alias("area_m2"), r(G.part_area(c("big")), 2).alias("largest_m2"), r(c("o.x") + c("m.x") / c("m.a"), 2).alias("east"), r(c("o.y") + c("m.y") / c("m.a"), 2).alias("north"),
    )


def footprint_circle(spark, d):
    """Count and area of what touches the circle, holes not counted as area."""
    df = S.in_circle(spark, stored(spark, d), LAT, LON, RADIUS)
    area = G.area(c("plane"))
    out = df.select(area.alias("a")).agg(F.count(F.lit(1)).alias("building_count"), r(F.coalesce(F.sum("a"), F.lit(0.0)), 1).alias("total_area_sqm"), r(F.coalesce(F.avg("a"), F.lit(0.0)), 2).alias("avg_building_area_sqm"))
    return out.select(F.lit(LAT).alias("latitude"), F.lit(LON).alias("longitude"), F.lit(RADIUS).alias("radius_m"), "*")


def footprint_box(spark, d):
    """Footprints whose box touches a box: the scan reads the row groups of the cells around it only."""
    return S.read(spark, stored(spark, d), BOX, keep=("id", "building_id", "height")).select("id", "building_id", r("bbox.xmin", 6).alias("xmin"), r("bbox.ymax", 6).alias("ymax"))


def shapes(spark, d):
    """building_id, geometry of the polygonal footprints."""
    df = S.read(spark, stored(spark, d), keep=("building_id",)).select("building_id", G.from_wkb(c("geometry")).alias("geometry"))
    return df.where(G.is_polygonal(c("geometry")))


def pins_in_footprints(spark, d):
    """Pins that stand in a polygon of a footprint, not in its yard: where no pin may be."""
    return polygons.containing(V.pins(spark, d).select("pin_id", "lat", "lon"), shapes(spark, d), "building_id").select("pin_id", c("r_building_id").alias("building_id"))


def addresses(spark, d):
    """address_id and a U of 24 x 18 m that stands off each building."""
    k = c("building_id")
    b = V.buildings(spark, d).select(k.alias("address_id"), (c("lat") + ((k * 37) % 61 - 30).cast("double") / V.M_PER_DEG).alias("y"), (c("lon") + ((k * 17) % 67 - 33).cast("double") / (V.M_PER_DEG * F.cos(F.radians("lat")))).alias("x"))
    corner = lambda x, y: F.struct((c("x") + x * 24.0 / (V.M_PER_DEG * F.cos(F.radians("y")))).alias("x"), (c("y") + y * 18.0 / V.M_PER_DEG).alias("y"))
    ring = F.array(*[corner(*q) for q in V.U + V.U[:1]])
    return b.select("address_id", F.struct(F.lit("Polygon").alias("kind"), F.array(F.struct(F.lit("Polygon").alias("kind"), F.array(ring).alias("rings"))).alias("parts")).alias("geometry"))


def address_first_hit(spark, d):
    """Each footprint's first address, in their order, among the address polygons that come within 5 m of it, and how many do."""
    hits = polygons.first_touching(shapes(spark, d), addresses(spark, d), "building_id", "address_id", REACH_M)
    return hits.withColumnRenamed("n", "n_addresses")


#: Pixels a metre and pixels a tile of the drawn footprints, and the width of a wall in pixels.
SCALE, TILE, WALL = 2.0, 256, 3.0


def drawn_footprints(spark, d):
    """Footprints filled, with their yards left out, and walls drawn, on tiles of a plane of half a metre a pixel: pixels by building and tile."""
    k = geo.M_PER_DEG * math.cos(math.radians(LAT)) * SCALE
    to = lambda x, y: ((x - LON) * k, (LAT - y) * (geo.M_PER_DEG * SCALE))
    df = S.read(spark, stored(spark, d), keep=("building_id",)).select("building_id", G.moved(G.from_wkb(c("geometry")), to).alias("geometry"))
    px = R.fill_polygons(df, "building_id").withColumn("kind", F.lit("filled")).unionByName(R.draw_polylines(df, "building_id", WALL).withColumn("kind", F.lit("drawn")))
    tile = lambda v: F.floor(c(v) / TILE).cast("long")
    out = px.groupBy("building_id", "kind", tile("y").alias("tile_y"), tile("x").alias("tile_x"))
    return out.agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.pmod(c("y"), F.lit(TILE)) * TILE + F.pmod(c("x"), F.lit(TILE))).cast("long").alias("places"))


# SQL over the corners of the same outlines

SIDES = """, crn1 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, count(*) OVER (PARTITION BY building_id, part, ring) AS n FROM crn WINDOW w AS (PARTITION BY building_id, part, ring ORDER BY i)),
 sd AS (SELECT building_id, kind, part, ring, i, x AS x0, y AS y0, coalesce(x1, x) AS x1, coalesce(y1, y) AS y1 FROM crn1 WHERE x1 IS NOT NULL OR n = 1)"""


def _utm_sql(source: str) -> str:
    """The rows of source (y, x in degrees) with east and north of the zone around 9 degrees west, where all of them are."""
    terms = lambda f, g: " + ".join(f"{a!r}::DOUBLE * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(geo.ALPHA, 1))
    ecc = 2 * geo.N3**0.5 / (1 + geo.N3)
    k = f"{geo.SCALE * geo.MEAN_RADIUS!r}::DOUBLE"
    return f"""(SELECT *, {k} * (eta + {terms('cos', 'sinh')}) + 500000 AS east, {k} * (xi + {terms('sin', 'cosh')}) AS north FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM
      (SELECT *, radians(x + 9) AS lam, sinh(atanh(sin(radians(y))) - {ecc!r}::DOUBLE * atanh({ecc!r}::DOUBLE * sin(radians(y)))) AS t FROM {source})))"""


def _to_segment(x, y, ax, ay, bx, by):
    t = f"CASE WHEN ({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}) > 0 THEN greatest(0::DOUBLE, least(1::DOUBLE, (({x} - {ax}) * ({bx} - {ax}) + ({y} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay})))) ELSE 0 END"
    return f"sqrt(power({x} - ({ax} + ({t}) * ({bx} - {ax})), 2) + power({y} - ({ay} + ({t}) * ({by} - {ay})), 2))"


def _sql(body: str, ctes: str = "", more: str = "") -> str:
    return f"WITH bld0 AS ({V.SQL['bld0']}),\n bld AS ({V.SQL['bld']}){more},\n {V.footprint_sql()}{ctes}\n{body}"


KIND_SQL = "CASE building_id % 16 " + " ".join(f"WHEN {k} THEN '{s[0]}'" for k, s in V.SHAPES.items() if s) + " END"
RING_SQL = f""", u AS (SELECT building_id, kind, part, ring, i, east, north FROM {_utm_sql('crn')}),
 u0 AS (SELECT *, first_value(east) OVER w AS e0, first_value(north) OVER w AS n0, lead(east) OVER w AS e1, lead(north) OVER w AS n1 FROM u WINDOW w AS (PARTITION BY building_id, part, ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 rg AS (SELECT building_id, kind, part, ring, any_value(e0) AS e0, any_value(n0) AS n0, sum(w) / 2 AS a, sum((east - e0 + e1 - e0) * w) / 6 AS mx, sum((north - n0 + n1 - n0) * w) / 6 AS my
   FROM (SELECT *, (east - e0) * (n1 - n0) - (e1 - e0) * (north - n0) AS w FROM u0 WHERE e1 IS NOT NULL) GROUP BY building_id, kind, part, ring),
 pt AS (SELECT building_id, part, sum(CASE WHEN ring = 0 THEN abs(a) ELSE -abs(a) END) AS a, any_value(e0 + mx / a) FILTER (ring = 0) AS cx, any_value(n0 + my / a) FILTER (ring = 0) AS cy FROM rg WHERE kind LIKE '%Polygon' GROUP BY building_id, part)"""
PINS_IN_SQL = f"""WITH bld0 AS ({V.SQL['bld0']}), pin AS ({V.SQL['pin']}), {V.footprint_sql()}{SIDES},
 bx AS (SELECT building_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM crn WHERE kind LIKE '%Polygon' GROUP BY building_id),
 cd AS (SELECT pin_id, lat, lon, bx.building_id FROM pin JOIN bx ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1)
SELECT DISTINCT pin_id, building_id FROM (SELECT pin_id, cd.building_id, part FROM cd JOIN sd ON sd.building_id = cd.building_id AND (sd.y0 <= lat) <> (sd.y1 <= lat) AND lon < sd.x0 + (lat - sd.y0) * (sd.x1 - sd.x0) / (sd.y1 - sd.y0) GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _address_sql() -> str:
    corners = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(V.U + V.U[:1]))
    m = "111320::DOUBLE"
    k = "cos(radians((s.y0 + s.y1 + t.y0 + t.y1) / 4))"
    p = {f"{n}{i}": (f"(({n}.x{i} - s.x0) * {m} * {k})", f"(({n}.y{i} - s.y0) * {m})") for n in "st" for i in "01"}
    side = lambda a, b, q: f"sign(({p[b][0]} - {p[a][0]}) * ({p[q][1]} - {p[a][1]}) - ({p[b][1]} - {p[a][1]}) * ({p[q][0]} - {p[a][0]}))"
    crossed = f"{side('s0', 's1', 't0')} * {side('s0', 's1', 't1')} < 0 AND {side('t0', 't1', 's0')} * {side('t0', 't1', 's1')} < 0"
    ends = " OR ".join(f"{_to_segment(*p[q], *p[a], *p[b])} <= {REACH_M}" for q, a, b in (("t0", "s0", "s1"), ("t1", "s0", "s1"), ("s0", "t0", "t1"), ("s1", "t0", "t1")))
    odd = lambda point, edges, key: f"""SELECT DISTINCT building_id, address_id FROM (SELECT cd.building_id, cd.address_id, q.part, e.part AS p2 FROM cd JOIN (SELECT * FROM {point} WHERE ring = 0 AND i = 0) q ON q.{key[0]} = cd.{key[0]} JOIN {edges} e ON e.{key[1]} = cd.{key[1]}
      AND (e.y0 <= q.y0) <> (e.y1 <= q.y0) AND q.x0 < e.x0 + (q.y0 - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) GROUP BY ALL HAVING count(*) % 2 = 1)"""  # noqa: E731
    return _sql(f"""SELECT building_id, min(address_id) AS address_id, count(*) AS n_addresses FROM (
      SELECT DISTINCT cd.building_id, cd.address_id FROM cd JOIN sp s ON s.building_id = cd.building_id JOIN ad t ON t.address_id = cd.address_id WHERE ({crossed}) OR {ends}
      UNION {odd('sp', 'ad', ('building_id', 'address_id'))} UNION {odd('ad', 'sp', ('address_id', 'building_id'))}) GROUP BY building_id""", SIDES + f""", sp AS (SELECT * FROM sd WHERE kind LIKE '%Polygon'),
 aa AS (SELECT building_id AS address_id, lat + ((building_id * 37) % 61 - 30)::DOUBLE / {m} AS y, lon + ((building_id * 17) % 67 - 33)::DOUBLE / ({m} * cos(radians(lat))) AS x FROM bld0),
 ac AS (SELECT address_id, i, x + fx * 24 / ({m} * cos(radians(y))) AS x, y + fy * 18 / {m} AS y FROM aa, (VALUES {corners}) t(i, fx, fy)),
 ad AS (SELECT * FROM (SELECT address_id, 0 AS part, 0 AS ring, i, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ac WINDOW w AS (PARTITION BY address_id ORDER BY i)) WHERE x1 IS NOT NULL),
 b1 AS (SELECT building_id, min(x0) - 0.0001 AS x0, max(x0) + 0.0001 AS x1, min(y0) - 0.00005 AS y0, max(y0) + 0.00005 AS y1 FROM sp GROUP BY building_id),
 b2 AS (SELECT address_id, min(x0) AS x0, max(x0) AS x1, min(y0) AS y0, max(y0) AS y1 FROM ad GROUP BY address_id),
 cd AS (SELECT building_id, address_id FROM b1 JOIN b2 ON b1.x0 <= b2.x1 AND b1.x1 >= b2.x0 AND b1.y0 <= b2.y1 AND b1.y1 >= b2.y0)""")


ORACLES = {
    "footprint_parts": _sql(f"""SELECT b.building_id, {KIND_SQL.replace('building_id', 'b.building_id')} AS kind, coalesce(n_parts, 0)::INT AS n_parts, coalesce(n_rings, 0)::INT AS n_rings, coalesce(n_points, 0)::INT AS n_points,
      coalesce(n_points > 0 AND kind LIKE '%Polygon', false) AS is_footprint, CASE WHEN b.building_id % 16 <> 15 THEN round(coalesce(area, 0), 2) END AS area_m2, round(p.a, 2) AS largest_m2, round(p.cx, 2) AS east, round(p.cy, 2) AS north
      FROM bld0 b LEFT JOIN (SELECT building_id, any_value(kind) AS kind, count(DISTINCT part) AS n_parts, count(DISTINCT (part, ring)) AS n_rings, count(*) AS n_points FROM crn GROUP BY building_id) n USING (building_id)
      LEFT JOIN (SELECT building_id, sum(a) AS area FROM pt GROUP BY building_id) a USING (building_id) LEFT JOIN (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY a DESC, part) = 1) p USING (building_id)""", RING_SQL),
    "footprint_circle": _sql(f"""SELECT {LAT}::DOUBLE AS latitude, {LON}::DOUBLE AS longitude, {RADIUS}::DOUBLE AS radius_m, count(*) AS building_count, round(coalesce(sum(a), 0), 1) AS total_area_sqm, round(coalesce(avg(a), 0), 2) AS avg_building_area_sqm
      FROM (SELECT DISTINCT building_id FROM near UNION SELECT building_id FROM ins) JOIN (SELECT building_id, coalesce(sum(a), 0) AS a FROM (SELECT DISTINCT building_id FROM crn) LEFT JOIN pt USING (building_id) GROUP BY building_id) USING (building_id)""", RING_SQL + f""",
 ctr AS (SELECT east AS ce, north AS cn FROM {_utm_sql(f'(SELECT {LAT}::DOUBLE AS y, ({LON})::DOUBLE AS x)')}),
 sg AS (SELECT building_id, kind, part, east - ce AS ax, north - cn AS ay, coalesce(e1, east) - ce AS bx, coalesce(n1, north) - cn AS by_ FROM u0, ctr WHERE e1 IS NOT NULL OR kind = 'Point'),
 near AS (SELECT building_id FROM sg WHERE {_to_segment('0', '0', 'ax', 'ay', 'bx', 'by_')} <= {RADIUS}),
 ins AS (SELECT DISTINCT building_id FROM (SELECT building_id, part FROM sg WHERE kind LIKE '%Polygon' AND (ay <= 0) <> (by_ <= 0) AND 0 < ax + (0 - ay) * (bx - ax) / (by_ - ay) GROUP BY building_id, part HAVING count(*) % 2 = 1))"""),
    "footprint_box": _sql(f"""SELECT 'b' || building_id AS id, building_id, round(min(x), 6) AS xmin, round(max(y), 6) AS ymax FROM crn GROUP BY building_id
      HAVING max(x) >= {BOX['xmin']}::DOUBLE AND min(x) <= {BOX['xmax']}::DOUBLE AND max(y) >= {BOX['ymin']}::DOUBLE AND min(y) <= {BOX['ymax']}::DOUBLE"""),
    "pins_in_footprints": PINS_IN_SQL,
    "drawn_footprints": _sql(f"""SELECT building_id, kind, floor(y / {TILE}::DOUBLE)::BIGINT AS tile_y, floor(x / {TILE}::DOUBLE)::BIGINT AS tile_x, count(*) AS pixels, sum(((y % {TILE} + {TILE}) % {TILE}) * {TILE} + (x % {TILE} + {TILE}) % {TILE})::BIGINT AS places FROM (
      SELECT DISTINCT building_id, 'filled' AS kind, y, x FROM (SELECT g.building_id, part, g.y, g.x FROM grid g JOIN e ON e.building_id = g.building_id AND e.kind LIKE '%Polygon' AND (e.y0 <= g.y) <> (e.y1 <= g.y) AND g.x < e.x0 + (g.y - e.y0) * (e.x1 - e.x0) / (e.y1 - e.y0) GROUP BY ALL HAVING count(*) % 2 = 1)
      UNION ALL SELECT DISTINCT building_id, 'drawn', g.y, g.x FROM grid g JOIN e USING (building_id) WHERE e.kind LIKE '%LineString' AND {_to_segment('g.x', 'g.y', 'e.x0', 'e.y0', 'e.x1', 'e.y1')} <= {WALL / 2}) GROUP BY ALL""", SIDES + f""",
 e AS (SELECT building_id, kind, part, (x0 - ({LON})::DOUBLE) * {geo.M_PER_DEG * math.cos(math.radians(LAT)) * SCALE!r}::DOUBLE AS x0, ({LAT}::DOUBLE - y0) * {geo.M_PER_DEG * SCALE}::DOUBLE AS y0, (x1 - ({LON})::DOUBLE) * {geo.M_PER_DEG * math.cos(math.radians(LAT)) * SCALE!r}::DOUBLE AS x1, ({LAT}::DOUBLE - y1) * {geo.M_PER_DEG * SCALE}::DOUBLE AS y1 FROM sd),
 ext AS (SELECT building_id, floor(min(least(x0, x1)) - 2)::BIGINT AS xa, ceil(max(greatest(x0, x1)) + 2)::BIGINT AS xb, floor(min(least(y0, y1)) - 2)::BIGINT AS ya, ceil(max(greatest(y0, y1)) + 2)::BIGINT AS yb FROM e GROUP BY building_id),
 grid AS (SELECT building_id, y, unnest(range(xa, xb + 1)) AS x FROM (SELECT building_id, xa, xb, unnest(range(ya, yb + 1)) AS y FROM ext))"""),
    "address_first_hit": _address_sql(),
}
QUERIES = {n: globals()[n] for n in ORACLES}
