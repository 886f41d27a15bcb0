"""Queries over the pixel tables."""

from pyspark.sql import functions as F

from parcelspark.operators import raster as R
from parcelspark.operators.tables import sent
from parcelspark.sources import views as V
from parcelspark.sources.views import oracle

c = F.col


#: Pixels of a row of the raster.
WIDE = 64


def size(spark, d):
    return {"x": WIDE, "y": (V.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1}


def hsv_convert(spark, d):
    return R.hsv(V.pixels(spark, d)).select("y", "x", "h", "s", "v")


def green_ranges(spark, d):
    df = R.hsv(V.pixels(spark, d))
    return df.groupBy("y").agg(F.count_if(R.is_green()).alias("any_range"), F.count_if(R.is_green(R.GREENS[:1])).alias("one_range"))


def exg_mask(spark, d):
    return V.pixels(spark, d).where(R.excess_green() > 0.1).select("y", "x", F.round(R.excess_green(), 6).alias("exg"))


def mask_algebra(spark, d):
    df = R.hsv(V.pixels(spark, d)).select("y", "x", R.is_green().alias("a"), (R.excess_green() > 0.05).alias("b"))
    return df.groupBy("y").agg(*[F.count_if(m).alias(n) for n, m in (("both", c("a") & c("b")), ("either", c("a") | c("b")), ("less", c("a") & ~c("b")), ("neither", ~(c("a") | c("b"))))])


def box_mean_11(spark, d):
    df = R.box_sums(V.pixels(spark, d).select("y", "x", c("g").cast("long").alias("g")), size(spark, d), 5, "g")
    return df.select("y", "x", F.round(c("g") / 121, 6).alias("mean"))


def _cv(spark, d):
    df = V.pixels(spark, d).select("y", "x", c("g").cast("long").alias("g"), (c("g") * c("g")).cast("long").alias("q"))
    df = R.box_sums(df, size(spark, d), 5, "g", "q")
    mean = c("g") / 121
    return df.select("y", "x", (F.sqrt(F.greatest(F.lit(0.0), c("q") / 121 - mean * mean)) / F.greatest(mean, F.lit(1.0))).alias("cv"))


def local_cv(spark, d):
    return _cv(spark, d).select("y", "x", F.round("cv", 5).alias("cv"))


def cv_median_split(spark, d):
    df = _cv(spark, d).withColumn("cv", F.round("cv", 5))
    limit = df.agg(F.least(F.lit(0.5), F.greatest(F.lit(0.05), F.percentile("cv", 0.5))).alias("threshold"))
    return df.crossJoin(limit).groupBy("threshold").agg(F.count_if(c("cv") < c("threshold")).alias("grass"), F.count_if(c("cv") >= c("threshold")).alias("tree"))


def veg_ratio_51(spark, d):
    df = V.pixels(spark, d).select("y", "x", (R.excess_green() > 0.1).cast("long").alias("n"))
    return R.box_sums(df, size(spark, d), 25, "n").select("y", "x", F.round(c("n") / 2601, 6).alias("ratio"))


def owner_edges(spark, d):
    df = V.pixels(spark, d).withColumn("owner", F.floor(c("r") / 64) + 4 * F.floor(c("b") / 128))
    return R.owner_edges(df, "owner").where("edge").select("y", "x")


def owner_voronoi(spark, d):
    """Each pixel to the nearest seed (bright red pixels of every eighth row), at any distance; smaller seed on ties."""
    df = R.nearest_source(V.pixels(spark, d), (c("r") > 150) & (c("y") % 8 == 0))
    return df.select("y", "x", "sy", "sx", "d2")


def edt_small(spark, d):
    return R.squared_distance(V.pixels(spark, d), c("g") > 190).select("y", "x", "d2")


def erode_dilate(spark, d):
    df = V.pixels(spark, d).select("y", "x", (c("g") > 128).cast("int").alias("m"))
    return R.morph(R.morph(df, "m", F.min, "eroded"), "m", F.max, "dilated").select("y", "x", "eroded", "dilated")


def open_close(spark, d):
    """Opened by the cross of 3, closed by the ellipse of 5, dilated by the ellipse of 7."""
    df = V.pixels(spark, d).select("y", "x", (c("g") > 128).cast("int").alias("m"))
    df = R.morph(R.morph(df, "m", F.min, "e"), "m", F.max, "f", R.ELLIPSE_5)
    df = R.morph(R.morph(df, "e", F.max, "opened"), "f", F.min, "closed", R.ELLIPSE_5)
    return R.morph(df, "m", F.max, "wide", R.ELLIPSE_7).select("y", "x", "opened", "closed", "wide")


def _mask(spark, d):
    return V.pixels(spark, d).where("g > 150").select("y", "x")


def components_4(spark, d):
    return R.components(_mask(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def components_8(spark, d):
    return R.components(_mask(spark, d), eight=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def fill_holes(spark, d):
    return R.holes(V.pixels(spark, d).withColumn("m", c("g") > 100), "m", *size(spark, d).values())


def component_contours(spark, d):
    """Outlines of the components of 6 pixels or more."""
    return R.contours(R.components(_mask(spark, d)), 6).select("y", "x", "label")


def mask_stats(spark, d):
    """Pixels, share, components and area of the vegetation mask, at 0.3 m a pixel."""
    mask = V.pixels(spark, d).where(R.excess_green() > 0.3).select("y", "x")
    parts = R.components(mask, eight=True).agg(F.count(F.lit(1)).alias("pixels"), F.count_distinct("label").alias("components"))
    whole = V.pixels(spark, d).agg(F.count(F.lit(1)).alias("whole"))
    return parts.crossJoin(whole).select("pixels", F.round(c("pixels") * 100.0 / c("whole"), 4).alias("pct"), "components", F.round(c("pixels") * 0.09, 4).alias("area_m2"))  # two rows of one


def density_maps(spark, d):
    """Green share in squares of 31, share of trees in squares of 41, and of trees in the green where there is more than 0.05 of it."""
    df = R.hsv(V.pixels(spark, d)).select("y", "x", (R.excess_green() > 0.1).cast("long").alias("green"), ((R.excess_green() > 0.1) & (c("v") < 170)).cast("long").alias("tree"))
    at = size(spark, d)
    one = R.box_sums(df.select("y", "x", "green"), at, 15, "green")
    two = R.box_sums(df.select("y", "x", c("green").alias("green41"), "tree"), at, 20, "green41", "tree")
    den, tree = c("green41") / 1681, c("tree") / 1681
    return one.join(sent(two), ["y", "x"]).select("y", "x", F.round(c("green") / 961, 6).alias("green_31"), F.round(tree, 6).alias("tree_41"), F.round(F.when(den > 0.05, tree / den).otherwise(0.0), 6).alias("tree_fraction"))


def enhanced_vegetation(spark, d):
    """Vegetation by hue and by excess green where the ground is rough, closed twice and opened once by the ellipse of 5; of the image smoothed once,
    as its raw pixels have nothing to do with each other."""
    at = size(spark, d)
    mean = lambda v: F.floor(c(v) / 256).cast("int").alias(v)
    px = R.gauss_sums(V.pixels(spark, d), at, "r", "g", "b").select("y", "x", mean("r"), mean("g"), mean("b"))
    green = R.hsv(px).select("y", "x", (R.is_green() & (R.excess_green() > 0.1)).cast("int").alias("green"))
    df = green.join(sent(R.rough(px, at)), ["y", "x"]).select("y", "x", (c("green") * c("rough")).alias("m"))
    for value, pick, name in (("m", F.max, "a"), ("a", F.max, "b"), ("b", F.min, "e"), ("e", F.min, "f"), ("f", F.min, "g"), ("g", F.max, "h")):
        df = R.morph(df, value, pick, name, R.ELLIPSE_5)
    return df.where("h = 1").select("y", "x")


def tree_recovery(spark, d):
    """Vegetation that isn't grass by texture (CV at the threshold or more) but under twice it, within 8 m of a building (0.5 m a pixel)."""
    cv = _cv(spark, d).withColumn("cv", F.round("cv", 5))
    limit = cv.agg(F.least(F.lit(0.5), F.greatest(F.lit(0.05), F.percentile("cv", 0.5))).alias("threshold"))
    near = R.squared_distance(V.pixels(spark, d), c("r") > 190).where((c("d2") <= 256) & (R.excess_green() > 0.1)).select("y", "x")
    return cv.join(sent(near), ["y", "x"]).crossJoin(F.broadcast(limit)).where((c("cv") >= c("threshold")) & (c("cv") < 2 * c("threshold"))).select("y", "x")  # one row


def shade_image(spark, d):
    """Shade recovered from the image: dark and dull, hue 20-105, a little green, within 15 m of a building (0.5 m a pixel), with more than
    0.08 of vegetation in the 31 x 31 square, itself no vegetation, building or road."""
    df = R.hsv(V.pixels(spark, d)).withColumn("n", (R.excess_green() > 0.1).cast("long"))
    near = R.box_sums(df.select("y", "x", "n"), size(spark, d), 15, "n").select("y", "x", c("n").alias("near"))
    df = R.squared_distance(df, c("r") > 190).join(sent(near), ["y", "x"])
    dark = (c("v") < 170) & (c("s") > 10) & c("h").between(20, 105) & (R.excess_green() > 0.005)
    ground = (c("n") == 0) & (c("r") <= 190) & (c("b") <= 190)
    return df.where(dark & ground & (c("near") > 0.08 * 961) & (c("d2") <= 900)).select("y", "x")


def crop(spark, d):
    """The raster cut into chunks of 16 x 16 pixels with a halo of 4: rows and columns within each chunk, and whose core a pixel is in."""
    chunk = lambda v, by: F.floor((v + by) / 16).cast("int")
    df = V.pixels(spark, d).select("y", "x", "g", F.explode(F.sequence(chunk(c("y"), -4), chunk(c("y"), 4))).alias("i"))
    df = df.select("*", F.explode(F.sequence(chunk(c("x"), -4), chunk(c("x"), 4))).alias("j")).where("i >= 0 and j >= 0 and j < 4")
    own = (F.floor(c("y") / 16) == c("i")) & (F.floor(c("x") / 16) == c("j"))
    return df.groupBy("i", "j").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(own).alias("core"), F.sum("g").alias("total"))


def placeholder_raster(spark, d):
    """The raster of areas without imagery: 200, with lines of 150 two pixels wide at every 256; counts by tile."""
    from parcelspark.functions import geo

    tiles = V.areas(spark, d).select("area_id", geo.tiles_for_distance(c("radius_m"), c("lat"), c("zoom")).alias("n"))
    rows = tiles.select("area_id", "n", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("y"))
    df = rows.select("area_id", "n", "y", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("x"))
    value = F.when((c("y") < 2) | (c("x") < 2), 150).otherwise(200)
    return df.groupBy("area_id", "n").agg(F.sum(value).alias("total"), F.count_if(value == 150).alias("lines")).select("area_id", ((2 * c("n") + 1) * (2 * c("n") + 1)).alias("tiles"), "total", "lines")


def fill_and_draw(spark, d):
    """Diamonds around every building and 3-pixel lines through them, as pixels of a plane of 1 m; counted by building."""
    b = V.buildings(spark, d).select("building_id", "w_m", "h_m")
    b = b.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "building_id")  # a shape is small: all its rows and pixels stay in the task
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero, w, h = F.lit(0.0), c("w_m"), c("h_m")
    ring = F.array(corner(zero, -h), corner(w, zero), corner(zero, h), corner(-w, zero), corner(zero, -h))
    pixels = F.sum(c("x1").cast("long") - c("x0") + 1)  # of runs
    filled = R.ring_runs(b.select("building_id", ring.alias("ring")), "building_id").groupBy("building_id").agg(pixels.alias("filled"))
    lines = b.select("building_id", (-w).alias("ax"), (-h).alias("ay"), w.alias("bx"), h.alias("by"))
    drawn = R.line_runs(lines, "building_id", 3.0).groupBy("building_id").agg(pixels.alias("drawn"))
    return filled.join(drawn, "building_id")


def surface_precedence(spark, d):
    df = V.pixels(spark, d)
    kind = F.when(c("r") > 190, "building").when(c("b") > 190, "road").when(c("r") + c("b") > 300, "driveway").when(R.excess_green() > 0.1, "grass").when((R.excess_green() > 0.005) & (c("g") > 120), "grass").when(c("r") < 70, "car_parking").otherwise("paved")
    return df.select("y", "x", kind.alias("surface"))


def spatial_mask_20m(spark, d):
    """Ground within 20 m (40 pixels of 0.5 m) of a building pixel, less buildings and roads."""
    df = R.squared_distance(V.pixels(spark, d), c("r") > 190, 40)
    return df.where(c("d2").isNotNull() & (c("r") <= 190) & (c("b") <= 190)).select("y", "x", "d2")


HSV = """, mm AS (SELECT y, x, r, g, b, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM px),
 hh AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b) * 60 / d::DOUBLE WHEN v = g THEN 120 + (b - r) * 60 / d::DOUBLE ELSE 240 + (r - g) * 60 / d::DOUBLE END AS deg FROM mm),
 hsv AS (SELECT y, x, r, g, b, round((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) / 2)::INT AS h, (CASE WHEN v = 0 THEN 0 ELSE round(d * 255 / v::DOUBLE) END)::INT AS s, v FROM hh)"""


def green_sql(ranges):
    return "(" + " OR ".join(f"(h BETWEEN {a[0]} AND {b[0]} AND s BETWEEN {a[1]} AND {b[1]} AND v BETWEEN {a[2]} AND {b[2]})" for a, b in ranges) + ")"


EXG = "((2 * g - r - b) / 255::DOUBLE)"
D2 = "(p.y - s.y) * (p.y - s.y) + (p.x - s.x) * (p.x - s.x)"


def source_sql(where):
    """nd: y, x, d2 of every pixel to the nearest pixel of a kind: the nearest one of its column, then the best column of its row."""
    return f""", nc AS (SELECT y, x, least(y - max(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), min(s) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - y) AS c FROM (SELECT y, x, CASE WHEN {where} THEN y END AS s FROM px) WINDOW w AS (PARTITION BY x ORDER BY y)),
 nd AS (SELECT p.y, p.x, min((p.x - q.x) * (p.x - q.x) + q.c * q.c)::BIGINT AS d2 FROM nc p LEFT JOIN nc q ON q.y = p.y AND q.c IS NOT NULL GROUP BY p.y, p.x)"""


def box_sql(name, source, half, *values):
    """name: y, x and sums of values over squares, by mirrored rows and two windows."""
    out, rows = "", source
    for k, axis in enumerate("xy"):
        last = "63" if axis == "x" else "(SELECT max(y) FROM px)"
        other = "y" if axis == "x" else "x"
        cols = lambda e: ", ".join(e if x == axis else x for x in ("y", "x"))
        vs = ", ".join(values)
        sums = ", ".join(f"sum({v}) OVER (PARTITION BY {other} ORDER BY {axis} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS {v}" for v in values)
        out += f""", {name}m{k} AS (SELECT y, x, {vs} FROM {rows} UNION ALL SELECT {cols(f'-{axis} - 1')}, {vs} FROM {rows} WHERE {axis} < {half} UNION ALL SELECT {cols(f'2 * {last} + 1 - {axis}')}, {vs} FROM {rows} WHERE {axis} > {last} - {half}),
      {name}{k} AS (SELECT * FROM (SELECT y, x, {sums} FROM {name}m{k}) WHERE {axis} BETWEEN 0 AND {last})"""
        rows = f"{name}{k}"
    return out + f", {name} AS (SELECT * FROM {rows})"


CV = ", gq AS (SELECT y, x, g, g * g AS q FROM px)" + box_sql("cs", "gq", 5, "g", "q") + """,
 cv AS (SELECT y, x, round(sqrt(greatest(0, q / 121::DOUBLE - (g / 121::DOUBLE) * (g / 121::DOUBLE))) / greatest(g / 121::DOUBLE, 1), 5) AS cv FROM cs),
 lim AS (SELECT least(0.5::DOUBLE, greatest(0.05::DOUBLE, quantile_cont(cv, 0.5))) AS t FROM cv)"""
VEG = f", vg AS (SELECT y, x, ({EXG} > 0.1::DOUBLE)::INT AS n FROM px)"
NEAR4 = "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
STEP4 = "((b.y = a.y AND b.x IN (a.x - 1, a.x + 1)) OR (b.x = a.x AND b.y IN (a.y - 1, a.y + 1)))"


def offsets_sql(reach):
    """Offsets dy, dx of a structuring element."""
    return ", ".join(f"({dy}, {dx})" for dy, r in reach.items() for dx in range(-r, r + 1))


def morph_sql(name, source, value, pick, element):
    """name: y, x and the value of the dilated or eroded raster."""
    return f", {name} AS (SELECT p.y, p.x, {pick}(q.{value}) AS {value} FROM {source} p, (VALUES {offsets_sql(element)}) o(dy, dx), {source} q WHERE q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY p.y, p.x)"


def components_sql(eight=False, where="g > 150"):
    steps = "(0, 1), (1, 0), (0, -1), (-1, 0)" + (", (1, 1), (1, -1), (-1, 1), (-1, -1)" if eight else "")
    return f""", m AS (SELECT y, x, y * 1048576 + x AS id FROM px WHERE {where}), e AS (SELECT a.id AS u, b.id AS v FROM m a, (VALUES {steps}) o(dy, dx), m b WHERE b.y = a.y + o.dy AND b.x = a.x + o.dx),
 walk AS (SELECT id AS u, id AS root FROM m UNION SELECT e.v, w.root FROM walk w JOIN e ON e.u = w.u AND w.root < e.v),
 lab AS (SELECT u AS id, min(root) AS label FROM walk GROUP BY u)"""


#: Weighted sums as joins of each pixel with the 25 it mirrors to; sm: the raster smoothed once; t2: where that is rough.
FOLD = lambda v, last: f"({last} - abs({last} - abs({v})))"


def gauss_sql(name, source, *values):
    sums = ", ".join(f"sum(w * q.{v}) AS {v}" for v in values)
    return f""", {name}x AS (SELECT p.y, p.x, {sums} FROM {source} p, gw JOIN {source} q ON q.y = p.y AND q.x = {FOLD('p.x + k', '63')} GROUP BY p.y, p.x),
 {name} AS (SELECT p.y, p.x, {sums} FROM {source} p, gw JOIN {name}x q ON q.x = p.x AND q.y = {FOLD('p.y + k', '(SELECT max(y) FROM px)')} GROUP BY p.y, p.x)"""


SMOOTH = ", gw AS (SELECT * FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) t(k, w))" + gauss_sql("s0", "px", "r", "g", "b") + ", sm AS (SELECT y, x, (r // 256)::INT AS r, (g // 256)::INT AS g, (b // 256)::INT AS b FROM s0)"
TEXTURE = f", gr AS (SELECT y, x, (r * {R.GRAY[0]} + g * {R.GRAY[1]} + b * {R.GRAY[2]} + 8192) // 16384 AS v FROM sm)" + gauss_sql("gy", "gr", "v") + """,
 t0 AS (SELECT y, x, (abs(gr.v - (gy.v + 128) // 256) > 3)::INT AS t FROM gr JOIN gy USING (y, x))""" + morph_sql("t1", "t0", "t", "max", R.ELLIPSE_7) + morph_sql("t2", "t1", "t", "max", R.ELLIPSE_7)
BIN = ", mk AS (SELECT y, x, (g > 128)::INT AS m FROM px)"
ORACLES = {
    "hsv_convert": oracle("px", "SELECT y, x, h, s, v FROM hsv", HSV),
    "green_ranges": oracle("px", f"SELECT y, count(*) FILTER ({green_sql(R.GREENS)}) AS any_range, count(*) FILTER ({green_sql(R.GREENS[:1])}) AS one_range FROM hsv GROUP BY y", HSV),
    "exg_mask": oracle("px", f"SELECT y, x, round({EXG}, 6) AS exg FROM px WHERE {EXG} > 0.1::DOUBLE"),
    "mask_algebra": oracle("px", "SELECT y, count(*) FILTER (a AND b) AS both, count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND NOT b) AS less, count(*) FILTER (NOT (a OR b)) AS neither FROM ab GROUP BY y", HSV + f", ab AS (SELECT y, {green_sql(R.GREENS)} AS a, {EXG} > 0.05::DOUBLE AS b FROM hsv)"),
    "box_mean_11": oracle("px", "SELECT y, x, round(g / 121::DOUBLE, 6) AS mean FROM bs", box_sql("bs", "px", 5, "g")),
    "local_cv": oracle("px", "SELECT y, x, cv FROM cv", CV),
    "cv_median_split": oracle("px", "SELECT t AS threshold, count(*) FILTER (cv < t) AS grass, count(*) FILTER (cv >= t) AS tree FROM cv, lim GROUP BY t", CV),
    "veg_ratio_51": oracle("px", "SELECT y, x, round(n / 2601::DOUBLE, 6) AS ratio FROM bs", VEG + box_sql("bs", "vg", 25, "n")),
    "owner_edges": oracle("px", "SELECT y, x FROM (SELECT y, x, o, lag(o) OVER (PARTITION BY y ORDER BY x) AS l, lag(o) OVER (PARTITION BY x ORDER BY y) AS u FROM (SELECT y, x, floor(r / 64::DOUBLE) + 4 * floor(b / 128::DOUBLE) AS o FROM px)) WHERE l <> o OR u <> o"),
    "owner_voronoi": oracle("px", f"SELECT y, x, m[2] AS sy, m[3]::INT AS sx, m[1] AS d2 FROM (SELECT p.y, p.x, min([{D2}, s.y, s.x]) AS m FROM px p, (SELECT y, x FROM px WHERE r > 150 AND y % 8 = 0) s GROUP BY p.y, p.x)"),
    "edt_small": oracle("px", "SELECT y, x, d2 FROM nd", source_sql("g > 190")),
    "erode_dilate": oracle("px", "SELECT y, x, a.m AS eroded, b.m AS dilated FROM a JOIN b USING (y, x)", BIN + morph_sql("a", "mk", "m", "min", R.CROSS_3) + morph_sql("b", "mk", "m", "max", R.CROSS_3)),
    "open_close": oracle("px", "SELECT y, x, b.m AS opened, d.m AS closed, w.m AS wide FROM b JOIN d USING (y, x) JOIN w USING (y, x)", BIN + morph_sql("a", "mk", "m", "min", R.CROSS_3) + morph_sql("b", "a", "m", "max", R.CROSS_3) + morph_sql("c", "mk", "m", "max", R.ELLIPSE_5) + morph_sql("d", "c", "m", "min", R.ELLIPSE_5) + morph_sql("w", "mk", "m", "max", R.ELLIPSE_7)),
    "components_4": oracle("px", "SELECT label, count(*) AS n FROM lab GROUP BY label", components_sql(), recursive=True),
    "components_8": oracle("px", "SELECT label, count(*) AS n FROM lab GROUP BY label", components_sql(True), recursive=True),
    "component_contours": oracle("px", "SELECT id // 1048576 AS y, (id % 1048576)::INT AS x, label FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) >= 6) AND id IN (SELECT u FROM e GROUP BY u HAVING count(*) < 4 UNION ALL SELECT id FROM m WHERE id NOT IN (SELECT u FROM e))", components_sql(), recursive=True),
    "mask_stats": oracle("px", "SELECT count(*) AS pixels, round(count(*) * 100::DOUBLE / (SELECT count(*) FROM px), 4) AS pct, count(DISTINCT label) AS components, round(count(*) * 0.09::DOUBLE, 4) AS area_m2 FROM lab", components_sql(True, f"{EXG} > 0.3::DOUBLE"), recursive=True),
    "fill_holes": oracle("px", "SELECT id // 1048576 AS y, (id % 1048576)::INT AS x FROM lab WHERE label NOT IN (SELECT label FROM lab WHERE id // 1048576 IN (0, (SELECT max(y) FROM px)) OR id % 1048576 IN (0, 63))", components_sql(where="NOT g > 100"), recursive=True),
    "density_maps": oracle("px", "SELECT y, x, round(g1.n / 961::DOUBLE, 6) AS green_31, round(g2.t / 1681::DOUBLE, 6) AS tree_41, round(CASE WHEN g2.n / 1681::DOUBLE > 0.05::DOUBLE THEN (g2.t / 1681::DOUBLE) / (g2.n / 1681::DOUBLE) ELSE 0 END, 6) AS tree_fraction FROM g1 JOIN g2 USING (y, x)", f", gt AS (SELECT y, x, ({EXG} > 0.1::DOUBLE)::INT AS n, ({EXG} > 0.1::DOUBLE AND greatest(r, g, b) < 170)::INT AS t FROM px)" + box_sql("g1", "gt", 15, "n") + box_sql("g2", "gt", 20, "n", "t")),
    "enhanced_vegetation": oracle("px", "SELECT y, x FROM m6 WHERE m = 1", SMOOTH + HSV.replace("FROM px", "FROM sm") + TEXTURE + f", m0 AS (SELECT y, x, ({green_sql(R.GREENS)} AND {EXG} > 0.1::DOUBLE)::INT * t AS m FROM hsv JOIN t2 USING (y, x))" + "".join(morph_sql(f"m{k + 1}", f"m{k}", "m", p, R.ELLIPSE_5) for k, p in enumerate(("max", "max", "min", "min", "min", "max")))),
    "tree_recovery": oracle("px", f"SELECT y, x FROM cv JOIN nd USING (y, x) JOIN px USING (y, x), lim WHERE d2 <= 256 AND {EXG} > 0.1::DOUBLE AND cv >= t AND cv < 2 * t", CV + source_sql("r > 190")),
    "shade_image": oracle("px", f"SELECT y, x FROM hsv JOIN vg USING (y, x) JOIN nd USING (y, x) JOIN (SELECT y, x, n AS near FROM bs) USING (y, x) WHERE v < 170 AND s > 10 AND h BETWEEN 20 AND 105 AND {EXG} > 0.005::DOUBLE AND n = 0 AND r <= 190 AND b <= 190 AND near > 0.08::DOUBLE * 961 AND d2 <= 900", HSV + VEG + box_sql("bs", "vg", 15, "n") + source_sql("r > 190")),
    "crop": oracle("px", "SELECT i::INT AS i, j::INT AS j, count(*) AS pixels, count(*) FILTER (y // 16 = i AND x // 16 = j) AS core, sum(g)::BIGINT AS total FROM px, range((SELECT max(y) // 16 + 2 FROM px)) a(i), range(4) b(j) WHERE y BETWEEN i * 16 - 4 AND i * 16 + 19 AND x BETWEEN j * 16 - 4 AND j * 16 + 19 GROUP BY 1, 2"),
    "placeholder_raster": oracle("area", "SELECT area_id, ((2 * n + 1) * (2 * n + 1))::BIGINT AS tiles, (256 * 256 * 200 - 50 * (256 * 256 - 254 * 254))::BIGINT AS total, (256 * 256 - 254 * 254)::BIGINT AS lines FROM (SELECT area_id, greatest(1, ceil(radius_m / (156543.03392::DOUBLE / power(2::DOUBLE, zoom) * cos(radians(lat))) / 256)) AS n FROM area)"),
    "fill_and_draw": oracle("bld", """SELECT building_id, count(*) FILTER (abs(x) / w_m + abs(y) / h_m < 1 OR (abs(x) / w_m + abs(y) / h_m <= 1 AND y < h_m)) AS filled, count(*) FILTER (d <= 1.5) AS drawn
      FROM (SELECT *, sqrt(power(x - t * 2 * w_m + w_m, 2) + power(y - t * 2 * h_m + h_m, 2)) AS d FROM (SELECT building_id, w_m, h_m, x, y, greatest(0::DOUBLE, least(1::DOUBLE, ((x + w_m) * 2 * w_m + (y + h_m) * 2 * h_m) / (4 * w_m * w_m + 4 * h_m * h_m))) AS t FROM bld, range(-20, 21) a(x), range(-20, 21) b(y))) GROUP BY building_id"""),
    "surface_precedence": oracle("px", f"SELECT y, x, CASE WHEN r > 190 THEN 'building' WHEN b > 190 THEN 'road' WHEN r + b > 300 THEN 'driveway' WHEN {EXG} > 0.1::DOUBLE THEN 'grass' WHEN {EXG} > 0.005::DOUBLE AND g > 120 THEN 'grass' WHEN r < 70 THEN 'car_parking' ELSE 'paved' END AS surface FROM px"),
    "spatial_mask_20m": oracle("px", "SELECT y, x, d2 FROM nd JOIN px USING (y, x) WHERE d2 <= 1600 AND r <= 190 AND b <= 190", source_sql("r > 190")),
}
QUERIES = {n: globals()[n] for n in ORACLES}
