"""Raster map algebra on pixel tables (y, x, bands): colour, focal windows, morphology, distance and components.

Focal operators are separable windows along rows, then columns, so a pixel is never joined to its whole neighbourhood. A table may hold
many images (or chunks of one): `by` names their key columns, and every window, join and label stays within an image. An image
has a bounded side, so a window over a row or a column of one has too.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions import geometry
from parcelspark.functions.geo import segment_distance
from parcelspark.operators import blocks
from parcelspark.operators.tables import cut, sent

c = F.col

#: Hue, saturation and value ranges of vegetation (low, high).
GREENS = (
    ((35, 25, 25), (85, 255, 255)),
    ((20, 15, 40), (45, 255, 255)),
    ((30, 10, 10), (95, 255, 200)),
    ((25, 20, 50), (100, 255, 255)),
    ((30, 5, 5), (90, 200, 150)),
    ((15, 10, 30), (50, 200, 200)),
    ((75, 15, 20), (110, 255, 255)),
)


def hsv(df: DataFrame) -> DataFrame:
    """Adds h (0-180), s and v (0-255)."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    d = (top - low).cast("double")
    h = F.when(d == 0, F.lit(0.0)).when(top == c("r"), (c("g") - c("b")) * 60 / d).when(top == c("g"), 120 + (c("b") - c("r")) * 60 / d).otherwise(240 + (c("r") - c("g")) * 60 / d)
    h = F.when(h < 0, h + 360).otherwise(h)
    return df.withColumns({"h": F.round(h / 2).cast("int"), "s": F.when(top == 0, 0).otherwise(F.round(d * 255 / top)).cast("int"), "v": top})


def is_green(ranges=GREENS) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | (c("h").between(low[0], high[0]) & c("s").between(low[1], high[1]) & c("v").between(low[2], high[2]))
    return out


def excess_green() -> Column:
    return (2 * c("g") - c("r") - c("b")) / F.lit(255.0)


def gray() -> Column:
    return (c("r") * 299 + c("g") * 587 + c("b") * 114) / F.lit(1000.0)


def reflected(df: DataFrame, axis: str, size: int, by: int) -> DataFrame:
    """Rows mirrored over both ends of the axis: d c b a | a b c d | d c b a."""
    at = c(axis)
    places = F.array_compact(F.array(at, F.when(at < by, -at - 1), F.when(at >= size - by, 2 * size - 1 - at)))
    return df.withColumn(axis, F.explode(places))


def box_sums(df: DataFrame, sizes: dict[str, int], half: int, *values: str, axes: tuple[str, ...] = ("x", "y"), by: tuple[str, ...] = ()) -> DataFrame:
    """Sums over the square of side 2 half + 1 around each pixel, mirrored at the border; half may be no longer than a side."""
    for axis in axes:
        other = "y" if axis == "x" else "x"
        w = Window.partitionBy(*by, other, "_block").orderBy(axis).rowsBetween(-half, half)
        df = blocks.windowed(reflected(df, axis, sizes[axis], half), axis, half)
        df = df.withColumns({v: F.sum(v).over(w) for v in values}).where(c("_own") & c(axis).between(0, sizes[axis] - 1)).drop("_block", "_own")
    return df


def gauss_sums(df: DataFrame, sizes: dict[str, int], *values: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums over the square of side 5 with the weights 1 4 6 4 1 in both axes (256 in all), mirrored at the border without its own pixel: c b | a b c | b a.
    Sides have three pixels or more."""
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*by, other, "_block").orderBy(axis)

        def weighted(v: str) -> Column:
            back, on = (lambda k: F.lag(v, k).over(w)), (lambda k: F.lead(v, k).over(w))
            near = F.coalesce(back(1), on(1)) + F.coalesce(on(1), back(1))
            far = F.coalesce(back(2), F.when(c(axis) == 0, on(2)).otherwise(c(v))) + F.coalesce(on(2), F.when(c(axis) == sizes[axis] - 1, back(2)).otherwise(c(v)))
            return far + 4 * near + 6 * c(v)

        df = blocks.windowed(df, axis, 2)
        df = df.withColumns({v: weighted(v) for v in values}).where("_own").drop("_block", "_own")
    return df


#: Weights of the channels in a gray of whole numbers, of 16384.
GRAY = (4899, 9617, 1868)


def rough(df: DataFrame, sizes: dict[str, int], by: tuple[str, ...] = ()) -> DataFrame:
    """y, x, rough (0 or 1): within two dilations by the ellipse of 7 of a pixel whose gray is more than 3 off its Gaussian mean."""
    gray = F.floor((c("r") * GRAY[0] + c("g") * GRAY[1] + c("b") * GRAY[2] + 8192) / 16384).cast("int")
    df = gauss_sums(df.select(*by, "y", "x", gray.alias("gray"), gray.alias("n")), sizes, "n", by=by)
    df = df.select(*by, "y", "x", (F.abs(c("gray") - F.floor((c("n") + 128) / 256)) > 3).cast("int").alias("t0"))
    df = morph(morph(df, "t0", F.max, "t1", ELLIPSE_7, by), "t1", F.max, "rough", ELLIPSE_7, by)
    return df.select(*by, "y", "x", "rough")


#: Structuring elements: for each row offset, how far they reach along the row.
CROSS_3 = {-1: 0, 0: 1, 1: 0}
ELLIPSE_5 = {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}
ELLIPSE_7 = {-3: 0, -2: 2, -1: 3, 0: 3, 1: 3, 2: 2, 3: 0}


def morph(df: DataFrame, value: str, pick, name: str, element: dict[int, int] = CROSS_3, by: tuple[str, ...] = ()) -> DataFrame:
    """pick (F.max: dilate, F.min: erode) over the structuring element around each pixel; beyond the border there are no pixels.

    One window along the row for each reach that occurs, then one along the column for each row offset.
    """
    along = {r: f"_r{r}" for r in set(element.values())}
    df = blocks.windowed(df, "x", max(element.values()))
    df = df.withColumns({n: pick(value).over(Window.partitionBy(*by, "y", "_block").orderBy("x").rangeBetween(-r, r)) for r, n in along.items()}).where("_own").drop("_block", "_own")
    df = blocks.windowed(df, "y", max(element))
    column = Window.partitionBy(*by, "x", "_block").orderBy("y")
    parts = [pick(along[r]).over(column.rangeBetween(dy, dy)) for dy, r in element.items()]
    join = F.greatest if pick is F.max else F.least
    return df.withColumn(name, join(*parts)).where("_own").drop(*along.values(), "_block", "_own")


def owner_edges(df: DataFrame, owner: str, by: tuple[str, ...] = ()) -> DataFrame:
    """edge: the owner differs from that of the pixel to the left or above."""
    left = F.lag(owner).over(Window.partitionBy(*by, "y").orderBy("x"))
    above = F.lag(owner).over(Window.partitionBy(*by, "x").orderBy("y"))
    return df.withColumn("edge", F.coalesce(left != c(owner), F.lit(False)) | F.coalesce(above != c(owner), F.lit(False)))


def nearest_source(df: DataFrame, source: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """df with sy, sx, the nearest source pixel of the image (smallest sy, then sx, of equally near ones), and d2, its squared
    distance; null where an image has no source. Exact at any distance, block by block."""
    out = df.join(sent(blocks.nearest_source(df, source, by)), [*by, "y", "x"])
    return out.withColumn("d2", ((c("y") - c("sy")) * (c("y") - c("sy")) + (c("x") - c("sx")) * (c("x") - c("sx"))).cast("long"))


def squared_distance(df: DataFrame, source: Column, reach: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df with d2, the squared distance to the nearest source pixel; with a reach, null beyond it."""
    df = nearest_source(df, source, by).drop("sy", "sx")
    return df if reach is None else df.withColumn("d2", F.when(c("d2") <= reach * reach, c("d2")))


def components(df: DataFrame, eight: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """y, x, label of the given pixels; label is the smallest y * 2^20 + x of the component.

    Each block labels its own pixels; labels that touch over a seam are linked. They fall to the smallest neighbour's and then jump to their
    label's label, so the rounds grow with the logarithm of the number of blocks that a component goes through.
    """
    pixels, links = blocks.local_labels(df, eight, by)
    links = cut(links.union(links.select(*by, "other", "run")))
    if links.isEmpty():
        return pixels.withColumnRenamed("run", "label")
    labels = links.select(*by, "run").distinct().withColumn("label", c("run"))
    while True:
        low = links.join(labels.select(*by, c("run").alias("other"), c("label").alias("_l")), [*by, "other"]).groupBy(*by, "run").agg(F.min("_l").alias("_l"))
        moved = labels.join(low, [*by, "run"], "left").withColumn("_new", F.least("label", "_l"))
        jump = moved.select(*by, c("run").alias("_new"), c("_new").alias("_far"))
        after = moved.join(jump, [*by, "_new"], "left").select(*by, "run", F.least(c("_new"), F.coalesce("_far", "_new")).alias("_to"), "label")
        after = cut(after)
        labels = after.select(*by, "run", c("_to").alias("label"))
        if after.where("_to <> label").isEmpty():
            return pixels.join(labels, [*by, "run"], "left").select(*by, "y", "x", F.coalesce("label", "run").alias("label"))


def holes(df: DataFrame, mask: str, width: int, height: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels outside the mask whose component does not touch the border."""
    out = components(df.where(~c(mask)), by=by)
    edge = (c("x") == 0) | (c("y") == 0) | (c("x") == width - 1) | (c("y") == height - 1)
    open_ = out.groupBy(*by, "label").agg(F.bool_or(edge).alias("_open")).where(~c("_open")).select(*by, "label")
    return sent(out).join(open_, [*by, "label"]).select(*by, "y", "x")


def contours(labels: DataFrame, least: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels of components of at least `least` pixels that have a neighbour (of four) outside their component."""
    large = labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= least).select(*by, "label")
    rows, columns = Window.partitionBy(*by, "label", "y").orderBy("x"), Window.partitionBy(*by, "label", "x").orderBy("y")
    inner = [F.lag("x").over(rows) == c("x") - 1, F.lead("x").over(rows) == c("x") + 1, F.lag("y").over(columns) == c("y") - 1, F.lead("y").over(columns) == c("y") + 1]
    all_ = inner[0]
    for i in inner[1:]:
        all_ = all_ & i
    return sent(labels).join(large, [*by, "label"]).withColumn("_in", F.coalesce(all_, F.lit(False))).where(~c("_in")).select(*by, "y", "x", "label")


def apart(runs: DataFrame, key: str) -> DataFrame:
    """Runs of pixels (key, y, x0, x1, both ends included) without those that an earlier run of the row has: the same pixels, each once."""
    before = Window.partitionBy(key, "y").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest("x0", F.max("x1").over(before) + 1)  # a null is skipped
    return runs.select(key, "y", start.alias("x0"), "x1").where("x0 <= x1")


def pixels_of(runs: DataFrame, key: str) -> DataFrame:
    return runs.select(key, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def fill_ring(rings: DataFrame, key: str) -> DataFrame:
    """y, x and key of every pixel whose centre lies inside a ring."""
    return pixels_of(ring_runs(rings, key), key)


def ring_runs(rings: DataFrame, key: str) -> DataFrame:
    """Runs of the pixels whose centre lies inside a ring (array of struct x, y; the last corner is the first), by key and y.

    Each row of pixels asks where the ring's sides cross it and fills between the first and second crossing, the third and fourth, and so on.
    """
    ys = lambda f: f(F.transform("ring", lambda q: q["y"]))
    rows = rings.select(key, "ring", F.explode(F.sequence(F.ceil(ys(F.array_min)).cast("int"), F.floor(ys(F.array_max)).cast("int"))).alias("y"))
    n = F.size("ring") - 1
    sides = F.arrays_zip(F.slice("ring", F.lit(1), n).alias("a"), F.slice("ring", F.lit(2), n).alias("b"))
    crossed = F.filter(sides, lambda q: (q["a"]["y"] <= c("y")) != (q["b"]["y"] <= c("y")))
    at = F.array_sort(F.transform(crossed, lambda q: q["a"]["x"] + (c("y") - q["a"]["y"]) * (q["b"]["x"] - q["a"]["x"]) / (q["b"]["y"] - q["a"]["y"])))
    rows = rows.withColumn("_at", at).where(F.size("_at") > 0)
    pairs = rows.select(key, "y", "_at", F.explode(F.sequence(F.lit(0), F.size("_at") - 2, F.lit(2))).alias("_i"))
    ends = pairs.select(key, "y", F.ceil(F.get("_at", c("_i"))).cast("int").alias("x0"), F.floor(F.get("_at", c("_i") + 1)).cast("int").alias("x1")).where("x0 <= x1")
    return apart(ends, key)


def fill_polygons(shapes: DataFrame, key: str) -> DataFrame:
    """y, x and key of every pixel whose centre lies in a polygon of the geometry (key, geometry in pixels), holes left out.

    Sides go to the rows of pixels they cross; a row of a part fills between its first and second crossing, the third and fourth, and so on. So the work
    follows sides times rows they cross, and a polygon of very many sides is spread over its rows.
    """
    parts = shapes.select(key, F.posexplode(F.filter("geometry.parts", lambda p: p["kind"] == "Polygon")).alias("_part", "_p"))
    sides = parts.select(key, "_part", F.explode(F.flatten(F.transform("_p.rings", geometry.sides))).alias("q"))
    low, high = F.least("q.a.y", "q.b.y"), F.greatest("q.a.y", "q.b.y")
    y0, y1 = F.ceil(low), F.ceil(high) - 1  # a row that an end lies on belongs to the side above it
    rows = sides.where(y0 <= y1).select(key, "_part", "q", F.explode(F.sequence(y0, y1)).alias("y"))
    at = c("q.a.x") + (c("y") - c("q.a.y")) * (c("q.b.x") - c("q.a.x")) / (c("q.b.y") - c("q.a.y"))
    rows = rows.groupBy(key, "_part", "y").agg(F.array_sort(F.collect_list(at)).alias("_at"))  # as many as a part's sides on one row
    pairs = rows.select(key, "y", "_at", F.explode(F.sequence(F.lit(0), F.size("_at") - 2, F.lit(2))).alias("_i"))
    ends = pairs.select(key, "y", F.ceil(F.get("_at", c("_i"))).alias("x0"), F.floor(F.get("_at", c("_i") + 1)).alias("x1")).where("x0 <= x1")
    return pixels_of(apart(ends, key), key)


def draw_polylines(shapes: DataFrame, key: str, width: float) -> DataFrame:
    """y, x and key of every pixel whose centre lies within width / 2 of a line of the geometry (key, geometry in pixels): ends and joints are round."""
    parts = shapes.select(key, F.explode(F.filter("geometry.parts", lambda p: p["kind"] == "LineString")).alias("_p"))
    sides = parts.select(key, F.explode(F.flatten(F.transform("_p.rings", geometry.sides))).alias("q"))
    return draw_lines(sides.select(key, c("q.a.x").alias("ax"), c("q.a.y").alias("ay"), c("q.b.x").alias("bx"), c("q.b.y").alias("by")), key, width)


def draw_lines(lines: DataFrame, key: str, width: float) -> DataFrame:
    """y, x and key of every pixel whose centre lies within width / 2 of a segment (ax, ay, bx, by)."""
    return pixels_of(line_runs(lines, key, width), key)


def line_runs(lines: DataFrame, key: str, width: float) -> DataFrame:
    """Runs of the pixels whose centre lies within width / 2 of a segment (ax, ay, bx, by), by key and y.

    What is near a segment is convex, so a row has one run of it; it is looked for beside the part of the segment that comes near the row, so the work
    follows the segment's length and not its box.
    """
    half = width / 2
    y0, y1 = F.ceil(F.least("ay", "by") - half).cast("int"), F.floor(F.greatest("ay", "by") + half).cast("int")
    rows = lines.select(key, "ax", "ay", "bx", "by", F.explode(F.sequence(y0, y1)).alias("y"))
    up, along = c("by") - c("ay"), c("bx") - c("ax")
    # where the segment comes into reach of the row and leaves it; a flat one is in reach all the way
    place = lambda dy, flat: c("ax") + along * F.when(F.abs(up) > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("y") + dy - c("ay")) / up))).otherwise(flat)
    one, two = place(-half, 0.0), place(half, 1.0)
    # a pixel more on either side, as places are rounded
    some = F.sequence(F.ceil(F.least(one, two) - half).cast("int") - 1, F.floor(F.greatest(one, two) + half).cast("int") + 1)
    near = segment_distance(c("x"), c("y"), c("ax"), c("ay"), c("bx"), c("by")) <= half
    runs = rows.select("*", F.explode(some).alias("x")).where(near).groupBy(key, "ax", "ay", "bx", "by", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return apart(runs.select(key, "y", "x0", "x1"), key)
