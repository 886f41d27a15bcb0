"""Spatial joins as equi-joins on grid cells, so Spark shuffles them by key instead of comparing all with all.

Cells are bands of latitude, each divided into columns whose width follows the band's own highest latitude, so a cell is at least
as wide as it should be anywhere on the globe, and columns wrap around at 180 degrees. Neighbours of a point are then in its
band and the two beside it, in the columns around its own.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.functions.geo import M_PER_DEG, turn

c = F.col


def _columns(band: Column, side: float) -> Column:
    """How many columns a band has: as many as fit at the latitude nearest to a pole that it or a neighbour has, and at least one."""
    top = F.least(F.lit(90.0), F.greatest(F.abs((band - 1) * side), F.abs((band + 2) * side)))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(top)) / side)).cast("long")


def cells(df: DataFrame, radius_m: float, lat: str = "lat", lon: str = "lon", reach: int = 0) -> DataFrame:
    """Adds _cy, _cx: the cell of each point, of a side of radius_m or more; with reach also the cells around it, one row each."""
    side = radius_m * 1.001 / M_PER_DEG
    turn = F.pmod(c(lon) + 180.0, F.lit(360.0)) / 360.0
    df = df.withColumn("_cy", F.floor(c(lat) / side))
    if not reach:
        return df.withColumn("_cx", F.floor(turn * _columns(c("_cy"), side)))
    df = df.withColumn("_cy", F.explode(F.sequence(c("_cy") - reach, c("_cy") + reach)))
    n = _columns(c("_cy"), side)
    around = F.when(n <= 2 * reach + 1, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long")), lambda k: F.pmod(F.floor(turn * n) + k, n)))
    return df.withColumn("_cx", F.explode(around))


def _around(band: Column, side: float, reach: int) -> Column:
    """How many columns a band has, so that all within reach * side of a point is in the columns up to `reach` from its own, or in all of them near a pole."""
    top = F.least(F.lit(90.0), F.greatest(F.abs((band - reach) * side), F.abs((band + 1 + reach) * side)))
    half = F.radians(F.lit(reach * side)) / 2 / F.greatest(F.lit(1e-12), F.cos(F.radians(top)))
    return F.greatest(F.lit(1), F.floor(F.lit(reach * math.pi) / F.asin(F.least(F.lit(1.0), half)))).cast("long")


def fine_join(left: DataFrame, right: DataFrame, radius_m: float, distance: Column, parts: int) -> DataFrame:
    """range_join for few right rows and a large radius: cells have a side of radius_m / parts and right rows stand on all around them, so left rows stand
    once each, on many cells, and are spread over all tasks."""
    side = radius_m * 1.002 / parts / M_PER_DEG
    at = lambda lon: F.pmod(lon + 180.0, F.lit(360.0)) / 360.0
    left = left.withColumn("_cy", F.floor(c("lat") / side).cast("long"))
    left = left.withColumn("_cx", F.floor(at(c("lon")) * _around(c("_cy"), side, parts)).cast("long"))
    right = right.select(*[c(n).alias(f"r_{n}") for n in right.columns])
    cy = F.floor(c("r_lat") / side).cast("long")
    right = right.withColumn("_cy", F.explode(F.sequence(cy - parts, cy + parts))).withColumn("_n", _around(c("_cy"), side, parts))
    own = F.floor(at(c("r_lon")) * c("_n")).cast("long")
    columns = F.when(c("_n") <= 2 * parts + 1, F.sequence(F.lit(0).cast("long"), c("_n") - 1)).otherwise(F.transform(F.sequence(F.lit(-parts).cast("long"), F.lit(parts).cast("long")), lambda k: F.pmod(own + k, c("_n"))))
    right = right.withColumn("_cx", F.explode(columns)).drop("_n")
    return once(met(left, right, "_cy", "_cx").drop("_cy", "_cx"), "distance_m", distance).where(c("distance_m") <= radius_m)


#: Parts that the radius of few circles is cut into, and rows on cells that they may take.
PARTS, ON_CELLS = 8, 1 << 20


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn whose value is worked out once a row: the optimizer writes a plain column's expression out wherever it is named."""
    return df.withColumn("_v", F.explode(F.array(value))).drop(name).withColumnRenamed("_v", name)


def tasks(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def met(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """Join of left and right on the columns, over as many tasks as the session has partitions: the pairs are the work, and Spark would merge tasks by
    the bytes of the two sides, down to one."""
    n = tasks(left.sparkSession)
    return left.repartition(n, *on).join(right.repartition(n, *on), list(on))


def range_join(left: DataFrame, right: DataFrame, radius_m: float, distance: Column) -> DataFrame:
    """Pairs of left and right at a distance of at most radius_m. Both have lat, lon; right's columns are named r_...

    distance is an expression over lat, lon, r_lat and r_lon.
    """
    right = right.select(*[c(n).alias(f"r_{n}") for n in right.columns])
    near = cells(right, radius_m, "r_lat", "r_lon", reach=1)
    pairs = met(cells(left, radius_m), near, "_cy", "_cx").drop("_cy", "_cx")
    return once(pairs, "distance_m", distance).where(c("distance_m") <= radius_m)


def within_own_radius(points: DataFrame, circles: DataFrame, radius: str, distance: Column, extra_m: float = 0.0) -> DataFrame:
    """Pairs of points and circles whose centre is within the circle's own radius (a column) and extra_m of the point.

    Circles are joined by class of radius (powers of two), each on cells of its class, so small ones never meet points that only a
    large one reaches, and no radius is too large. Classes of few circles have cells that are small beside the radius, so points are spread over all tasks.
    """
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1.0), c(radius) + extra_m)))).cast("int")
    circles = circles.withColumn("_size", size)
    sizes = sorted((k, n) for k, n in circles.groupBy("_size").count().collect() if k is not None)  # at most 25: a circle of 2^25 m spans the globe
    out = None
    for k, n in sizes:
        parts = min(PARTS, int((math.sqrt(ON_CELLS / n) - 1) / 2))
        some, most = circles.where(c("_size") == k).drop("_size"), float(1 << min(k, 25))
        found = range_join(points, some, most, distance) if parts < 2 else fine_join(points, some, most, distance, parts)
        found = found.where(c("distance_m") <= c(f"r_{radius}") + extra_m)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return range_join(points, circles.drop("_size"), 1.0, distance)
    return out


def nearest(pairs: DataFrame, key: str, *order) -> DataFrame:
    """The first right row of each left key; ties by the later order columns. A partial aggregate, not a sort of all pairs."""
    order = order or ("distance_m",)
    rest = [n for n in pairs.columns if n not in (key, *order)]
    best = F.min_by(F.struct(*order, *rest), F.struct(*order))
    return pairs.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def ranked(pairs: DataFrame, key: str, most: int, *order) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(c("rank") <= most)


def ring_start(right: DataFrame, most_m: float) -> float | None:
    """A radius in which a place of mean density has some four rows; None where there are no rows."""
    n, south, north, west, east = right.agg(F.count(F.lit(1)), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if not n:
        return None
    area = ((north - south) * M_PER_DEG + 1) * ((east - west) * M_PER_DEG * math.cos(math.radians((north + south) / 2)) + 1)
    return max(1.0, min(most_m, 2 * math.sqrt(area / (math.pi * n))))


def nearest_at_any_distance(left: DataFrame, right: DataFrame, key: str, start_m: float, distance: Column, *ties: str, most_m: float = math.inf, reach: str | None = None) -> DataFrame:
    """For each left row (key, lat, lon) the right row of smallest distance, whatever that is: cells grow by four until all rows have
    theirs. Columns as in range_join.

    A hit counts once its distance is at most the radius of the ring it was found in, as nothing outside that ring can be nearer. The first ring has
    the radius that the density of right suggests, start_m at most. reach: a right column with how far a row's shape goes beyond its point; rows are
    joined by class of reach (powers of two), each on cells of its own, so a long one widens the ring for itself only. most_m: give up beyond that.
    """
    from parcelspark.operators.tables import cut

    classes: list = [None]
    if reach is not None:
        right = right.withColumn("_class", F.ceil(F.log2(F.greatest(F.lit(1.0), c(reach)))).cast("int"))
        classes = sorted(r[0] for r in right.select("_class").distinct().collect()) or [None]  # at most 25
    far = min(most_m, math.pi * 6371000.0)
    start = ring_start(right, start_m)
    radius, out, open_, todo = start or far, None, left, left.count()
    while True:
        found = None
        for k in classes:
            # the ring is one of points; the distance is to shapes
            some = right if k is None else right.where(c("_class") == k)
            r = some.select(*[c(n).alias(f"r_{n}") for n in right.columns if n != "_class"])
            wide = radius + (0.0 if k is None else float(1 << k))
            pairs = once(met(cells(open_, wide), cells(r, wide, "r_lat", "r_lon", reach=1), "_cy", "_cx").drop("_cy", "_cx"), "distance_m", distance)
            pairs = nearest(pairs.where(c("distance_m") <= min(radius, most_m)), key, "distance_m", *ties)
            found = pairs if found is None else found.unionByName(pairs)
        found = cut(found if len(classes) == 1 else nearest(found, key, "distance_m", *ties))
        out = found if out is None else out.unionByName(found)
        todo -= found.count()
        if radius >= far or not todo:
            return out
        open_ = open_.join(found.select(key), key, "left_anti")
        radius *= 4


def _code(lat: Column, around: Column, band: int | Column, column: int, side: float) -> Column:
    """The cell so many bands and columns from that of a point as one number; around is its longitude as a part of the turn."""
    cy = F.floor(lat / side) + band
    n = _columns(cy, side)
    return cy * F.lit(1 << 32) + F.pmod(F.floor(around * n) + column, n)


def coded(df: DataFrame, side_m: float) -> DataFrame:
    """Adds _cell, the cell of each point as one number, of a side of side_m or more."""
    side = side_m * 1.001 / M_PER_DEG
    return df.withColumn("_cell", _code(c("lat"), F.pmod(c("lon") + 180.0, F.lit(360.0)) / 360.0, 0, 0, side))


def coded_along(lines: DataFrame, reach_m: float) -> DataFrame:
    """Adds _cell, one row each: cells of a side of 1.5 times reach_m (as those of coded) that hold all within reach_m of the line (lat0, lon0, lat1, lon1).

    A line is cut into pieces of reach_m at most, each of which is in reach of the cells around that of its middle only.
    """
    side = reach_m * 1.5 * 1.001 / M_PER_DEG
    dy, dx = c("lat1") - c("lat0"), turn(c("lon1"), c("lon0"))
    low = F.when(c("lat0") * c("lat1") < 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.abs("lat0"), F.abs("lat1")) - reach_m / M_PER_DEG))
    x, y = dx * M_PER_DEG * F.cos(F.radians(low)), dy * M_PER_DEG
    lines = lines.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.sqrt(x * x + y * y) / reach_m)).cast("long"))
    lines = lines.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), c("_n") - 1, F.lit(256).cast("long"))))  # a row holds 256 pieces at most

    def around(i):
        lat, lon = c("lat0") + dy * (i + 0.5) / c("_n"), c("lon0") + dx * (i + 0.5) / c("_n")
        at = F.pmod(lon + 180.0, F.lit(360.0)) / 360.0
        return F.array(*[_code(lat, at, b, k, side) for b in (-1, 0, 1) for k in (-1, 0, 1)])

    pieces = F.transform(F.sequence(c("_i"), F.least(c("_n") - 1, c("_i") + 255)), around)
    return lines.withColumn("_cell", F.explode(F.array_distinct(F.flatten(pieces)))).drop("_n", "_i")


def line_ring(lines: DataFrame, points: int, on: tuple[str, ...], most_m: float) -> float | None:
    """A radius in which a place of mean density has some four lines (of its own `on`), or one of the points if that is more; None where there are no lines."""
    dy, dx = (c("lat1") - c("lat0")) * M_PER_DEG, turn(c("lon1"), c("lon0")) * M_PER_DEG * F.cos(F.radians("lat0"))
    ends = [f(g(c(f"{n}0"), c(f"{n}1"))) for n in ("lat", "lon") for f, g in ((F.min, F.least), (F.max, F.greatest))]
    n, total, classes, south, north, west, east = lines.agg(F.count(dx + dy), F.sum(F.sqrt(dx * dx + dy * dy)), F.count_distinct(*on) if on else F.max(F.lit(1)), *ends).first()
    if not n:
        return None
    area = ((north - south) * M_PER_DEG + 1) * ((east - west) * M_PER_DEG * math.cos(math.radians((north + south) / 2)) + 1)
    hits = min(2 * area * classes / max(total, 1.0), 2 * math.sqrt(area * classes / (math.pi * n)))
    return max(1.0, min(most_m, max(hits, math.sqrt(area / max(points, 1)))))


def nearest_line(points: DataFrame, lines: DataFrame, key: str, start_m: float, measure, *ties: str, on: tuple[str, ...] = (), most_m: float = math.inf, beyond_m: float = 0.0, where: Column | None = None) -> DataFrame:
    """For each point (key, lat, lon and others) the line (lat0, lon0, lat1, lon1 and others, here named r_...) of smallest distance, of those that agree
    in the columns `on` and for which where holds; its distance_m, rounded to 4 places. measure(pairs, most) adds distance_m and may drop pairs beyond most.
    most_m: none beyond that. beyond_m: how much the distance can be less than that of the point.

    Lines meet points on the cells along them and not on those of a circle around them, so rows follow the length of lines near a point, and rings grow as
    in nearest_at_any_distance.
    """
    from parcelspark.operators.tables import cut

    far = min(most_m, math.pi * 6371000.0)
    open_, out, todo = points, None, points.count()
    radius = line_ring(lines, todo, on, start_m) or far
    while True:
        wide = radius + beyond_m
        right = coded_along(lines.repartition(tasks(lines.sparkSession)), wide)  # a small file of lines is one task, whatever their cells are
        right = right.select("_cell", *on, *[c(n).alias(f"r_{n}") for n in lines.columns if n not in on])
        pairs = measure(met(coded(open_, wide * 1.5), right, "_cell", *on).drop("_cell"), min(radius, most_m) + 0.001)
        pairs = once(pairs.where(c("distance_m") <= min(radius, most_m) + 0.001), "distance_m", F.round("distance_m", 4)).where(c("distance_m") <= min(radius, most_m))
        found = cut(nearest(pairs if where is None else pairs.where(where), key, "distance_m", *ties))
        out = found if out is None else out.unionByName(found)
        todo -= found.count()
        if radius >= far or not todo:
            return out
        open_ = open_.join(found.select(key), key, "left_anti")
        radius *= 4


def nearest_few(left: DataFrame, right: DataFrame, key: str, most: int, most_m: float, distance: Column, where: Column, *ties: str) -> DataFrame:
    """Pairs of each left row (key, lat, lon) and its nearest right ones within most_m for which where holds, `most` at most, with their rank; columns as in range_join.

    Rings start where a place of mean density has some twice as many and double; a left row is done once its ring holds as many.
    """
    from parcelspark.operators.tables import cut

    radius = (ring_start(right, most_m * 2) or most_m) * math.sqrt(most / 2)
    out, open_ = None, left
    while True:
        radius = min(radius, most_m)
        found = cut(ranked(range_join(open_, right, radius, distance).where(where), key, most, "distance_m", *ties))
        if radius >= most_m:
            return found if out is None else out.unionByName(found)
        full = found.where(c("rank") == most).select(key)
        found = found.join(full, key, "left_semi")
        out = found if out is None else out.unionByName(found)
        open_ = cut(open_.join(full, key, "left_anti"))
        radius *= 2


def with_any(left: DataFrame, right: DataFrame, key: str, reach: str, distance: Column, where: Column) -> DataFrame:
    """The keys of the left rows (key, lat, lon, reach and others) that have a right row within their own reach for which where holds.

    Rings start where a place of mean density has some four right rows and double up to the largest reach; a row that has one is asked no further.
    """
    from parcelspark.operators.tables import cut

    far = left.agg(F.max(reach)).first()[0]
    far = 1.0 if far is None else max(1.0, far)
    radius, out, open_ = min(ring_start(right, far) or far, far), None, left
    while True:
        hits = range_join(open_, right, radius, distance).where((c("distance_m") <= c(reach)) & where)
        hits = cut(hits.select(key).distinct())
        out = hits if out is None else out.unionByName(hits)
        if radius >= far:
            return out
        open_ = cut(open_.where(c(reach) > radius).join(hits, key, "left_anti"))
        radius = min(2 * radius, far)
