"""Geodesic, projection and tile functions as Column expressions."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Mean earth radius, equatorial circumference, metres a pixel at zoom 0, metres in a degree.
EARTH_RADIUS = 6371000.0
CIRCUMFERENCE = 40075016.686
PIXEL_AT_ZOOM_0 = 156543.03392
M_PER_DEG = 111320.0
TILE = 256


def haversine(lat1, lon1, lat2, lon2) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2.0)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def turn(lon, lon0) -> Column:
    """lon - lon0 in degrees, the short way around."""
    d = lon - lon0
    return d - 360.0 * F.rint(d / 360.0)


def metres(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """East and north of (lat0, lon0), on the plane that touches there."""
    return turn(lon, lon0) * M_PER_DEG * F.cos(F.radians(lat0)), (lat - lat0) * M_PER_DEG


def plane(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """East and north of (lat0, lon0) by the cosine of the mean latitude, so that both ways are equally far."""
    return turn(lon, lon0) * M_PER_DEG * F.cos(F.radians((lat + lat0) / 2)), (lat - lat0) * M_PER_DEG


def equirectangular(lat, lon, lat0, lon0) -> Column:
    x, y = metres(lat, lon, lat0, lon0)
    return F.sqrt(x * x + y * y)


def circle_box(lat: float, lon: float, radius_m: float) -> dict[str, float]:
    """Box around a circle, from the angular distance."""
    angle, phi = radius_m / EARTH_RADIUS, math.radians(lat)
    dlon = math.degrees(math.asin(math.sin(angle) / math.cos(phi)))
    dlat = math.degrees(angle)
    return {"xmin": lon - dlon, "ymin": lat - dlat, "xmax": lon + dlon, "ymax": lat + dlat}


def box_distance(px, py, xmin, ymin, xmax, ymax) -> Column:
    """Distance of a point to a box, 0 inside."""
    dx = F.greatest(xmin - px, F.lit(0.0), px - xmax)
    dy = F.greatest(ymin - py, F.lit(0.0), py - ymax)
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment; to its start where the segment has no length."""
    vx, vy, wx, wy = bx - ax, by - ay, px - ax, py - ay
    along, length2 = wx * vx + wy * vy, vx * vx + vy * vy
    to_end = F.sqrt((px - bx) * (px - bx) + (py - by) * (py - by))
    # three cases instead of a clamped place on the segment, which would stand in the expression once for each use
    return F.when(along <= 0, F.sqrt(wx * wx + wy * wy)).when(along >= length2, to_end).otherwise(F.abs(wx * vy - wy * vx) / F.sqrt(length2))


def segments_distance(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Distance of two segments, 0 where they cross: else one of the four ends is nearest."""
    side = lambda px, py, qx, qy, x, y: F.signum((qx - px) * (y - py) - (qy - py) * (x - px))
    crossed = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
    ends = [segment_distance(x, y, ax, ay, bx, by) for x, y in ((cx, cy), (dx, dy))] + [segment_distance(x, y, cx, cy, dx, dy) for x, y in ((ax, ay), (bx, by))]
    return F.when(crossed, F.lit(0.0)).otherwise(F.least(*ends))


def box_segment_distance(xmin, ymin, xmax, ymax, ax, ay, bx, by) -> Column:
    """Distance of a box to a segment, 0 where they touch: where none of them crosses the other, an end of the segment or a corner of the
    box is nearest."""
    low, high = F.lit(0.0), F.lit(1.0)
    inside = F.lit(True)
    for lo, hi, a, b in ((xmin, xmax, ax, bx), (ymin, ymax, ay, by)):
        t0, t1 = F.when(a != b, (lo - a) / (b - a)), F.when(a != b, (hi - a) / (b - a))
        low, high = F.greatest(low, F.least(t0, t1)), F.least(high, F.greatest(t0, t1))
        inside = inside & ((a != b) | a.between(lo, hi))
    ends = [box_distance(x, y, xmin, ymin, xmax, ymax) for x, y in ((ax, ay), (bx, by))]
    corners = [segment_distance(x, y, ax, ay, bx, by) for x in (xmin, xmax) for y in (ymin, ymax)]
    return F.when(inside & (low <= high), F.lit(0.0)).otherwise(F.least(*ends, *corners))


def box_to_segment(*args) -> Column:
    """box_segment_distance of a box of w x h around the origin and the segment ax, ay, bx, by, for very many pairs: as an expression it is a method too long
    for the JVM to compile. Worked out once a row. Each call makes its own function: one that has been used holds on to the JVM, and no function that names this
    module could be sent to tasks any more."""
    return F.pandas_udf(_box_to_segment, DoubleType()).asNondeterministic()(*args)


def _box_to_segment(w: pd.Series, h: pd.Series, ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    w, h, ax, ay, bx, by = (v.to_numpy(np.float64, na_value=np.nan) for v in (w, h, ax, ay, bx, by))
    low, high, inside = np.zeros(len(w)), np.ones(len(w)), np.ones(len(w), bool)
    for half, a, b in ((w / 2, ax, bx), (h / 2, ay, by)):
        moves = a != b
        by_one = np.where(moves, b - a, 1.0)
        t0, t1 = (-half - a) / by_one, (half - a) / by_one
        low, high = np.where(moves, np.maximum(low, np.minimum(t0, t1)), low), np.where(moves, np.minimum(high, np.maximum(t0, t1)), high)
        inside &= moves | (np.abs(a) <= half)
    least = np.full(len(w), np.inf)
    for x, y in ((ax, ay), (bx, by)):
        dx, dy = np.maximum(0.0, np.abs(x) - w / 2), np.maximum(0.0, np.abs(y) - h / 2)
        least = np.minimum(least, np.sqrt(dx * dx + dy * dy))
    vx, vy = bx - ax, by - ay
    length2 = vx * vx + vy * vy
    for x, y in ((i * w / 2, j * h / 2) for i in (-1, 1) for j in (-1, 1)):
        wx, wy, ex, ey = x - ax, y - ay, x - bx, y - by
        along = wx * vx + wy * vy
        beside = np.abs(wx * vy - wy * vx) / np.sqrt(np.where(length2 > 0, length2, 1.0))
        least = np.minimum(least, np.where(along <= 0, np.sqrt(wx * wx + wy * wy), np.where(along >= length2, np.sqrt(ex * ex + ey * ey), beside)))
    return pd.Series(np.where(inside & (low <= high), 0.0, least))


def tile_x(lon, zoom) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat, zoom) -> Column:
    return F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_west(x, zoom) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_north(y, zoom) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / F.pow(F.lit(2.0), zoom)))))


def metres_per_pixel(lat, zoom) -> Column:
    return F.lit(PIXEL_AT_ZOOM_0) / F.pow(F.lit(2.0), zoom) * F.cos(F.radians(lat))


def tiles_for_distance(distance, lat, zoom) -> Column:
    return F.greatest(F.lit(1), F.ceil(distance / metres_per_pixel(lat, zoom) / TILE)).cast("long")


def utm_zone(lon) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


#: WGS84 axis and third flattening, scale on the central meridian.
AXIS, N3 = 6378137.0, 0.0016792203863837047
SCALE = 0.9996
MEAN_RADIUS = AXIS / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
ALPHA = (
    N3 / 2 - 2 / 3 * N3**2 + 5 / 16 * N3**3 + 41 / 180 * N3**4,
    13 / 48 * N3**2 - 3 / 5 * N3**3 + 557 / 1440 * N3**4,
    61 / 240 * N3**3 - 103 / 140 * N3**4,
    49561 / 161280 * N3**4,
)


def utm(lat, lon, central: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series (northern hemisphere: no false northing), of the point's own zone or that of a given
    central meridian."""
    central = (utm_zone(lon) * 6 - 183).cast("double") if central is None else central
    phi, lam = F.radians(lat), F.radians(lon - central)
    ecc = 2 * math.sqrt(N3) / (1 + N3)
    t = F.sinh(F.atanh(F.sin(phi)) - ecc * F.atanh(ecc * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    false_north = F.when(lat < 0, F.lit(10000000.0)).otherwise(F.lit(0.0))
    return SCALE * MEAN_RADIUS * east + 500000.0, SCALE * MEAN_RADIUS * north + false_north


def pixel_in_grid(lat, lon, zoom, x0, y0) -> tuple[Column, Column]:
    """Pixel of a point in a grid of tiles that starts at tile (x0, y0), cut to whole pixels."""
    n = F.pow(F.lit(2.0), zoom)
    x = ((lon + 180.0) / 360.0 * n - x0) * TILE
    y = ((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * n - y0) * TILE
    return x.cast("int"), y.cast("int")


def to_pixel(lat, lon, north, south, east, west, width, height) -> tuple[Column, Column]:
    """Pixel of a point in an image with these bounds, linear, cut to whole pixels."""
    return ((lon - west) / (east - west) * width).cast("int"), ((north - lat) / (north - south) * height).cast("int")


def from_pixel(px, py, north, south, east, west, width, height) -> tuple[Column, Column]:
    """lat, lon of a pixel."""
    return north - py / height * (north - south), west + px / width * (east - west)
