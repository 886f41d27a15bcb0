"""Geometries: WKB to nested arrays and back, and measures of them as Column expressions.

A geometry is a struct of its kind and its parts; a part has a kind of its own (Point, LineString or Polygon) and rings of points. Collections of
any depth become a flat list of parts. WKB is read and written for a whole Arrow batch at once: all rows stand at a place of their own in the
bytes and move on together, a member or ring at a time, so the number of NumPy passes follows the richest geometry of the batch
and not the number of rows. Both byte orders, Z and M (left out) and SRIDs are understood.

Defined results: null and malformed WKB give null; empty geometries have no parts or parts without rings; a point of NaN is empty.
Measures of null geometries are null, areas of what isn't a polygon 0.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelspark.functions.geo import segment_distance

#: The codes of WKB, from 1 on.
KINDS = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
POINT, LINE, POLYGON, MULTI = 1, 2, 3, 4
GEOMETRY = "struct<kind:string,parts:array<struct<kind:string,rings:array<array<struct<x:double,y:double>>>>>>"


class _Bytes:
    """The bytes of a column of binaries, read at many places at once."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        self.ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)

    def read(self, at: np.ndarray, big: np.ndarray, kind: str) -> np.ndarray:
        raw = self.data[at[:, None] + np.arange(np.dtype(kind).itemsize)]
        raw[big] = raw[big, ::-1]
        return np.ascontiguousarray(raw).view(kind).ravel()


def _members(found: _Bytes, valid: np.ndarray):
    """Of each row the code of its kind (0: malformed or null); parts (row, kind) and rings (part, first byte, points, bytes a point, byte order)."""
    n = len(valid)
    at, end = found.ends[:-1].copy(), found.ends[1:]
    left, codes = valid.astype(np.int64), np.zeros(n, np.int64)
    parts, rings, n_parts = [], [], 0

    def fits(rows, size):
        """The rows whose next bytes are there; the others are malformed."""
        ok = (size >= 0) & (size <= end[rows] - at[rows])
        left[rows[~ok]], codes[rows[~ok]] = 0, 0
        return ok

    def ring(rows, part, count, stride, big):
        ok = fits(rows, count * stride)
        rings.append((part[ok], at[rows[ok]], count[ok], stride[ok], big[ok]))
        at[rows[ok]] += (count * stride)[ok]

    def number(rows, big):
        """The rows that have a number, and these numbers."""
        ok = fits(rows, np.full(len(rows), 4))
        value = found.read(at[rows[ok]], big[ok], "<u4").astype(np.int64)
        at[rows[ok]] += 4
        return ok, value

    while (left > 0).any():
        rows = np.flatnonzero(left > 0)
        rows = rows[fits(rows, np.full(len(rows), 5))]
        big = found.data[at[rows]] == 0
        code = found.read(at[rows] + 1, big, "<u4").astype(np.int64)
        at[rows] += np.where(code & 0x20000000, 9, 5)
        iso, kind = (code & 0xFFFF) // 1000, (code & 0xFFFF) % 1000
        stride = 8 * (2 + ((code & 0x80000000) != 0) + ((code & 0x40000000) != 0) + (iso % 2) + (iso >= 2))
        known = (kind >= 1) & (kind <= len(KINDS)) & (iso <= 3) & (at[rows] <= end[rows])
        left[rows[~known]], codes[rows[~known]] = 0, 0
        rows, big, kind, stride = rows[known], big[known], kind[known], stride[known]
        codes[rows] = np.where(codes[rows] == 0, kind, codes[rows])
        left[rows] -= 1

        many = rows[kind >= MULTI]
        ok, count = number(many, big[kind >= MULTI])
        many = many[ok]
        count = count[fits(many, count * 5)]
        many = many[codes[many] > 0]
        left[many] += count

        one = kind < MULTI
        rows, big, kind, stride = rows[one], big[one], kind[one], stride[one]
        part = n_parts + np.arange(len(rows))
        n_parts += len(rows)
        parts.append((rows, kind))
        is_ = kind == POINT
        ring(rows[is_], part[is_], np.ones(is_.sum(), np.int64), stride[is_], big[is_])
        is_ = np.flatnonzero(kind == LINE)
        ok, count = number(rows[is_], big[is_])
        is_ = is_[ok]
        ring(rows[is_], part[is_], count, stride[is_], big[is_])
        is_ = np.flatnonzero(kind == POLYGON)
        ok, todo = number(rows[is_], big[is_])
        is_ = is_[ok]
        while True:
            more = (todo > 0) & (codes[rows[is_]] > 0)
            is_, todo = is_[more], todo[more]
            if not len(is_):
                break
            ok, count = number(rows[is_], big[is_])
            is_, todo = is_[ok], todo[ok] - 1
            ring(rows[is_], part[is_], count, stride[is_], big[is_])
    join = lambda x, k: tuple(np.concatenate([y[i] for y in x]) if x else np.zeros(0, np.int64) for i in range(k))
    return codes, join(parts, 2), join(rings, 5)


def _offsets(owner: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)


def decode(column: pa.Array) -> pa.Array:
    """A column of WKB as geometries."""
    valid = np.asarray(column.is_valid())
    found = _Bytes(column)
    codes, (row, kind), (part, start, count, stride, big) = _members(found, valid)
    # parts of a row follow one another, and so do rings of a part; what malformed rows have left behind goes
    number = np.full(len(row), -1)
    order = np.argsort(row, kind="stable")
    order = order[codes[row[order]] > 0]
    number[order] = np.arange(len(order))
    row, kind = row[order], kind[order]
    at = np.argsort(number[part], kind="stable")
    at = at[number[part[at]] >= 0]
    part, start, count, stride, big = number[part[at]], start[at], count[at], stride[at], big[at].astype(bool)

    first = np.cumsum(count) - count
    place = np.repeat(start, count) + (np.arange(count.sum()) - np.repeat(first, count)) * np.repeat(stride, count)
    flip = np.repeat(big, count)
    x, y = found.read(place, flip, "<f8"), found.read(place + 8, flip, "<f8")
    real = ~((kind[part] == POINT) & np.isnan(x[np.minimum(first, max(len(x) - 1, 0))])) if len(x) else np.ones(len(part), bool)
    stay = np.repeat(real, count)
    points = pa.StructArray.from_arrays([pa.array(x[stay]), pa.array(y[stay])], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[real])]).astype(np.int32)), points)
    names = pa.array(KINDS)
    of_part = pa.ListArray.from_arrays(pa.array(_offsets(part[real], len(row))), rings)
    parts = pa.StructArray.from_arrays([names.take(pa.array(kind - 1)), of_part], ["kind", "rings"])
    of_row = pa.ListArray.from_arrays(pa.array(_offsets(row, len(codes))), parts)
    return pa.StructArray.from_arrays([names.take(pa.array(np.maximum(codes, 1) - 1)), of_row], ["kind", "parts"], mask=pa.array(codes == 0))


def encode(column: pa.Array) -> pa.Array:
    """Geometries as little-endian WKB."""
    valid = np.asarray(column.is_valid())
    names = pa.array(KINDS)
    code = np.asarray(pc.index_in(column.field("kind"), value_set=names).fill_null(0)).astype(np.int64) + 1
    parts = column.field("parts")
    n_parts = np.where(valid, np.asarray(pc.list_value_length(parts).fill_null(0)), 0).astype(np.int64)
    parts = parts.filter(pa.array(valid)).flatten()
    kind = np.asarray(pc.index_in(parts.field("kind"), value_set=names)).astype(np.int64) + 1
    rings = parts.field("rings")
    n_rings = np.asarray(pc.list_value_length(rings)).astype(np.int64)
    rings = rings.flatten()
    n_points = np.asarray(pc.list_value_length(rings)).astype(np.int64)
    points = rings.flatten()
    xy = np.stack([np.asarray(points.field(k), np.float64) for k in ("x", "y")], axis=1)

    row_of, part_of = np.repeat(np.arange(len(column)), n_parts), np.repeat(np.arange(len(kind)), n_rings)
    sums = lambda owner, x, n: np.bincount(owner, weights=x, minlength=n).astype(np.int64)
    is_polygon, is_multi = kind == POLYGON, code >= MULTI
    ring_head = np.where(is_polygon[part_of], 4, 0)
    empty_point = (kind == POINT) & (n_rings == 0)
    part_head = np.where(kind == POINT, 5, 9) + 16 * empty_point
    part_size = part_head + sums(part_of, ring_head + 16 * n_points, len(kind))
    bare = ~is_multi & (n_parts == 0)  # a simple geometry without its part: the empty one
    size = np.where(valid, np.where(is_multi, 9, 0) + np.where(bare, np.where(code == POINT, 21, 9), 0) + sums(row_of, part_size, len(column)), 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(ends[-1], np.uint8)

    def put(at, values, kind):
        raw = np.ascontiguousarray(values.astype(kind)).reshape(len(values), -1 if len(values) else 1).view(np.uint8)
        out[at[:, None] + np.arange(raw.shape[1])] = raw

    def head(at, codes, counts):
        out[at] = 1
        put(at + 1, codes, "<u4")
        put((at + 5)[codes != POINT], counts[codes != POINT], "<u4")
        return at

    rows = np.flatnonzero(valid & (is_multi | bare))
    head(ends[rows], code[rows], n_parts[rows])
    nan = ends[:-1][valid & bare & (code == POINT)] + 5
    within = lambda owner, x: np.cumsum(x) - x - np.repeat((np.cumsum(x) - x)[np.unique(owner, return_index=True)[1]], np.unique(owner, return_counts=True)[1])
    part_at = ends[row_of] + np.where(is_multi[row_of], 9, 0) + within(row_of, part_size)
    of_line = sums(part_of, n_points, len(kind))
    head(part_at, kind, np.where(is_polygon, n_rings, of_line))
    nan = np.concatenate([nan, part_at[empty_point] + 5])
    put(nan, np.full((len(nan), 2), np.nan), "<f8")
    ring_at = part_at[part_of] + part_head[part_of] + within(part_of, ring_head + 16 * n_points)
    put(ring_at[ring_head > 0], n_points[ring_head > 0], "<u4")
    of_ring = np.repeat(np.arange(len(n_points)), n_points)
    step = np.arange(len(xy)) - np.repeat(np.cumsum(n_points) - n_points, n_points)
    put((ring_at + ring_head)[of_ring] + 16 * step, xy, "<f8")
    result = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())
    return pc.if_else(pa.array(valid), result, pa.scalar(None, pa.binary()))


def from_wkb(wkb: Column) -> Column:
    return F.arrow_udf(decode, GEOMETRY)(wkb)


def to_wkb(geometry: Column) -> Column:
    return F.arrow_udf(encode, "binary")(geometry)


# measures


def moved(geometry: Column, to) -> Column:
    """The geometry with each point (x, y) at to(x, y)."""

    def point(q: Column) -> Column:
        x, y = to(q["x"], q["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    part = lambda p: F.struct(p["kind"].alias("kind"), F.transform(p["rings"], lambda r: F.transform(r, point)).alias("rings"))
    return F.when(geometry.isNotNull(), F.struct(geometry["kind"].alias("kind"), F.transform(geometry["parts"], part).alias("parts")))


def sides(ring: Column) -> Column:
    """The segments (a, b) between neighbouring points."""
    n = F.greatest(F.lit(0), F.size(ring) - 1)
    return F.arrays_zip(F.slice(ring, F.lit(1), n).alias("a"), F.slice(ring, F.lit(2), n).alias("b"))


def moments(ring: Column) -> Column:
    """struct a, x, y: area (positive if counter-clockwise) and first moments, around the ring's first point."""
    o = F.get(ring, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, q: Column) -> Column:
        ax, ay, bx, by = q["a"]["x"] - o["x"], q["a"]["y"] - o["y"], q["b"]["x"] - o["x"], q["b"]["y"] - o["y"]
        w = ax * by - bx * ay
        return F.struct((s["a"] + w / 2).alias("a"), (s["x"] + (ax + bx) * w / 6).alias("x"), (s["y"] + (ay + by) * w / 6).alias("y"))

    return F.aggregate(sides(ring), zero, add)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def part_area(part: Column) -> Column:
    """Area of the outer ring less those of the holes; 0 for what isn't a polygon, null for no part."""
    areas = F.transform(part["rings"], lambda r: F.abs(moments(r)["a"]))
    return F.when(part.isNull(), F.lit(None)).when((part["kind"] == "Polygon") & (F.size(areas) > 0), 2 * F.get(areas, F.lit(0)) - total(areas)).otherwise(F.lit(0.0))


def area(geometry: Column) -> Column:
    return total(F.transform(geometry["parts"], part_area))


def is_polygonal(geometry: Column) -> Column:
    return F.coalesce(geometry["kind"].isin("Polygon", "MultiPolygon") & (n_points(geometry) > 0), F.lit(False))


def largest_part(geometry: Column) -> Column:
    """The polygon of largest area (net of holes), the first of equally large ones; null where there is none."""
    polygons = F.filter(geometry["parts"], lambda p: (p["kind"] == "Polygon") & (F.size(p["rings"]) > 0))
    sizes = F.transform(polygons, part_area)
    return F.get(polygons, (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int"))


def rings(geometry: Column) -> Column:
    """All rings of all parts."""
    return F.flatten(F.transform(geometry["parts"], lambda p: p["rings"]))


def n_points(geometry: Column) -> Column:
    return F.aggregate(rings(geometry), F.lit(0), lambda acc, r: acc + F.size(r))


def envelope(geometry: Column) -> Column:
    """struct xmin, ymin, xmax, ymax; null for an empty geometry."""
    points = F.flatten(rings(geometry))
    xs, ys = F.transform(points, lambda q: q["x"]), F.transform(points, lambda q: q["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")))


def _inside(part_rings: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses the rings an odd number of times."""

    def crossings(ring: Column) -> Column:
        def hit(q: Column) -> Column:
            a, b = q["a"], q["b"]
            return ((a["y"] <= y) != (b["y"] <= y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]))

        return F.size(F.filter(sides(ring), hit))

    return F.aggregate(part_rings, F.lit(0), lambda acc, r: acc + crossings(r)) % 2 == 1


def contains(geometry: Column, x: Column, y: Column) -> Column:
    """Whether the point lies inside one of the polygons and none of its holes."""
    return F.exists(geometry["parts"], lambda p: (p["kind"] == "Polygon") & _inside(p["rings"], x, y))


def distance(geometry: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the geometry, 0 inside a polygon; null for an empty one."""
    to_side = lambda q: segment_distance(x, y, q["a"]["x"], q["a"]["y"], q["b"]["x"], q["b"]["y"])
    to_point = lambda q: F.sqrt((x - q["x"]) * (x - q["x"]) + (y - q["y"]) * (y - q["y"]))
    near = lambda r: F.when(F.size(r) > 1, F.array_min(F.transform(sides(r), to_side))).otherwise(F.array_min(F.transform(r, to_point)))
    return F.when(contains(geometry, x, y), F.lit(0.0)).otherwise(F.array_min(F.transform(rings(geometry), near)))
