"""WKB and measures of geometries against plain versions."""

import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelspark.functions import geometry as G

c = F.col
KIND = {k: i + 1 for i, k in enumerate(G.KINDS)}


def wkb(shape, big=False, z=0, m=0, srid=None, iso=False):
    """shape: (kind, body); the body of a point is (x, y) or None, of a line a list of points, of a polygon a list of rings, else a list of shapes."""
    kind, body = shape
    e = ">" if big else "<"
    code = KIND[kind] + (1000 * (z + 2 * m) if iso else 0x80000000 * z + 0x40000000 * m)
    out = struct.pack(e + "BI", not big, code | (0x20000000 if srid else 0)) + (struct.pack(e + "I", srid) if srid else b"")
    point = lambda p: struct.pack(e + "dd", *p) + struct.pack(e + "d", 7.0) * (z + m)
    run = lambda ps: struct.pack(e + "I", len(ps)) + b"".join(map(point, ps))
    if kind == "Point":
        return out + point(body or (math.nan, math.nan))
    if kind == "LineString":
        return out + run(body)
    if kind == "Polygon":
        return out + struct.pack(e + "I", len(body)) + b"".join(map(run, body))
    return out + struct.pack(e + "I", len(body)) + b"".join(wkb(s, big, z, m, iso=iso) for s in body)


def flat(shape):
    kind, body = shape
    if kind in ("Point", "LineString", "Polygon"):
        return [(kind, [[body]] if kind == "Point" and body else [] if kind == "Point" else [body] if kind == "LineString" else body)]
    return [p for s in body for p in flat(s)]


def shapes(n=300, seed=4):
    r = random.Random(seed)
    point = lambda: (r.uniform(-180, 180), r.uniform(-90, 90))
    run = lambda low=0: [point() for _ in range(r.randint(low, 6))]

    def make(kind, depth=0):
        if kind == "Point":
            return kind, point() if r.random() < 0.9 else None
        if kind == "LineString":
            return kind, run()
        if kind == "Polygon":
            return kind, [run(3) for _ in range(r.randint(0, 3))]
        inner = {"MultiPoint": ["Point"], "MultiLineString": ["LineString"], "MultiPolygon": ["Polygon"]}.get(kind, G.KINDS if depth < 2 else G.KINDS[:3])
        return kind, [make(r.choice(inner), depth + 1) for _ in range(r.randint(0, 4))]

    return [make(r.choice(G.KINDS)) for _ in range(n)]


def plain(g):
    return g and (g["kind"], [(p["kind"], [[(q["x"], q["y"]) for q in ring] for ring in p["rings"]]) for p in g["parts"]])


def test_wkb_of_every_kind_is_read_as_written():
    all_ = shapes()
    ways = [{}, {"big": True}, {"z": 1}, {"m": 1, "big": True}, {"z": 1, "m": 1}, {"srid": 4326}, {"z": 1, "iso": True}, {"z": 1, "m": 1, "iso": True, "big": True}, {"m": 1, "iso": True}]
    data = [wkb(s, **ways[i % len(ways)]) for i, s in enumerate(all_)]
    data[5:5] = [None, b""]
    got = [plain(g) for g in G.decode(pa.array(data, pa.binary())).to_pylist()]
    want = [(s[0], flat(s)) for s in all_]
    want[5:5] = [None, None]
    assert got == want
    assert [plain(g) for g in G.decode(pa.array(data, pa.binary()).slice(3, 50)).to_pylist()] == want[3:53]
    assert len(G.decode(pa.array([], pa.binary()))) == 0 and G.decode(pa.array([None, None], pa.binary())).to_pylist() == [None, None]


def test_damaged_wkb_is_null_and_leaves_its_neighbours_alone():
    good = ("MultiPolygon", [("Polygon", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]]), ("Polygon", [[(9.0, 9.0), (8.0, 9.0), (8.0, 8.0), (9.0, 9.0)]])])
    whole = wkb(good)
    cut = [whole[:k] for k in range(len(whole))]
    odd = [b"\x01\x63\x00\x00\x00", b"\x01\x03\x00\x00\x00\xff\xff\xff\xff", b"\x01\x06\x00\x00\x00\xff\xff\xff\x7f", b"\x01\x02\x00\x00\x00\xff\xff\xff\xff" + bytes(32)]
    rows = [x for bad in cut + odd for x in (bad, whole)]
    got = [plain(g) for g in G.decode(pa.array(rows, pa.binary())).to_pylist()]
    assert got[::2] == [None] * len(cut + odd)
    assert got[1::2] == [(good[0], flat(good))] * len(cut + odd)


def test_geometries_are_written_as_they_are_read():
    simple = [s for s in shapes(400, 9) if s[0] != "GeometryCollection"]
    data = [wkb(s) for s in simple]
    data[3:3] = [None]
    column = pa.array(data, pa.binary())
    back = G.encode(G.decode(column)).to_pylist()
    assert [plain(g) for g in G.decode(pa.array(back, pa.binary())).to_pylist()] == [plain(g) for g in G.decode(column).to_pylist()]
    assert back == data
    for few in ([], [None], [data[0]], [wkb(("Point", None))], [wkb(("MultiPoint", []))], [None, wkb(("Polygon", [])), None]):
        assert G.encode(G.decode(pa.array(few, pa.binary()))).to_pylist() == few
    nested = pa.array([wkb(s) for s in shapes(200, 2)], pa.binary())  # collections come out flat
    assert [plain(g) for g in G.decode(G.encode(G.decode(nested))).to_pylist()] == [plain(g) for g in G.decode(nested).to_pylist()]


def test_measures(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]
    u = [(10.0, 0.0), (16.0, 0.0), (16.0, 6.0), (14.0, 6.0), (14.0, 2.0), (12.0, 2.0), (12.0, 6.0), (10.0, 6.0), (10.0, 0.0)]
    rows = [
        ("hole", wkb(("Polygon", [square, hole]))), ("multi", wkb(("MultiPolygon", [("Polygon", [square, hole]), ("Polygon", [u])]))), ("line", wkb(("LineString", square))), ("point", wkb(("Point", (3.0, 4.0)))),
        ("mixed", wkb(("GeometryCollection", [("Point", (50.0, 50.0)), ("MultiPolygon", [("Polygon", [u])])]))), ("empty", wkb(("Polygon", []))), ("none", None), ("lines", wkb(("MultiLineString", [("LineString", square[:2]), ("LineString", u[:3])]))),
    ]
    df = spark.createDataFrame(rows, "name string, wkb binary").select("name", G.from_wkb(c("wkb")).alias("g"))
    at = lambda x, y: (G.contains(c("g"), F.lit(x), F.lit(y)), F.round(G.distance(c("g"), F.lit(x), F.lit(y)), 6))
    got = {r[0]: tuple(r)[1:] for r in df.select("name", G.area(c("g")), G.is_polygonal(c("g")), F.size(G.largest_part(c("g"))["rings"]), G.n_points(c("g")), G.envelope(c("g")), *at(2.0, 2.0), *at(13.0, 4.0), *at(11.0, 5.0), *at(-3.0, -4.0)).collect()}
    s = math.sqrt
    assert got["hole"] == (12.0, True, 2, 10, (0.0, 0.0, 4.0, 4.0), False, 1.0, False, 9.0, False, round(s(50), 6), False, 5.0)
    assert got["multi"] == (40.0, True, 1, 19, (0.0, 0.0, 16.0, 6.0), False, 1.0, False, 1.0, True, 0.0, False, 5.0)
    assert got["line"] == (0.0, False, None, 5, (0.0, 0.0, 4.0, 4.0), False, 2.0, False, 9.0, False, round(s(50), 6), False, 5.0)
    assert got["point"][:6] == (0.0, False, None, 1, (3.0, 4.0, 3.0, 4.0), False) and got["point"][-1] == 10.0
    assert got["mixed"][:4] == (28.0, False, 1, 10) and got["mixed"][9] is True
    assert got["empty"] == (0.0, False, None, 0, None, False, None, False, None, False, None, False, None)
    assert got["none"][:5] == (None, False, None, None, None) and got["none"][5] is None
    assert got["lines"][:4] == (0.0, False, None, 5)
    moved = df.where("name = 'hole'").select(G.area(G.moved(c("g"), lambda x, y: (x * 2, y * 3)))).first()[0]
    assert moved == pytest.approx(72.0)
