"""The stored layout of footprints, and joins of geometries, against plain versions."""

import math
import random

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parcelspark.functions import geo
from parcelspark.functions import geometry as G
from parcelspark.operators import polygons
from parcelspark.sources import footprints as S

c = F.col
M = 111320.0


def squares(spark, n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = r.uniform(-180, 179), r.uniform(-85, 84)
        ring = [(x, y), (x + 0.01, y), (x + 0.01, y + 0.01), (x, y + 0.01), (x, y)]
        rows.append((str(i), ("Polygon", [("Polygon", [ring])]), "w" * 20, ("x",)))
    return spark.createDataFrame(rows, f"id string, geometry {G.GEOMETRY}, height string, names struct<primary:string>").withColumn("geometry", G.to_wkb(c("geometry")))


def rows_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if "Scan parquet" in p.nodeName():
            found += p.metrics().apply("numOutputRows").value()
        todo += [p.executedPlan()] if p.nodeName().startswith("AdaptiveSparkPlan") else [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_a_box_reads_few_row_groups(spark, tmp_path):
    path = f"{tmp_path}/f"
    S.write(squares(spark, 20000), path, rows_a_file=5000, group_bytes=40000)
    files = sorted((tmp_path / "f").glob("*.parquet"))
    groups = sum(pq.ParquetFile(f).num_row_groups for f in files)
    assert len(files) == 4 and groups >= 20
    box = {"xmin": 10.0, "ymin": 40.0, "xmax": 25.0, "ymax": 50.0}
    df = S.read(spark, path, box)
    plan = df._jdf.queryExecution().toString()
    assert all(f"bbox.{k}" in plan.split("PushedFilters")[1].split("ReadSchema")[0] for k in box)
    assert "names" not in plan.split("ReadSchema")[1]
    want = S.read(spark, path).where(S.in_box(box)).count()
    assert df.count() == want > 20
    assert rows_read(df) < 20000 / 4  # of 20,000
    assert set(S.read(spark, path, keep=("id", "absent")).columns) == {"id", "geometry", "bbox"}


def test_boxes_over_the_180th_meridian(spark, tmp_path):
    path = f"{tmp_path}/f"
    S.write(squares(spark, 3000), path)
    box = S.wrapped({"xmin": 170.0, "ymin": -60.0, "xmax": 190.0, "ymax": 60.0})
    assert box["xmax"] == -170.0
    got = S.read(spark, path, box).select("bbox.xmin", "bbox.xmax").collect()
    assert len(got) > 20 and all(r[1] >= 170 or r[0] <= -170 for r in got) and {r[0] > 0 for r in got} == {True, False}


def test_z_order_follows_both_axes(spark):
    df = spark.createDataFrame([(x / 4, y / 4) for x in range(-720, 720, 90) for y in range(-360, 360, 90)], "lon double, lat double")
    got = {(r[0], r[1]): r[2] for r in df.select("lon", "lat", S.z_order(c("lon"), c("lat"), 8)).collect()}
    cell = lambda v, low, width: int((v - low) / width * 256)
    assert got == {(x, y): sum((cell(x, -180, 360) >> i & 1) << 2 * i | (cell(y, -90, 180) >> i & 1) << 2 * i + 1 for i in range(8)) for x, y in got}


def test_a_footprint_on_the_edge_counts(spark, tmp_path):
    ring = lambda d: [(-6.34 + d, 53.356), (-6.34 + d + 0.001, 53.356), (-6.34 + d + 0.001, 53.357), (-6.34 + d, 53.357), (-6.34 + d, 53.356)]
    at = 400 / (M * math.cos(math.radians(53.356)))
    rows = [(str(i), ("Polygon", [("Polygon", [ring(d)])])) for i, d in enumerate((-0.0005, at - 0.0002, at + 0.0002, 1.0))]
    path = f"{tmp_path}/f"
    S.write(spark.createDataFrame(rows, f"id string, geometry {G.GEOMETRY}").withColumn("geometry", G.to_wkb(c("geometry"))), path)
    got = S.in_circle(spark, path, 53.356, -6.34, 400.0).select("id", G.area(c("plane"))).collect()
    assert {r[0] for r in got} == {"0", "1"}
    assert all(r[1] == pytest.approx(0.001 * M * math.cos(math.radians(53.3565)) * 0.001 * M, rel=0.01) for r in got)


# geometries that meet


def sides(parts):
    return [(a, b) for rings in parts for ring in rings for a, b in zip(ring, ring[1:], strict=False)]


def inside(parts, q):
    return any(sum((a[1] <= q[1]) != (b[1] <= q[1]) and q[0] < a[0] + (q[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in sides([rings])) % 2 for rings in parts)


def to_side(p, a, b):
    v, w = (b[0] - a[0], b[1] - a[1]), (p[0] - a[0], p[1] - a[1])
    n = v[0] ** 2 + v[1] ** 2
    t = max(0, min(1, (v[0] * w[0] + v[1] * w[1]) / n)) if n else 0
    return math.hypot(w[0] - t * v[0], w[1] - t * v[1])


def apart(s, t):
    (a, b), (p, q) = s, t
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    if turn(a, b, p) * turn(a, b, q) < 0 and turn(p, q, a) * turn(p, q, b) < 0:
        return 0.0
    return min(to_side(p, a, b), to_side(q, a, b), to_side(a, p, q), to_side(b, p, q))


def concave(r, x, y, size):
    """A star with as many corners, some with a hole; in metres."""
    n = r.randint(5, 9)
    star = [(x + size * k * math.cos(2 * math.pi * i / n), y + size * k * math.sin(2 * math.pi * i / n)) for i, k in enumerate(r.uniform(0.3, 1) for _ in range(n))]
    hole = [(x + size * 0.2 * math.cos(t), y + size * 0.2 * math.sin(t)) for t in (0, 2, 4)]
    return [star + star[:1], hole + hole[:1]] if r.random() < 0.4 else [star + star[:1]]


@pytest.mark.parametrize(("lat", "reach"), [(0.0, 0.0), (53.0, 5.0), (65.0, 12.0)])
def test_geometries_that_meet(spark, lat, reach):
    r = random.Random(7)
    k = math.cos(math.radians(lat))
    left = {i: [concave(r, r.uniform(0, 400), r.uniform(0, 400), r.choice([3, 8, 15])) for _ in range(r.randint(1, 2))] for i in range(60)}
    right = {i: [concave(r, r.uniform(0, 400), r.uniform(0, 400), r.choice([5, 20, 90]))] for i in range(25)}
    right[99] = [[[(200.0, 200.0), (200.0, 200.0)]]]
    degrees = lambda q: (20 + q[0] / (M * k), lat + q[1] / M)
    frame = lambda table, key: spark.createDataFrame([(i, ("MultiPolygon", [("Polygon", [[degrees(q) for q in ring] for ring in part]) for part in parts])) for i, parts in table.items()], f"{key} int, geometry {G.GEOMETRY}")
    got = {tuple(x) for x in polygons.touching(frame(left, "l"), frame(right, "r"), "l", "r", reach).collect()}
    near = lambda a, b: any(apart(s, t) <= reach for s in sides(a) for t in sides(b))
    first = lambda parts: [rings[0][0] for rings in parts]
    want = {(i, j) for i, a in left.items() for j, b in right.items() if near(a, b) or any(inside(b, q) for q in first(a)) or any(inside(a, q) for q in first(b))}
    assert len(got ^ want) <= (reach > 0)  # the plane of the test is one for all
    assert any(not near(left[i], right[j]) for i, j in want) and len(want) > 30
    assert polygons.touching(frame(left, "l").limit(0), frame(right, "r"), "l", "r").count() == 0




def test_small_geometries_meet_in_blocks(spark, monkeypatch):
    """Very many at one place are compared block by block, not piece by piece, and with the same result."""
    r = random.Random(3)
    shape = lambda: ("MultiPolygon", [("Polygon", [[(20 + x / M, y / M) for x, y in ring] for ring in concave(r, r.uniform(0, 60), r.uniform(0, 60), 6)])])
    left, right = (spark.createDataFrame([(i, shape()) for i in range(40)], f"{k} int, geometry {G.GEOMETRY}").cache() for k in "lr")
    want = {tuple(x) for x in polygons.by_pieces(left, right, "l", "r", 2.0, 15.0).collect()}

    def none(*_):
        raise AssertionError("pieces of small geometries")

    monkeypatch.setattr(polygons, "by_pieces", none)
    monkeypatch.setattr(polygons, "BLOCK", 7)
    got = [tuple(x) for x in polygons.touching(left, right, "l", "r", 2.0).collect()]
    assert len(got) == len(set(got)) > 50 and set(got) == want


def test_geometries_meet_after_boxes_were_measured(spark):
    """A function of the module of measures that has been used holds on to the JVM; what is sent to tasks mustn't carry it along."""
    from pyspark import cloudpickle

    one = spark.range(1).select(*[F.lit(float(v)).alias(n) for n, v in zip(("w", "h", "ax", "ay", "bx", "by"), (2, 4, 3, 0, 9, 9), strict=True)])
    assert one.select(geo.box_to_segment(*one.columns)).first()[0] == 2.0
    for run in (polygons._compare(5.0, "l", "r"), geo._box_to_segment):
        assert cloudpickle.dumps(run)


def test_most_pairs_of_a_crowd_are_settled_by_a_corner(spark, monkeypatch):
    """Of very many near one another few are compared side by side, with the same pairs as by pieces, and they are counted where they are found."""
    r = random.Random(5)
    shape = lambda: ("MultiPolygon", [("Polygon", [[(20 + x / M, y / M) for x, y in ring] for ring in concave(r, r.uniform(0, 40), r.uniform(0, 40), 9)])])
    left, right = (spark.createDataFrame([(i, shape()) for i in range(60)], f"{k} int, geometry {G.GEOMETRY}").cache() for k in "lr")
    want = {tuple(x) for x in polygons.by_pieces(left, right, "l", "r", 5.0, 15.0).collect()}
    assert {tuple(x) for x in polygons.touching(left, right, "l", "r", 5.0).collect()} == want and len(want) > 1000
    firsts = {x["l"]: (x["r"], x["n"]) for x in polygons.first_touching(left, right, "l", "r", 5.0).collect()}
    assert firsts == {i: (min(j for k, j in want if k == i), sum(k == i for k, _ in want)) for i in {k for k, _ in want}}

    block = lambda df, k, name: (lambda x: {f"{name}_keys": [y[0] for y in x], f"{name}_n": [len(y["flat"]) / 6 for y in x], f"{name}_flat": [v for y in x for v in y["flat"]]})(polygons._sized(df, k).collect())
    row = block(left, "l", "a") | block(right, "r", "b")
    seen, near = [], polygons._near
    monkeypatch.setattr(polygons, "_near", lambda s, t, reach: seen.append(len(s[0])) or near(s, t, reach))
    got = [f for f in polygons._compare(5.0, "l", "r", True)(iter([pd.DataFrame({k: [v] for k, v in row.items()})]))]
    assert sum(len(f) for f in got) == len(firsts)  # a row for each key, not for each pair
    assert sum(seen) < sum(row["a_n"]) * sum(row["b_n"]) / 20
