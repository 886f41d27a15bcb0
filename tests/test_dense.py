"""Joins where very many rows are near one another: results as by all pairs, from few of them."""

import math
import random

from pyspark.sql import functions as F

from parcelspark.operators import spatial

M = 111320.0


def to_segment_m(lat, lon, road):
    k = M * math.cos(math.radians(lat))
    x0, y0, x1, y1 = (road[2] - lon) * k, (road[1] - lat) * M, (road[4] - lon) * k, (road[3] - lat) * M
    vx, vy = x1 - x0, y1 - y0
    t = max(0.0, min(1.0, (-x0 * vx - y0 * vy) / (vx * vx + vy * vy))) if vx or vy else 0.0
    return round(math.hypot(x0 + t * vx, y0 + t * vy), 4)


def crowd(r, n, lat=53.35, lon=-6.35, side=300.0):
    return [(lat + r.random() * side / M, lon + r.random() * side / (M * math.cos(math.radians(lat)))) for _ in range(n)]


def test_nearest_lines_of_a_crowd_are_found_among_few(spark):
    from parcelspark.plans import vector as X

    r = random.Random(11)
    roads = [(i, a, o, a + r.uniform(-60, 60) / M, o + r.uniform(-60, 60) / M, f"s{i % 5}") for i, (a, o) in enumerate(crowd(r, 400))]
    points = [(i, a, o, f"s{i % 6}") for i, (a, o) in enumerate(crowd(r, 600))] + [(600, 53.5, -6.0, "s1")]
    p = spark.createDataFrame(points, "id long, lat double, lon double, street string")
    q = spark.createDataFrame(roads, "road_id long, lat0 double, lon0 double, lat1 double, lon1 double, street string")
    met = []

    def counted(pairs, most):
        met.append(pairs.count())
        return X._road_m(pairs, most)

    got = {x["id"]: (x["distance_m"], x["r_road_id"]) for x in spatial.nearest_line(p, q.drop("street"), "id", 200.0, counted, "r_road_id").collect()}
    assert got == {i: min((to_segment_m(a, o, x), x[0]) for x in roads) for i, a, o, _ in points}
    assert sum(met) < len(points) * len(roads) / 5

    roads.append((400, 53.35, -6.36, 53.35, -6.30, "s0"))  # 4 km long
    q = spark.createDataFrame(roads, q.schema)
    own = spatial.nearest_line(p, q, "id", 150.0, X._road_m, "r_road_id", on=("street",), most_m=150.0, where=F.col("distance_m") > 0.1).collect()
    want = {i: min(((m, x[0]) for x in roads if x[5] == s and 0.1 < (m := to_segment_m(a, o, x)) <= 150), default=None) for i, a, o, s in points}
    assert {x["id"]: (x["distance_m"], x["r_road_id"]) for x in own} == {i: x for i, x in want.items() if x}


def test_pairs_of_few_bytes_are_worked_out_in_many_tasks(spark):
    df = spark.range(200).select("id", F.lit(53.0).alias("lat"), (F.col("id") / 1000.0).alias("lon"))
    pairs = spatial.range_join(df, df, 5.0, F.lit(0.0) * F.col("lat"))
    assert pairs.count() >= 200 and pairs.rdd.getNumPartitions() >= 4


def counting(monkeypatch, seen):
    plain = spatial.range_join

    def counted(*args):
        pairs = plain(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "range_join", counted)


def test_few_and_any_of_a_crowd_are_found_without_all_pairs(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, a, o, r.choice([3.0, 30.0])) for i, (a, o) in enumerate(crowd(r, 1500, side=60.0))] + [(1500, 53.352, -6.35, 30.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, reach double")
    x, y = (F.col("lon") - F.col("r_lon")) * M * math.cos(math.radians(53.35)), (F.col("lat") - F.col("r_lat")) * M
    far = F.round(F.sqrt(x * x + y * y), 4)
    near = lambda p, q: round(math.hypot((p[2] - q[2]) * M * math.cos(math.radians(53.35)), (p[1] - q[1]) * M), 4)
    within = {p[0]: sorted((m, q[0]) for q in rows if q is not p and (m := near(p, q)) <= 30) for p in rows}
    seen = []
    counting(monkeypatch, seen)
    got = spatial.nearest_few(df, df, "id", 9, 30.0, far, F.col("id") != F.col("r_id"), "r_id").collect()
    assert {(v["id"], v["rank"], v["r_id"]) for v in got} == {(i, k, other) for i, found in within.items() for k, (_, other) in enumerate(found[:9], 1)}
    assert sum(seen) < sum(map(len, within.values())) / 4

    seen.clear()
    later = spatial.with_any(df, df, "id", "reach", far, (F.col("r_id") > F.col("id")) & (F.col("r_id") % 3 == 0)).collect()
    assert {v["id"] for v in later} == {p[0] for p in rows if any(other > p[0] and other % 3 == 0 and m <= p[3] for m, other in within[p[0]])}
    assert sum(seen) < sum(map(len, within.values())) / 4


def test_claims_at_one_place_store_no_pairs(spark, monkeypatch):
    from parcelspark.plans import decisions

    r, stored, cut = random.Random(4), [], decisions.cut

    def counted(df):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(decisions, "cut", counted)
    rows = [(i, r.choice(("front", "back")), 53 + r.uniform(0, 9) / 111320, 6 + r.uniform(0, 9) / 67000) for i in range(400)] + [(400, "front", None, None), (401, "front", 53.0, float("nan"))]
    far = lambda a, b: round(math.hypot((a[3] - b[3]) * 111320 * math.cos(math.radians(b[2])), (a[2] - b[2]) * 111320), 4)
    placed = []
    for row in rows[:400]:
        if all(p[1] != row[1] or far(row, p) > 5 for p in placed):
            placed.append(row)
    got = {x[0] for x in decisions.settle_claims(spark.createDataFrame(rows, "pin_id long, garden_type string, lat double, lon double")).collect()}
    assert got == {p[0] for p in placed} | {400, 401}
    assert max(stored) <= len(rows)


def test_edge_distances_of_many_pairs_are_those_of_the_expression(spark):
    from parcelspark.functions import geo

    r = random.Random(9)
    rows = [(r.uniform(1, 9), r.uniform(1, 9), *(r.choice((r.uniform(-9, 9), 0.0, 2.0)) for _ in range(4))) for _ in range(500)]
    rows += [(4.0, 6.0, x, y, x, y) for x, y in ((0.0, 0.0), (2.0, 3.0), (5.0, 7.0), (2.0, 9.0))]
    df = spark.createDataFrame(rows, "w double, h double, ax double, ay double, bx double, by double")
    c = F.col
    want = geo.box_segment_distance(-c("w") / 2, -c("h") / 2, c("w") / 2, c("h") / 2, c("ax"), c("ay"), c("bx"), c("by"))
    got = df.select(want.alias("a"), geo.box_to_segment("w", "h", "ax", "ay", "bx", "by").alias("b")).collect()
    assert all(abs(x["a"] - x["b"]) < 1e-9 for x in got) and 50 < sum(x["a"] > 0 for x in got) < len(got)


def test_only_near_pairs_are_rounded(spark):
    from parcelspark.plans import vector

    plan = vector.range_pairs_20m(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and "20.0001" in plan
    assert plan.index("round(") < plan.index("20.0001")  # above the filter
