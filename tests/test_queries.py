"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os
import random

import duckdb
import pytest

from parcelspark.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in row) for row in df.select(*columns).collect()), key=repr)
    found = oracle.execute(catalogue.ORACLES[name])
    at = [x[0] for x in found.description]
    assert sorted(at) == columns
    want = sorted((tuple(plain(row[at.index(c)]) for c in columns) for row in found.fetchall()), key=repr)
    assert got == want


def test_claims_are_those_of_going_through_all_pins(spark):
    from parcelspark.plans import decisions
    from parcelspark.sources import views as V

    rows = V.pins(spark, SF).select("pin_id", "garden_type", "lat", "lon").toPandas().sort_values("pin_id")
    placed = {"front": [], "back": []}
    for pin, kind, lat, lon in rows.itertuples(index=False):
        if all(round(math.hypot((lon - x) * 111320 * math.cos(math.radians(y)), (lat - y) * 111320), 4) > 5 for _, y, x in placed[kind] if abs(lat - y) < 0.0001):
            placed[kind].append((pin, lat, lon))
    got = {r["pin_id"] for r in decisions.greedy_claims(spark, SF).collect()}
    assert got == {p[0] for ps in placed.values() for p in ps} and 100 < len(got) < len(rows)


def test_settled_pins_are_those_of_one_building_after_another(spark):
    """The placement in rounds against a plain loop over owners that claims discs."""
    from parcelspark.plans import site

    r = random.Random(3)
    rows = sorted({(o, k, 6 * (o // 4) + r.randrange(12), 6 * (o % 4) + r.randrange(12)) for o in range(16) for k in ("front", "back") for _ in range(14)})
    rows = [(*x, r.randint(1, 3), r.randint(1, 4), float(r.randint(10, 99))) for x in rows]
    df = spark.createDataFrame(rows, "owner long, kind string, y long, x int, attempt int, tier int, score double")
    want = {}
    for owner in range(16):
        for kind in ("front", "back"):
            left = [x for x in rows if x[:2] == (owner, kind) and all((x[2] - y) ** 2 + (x[3] - z) ** 2 > 100 for (o, k), (y, z) in want.items() if k == kind and o < owner)]
            for i in (4, 5):
                left = [x for x in left if x[i] == min(y[i] for y in left)]
            left = [x for x in left if x[6] >= 0.5 * max(y[6] for y in left)]
            if left:
                my, mx = (sum(x[i] for x in left) / len(left) for i in (2, 3))
                want[owner, kind] = min((round((x[2] - my) ** 2 + (x[3] - mx) ** 2, 6), x[2], x[3]) for x in left)[1:]
    got = {(x["owner"], x["kind"]): (x["y"], x["x"]) for x in site.settle(df).collect()}
    assert got == want and 4 < len(got) < 32


def test_rasters_of_two_images_stay_apart(spark):
    from pyspark.sql import functions as F

    from parcelspark.operators import raster as R

    r = random.Random(5)
    rows = [(i, y, x, int(r.random() < 0.06), int(r.random() < 0.5)) for i in (1, 2) for y in range(13) for x in range(11)]
    df = spark.createDataFrame(rows, "image int, y int, x int, s int, m int")
    at = {(i, y, x): (s, m) for i, y, x, s, m in rows}
    got = {(p["image"], p["y"], p["x"]): (p["d2"], p["sy"], p["sx"]) for p in R.nearest_source(df, F.col("s") == 1, by=("image",)).collect()}
    assert got == {(i, y, x): min(((y - b) ** 2 + (x - c) ** 2, b, c) for j, b, c in at if j == i and at[j, b, c][0]) for i, y, x in at}
    none = R.nearest_source(df, F.lit(False), by=("image",))
    assert none.count() == len(rows) and none.where("d2 is not null").count() == 0
    sums = R.box_sums(df.select("image", "y", "x", "m"), {"x": 11, "y": 13}, 2, "m", by=("image",))
    fold = lambda v, n: -v - 1 if v < 0 else 2 * n - 1 - v if v >= n else v
    assert {(p["image"], p["y"], p["x"]): p["m"] for p in sums.collect()} == {(i, y, x): sum(at[i, fold(y + a, 13), fold(x + b, 11)][1] for a in range(-2, 3) for b in range(-2, 3)) for i, y, x in at}
    wide = R.morph(df, "m", F.min, "e", R.ELLIPSE_5, by=("image",))
    assert {(p["image"], p["y"], p["x"]): p["e"] for p in wide.collect()} == {(i, y, x): min(at[i, y + a, x + b][1] for a, w in R.ELLIPSE_5.items() for b in range(-w, w + 1) if (i, y + a, x + b) in at) for i, y, x in at}
    labels = {(p["image"], p["y"], p["x"]): p["label"] for p in R.components(df.where("m = 1"), by=("image",)).collect()}
    for i in (1, 2):
        mine = R.components(df.where(f"m = 1 and image = {i}")).collect()
        assert {(i, p["y"], p["x"]): p["label"] for p in mine} == {k: v for k, v in labels.items() if k[0] == i}
