"""The catalog of areas: commits that count whole or not at all, and chunks that are taken up again."""

import pytest
from pyspark.sql import functions as F

from parcelspark.sources.catalog import Catalog, resume

c = F.col


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"{tmp_path}/c", "lat double, radius_m double")


def entries(spark, *rows):
    return spark.createDataFrame(rows, "area_id string, lat double, radius_m double")


def rows(spark, *rows):
    return spark.createDataFrame(rows, "area_id string, v int")


def state(catalog, version=None):
    return {r["area_id"]: (r["lat"], r["radius_m"], r["at"], r["accessed"], r["counts"]) for r in catalog.areas(version).collect()}


def read(catalog, table="t", **kw):
    df = catalog.read(table, **kw)
    return df if df is None else sorted(tuple(r) for r in df.select("area_id", "v").collect())


def test_commits_in_turn(spark, catalog):
    assert state(catalog) == {} and catalog.read("t") is None and catalog.stats().first()[:] == (0, 0)
    one = catalog.upsert(entries(spark, ("a", 1.0, 5.0), ("b", 2.0, 6.0)), {"t": rows(spark, ("a", 1), ("a", 2), ("b", 3)), "empty": rows(spark)}, 1.0)
    two = catalog.upsert(entries(spark, ("b", 9.0, 9.0), ("c", 3.0, 7.0)), {"t": rows(spark, ("b", 4))}, 2.0)
    assert (one, two) == (1, 2)
    assert state(catalog) == {"a": (1.0, 5.0, 1.0, 1.0, {"t": 2, "empty": 0}), "b": (9.0, 9.0, 2.0, 2.0, {"t": 1}), "c": (3.0, 7.0, 2.0, 2.0, {"t": 0})}
    assert read(catalog) == [("a", 1), ("a", 2), ("b", 4)]
    assert read(catalog, version=1) == [("a", 1), ("a", 2), ("b", 3)]  # what a reader of then sees
    assert read(catalog, area_id="a") == [("a", 1), ("a", 2)] and read(catalog, area_id="c") == [] and read(catalog, area_id="z") is None
    empty = catalog.read("empty")
    assert empty.count() == 0 and set(empty.columns) == {"area_id", "v"}
    catalog.touch(rows(spark, ("a", 0)), 8.0)
    assert state(catalog)["a"][2:4] == (1.0, 8.0)
    assert catalog.delete(rows(spark, ("a", 0), ("z", 0))) == 1 and catalog.delete(rows(spark, ("a", 0))) == 0
    assert set(state(catalog)) == {"b", "c"} and catalog.stats().first()[:] == (2, 1)
    catalog.upsert(entries(spark, ("a", 4.0, 4.0)), {"t": rows(spark, ("a", 7))}, 9.0)
    assert read(catalog) == [("a", 7), ("b", 4)]
    assert Catalog(spark, catalog.root, "lat double, radius_m double").areas().count() == 3  # opened again
    assert catalog.clear() == 3 and state(catalog) == {} and catalog.read("t") is None and catalog.clear() == 0
    catalog.upsert(entries(spark, ("a", 1.0, 1.0)), {})
    assert state(catalog) == {"a": (1.0, 1.0, 0.0, 0.0, None)}


def test_a_commit_that_fails_leaves_the_old_state(spark, catalog):
    catalog.upsert(entries(spark, ("a", 1.0, 5.0)), {"t": rows(spark, ("a", 1))})
    before = state(catalog), catalog.version()
    broken = rows(spark, ("a", 2), ("b", 3)).withColumn("v", F.when(c("area_id") == "b", F.raise_error(F.lit("gone")).cast("int")).otherwise(c("v")))
    with pytest.raises(Exception, match="gone"):
        catalog.upsert(entries(spark, ("a", 2.0, 2.0), ("b", 3.0, 3.0)), {"ok": rows(spark, ("a", 5)), "t": broken})
    assert (state(catalog), catalog.version()) == before and read(catalog) == [("a", 1)] and catalog.read("ok") is None


def test_sweeping_keeps_what_is_needed(spark, catalog, tmp_path):
    catalog.upsert(entries(spark, ("a", 1.0, 5.0), ("b", 2.0, 6.0)), {"t": rows(spark, ("a", 1), ("b", 2))}, 1.0)
    catalog.upsert(entries(spark, ("b", 3.0, 3.0)), {"t": rows(spark, ("b", 3))}, 2.0)
    catalog.upsert(entries(spark, ("c", 4.0, 4.0)), {"t": rows(spark, ("c", 4))}, 3.0)
    catalog.delete(rows(spark, ("c", 0)))
    before = state(catalog), read(catalog)
    assert catalog.sweep() == 1
    assert (state(catalog), read(catalog)) == before
    assert len(list((tmp_path / "c/log").iterdir())) == 1 and len(list((tmp_path / "c/data").iterdir())) == 2
    assert catalog.sweep() == 0 and (state(catalog), read(catalog)) == before
    catalog.upsert(entries(spark, ("a", 7.0, 7.0)), {"t": rows(spark, ("a", 9))}, 4.0)
    assert read(catalog) == [("a", 9), ("b", 3)]


def test_chunks_are_taken_up_again(spark, tmp_path):
    chunks = entries(spark, *[(f"{k:02d}", float(k), 1.0) for k in range(11)])
    seen = []

    def work(some, fail=None):
        seen.append(sorted(r[0] for r in some.select("area_id").collect()))
        out = some.select("area_id", F.explode(F.sequence(F.lit(1), c("lat").cast("int") % 3 + 1)).alias("v"))
        return out if fail is None else out.withColumn("v", F.when(c("area_id") == fail, F.raise_error(F.lit("stopped")).cast("int")).otherwise(c("v")))

    whole = sorted(tuple(r) for r in work(chunks).collect())
    seen.clear()
    catalog = Catalog(spark, f"{tmp_path}/r", "lat double, radius_m double")
    assert len(resume(catalog, chunks, work, at_a_time=3, most=1).select("area_id").distinct().collect()) == 3
    with pytest.raises(Exception, match="stopped"):
        resume(catalog, chunks, lambda some: work(some, "07"), at_a_time=3)
    assert catalog.areas().count() == 6  # one more commit, then the one that failed
    again = Catalog(spark, f"{tmp_path}/r", "lat double, radius_m double")
    assert sorted(tuple(r) for r in resume(again, chunks, work, at_a_time=4).select("area_id", "v").collect()) == whole
    assert seen == [["00", "01", "02"], ["03", "04", "05"], ["06", "07", "08"], ["06", "07", "08", "09"], ["10"]]
    assert resume(again, chunks, work).count() == len(whole) and len(seen) == 5
