"""All near pairs of the rows of one table, formed within tasks.

Rows stand on cells of some eight times the radius, and on the cells beside it only if these are within the radius, so that few are sent more than once.
A task reads a cell as a stream, in bands of latitude as high as the radius, and holds three of them: a row's partners are in its band and the two beside
it, and there within a run of longitudes. What is sent, kept and spilled follows the rows, whatever the number of pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.geo import M_PER_DEG
from parcelspark.operators import spatial
from parcelspark.operators.polygons import _dealt, _slices

c = F.col
#: The side of a cell in radiuses.
WIDE = 8


def _on_cells(df: DataFrame, radius_m: float) -> DataFrame:
    """df on its own cell (_own) and on those around it that are within the radius, and the band of latitude that it is in."""
    side_m = radius_m * WIDE
    side, reach = side_m * 1.001 / M_PER_DEG, radius_m * 1.002 / M_PER_DEG
    df = df.withColumns({"_band": F.floor(c("lat") / reach).cast("long"), "_home": F.floor(c("lat") / side).cast("long")})
    df = df.withColumn("_cy", F.explode(F.sequence(c("_home") - 1, c("_home") + 1))).where((c("lat") >= c("_cy") * side - reach) & (c("lat") <= (c("_cy") + 1) * side + reach))
    n = spatial._columns(c("_cy"), side)
    at = F.pmod(c("lon") + 180.0, F.lit(360.0)) / 360.0 * n
    own = F.pmod(F.floor(at), n)
    off = at - F.floor(at)
    beside = F.filter(F.array(F.lit(0), F.when(off * WIDE <= 1.01, -1), F.when((1 - off) * WIDE <= 1.01, 1)), lambda k: k.isNotNull())  # columns are a side wide or more
    columns = F.when(n <= 3, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(beside, lambda k: F.pmod(own + k, n)))
    df = df.withColumn("_at", own).withColumn("_cx", F.explode(columns))
    return df.withColumn("_own", (c("_cy") == c("_home")) & (c("_cx") == c("_at"))).drop("_home", "_at")


def _bands(batches):
    """_cy, _cx, _band and the rows of each, of rows sorted by these."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("_cy", "_cx", "_band")])
        new = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(axis=0)]))
        for i, j in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
            this = tuple(ids[:, i].tolist())
            if held and this != key:
                yield *key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = this
            held.append(batch.slice(i, j - i))
    if held:
        yield *key, pa.Table.from_batches(held).combine_chunks()


def _met(band: pa.Table, around: list[pa.Table], radius_m: float, names: list[str]):
    """Pairs of the own rows of a band and all rows of those around it, itself included."""
    left, right = band.filter(band.column("_own")), pa.concat_tables(around).combine_chunks()
    if not left.num_rows:
        return
    y, x, v, u = (np.asarray(t.column(n), np.float64) for t in (left, right) for n in ("lat", "lon"))
    rel = u - x[0]
    rel -= 360.0 * np.rint(rel / 360.0)
    order = np.argsort(rel, kind="stable")
    right, v, u, rel = right.take(pa.array(order)), v[order], u[order], rel[order]
    mine = x - x[0]
    mine -= 360.0 * np.rint(mine / 360.0)
    wide = radius_m * 1.000001 / (M_PER_DEG * max(1e-9, np.cos(np.radians(min(90.0, np.abs(v).max()))))) + 1e-12
    if rel[-1] - rel[0] + wide >= 180.0:  # near a pole or all around it
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), len(u))
    else:
        lo, hi = np.searchsorted(rel, mine - wide, "left"), np.searchsorted(rel, mine + wide, "right")
    counts = hi - lo
    for a, b in _slices(counts):
        i, k = _dealt(counts[a:b])
        i += a
        j = k + lo[i]
        off = x[i] - u[j]
        east = (off - 360.0 * np.rint(off / 360.0)) * M_PER_DEG * np.cos(np.radians((y[i] + v[j]) / 2))
        north = (y[i] - v[j]) * M_PER_DEG
        far = np.sqrt(east * east + north * north)
        hit = far <= radius_m
        one, two = pa.array(i[hit]), pa.array(j[hit])
        columns = [left.column(n).take(one) for n in names] + [right.column(n).take(two) for n in names]
        yield from pa.table([*columns, pa.array(far[hit])], names=[*names, *(f"r_{n}" for n in names), "distance_m"]).combine_chunks().to_batches()


def pairs_within(df: DataFrame, radius_m: float) -> DataFrame:
    """All pairs of rows of df (lat, lon and others) at most radius_m from each other on the plane of geo.plane, both ways and each with itself: the columns but
    lat and lon, the other row's named r_..., and distance_m."""
    names = [n for n in df.columns if n not in ("lat", "lon")]
    on = ["_cy", "_cx"]
    rows = _on_cells(df.where("not isnan(lat) and not isnan(lon)"), radius_m)
    rows = rows.repartition(spatial.tasks(df.sparkSession), *on).sortWithinPartitions(*on, "_band")

    def run(batches):
        before = here = None
        for after in _bands(batches):
            if here is not None:
                yield from _met(here[3], [t[3] for t in (before, here, after) if t is not None and t[:2] == here[:2] and abs(t[2] - here[2]) <= 1], radius_m, names)
            before, here = here, after
        if here is not None:
            yield from _met(here[3], [t[3] for t in (before, here) if t is not None and t[:2] == here[:2] and abs(t[2] - here[2]) <= 1], radius_m, names)

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{p}{n}` {kinds[n]}" for p in ("", "r_") for n in names] + ["distance_m double"])
    return rows.mapInArrow(run, schema).where(c("distance_m") <= radius_m)
