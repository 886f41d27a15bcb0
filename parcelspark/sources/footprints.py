"""Footprints as a source: WKB with a bbox struct, stored along a space-filling curve so that a box reads few row groups.

Tables follow the layout that open building datasets have: id, geometry (WKB), bbox (struct of xmin, ymin, xmax, ymax) and nested columns that no
query here needs. Rows are range-partitioned and sorted by the Z-order cell of their box's middle, so neighbours share files and row groups, and
the minima and maxima of bbox.xmin and its like, which Parquet keeps for each row group, let a scan skip the rest.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import geo, geometry

c = F.col
#: Nested columns of the source that aren't read.
NESTED = ("sources", "names", "categories", "brand", "addresses", "websites", "socials", "emails", "phones")
#: Masks that spread the bits of a number of 32 bits to every second place.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def z_order(lon: Column, lat: Column, bits: int = 26) -> Column:
    """A number that is near for near places: the bits of both coordinates, in turn."""

    def spread(x: Column) -> Column:
        for by, mask in SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
        return x

    top = float(1 << bits)
    whole = lambda v, low, width: F.greatest(F.lit(0.0), F.least(F.lit(top - 1), F.floor((v - low) / width * top).cast("double"))).cast("long")
    return spread(whole(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(whole(lat, -90.0, 180.0)), 1))


def write(footprints: DataFrame, path: str, rows_a_file: int = 1 << 20, group_bytes: int = 16 << 20) -> None:
    """footprints: id, geometry (WKB) and any other columns. Adds bbox from the geometry where there is none; rows without a box come last."""
    if "bbox" not in footprints.columns:
        footprints = footprints.withColumn("bbox", geometry.envelope(geometry.from_wkb(c("geometry"))))
    cell = z_order((c("bbox.xmin") + c("bbox.xmax")) / 2, (c("bbox.ymin") + c("bbox.ymax")) / 2)
    files = max(1, -(-footprints.count() // rows_a_file))
    laid = footprints.withColumn("_cell", F.coalesce(cell, F.lit((1 << 62)))).repartitionByRange(files, "_cell", "id").sortWithinPartitions("_cell", "id").drop("_cell")
    laid.write.option("parquet.block.size", group_bytes).parquet(path)


def in_box(box: dict[str, float]) -> Column:
    """Boxes that touch; over the 180th meridian (xmin > xmax) the box is two."""
    ys = (c("bbox.ymax") >= box["ymin"]) & (c("bbox.ymin") <= box["ymax"])
    if box["xmin"] > box["xmax"]:
        return ys & ((c("bbox.xmax") >= box["xmin"]) | (c("bbox.xmin") <= box["xmax"]))
    return ys & (c("bbox.xmax") >= box["xmin"]) & (c("bbox.xmin") <= box["xmax"])


def read(spark: SparkSession, path: str, box: dict[str, float] | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Footprints of a box, without the nested columns; keep: only these, as far as they are there."""
    df = spark.read.parquet(path)
    df = df.drop(*NESTED) if keep is None else df.select(*[n for n in df.columns if n in {*keep, "geometry", "bbox"}])
    return df if box is None else df.where(in_box(box))


def in_circle(spark: SparkSession, path: str, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Footprints that touch the circle, with plane, the geometry in metres of the UTM zone of the circle's middle around that middle. The box is left to
    the scan; only what it lets through is decoded. Exact distance: a footprint that straddles the edge counts, and with its whole area."""
    df = read(spark, path, wrapped(geo.circle_box(lat, lon, radius_m)))
    central = F.lit(float(int((lon + 180.0) // 6) * 6 - 177))
    mx, my = geo.utm(F.lit(lat), F.lit(lon), central)
    to = lambda x, y: tuple(a - b for a, b in zip(geo.utm(y, x, central), (mx, my), strict=True))
    df = df.withColumn("plane", geometry.moved(geometry.from_wkb(c("geometry")), to))
    return df.where(geometry.distance(c("plane"), F.lit(0.0), F.lit(0.0)) <= radius_m)


def wrapped(box: dict[str, float]) -> dict[str, float]:
    """A box whose longitudes are between -180 and 180, unless it goes all around."""
    if box["xmax"] - box["xmin"] >= 360:
        return box | {"xmin": -180.0, "xmax": 180.0}
    turn = lambda x: x + 360 if x < -180 else x - 360 if x > 180 else x
    return box | {"xmin": turn(box["xmin"]), "xmax": turn(box["xmax"])}
