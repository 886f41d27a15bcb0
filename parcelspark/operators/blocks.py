"""Rasters in square blocks: NumPy works on a block and its halo, Spark moves blocks, and what crosses a seam is joined by label or asked again.

A task never holds more than a block with its halo, however large the image is, and no window runs along a whole row or column.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.tables import cut

c = F.col
SIDE = 128
#: First halo of a distance transform; it grows by HALO_GROWTH for the blocks that need it.
HALO, HALO_GROWTH = 48, 4
NONE = -(1 << 40)


def block(v: Column) -> Column:
    return F.floor(v / SIDE).cast("long")


def nearest_in_block(ys: np.ndarray, xs: np.ndarray, sy: np.ndarray, sx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the nearest source (smallest sy, then sx, of equally near ones): the nearest of each column, then the best column."""
    columns, at = np.unique(sx, return_inverse=True)
    rows = np.unique(ys)
    top, height = min(rows[0], sy.min()), max(rows[-1], sy.max()) - min(rows[0], sy.min()) + 1
    up = np.full((height, len(columns)), NONE, np.int64)
    up[sy - top, at] = sy
    down = np.where(up == NONE, -NONE, up)
    up, down = np.maximum.accumulate(up, axis=0)[rows - top], np.minimum.accumulate(down[::-1], axis=0)[::-1][rows - top]
    near = np.where(rows[:, None] - up <= down - rows[:, None], up, down)
    out = np.zeros((len(ys), 2), np.int64)
    order = np.argsort(ys, kind="stable")
    for k, idx in enumerate(np.split(order, np.searchsorted(ys[order], rows[1:]))):
        far = (near[k] - rows[k]) ** 2 + (xs[idx][:, None] - columns[None, :]) ** 2
        tied = np.where(far == far.min(axis=1, keepdims=True), near[k][None, :], 1 << 60)  # columns ascend, so the first of the smallest rows has the smallest column
        best = tied.argmin(axis=1)
        out[idx, 0], out[idx, 1] = near[k][best], columns[best]
    return out[:, 0], out[:, 1]


def _nearest(by: tuple[str, ...]):
    def run(pixels: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        out = pixels[[*by, "y", "x"]].copy()
        if len(sources) and len(pixels):
            found = nearest_in_block(*(pixels[k].to_numpy(np.int64) for k in "yx"), *(sources[k].to_numpy(np.int64) for k in "yx"))
            return out.assign(sy=found[0], sx=found[1])
        return out.assign(sy=pd.array([None] * len(out), "Int64"), sx=pd.array([None] * len(out), "Int64"))

    return run


def nearest_source(df: DataFrame, source: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """y, x, sy, sx of each pixel: the nearest source pixel of its image (smallest sy, then sx, of equally near ones), null where an image has none.
    Exact at any distance: a block sees all sources within its halo, so a hit no farther than that is certain, and the blocks of the other pixels
    ask again with a larger one."""
    pixels = cut(df.select(*by, c("y").cast("long").alias("y"), c("x").cast("long").alias("x"), F.coalesce(source, F.lit(False)).alias("_s")))
    kinds = dict(pixels.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "y long", "x long", "sy long", "sx long"])
    key = [*by, "_by", "_bx"]
    span = pixels.agg(F.max("y") - F.min("y"), F.max("x") - F.min("x")).first()
    most = max((s or 0 for s in span), default=0) + 1
    sources, todo = pixels.where("_s").select(*by, "y", "x"), pixels.select(*by, "y", "x").withColumns({"_by": block(c("y")), "_bx": block(c("x"))})
    halo, out = HALO, None
    while True:
        reach = lambda v, halo=halo: F.explode(F.sequence(block(c(v) - halo), block(c(v) + halo)))
        around = sources.withColumn("_by", reach("y")).withColumn("_bx", reach("x"))
        if out is not None:
            around = around.join(todo.select(*key).distinct(), key, "left_semi")
        found = cut(todo.groupBy(*key).cogroup(around.groupBy(*key)).applyInPandas(_nearest(by), schema))
        d2 = (c("y") - c("sy")) * (c("y") - c("sy")) + (c("x") - c("sx")) * (c("x") - c("sx"))
        certain = F.coalesce(d2 <= halo * halo, F.lit(False)) if halo < most else F.lit(True)
        out = found.where(certain) if out is None else out.unionByName(found.where(certain))
        if halo >= most:
            return out
        left = found.where(~certain)
        if left.isEmpty():
            return out
        todo = left.select(*by, "y", "x").withColumns({"_by": block(c("y")), "_bx": block(c("x"))})
        halo *= HALO_GROWTH


def labels_in_block(ys: np.ndarray, xs: np.ndarray, eight: bool) -> np.ndarray:
    """The smallest y * 2^20 + x of each pixel's component within the block."""
    y, x = ys - ys.min(), xs - xs.min()
    at = np.full((y.max() + 3, x.max() + 3), -1, np.int64)
    ids = ys * (1 << 20) + xs
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    at[y + 1, x + 1] = rank
    pairs = []
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))[: 4 if eight else 2]:
        other = at[y + 1 + dy, x + 1 + dx]
        pairs.append((rank[other >= 0], other[other >= 0]))
    u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    root = np.arange(len(ids))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return ids[order][root[rank]]
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def _labels(eight: bool, by: tuple[str, ...]):
    def run(pixels: pd.DataFrame) -> pd.DataFrame:
        pixels = pixels.drop_duplicates([*by, "y", "x"])
        return pixels[[*by, "y", "x"]].assign(run=labels_in_block(pixels["y"].to_numpy(np.int64), pixels["x"].to_numpy(np.int64), eight))

    return run


def local_labels(df: DataFrame, eight: bool, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Pixels with the label of their component within their block (run), and pairs of such labels that touch over a seam (run, other)."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "y long", "x long", "run long"])
    pixels = df.select(*by, c("y").cast("long").alias("y"), c("x").cast("long").alias("x"))
    pixels = cut(pixels.groupBy(*by, block(c("y")).alias("_by"), block(c("x")).alias("_bx")).applyInPandas(_labels(eight, by), schema))
    side = F.lit(SIDE)
    last = lambda v: F.pmod(c(v), side) == SIDE - 1
    beside = lambda v: F.explode(F.array(*[c(v) + k for k in ((-1, 0, 1) if eight else (0,))])).alias(v)
    below = pixels.where(last("y")).select(*by, c("run").alias("other"), (c("y") + 1).alias("y"), beside("x"))
    right = pixels.where(last("x")).select(*by, c("run").alias("other"), beside("y"), (c("x") + 1).alias("x"))
    edge = pixels.where(F.pmod(c("y"), side).isin(0, SIDE - 1) | F.pmod(c("x"), side).isin(0, SIDE - 1))
    links = edge.join(below.union(right), [*by, "y", "x"]).where("run <> other").select(*by, "run", "other").distinct()
    return pixels, links


def windowed(df: DataFrame, axis: str, half: int) -> DataFrame:
    """df with _block, so that windows of up to half pixels along an axis may run within a block: pixels near a seam stand in both blocks, and _own says in
    which one they belong."""
    size = max(SIDE, 4 * half)
    df = df.withColumn("_block", F.explode(F.sequence(F.floor((c(axis) - half) / size).cast("long"), F.floor((c(axis) + half) / size).cast("long"))))
    return df.withColumn("_own", F.floor(c(axis) / size) == c("_block"))
