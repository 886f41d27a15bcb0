"""Embedding near-dedup with a pivot-permutation index.

Pivots are reference vectors: a sample of bounded, documented size (one for each 50 distinct vectors, 32 to 16,384), from which
those near an earlier pivot are left out, so a dense region has one. Every vector is described by its permutation: the `near` closest
pivots, nearest first, and posted to their inverted lists. Two vectors of a list that share at least `shared` pivots are
candidates; only these are verified, by cosine in double precision. A pair is taken in one list only, that of the shared pivot of the
smallest sum of places in the two permutations, so pairs are never materialised or made distinct: a list returns, for each
vector, its number of links and the smallest vector of its part.

Equal vectors are one entry with a weight. Lists longer than BLOCK are split into blocks that meet block by block, so a list of any
length is processed in bounded groups, and nothing is capped. Above 800,000 distinct vectors the number of pivots stands still
and lists grow with the table. Recall is that of the index; README has it as measured against brute force.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components link with nothing and are kept;
vectors of different lengths never link, and those of a length that no pivot has meet in a list of their own; null vec_ids come after
all others; rows with the same vec_id or vector count as separate vectors; an empty table gives an empty table; other columns,
whatever their names, are left behind.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, hash_pair
from parcelspark.llm.components import components

LAST = (1 << 63) - 1
BLOCK = 1024
PIVOTS = (32, 16384, 50)
#: Stands for no pivot.
NONE = -(1 << 30)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def spread(sample: list[np.ndarray], most: float = 0.8) -> list[np.ndarray]:
    """The sample without vectors that are nearer than `most` to an earlier one of their length that stays."""
    out: list[np.ndarray] = []
    for n in sorted({len(x) for x in sample}):
        vectors = np.stack([x for x in sample if len(x) == n])
        kept = np.zeros((0, n))
        for i in range(0, len(vectors), 512):
            some = vectors[i : i + 512]
            some = some[(some @ kept.T).max(axis=1, initial=-1) < most]
            stay: list[int] = []
            for k, sims in enumerate(some @ some.T):
                if not stay or sims[stay].max() < most:
                    stay.append(k)
            kept = np.concatenate([kept, some[stay]])
        out += list(kept)
    return out


def _posted(shared, near: int):
    """Pivot numbers of each vector, nearest first; one of a length that no pivot has is posted to a list of that length."""

    def run(batches):
        pivots = shared.value
        by_length = {n: (np.array([i for i, p in enumerate(pivots) if len(p) == n]), np.stack([p for p in pivots if len(p) == n])) for n in {len(p) for p in pivots}}
        for batch in batches:
            rows = []
            for v in batch["vector"]:
                ids, table = by_length.get(len(v), (None, None))
                if ids is None:
                    rows.append([-len(v)])
                    continue
                sims = table @ unit(np.asarray(v, float))
                rows.append(ids[np.argsort(-sims, kind="stable")[:near]].tolist())
            yield pd.DataFrame({"rep": batch["rep"], "weight": batch["weight"], "vector": batch["vector"], "pivots": rows})

    return run


def candidates(left: np.ndarray, right: np.ndarray | None, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that share at least so many pivots (all, where a permutation has fewer); within left where right is None."""
    both = left if right is None else np.concatenate([left, right])
    names, at = np.unique(both, return_inverse=True)
    has = np.zeros((len(both), len(names)), np.float32)
    has[np.repeat(np.arange(len(both)), both.shape[1]), at.ravel()] = 1
    has = has[:, names != NONE]
    a, b = has[: len(left)], has[: len(left)] if right is None else has[len(left) :]
    counts = a @ b.T
    if right is None:
        counts[np.tril_indices(len(left))] = 0
    return np.nonzero(counts >= min(shared, int(both.shape[1]), int((both != NONE).sum(axis=1).min())))


def _linked(at_least: float, shared: int):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        pivot, a, b = key
        g = g.sort_values("rep", ignore_index=True)
        one, two = np.flatnonzero(g["chunk"] == a), np.flatnonzero(g["chunk"] == b)
        x = unit(np.stack(g["vector"].to_list()).astype(float))
        width = max(map(len, g["pivots"]))
        lists = np.stack([np.pad(np.asarray(p), (0, width - len(p)), constant_values=NONE) for p in g["pivots"]])
        i, j = candidates(lists[one], None if a == b else lists[two], shared)
        i, j = one[i], (one if a == b else two)[j]
        own = []
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            near = np.einsum("ij,ij->i", x[p], x[q]) >= at_least
            p, q = p[near], q[near]
            if not len(p):
                continue
            same = (lists[p][:, :, None] == lists[q][:, None, :]) & (lists[p] != NONE)[:, :, None]
            places = np.where(same, np.arange(width)[:, None] + np.arange(width)[None, :], 1 << 20) * (1 << 20) + np.where(lists[p] < 0, 0, lists[p])[:, :, None]
            best = places.reshape(len(p), -1).argmin(axis=1) // width
            mine = lists[p][np.arange(len(p)), best] == pivot
            own.append((p[mine], q[mine]))
        i, j = (np.concatenate([o[k] for o in own]) if own else np.zeros(0, np.int64) for k in (0, 1))
        weight = g["weight"].to_numpy()
        links = np.bincount(i, weights=weight[j], minlength=len(g)) + np.bincount(j, weights=weight[i], minlength=len(g))
        root = np.arange(len(g))
        while len(i):
            old = root.copy()
            np.minimum.at(root, i, old[j])
            np.minimum.at(root, j, old[i])
            root = root[root]
            if (root == old).all():
                break
        found = np.flatnonzero(links)
        rep = g["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[found], "links": links[found].astype(np.int64), "root": rep[root[found]]})

    return run


def link_vectors(vectors: DataFrame, at_least: float = 0.95, near: int = 8, shared: int = 2) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce("vec_id", F.lit(LAST)).cast("long").alias("_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("vector"))
    ok = F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    a, b = hash_pair(F.col("vector"))
    keyed = rows.where("_ok").withColumn("_k", F.struct(a.alias("a"), b.alias("b")))
    entries = cut(keyed.groupBy("_k").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")))
    low, high, each = PIVOTS
    wanted = max(low, min(high, entries.count() // each))
    sample = entries.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("vector").toPandas()["vector"]
    pivots = spark.sparkContext.broadcast(spread([unit(np.asarray(v, float)) for v in sample]))

    posted = entries.select("rep", "weight", "vector").mapInPandas(_posted(pivots, near), "rep long, weight long, vector array<double>, pivots array<int>")
    posted = posted.withColumn("pivot", F.explode("pivots"))
    chunks = posted.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n"))
    posted = posted.join(chunks, "pivot").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("_n")))
    posted = posted.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    met = posted.groupBy("pivot", F.least("chunk", "_other").alias("a"), F.greatest("chunk", "_other").alias("b"))
    found = cut(met.applyInPandas(_linked(at_least, shared), "rep long, links long, root long"))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v"))).toDF("rep", "component")
    entries = entries.select("_k", "rep", "weight").join(links, "rep", "left").join(parts, "rep", "left")
    known = keyed.select("_id", "_k").join(entries, "_k").select("_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = known.union(rows.where("not _ok").select("_id", F.lit(0).cast("long"), "_id"))
    kept = F.col("component_id") == F.col("_id")
    return out.select(F.nullif("_id", F.lit(LAST)).alias("vec_id"), "n_links", F.nullif("component_id", F.lit(LAST)).alias("component_id"), kept.alias("kept"))
