"""Substring dedup on a De Bruijn graph of words.

Every window of k words is an edge of the graph, named by its 64-bit hash and a 32-bit check. Only repeated edges matter, so
windows are first screened: of the `gram`-word grams inside a window the one of the smallest hash (its minimizer) is the same for
equal windows. Minimizers that occur once in the whole corpus rule their windows out; those that repeat set a bit in a table of
fixed size that goes to all tasks. A false bit costs time, never a result.

Edges that pass are compacted on the map side first: of equal edges within a task only the earliest source coordinate travels,
the others are already decided. The rest meet by edge hash; the smallest (doc_id, position) of an edge keeps its words and every
other coordinate is removed. Back at the documents, runs of removed edges join into spans. A run may hold edges of several sources, so spans
are those of the text, not of the graph: degrees of nodes are never worked out.

Every row is a source of its own. Where a doc_id stands in more than one row (or is null), a hash of the text tells the rows apart:
coordinates are (doc_id, hash, position), and rows that agree in both are copies, of which one is the source and the others lose
all their windows. Which doc_ids those are is a table of bits of fixed size; a false bit costs space, never a result.

Defined results: null or empty text has no words; texts shorter than k words lose nothing; a very long text is hashed as a whole by one task, and its
windows travel as those of any other; of equal windows (ties) the smallest (doc_id, hash, position) stays; null doc_ids come after all others;
rows with the same doc_id count as one source each, in the order of a 64-bit hash of their text; an empty table gives an empty table; other columns
are left behind by remove_spans' query form and carried along otherwise.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.rolling import Roller, word_line

LAST = (1 << 63) - 1
TABLE_BITS = 27
ROW_BITS = 24
FLUSH = 1 << 19


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each w consecutive values."""
    have = 1
    while 2 * have <= w:
        x, have = pick(x[:-have], x[have:]), 2 * have
    return pick(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def minimizers(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest gram of each w consecutive ones, and the positions of the grams that are the smallest somewhere."""
    low = sliding(grams, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    return low, np.flatnonzero(sliding(padded, w, np.maximum) == grams)


def bit_table(repeated: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """A table of 2^bits bits, set at the top bits of each hash; combined on the executors."""
    at = F.call_function("shiftrightunsigned", F.col("hash"), F.lit(64 - bits))
    words = repeated.select(F.call_function("shiftright", at, F.lit(6)).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))").alias("bits"))
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["word"]] = rows["bits"]
    return table.view(np.uint64)


def has_bit(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(65 - (64 * len(table)).bit_length())
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with _id, doc_id or LAST, and _sub, which tells the rows of an _id apart: a hash of the text, 0 where the _id is alone."""
    docs = docs.withColumn("_id", F.coalesce("doc_id", F.lit(LAST)))
    again = docs.groupBy(F.xxhash64("_id").alias("hash")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(again, ROW_BITS))

    def several(hashes: pd.Series) -> pd.Series:
        return pd.Series(has_bit(shared.value, hashes.to_numpy().view(np.uint64)))

    flag = F.pandas_udf(several, "boolean")(F.xxhash64("_id"))
    return docs.withColumn("_sub", F.when(flag, F.xxhash64("text")).otherwise(F.lit(0)).cast("long"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with _copy, 1 for one row of each _id and _sub, and more for its copies."""
    return docs.withColumn("_copy", F.row_number().over(Window.partitionBy("_id", "_sub").orderBy("_sub")))


def ranked(rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (_id, _sub) in order, and the place of each row among them."""
    keys, at = np.unique(np.array(rows, np.int64), axis=0, return_inverse=True)
    return keys, at.ravel()


def counted(values: list[np.ndarray]) -> pd.DataFrame:
    v, n = np.unique(np.concatenate(values) if values else np.zeros(0, np.uint64), return_counts=True)
    return pd.DataFrame({"hash": v.view(np.int64), "n": np.minimum(n, 2).astype(np.int32)})


def _grams(text: str | None, k: int, gram: int, roller: Roller):
    line, starts, ends = word_line(text, lower=False)
    if len(starts) < k:
        return None
    prefixes = roller.prefixes(line)
    grams = roller.spans(prefixes, starts[: len(starts) - gram + 1], ends[gram - 1 :])
    return prefixes, starts, ends, *minimizers(grams, k - gram + 1), grams


def _screen(k: int, gram: int):
    def run(batches):
        roller, held, n = Roller(), [], 0
        for batch in batches:
            for t in batch["text"]:
                found = _grams(t, k, gram, roller)
                if found:
                    held.append(found[5][found[4]])
                    n += len(held[-1])
                    if n > FLUSH:
                        yield counted(held)
                        held, n = [], 0
        yield counted(held)

    return run


def earliest(edge: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest coordinate of each edge, and of those at another coordinate than that."""
    order = np.lexsort((pos, row, edge))
    e, r, p = edge[order], row[order], pos[order]
    first = np.append(True, e[1:] != e[:-1])
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    return order[first], order[(r != r[at]) | (p != p[at])]


def _edges(k: int, gram: int, shared):
    """Rows with n = 0 are edges that still have to meet others; n > 0 are n removed windows in a row."""

    def made(held):
        edge, check, pos = (np.concatenate([h[i] for h in held]) for i in range(3))
        keys, at = ranked([h[3] for h in held])
        row = np.repeat(at, [len(h[0]) for h in held])
        keep, gone = earliest(edge, row, pos)
        gone = gone[np.lexsort((pos[gone], row[gone]))]
        r, p = row[gone], pos[gone]
        starts = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1))) if len(gone) else gone
        n = np.diff(np.append(starts, len(gone)))
        one = pd.DataFrame({"edge": edge[keep].view(np.int64), "check": check[keep], "doc": keys[row[keep], 0], "sub": keys[row[keep], 1], "pos": pos[keep], "n": np.zeros(len(keep), np.int32)})
        two = pd.DataFrame({"edge": edge[gone][starts].view(np.int64), "check": np.zeros(len(starts), np.int32), "doc": keys[r[starts], 0], "sub": keys[r[starts], 1], "pos": p[starts], "n": n.astype(np.int32)})
        return pd.concat([one, two])

    def run(batches):
        roller, table, held, n = Roller(), shared.value, [], 0
        for batch in batches:
            for doc, sub, t in zip(batch["_id"], batch["_sub"], batch["text"], strict=True):
                found = _grams(t, k, gram, roller)
                if not found:
                    continue
                prefixes, starts, ends, low, *_ = found
                at = np.flatnonzero(has_bit(table, low))
                if not len(at):
                    continue
                edge = roller.spans(prefixes, starts[at], ends[at + k - 1])
                check = (roller.spans(prefixes, starts[at], ends[at + k // 2 - 1]) >> np.uint64(33)).astype(np.int32)
                held.append((edge, check, at.astype(np.int32), (doc, sub)))
                n += len(at)
                if n > FLUSH:
                    yield made(held)
                    held, n = [], 0
        if held:
            yield made(held)

    return run


def _meet(batches):
    """Rows sorted by edge, check, doc, sub, pos: those at another coordinate than the first of their edge are removed."""
    first = None
    for b in batches:
        done = b["n"].to_numpy() > 0
        e = b[~done]
        out = b.loc[done, ["doc", "sub", "pos", "n"]]
        if len(e):
            edge, check = e["edge"].to_numpy(), e["check"].to_numpy()
            new = np.append(first is None or first[:2] != (edge[0], check[0]), (edge[1:] != edge[:-1]) | (check[1:] != check[:-1]))
            heads, at, gone, last = np.flatnonzero(new), np.cumsum(new) - 1, np.zeros(len(e), bool), (edge[-1], check[-1])
            for i, c in enumerate(("doc", "sub", "pos"), 2):
                v = e[c].to_numpy()
                head = np.where(at >= 0, v[heads][at] if len(heads) else 0, first[i] if first else 0)
                gone |= v != head
                last += (head[-1],)
            first = last
            out = pd.concat([out, e.loc[gone, ["doc", "sub", "pos"]].assign(n=np.int32(1))])
        yield out


def covered(n: int, k: int, starts, runs) -> np.ndarray:
    """Which of n units a window of k units covers; windows start at starts and the runs - 1 places after."""
    steps = np.zeros(n + 1, np.int64)
    a = np.asarray(starts, np.int64)
    np.add.at(steps, a, 1)
    np.add.at(steps, a + np.asarray(runs, np.int64) - 1 + k, -1)
    return np.cumsum(steps[:-1]) > 0


def removals(docs: DataFrame, k: int = 20, gram: int = 10) -> DataFrame:
    """_id, _sub, removed (array of pos, n) of each row with windows that also start earlier. docs: _id, _sub, text."""
    spark = docs.sparkSession
    repeated = docs.select("text").mapInPandas(_screen(k, gram), "hash long, n int").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    table = spark.sparkContext.broadcast(bit_table(repeated))
    edges = docs.mapInPandas(_edges(k, gram, table), "edge long, check int, doc long, sub long, pos int, n int")
    met = edges.repartition("edge").sortWithinPartitions("edge", "check", "doc", "sub", "pos").mapInPandas(_meet, "doc long, sub long, pos int, n int")
    return met.groupBy(F.col("doc").alias("_id"), F.col("sub").alias("_sub")).agg(F.collect_list(F.struct("pos", "n")).alias("removed"))


def _cut_words(k: int):
    def run(text: pd.Series, pos: pd.Series, n: pd.Series, copy: pd.Series) -> pd.DataFrame:
        rows = []
        for t, starts, runs, number in zip(text, pos, n, copy, strict=True):
            words = (t or "").encode().split()
            if number > 1:
                gone = np.full(len(words), len(words) >= k)
            else:
                gone = np.zeros(len(words), bool) if starts is None or not len(starts) else covered(len(words), k, starts, runs)
            kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else b" ".join(words)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            rows.append((len(words), int(gone.sum()), kept.decode(), edges.tolist()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, k: int = 20, gram: int = 10) -> DataFrame:
    """docs with n_words, n_removed, kept (the words that stay) and spans (removed word ranges: from, to, from, to ...)."""
    docs = row_keys(docs)
    out = numbered(docs).join(removals(docs.select("_id", "_sub", "text"), k, gram), ["_id", "_sub"], "left")
    cut_words = F.pandas_udf(_cut_words(k), "n_words long, n_removed long, kept string, spans array<int>")
    out = out.withColumn("_c", cut_words("text", "removed.pos", "removed.n", "_copy")).drop("_id", "_sub", "_copy", "removed")
    return out.withColumns({c: F.col(f"_c.{c}") for c in ("n_words", "n_removed", "kept", "spans")}).drop("_c")
