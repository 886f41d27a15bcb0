"""Suffix-array dedup: repeated byte strings from merged Burrows-Wheeler transforms.

A byte goes if a string of k bytes around it also starts earlier. Windows of k bytes are first screened: of the `gram`-byte grams of
a window, the leftmost of smallest hash (its minimizer) is the same for equal windows, so a minimizer that occurs once in the
corpus rules its windows out. Consecutive windows of one minimizer travel as one row, a stretch, with a hash of all its bytes.
Equal stretches are decided by their earliest coordinate: within a task at once, the rest where they meet by minimizer. What is
left are minimizers with several different stretches; only their bytes are sorted.

Those stretches are dealt by minimizer and worked on in units of bounded size. A unit is cut into shards. Each shard gets its own
suffix order and Burrows-Wheeler transform, and the transforms are merged by iterative interleave refinement: starting from
shard after shard, each round moves every suffix to the bucket of the character before it, which makes the interleaving
right for one more character. No suffix is sorted again. A round also carries where neighbours first differ and drops the suffixes
that differ from all others, so what is left after k rounds are the common prefixes of k bytes or more: the repeated intervals. Their
earliest coordinate stays.

A minimizer whose different stretches are more than GROUP bytes is dealt out window by window. Windows have k bytes, so Spark's sort of them is their suffix
order: equal ones stand together, and a task reads them as a stream. So no group is unbounded, whatever very many stretches share.

Defined results: null or empty text has no bytes; texts shorter than k bytes lose nothing; very long texts are screened in pieces of PIECE bytes that
overlap by k - 1, so no window is lost at a seam; of equal strings (ties) the smallest (doc_id, hash, position) stays; matches never cross rows; null doc_ids
come after all others; rows with the same doc_id are one source each, in the order of a 64-bit hash of their text, and of rows that
agree in both one is the source and the others lose all their windows (see substring_dedup); an empty table gives an
empty table; other columns are carried along, except that the added columns replace any of the same name.
"""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import bounded_batches, released, written
from parcelspark.llm.rolling import Roller
from parcelspark.llm.substring_dedup import FLUSH, bit_table, counted, covered, has_bit, numbered, ranked, row_keys, sliding

PIECE = 1 << 20
UNIT = 1 << 18
SHARDS = 4
GROUP = 1 << 21
#: Bytes of strings that are passed on at a time.
PASSED = 1 << 22


def stretches(data: np.ndarray, k: int, gram: int, roller: Roller):
    """prefix hashes, and start, number of windows and minimizer of each stretch of windows with one minimizer position."""
    prefixes = roller.prefixes(data)
    at = np.arange(len(data) - gram + 1)
    grams = roller.spans(prefixes, at, at + gram)
    low = np.uint64((1 << 22) - 1)
    place = (sliding((grams & ~low) | at.astype(np.uint64), k - gram + 1, np.minimum) & low).astype(np.int64)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return prefixes, starts, np.diff(np.append(starts, len(place))), grams[place[starts]]


def pieces(text: str | None, k: int):
    """Offset and bytes of pieces that together hold each window once."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    for i in range(0, len(data) - k + 1, PIECE):
        yield i, data[i : i + PIECE + k - 1]


def _screen(k: int, gram: int):
    def run(batches):
        roller, held, n = Roller(), [], 0
        for batch in batches:
            for t in batch["text"]:
                for _, data in pieces(t, k):
                    held.append(stretches(data, k, gram, roller)[3])
                    n += len(held[-1])
            if n > FLUSH:
                yield counted(held)
                held, n = [], 0
        yield counted(held)

    return run


def others(group: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the earliest row of each group, and of the rows at another coordinate than that."""
    order = np.lexsort((pos, doc, group))
    g, d, p = group[order], doc[order], pos[order]
    new = np.append(True, g[1:] != g[:-1])
    at = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[new], order[(d != d[at]) | (p != p[at])]


def _stretches(k: int, gram: int, shared):
    """Rows with done are stretches that are removed for good; the others still have to meet."""

    def made(held):
        m, content, pos, n = (np.concatenate([h[i] for h in held]) for i in range(4))
        keys, row = ranked([h[4] for h in held])
        row = np.repeat(row, [len(h[0]) for h in held])
        keep, gone = others(content, row, pos)
        at = np.concatenate([keep, gone])
        return pd.DataFrame({"m": m[at].view(np.int64), "content": content[at].view(np.int64), "doc": keys[row[at], 0], "sub": keys[row[at], 1], "pos": pos[at], "n": n[at].astype(np.int32), "done": np.arange(len(at)) >= len(keep)})

    def run(batches):
        roller, table, held, size = Roller(), shared.value, [], 0
        for batch in batches:
            for doc, sub, t in zip(batch["_id"], batch["_sub"], batch["text"], strict=True):
                for i, data in pieces(t, k):
                    prefixes, starts, n, m = stretches(data, k, gram, roller)
                    ok = has_bit(table, m)
                    if ok.any():
                        starts, n, m = starts[ok], n[ok], m[ok]
                        held.append((m, roller.spans(prefixes, starts, starts + n + k - 1), starts + i, n, (doc, sub)))
                        size += len(m)
            if size > FLUSH:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    return run


def _meet(batches):
    """Rows sorted by m, content, doc, sub, pos. Equal stretches but the first are removed; first ones whose minimizer has others of
    different content stay open. At most one row is held back."""
    first = held = before = None
    for b in batches:
        done = b["done"].to_numpy()
        out = [b.loc[done, ["doc", "sub", "pos", "n", "m"]].assign(open=False)]
        b = b[~done]
        if len(b):
            content, doc, sub, pos = (b[c].to_numpy() for c in ("content", "doc", "sub", "pos"))
            m = b["m"].to_numpy()
            new = np.append(first is None or first[:2] != (m[0], content[0]), (m[1:] != m[:-1]) | (content[1:] != content[:-1]))
            at = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            hd = np.where(at >= 0, doc[heads][at] if len(heads) else 0, first[2] if first else 0)
            hs = np.where(at >= 0, sub[heads][at] if len(heads) else 0, first[3] if first else 0)
            hp = np.where(at >= 0, pos[heads][at] if len(heads) else 0, first[4] if first else 0)
            out.append(b.loc[~new & ((doc != hd) | (sub != hs) | (pos != hp)), ["doc", "sub", "pos", "n", "m"]].assign(open=False))
            first = (m[-1], content[-1], hd[-1], hs[-1], hp[-1])
            rows = b.loc[new, ["doc", "sub", "pos", "n", "m"]]
            if len(rows):
                had = held is not None
                rows = pd.concat([held, rows], ignore_index=True) if had else rows
                g = rows["m"].to_numpy()
                keep = np.append(not had and before == g[0], g[1:] == g[:-1]) | np.append(g[:-1] == g[1:], False)
                held, before = None if keep[-1] else rows.iloc[-1:], g[-1]
                out.append(rows[keep].assign(open=True))
        yield pd.concat(out)


def _bytes(k: int):
    """The bytes of open stretches (part 0); those of a minimizer dealt out further go window by window (parts from 1 on)."""
    columns = ["m", "part", "doc", "sub", "pos", "raw"]

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for doc, sub, t, *todo in zip(*(batch[c] for c in ("_id", "_sub", "text", "pos", "n", "m", "parts")), strict=True):
                data = (t or "").encode()
                for pos, n, m, parts in zip(*(x.tolist() for x in todo), strict=True):
                    raw = data[pos : pos + n + k - 1]
                    if parts == 0:
                        rows.append((m, 0, doc, sub, pos, raw))
                    else:
                        rows += [(m, 1 + zlib.crc32(raw[i : i + k]) % parts, doc, sub, pos + i, raw[i : i + k]) for i in range(n)]
                    size += len(raw) if parts == 0 else n * k
                    if size > PASSED:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return run


def suffix_order(text: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` characters (at least), text order where these are equal. rest: characters
    up to the suffix's terminator, itself included."""
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(rest > i, padded[i : i + len(text)], np.uint64(0))
    have = 8
    while True:
        order = np.argsort(key, kind="stable")
        if have >= depth:
            return order
        ordered = key[order]
        rank = np.empty(len(text), np.uint64)
        rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        ahead = np.append(rank[have:], np.zeros(min(have, len(text)), np.uint64))
        key, have = (rank << np.uint64(32)) | np.where(rest > have, ahead[: len(text)], np.uint64(0)), 2 * have


def transform(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, Burrows-Wheeler transform and the step from each suffix to the one a character longer. Characters are bytes plus
    1 (no UTF-8 byte is 255); 0 ends a string."""
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
    ends = np.flatnonzero(text == 0)
    rest = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(len(text)) + 1
    order = suffix_order(text, rest, depth)
    bwt = text[order - 1]
    step = np.empty(len(text), np.int32)
    step[np.argsort(bwt, kind="stable")] = np.arange(len(text), dtype=np.int32)
    return order.astype(np.int32), bwt, step


def merge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The repeated intervals of all shards' suffixes (numbered shard after shard): those that agree with another one in their first
    depth characters, interleaved by these, and the block of each: suffixes of a block agree.

    A suffix that agrees with no other in d characters leaves, as those that are longer by characters before it can't agree with
    others in more than these and d.
    """
    offsets = np.cumsum([0] + [len(p[0]) for p in parts])
    bwt = np.concatenate([p[1] for p in parts])
    step = np.concatenate([p[2] + np.int32(o) for p, o in zip(parts, offsets, strict=False)])
    z, block = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    for _ in range(depth):
        before = bwt[z]
        move = np.argsort(before, kind="stable")[int(np.count_nonzero(before == 0)) :]  # 0: there is no character before
        c, b = before[move], block[move]
        new = np.append(True, (c[1:] != c[:-1]) | (b[1:] != b[:-1]))[: len(c)]
        shared = ~(new & np.append(new[1:], True)[: len(c)])
        z, block = step[z[move[shared]]], np.cumsum(new, dtype=np.int32)[shared]
    return z, block


def repeats(strings: list[bytes], docs: list[int], starts: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """doc and position of every window of k bytes in the strings that also starts earlier in one of them."""
    shards = [list(range(len(strings)))[i::SHARDS] for i in range(min(SHARDS, len(strings)))]
    parts, doc, pos = [], [], []
    for shard in shards:
        parts.append(transform([strings[i] for i in shard], k))
        lengths = np.array([len(strings[i]) + 1 for i in shard])
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = parts[-1][0]
        doc.append(np.repeat(np.array([docs[i] for i in shard], np.int32), lengths)[order])
        pos.append((np.repeat(np.array([starts[i] for i in shard]), lengths) + np.arange(lengths.sum()) - first).astype(np.int32)[order])
    z, block = merge(parts, k)
    if not len(z):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, p = np.concatenate(doc)[z], np.concatenate(pos)[z]
    gone = others(block, d, p)[1]
    return d[gone], p[gone]


def _again(first: tuple | None, b: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
    """Rows sorted by m, part, raw, doc, sub, pos: those at another coordinate than the first of their bytes, and the first of the last row's bytes. first: that
    of the rows before."""
    keys = [b[c].to_numpy() for c in ("m", "part", "raw")]
    new = np.append(first is None or first[:3] != tuple(v[0] for v in keys), np.logical_or.reduce([v[1:] != v[:-1] for v in keys]))
    heads, at, gone, last = np.flatnonzero(new), np.cumsum(new) - 1, np.zeros(len(b), bool), tuple(v[-1] for v in keys)
    for i, c in enumerate(("doc", "sub", "pos"), 3):
        v = b[c].to_numpy()
        head = np.where(at >= 0, v[heads][at] if len(heads) else 0, first[i] if first else 0)
        gone |= v != head
        last += (head[-1],)
    return b.loc[gone, ["doc", "sub", "pos"]].assign(n=np.int32(1)), last


def _merged(k: int):
    """Rows sorted by m, part, raw, doc, sub, pos: the windows that also start earlier. Stretches (part 0) are merged unit by unit."""

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        keys, row = ranked(rows[["doc", "sub"]].to_numpy())
        d, p = repeats(rows["raw"].tolist(), row.tolist(), rows["pos"].tolist(), k)
        return pd.DataFrame({"doc": keys[d, 0], "sub": keys[d, 1], "pos": p.astype(np.int32), "n": np.ones(len(d), np.int32)})

    def run(batches):
        kept: list[pd.DataFrame] = []
        size, first = 0, None
        for b in batches:
            dealt = b["part"].to_numpy() > 0
            if dealt.any():
                gone, first = _again(first, b[dealt])
                yield gone
                b = b[~dealt]
            kept.append(b)
            size += b["raw"].str.len().sum()
            if size < UNIT:
                continue
            rows = pd.concat(kept, ignore_index=True)
            new = (rows[["m", "part"]] != rows[["m", "part"]].shift()).any(axis=1).to_numpy()
            cuts = np.flatnonzero(new)
            ends = np.cumsum(rows["raw"].str.len().to_numpy())
            start = 0
            while len(cuts):  # whole groups, UNIT bytes or a little more at a time; the last group may go on
                enough = cuts[(cuts > start) & (ends[np.maximum(cuts - 1, 0)] - (ends[start - 1] if start else 0) >= UNIT)]
                if not len(enough):
                    break
                yield solved(rows.iloc[start : enough[0]])
                start = int(enough[0])
            kept = [rows.iloc[start:]]
            size = int(kept[0]["raw"].str.len().sum())
        if size:
            yield solved(pd.concat(kept, ignore_index=True))

    return run


def removals(docs: DataFrame, k: int = 100, gram: int = 40) -> DataFrame:
    """doc, sub, pos, n: n windows from byte pos on also start earlier. docs: _id, _sub, text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    repeated = docs.select("text").mapInPandas(released(_screen(k, gram)), "hash long, n int").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    table = spark.sparkContext.broadcast(bit_table(repeated))
    rows = docs.mapInPandas(released(_stretches(k, gram, table)), "m long, content long, doc long, sub long, pos int, n int, done boolean")
    met = rows.repartition("m").sortWithinPartitions("m", "content", "doc", "sub", "pos").mapInPandas(released(_meet), "doc long, sub long, pos int, n int, m long, open boolean")
    met = written(met, "stretches")
    todo = met.where("open")
    size = F.sum(F.col("n") + (k - 1))
    parts = todo.groupBy("m").agg(F.when(size <= GROUP, 0).otherwise(F.ceil(F.sum("n") * k / GROUP)).cast("int").alias("parts"))
    todo = todo.join(parts, "m").groupBy(F.col("doc").alias("_id"), F.col("sub").alias("_sub")).agg(F.collect_list(F.struct("pos", "n", "m", "parts")).alias("todo"))
    todo = todo.select("_id", "_sub", *[F.col(f"todo.{c}").alias(c) for c in ("pos", "n", "m", "parts")])  # an array a column: numbers, no objects
    raw = docs.join(todo, ["_id", "_sub"]).mapInPandas(released(_bytes(k)), "m long, part int, doc long, sub long, pos int, raw binary")
    more = raw.repartition("m", "part").sortWithinPartitions("m", "part", "raw", "doc", "sub", "pos").mapInPandas(released(_merged(k)), "doc long, sub long, pos int, n int")
    return met.where("not open").select("doc", "sub", "pos", "n").union(more)


def _cut_bytes(k: int):
    def run(text: pd.Series, pos: pd.Series, n: pd.Series, copy: pd.Series) -> pd.DataFrame:
        rows = []
        for t, starts, runs, number in zip(text, pos, n, copy, strict=True):
            data = (t or "").encode()
            if number > 1 and len(data) >= k:
                rows.append((len(data), len(data), 1, b""))
                continue
            if starts is None or not len(starts):
                rows.append((len(data), 0, 0, data))
                continue
            gone = covered(len(data), k, starts, runs)
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, k: int = 100, gram: int = 40) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    docs = row_keys(docs)
    gone = removals(docs.select("_id", "_sub", "text"), k, gram).groupBy(F.col("doc").alias("_id"), F.col("sub").alias("_sub")).agg(F.collect_list(F.struct("pos", "n")).alias("removed"))
    cut_bytes = F.pandas_udf(_cut_bytes(k), "n_bytes long, n_removed long, n_spans long, kept binary")
    out = numbered(docs).join(gone, ["_id", "_sub"], "left").withColumn("_c", cut_bytes("text", "removed.pos", "removed.n", "_copy")).drop("_id", "_sub", "_copy", "removed")
    return out.withColumns({c: F.col(f"_c.{c}") for c in ("n_bytes", "n_removed", "n_spans", "kept")}).drop("_c")
