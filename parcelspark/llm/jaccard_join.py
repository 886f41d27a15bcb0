"""N-gram Jaccard join with prefix trees.

A document's set is its distinct n-word shingles as 64-bit hashes, in the global order of these. Documents of equal sets are one node
from the start, so copies never meet each other as pairs.

1. Dealing. Two sets that are similar enough differ in at most k shingles, where k follows from the larger size. Shingles are dealt
   into k + 1 parts and some spare ones by a hash, so similar sets agree in more whole parts than there are spare ones. Each set
   posts a hash of each of its parts, by size class; parts of few shingles are left out unless a set has more of these than
   spare ones. So sets only meet over several equal shingles that stand alone in both, which a shared passage or chance seldom brings
   about however large the corpus grows, and no frequencies have to be known.
   With deal="rare" sets post their rarest shingles instead, as many as must include a common one. That is better where most
   documents are made of passages that many share; rarity is a count over all documents in a table of fixed size (cells of the
   hash), so it tells less in a larger corpus. Lists whose members are not connected after step 2 are then joined across components.
2. The smallest node of a list leads it, and the others are its candidates. Candidates of a leader form groups of bounded
   size (in shingles). In a group, sets are stored in a prefix tree. Each set meets those it shares one of its rarest shingles of the
   group with and isn't connected to yet: on the way down to them, the overlap with common paths is worked out once, and a
   subtree is left when the longest rest can't reach the needed overlap.
3. Where the candidates of a leader are more than one group and not yet connected, groups meet two by two in the same way, those that
   are of one component left out.

The result is exact up to collisions of 64-bit hashes. What is broadcast has a fixed size: a table of bits that spares most
documents without candidates a second reading (a false bit costs time only).

Defined results: null text and text without words have an empty set (n_shingles 0) and stand alone; fewer words than n are
one shingle; null doc_ids come after all others and have component null if no other is reached; rows with the same doc_id are
one document if their sets link them, and get the same component; a very long text is one set, in some 100 bytes of memory a word;
an empty table gives an empty table; other columns, whatever their names, are left behind by link_documents and carried along by drop_near_copies. drop_near_copies decides row by row: of each component the
row of the smallest doc_id (then hash of the text) stays, of rows that agree in both one.
"""

import hashlib
from bisect import bisect_right
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, written
from parcelspark.llm.components import components
from parcelspark.llm.rolling import Roller, mixed, word_windows
from parcelspark.llm.substring_dedup import bit_table, has_bit

LAST = (1 << 63) - 1
TABLE_BITS = 24
CELL_BITS = 18
#: Shingles of a group.
GROUP = 1 << 19
#: Sets whose signatures a task remembers, to send those of equal sets once.
REMEMBER = 1 << 17


def set_of(text: str | None, n: int, roller: Roller) -> np.ndarray:
    return np.unique(word_windows(text, n, roller, lower=True, whole=True)[0])


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def size_classes(pct: int, most: int = 1 << 40) -> list[int]:
    """Least sizes of the classes: the sizes that a set may be linked with lie in its class and one neighbour."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 10000 // (pct * pct) + 1)
    return out


def parts_of(most: int, pct: int) -> tuple[int, int, int]:
    """For sets of up to so many shingles: number of parts, how many of them are spare, and the size up to which a part is thin, so that
    few sets have more thin parts than spare ones. No parts where only equal sets are linked."""
    differ = 2 * (100 - pct) * most // (100 + pct)
    if not differ:
        return 0, 0, 0
    spare = 1 + differ * (100 - pct) // 40
    parts = differ + 1 + spare
    mean = 0.85 * most / parts
    thin, share = 0, exp(-mean)
    chance = share
    while thin < 3:
        chance *= mean / (thin + 1)
        if share + chance > 0.9 * spare / parts:
            break
        thin, share = thin + 1, share + chance
    return parts, spare, thin


def signatures(shingles: np.ndarray, pct: int, classes: list[int]) -> np.ndarray:
    """One hash for each part of the set, in its size class and, where a linked set may be in it, the next."""
    size, out = len(shingles), []
    own = bisect_right(classes, size) - 1
    for c in (own, own + 1):
        parts, spare, thin = parts_of(classes[c + 1] - 1, pct)
        if not parts or 100 * size < pct * classes[c]:
            continue
        h = mixed(shingles ^ mixed(np.array([c + 1], np.uint64)))
        part = (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        low = np.bincount(part, weights=(h & np.uint64(0xFFFFFFFF)).astype(float), minlength=parts).astype(np.uint64)
        high = np.bincount(part, weights=(h >> np.uint64(32)).astype(float), minlength=parts).astype(np.uint64)
        of = mixed(((high << np.uint64(32)) + low) ^ mixed(np.arange(parts, dtype=np.uint64) + np.uint64(c << 32)))
        full = np.bincount(part, minlength=parts) > thin
        # linked sets agree in spare + 1 parts or more; all of these are thin only if both have more thin parts than spare ones
        out.append(of[full] if parts - int(full.sum()) <= spare else of)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def cell_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefix_length(size: int, pct: int) -> int:
    return size - -(-pct * size // 100) + 1


def _nodes(n: int):
    def run(batches):
        roller = Roller()
        for batch in batches:
            sets = [set_of(t, n, roller) for t in batch["text"]]
            yield pd.DataFrame({"_id": batch["_id"], "_sub": batch["_sub"], "n_shingles": [len(s) for s in sets], "node": pd.array([node_of(s) if len(s) else None for s in sets], "Int64")})

    return run


def _cells(n: int):
    """How many documents of a task have a shingle in each cell."""

    def run(batches):
        roller, cells = Roller(), np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            cells += np.bincount(cell_of(np.concatenate([set_of(t, n, roller) for t in batch["text"]])), minlength=len(cells))
        at = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": at, "docs": cells[at]})

    return run


def _prefixes(n: int, pct: int, shared):
    """shingle, node, size, place of each prefix posting; equal sets of one task send theirs once."""

    def run(batches):
        roller, cells, seen = Roller(), shared.value, set()
        for batch in batches:
            out = []
            for t in batch["text"]:
                s = set_of(t, n, roller)
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                p = prefix_length(len(s), pct)
                s = s[np.lexsort((s, cells[cell_of(s)]))[:p]]
                out.append((s.view(np.int64), np.full(p, node), np.arange(p, dtype=np.int32)))
            if out:
                yield pd.DataFrame(dict(zip(("shingle", "node", "place"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _rare_lists(batches):
    """Rows sorted by shingle and node: lists of two nodes or more, each node once, with the smallest node as leader."""
    last = None  # shingle, leader, its place, whether the leader's row is still held back, the latest node
    for b in batches:
        shingle, node, place = (b[c].to_numpy() for c in ("shingle", "node", "place"))
        if not len(b):
            continue
        new = np.append(last is None or last[0] != shingle[0], shingle[1:] != shingle[:-1])
        again = ~new & (node == np.append(node[0] - 1 if last is None else last[4], node[:-1]))
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1  # -1: goes on from the batch before
        leader = np.where(group >= 0, node[starts][group] if len(starts) else 0, last[1] if last else 0)
        keep = ~new & ~again
        led = np.unique(group[keep])
        heads = starts[led[led >= 0]]
        at = np.concatenate([heads, np.flatnonzero(keep)])
        out = [(shingle[at], node[at], place[at], leader[at])]
        held = last is not None and last[3]
        if held and len(led) and led[0] < 0:
            out.append(tuple(np.array([x]) for x in (last[0], last[1], last[2], last[1])))
            held = False
        if len(starts):
            h = starts[-1]
            last = (shingle[h], node[h], place[h], not (len(led) and led[-1] == group[-1]), node[-1])
        else:
            last = (*last[:3], held, node[-1])
        yield pd.DataFrame({c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("shingle", "node", "place", "leader"))})


def _signatures(n: int, pct: int):
    """signature and node of each posting; equal sets of one task send theirs once."""

    def run(batches):
        roller, classes, seen = Roller(), size_classes(pct), set()
        for batch in batches:
            out = []
            for t in batch["text"]:
                s = set_of(t, n, roller)
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                found = signatures(s, pct, classes)
                out.append((found.view(np.int64), np.full(len(found), node)))
            if out:
                yield pd.DataFrame(dict(zip(("signature", "node"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
            if len(seen) > REMEMBER:
                seen.clear()

    return run


def _lists(batches):
    """Rows sorted by signature and node: each node of a list but its first, the leader."""
    last = None  # signature, leader, latest node
    for b in batches:
        if not len(b):
            continue
        signature, node = b["signature"].to_numpy(), b["node"].to_numpy()
        new = np.append(last is None or last[0] != signature[0], signature[1:] != signature[:-1])
        again = ~new & (node == np.append(last[2] if last else 0, node[:-1]))
        group = np.cumsum(new) - 1  # -1: goes on from the batch before
        heads = node[np.flatnonzero(new)]
        leader = np.where(group >= 0, heads[group] if len(heads) else 0, last[1] if last else 0)
        last = signature[-1], leader[-1], node[-1]
        keep = ~new & ~again
        yield pd.DataFrame({"leader": leader[keep], "node": node[keep]}).drop_duplicates()


def _flagged(shared):
    """The documents whose bit is set; equal rows of a task once, as far as it remembers them."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            batch = batch[has_bit(shared.value, batch["hash"].to_numpy().view(np.uint64))].drop_duplicates(["_id", "_sub"])
            keys = list(zip(batch["_id"].tolist(), batch["_sub"].tolist(), strict=True))
            yield batch.loc[[k not in seen for k in keys], ["_id", "_sub", "text"]]
            if len(seen) > REMEMBER:
                seen.clear()
            seen.update(keys)

    return run


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text of the wanted nodes (node, _id, _sub) from docs (_id, text): documents are found by their own number and the hash of
    their text, so rows without a doc_id don't all meet each other; equal rows come once a task."""
    key = F.xxhash64("_id", "_sub").alias("hash")
    table = wanted.sparkSession.sparkContext.broadcast(bit_table(wanted.select(key), TABLE_BITS))
    texts = docs.withColumn("_sub", F.xxhash64("text")).select(key, "_id", "_sub", "text").mapInPandas(_flagged(table), "_id long, _sub long, text string")
    return wanted.select("node", "_id", "_sub").join(texts, ["_id", "_sub"]).select("node", "text")


class Tree:
    """A prefix tree over ascending arrays; a node holds the run of values that all sets below it share.

    Nodes are numbers: parent, depth (values from the root to its end), a set below it, and the smallest and largest set below it.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.parent, self.depth, self.of = [-1], [0], [order[0]]
        self.leaf = [0] * len(sets)
        path, before = [0], None
        for i in order:
            mine = sets[i]
            if before is None:
                same = 0
            else:
                k = min(len(mine), len(before))
                differ = np.flatnonzero(mine[:k] != before[:k])
                same = int(differ[0]) if len(differ) else k
            last = -1
            while self.depth[path[-1]] > same:
                last = path.pop()
            if self.depth[path[-1]] < same:  # the path forks within the last node's run
                self.parent[last] = len(self.parent)
                path.append(self._add(path[-1], same, i))
            if len(mine) > same:
                path.append(self._add(path[-1], len(mine), i))
            self.leaf[i] = path[-1]
            before = mine
        self.least, self.most = [1 << 60] * len(self.parent), [0] * len(self.parent)
        for i, at in enumerate(self.leaf):
            n = len(sets[i])
            while at >= 0 and (n < self.least[at] or n > self.most[at]):
                self.least[at], self.most[at] = min(n, self.least[at]), max(n, self.most[at])
                at = self.parent[at]

    def _add(self, parent: int, depth: int, of: int) -> int:
        self.parent.append(parent)
        self.depth.append(depth)
        self.of.append(of)
        return len(self.parent) - 1


def rare_lists(at: np.ndarray, sizes: np.ndarray, frequency: np.ndarray, pct: int) -> tuple[np.ndarray, ...]:
    """The sets of each value among the prefixes of rarest values, one list after another, and for each set the bounds of the lists of
    its own prefix. Sets similar enough share a value of their prefixes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((at, frequency[at], owner))
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - (pct * sizes + 99) // 100 + 1
    ok = (place < np.repeat(prefix, sizes)) & (frequency[at[order]] > 1)
    value, owner = at[order][ok], owner[ok]
    by_value = np.argsort(value, kind="stable")
    ordered = value[by_value]
    return owner[by_value], np.searchsorted(ordered, value), np.searchsorted(ordered, value, "right"), np.searchsorted(owner, np.arange(len(sizes) + 1))


def tree_links(sets: list[np.ndarray], pct: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links of similarity >= pct / 100 that connect what all such links connect. sets: ascending distinct integers, which is the
    global order. known: numbers of the components that sets are in already."""
    values, at, frequency = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets])
    ranked = np.split(at, np.cumsum(sizes)[:-1])
    tree, links = Tree(ranked), []
    members, starts, ends, own = rare_lists(at, sizes, frequency, pct)
    group = np.arange(len(sets)) if known is None else np.unique(np.array(known, np.int64), return_inverse=True)[1]
    has, met = np.zeros(len(values), bool), np.zeros(len(sets), bool)
    for x in range(1, len(sets)):
        for i in range(own[x], own[x + 1]):
            met[members[starts[i] : ends[i]]] = True
        others = np.flatnonzero(met[:x] & (group[:x] != group[x]) & (100 * sizes[:x] >= pct * sizes[x]) & (pct * sizes[:x] <= 100 * sizes[x]))
        met[:] = False
        if not len(others):
            continue
        mine, n = ranked[x], len(ranked[x])
        has[mine] = True
        shared: dict[int, int] = {0: 0}  # of each node seen; -1: no set below it can be linked
        for y in others.tolist():
            if group[y] == group[x]:
                continue
            way, node = [], tree.leaf[y]
            while node not in shared:
                way.append(node)
                node = tree.parent[node]
            for below in reversed(way):
                so_far = shared[node]
                if so_far >= 0:
                    run = ranked[tree.of[below]][tree.depth[node] : tree.depth[below]]
                    so_far += int(has[run].sum())
                    rest = n - int(np.searchsorted(mine, run[-1], "right"))
                    can = so_far + min(rest, tree.most[below] - tree.depth[below])
                    if (100 + pct) * can < pct * (n + tree.least[below]):
                        so_far = -1
                shared[below] = so_far
                node = below
            if (100 + pct) * shared[node] >= pct * (n + len(ranked[y])):
                links.append((x, y))
                group[group == group[y]] = group[x]
        has[mine] = False
    return links


def _groups(n: int, pct: int):
    """Rows come sorted by group; a group may go over from one batch to the next. Texts travel instead of sets: they pack better."""
    roller = Roller()

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.groupby("group", sort=False):
            sets = [set_of(t, n, roller) for t in g["text"]]
            of = [(x, s, c) for x, s, c in zip(g["node"].tolist(), sets, g["component"].tolist(), strict=True) if len(s) and node_of(s) == x]  # not another row of the doc_id
            if len(of) > 1:
                out += [(of[a][0], of[b][0]) for a, b in tree_links([s for _, s, _ in of], pct, [c for *_, c in of])]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    def run(batches):
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            group = batch["group"].to_numpy()
            if kept and group[-1] == kept[0]["group"].iloc[0]:
                kept.append(batch)
                continue
            last = group == group[-1]
            yield linked(pd.concat([*kept, batch[~last]]))
            kept = [batch[last]]
        if kept:
            yield linked(pd.concat(kept))

    return run


def first_groups(pairs: DataFrame) -> DataFrame:
    """leader, group, node, component: the candidates of each leader in groups of about GROUP, the leader in all of them."""
    sized = pairs.groupBy("leader").agg(F.ceil(F.sum("size") / GROUP).alias("_blocks"))
    dealt = pairs.join(sized, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("_blocks")).alias("block"), "node")
    dealt = dealt.union(dealt.select("leader", "block", F.col("leader").alias("node")).distinct())
    return dealt.select("leader", F.xxhash64("leader", "block").alias("group"), "node", F.col("node").alias("component"))


def open_groups(pairs: DataFrame, so_far: DataFrame) -> DataFrame:
    """leader, group, node, component for leaders whose candidates were several groups and are of several components.

    Large components are cut into chunks of their own, the small ones of a leader share chunks; each two chunks of a leader meet, unless they
    are of one and the same component.
    """
    large = pairs.groupBy("leader").agg(F.sum("size").alias("_n"), F.max("size").alias("size")).where(F.col("_n") > GROUP)
    rows = pairs.join(large.select("leader"), "leader")
    rows = rows.unionByName(large.select("leader", F.col("leader").alias("node"), "size")).join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy("leader", "component").agg(F.sum("size").alias("_n"))
    small = F.col("_n") <= GROUP
    sums = parts.groupBy("leader").agg(F.count(F.lit(1)).alias("_parts"), F.sum(F.when(small, F.col("_n")).otherwise(0)).alias("_small")).where("_parts > 1")
    parts = parts.join(sums, "leader").select("leader", "component", F.when(~small, F.ceil(F.col("_n") / GROUP)).alias("_own"), F.ceil(F.col("_small") / GROUP).alias("_shared"))
    chunk = F.when(F.col("_own").isNotNull(), F.xxhash64("component", F.pmod(F.xxhash64("node"), F.col("_own")))).otherwise(F.pmod(F.xxhash64("component"), F.col("_shared")))
    rows = cut(rows.join(parts, ["leader", "component"]).select("leader", "node", "component", chunk.alias("chunk"), F.when(F.col("_own").isNotNull(), F.col("component")).alias("whole")))
    chunks = rows.select("leader", "chunk", "whole").distinct()
    met = chunks.join(chunks.toDF("leader", "other", "_whole"), "leader").where("chunk <= other and coalesce(whole <> _whole, true)")
    met = met.select("leader", "chunk", "other", F.xxhash64("leader", "chunk", "other").alias("group"))
    both = met.select("leader", "chunk", "group").union(met.where("chunk <> other").select("leader", "other", "group"))
    return rows.join(both, ["leader", "chunk"]).select("leader", "group", "node", "component")


def link_nodes(docs: DataFrame, n: int = 5, pct: int = 80, deal: str = "parts") -> tuple[DataFrame, DataFrame, DataFrame]:
    """_id, _sub (hash of the text), n_shingles and node of each row; node and smallest _id of each set; u, v of linked nodes."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), "text")
    nodes = written(slim.withColumn("_sub", F.xxhash64("text")).mapInPandas(_nodes(n), "_id long, _sub long, n_shingles long, node long"), "nodes")
    reps = nodes.where("node is not null").groupBy("node").agg(F.min(F.struct("_id", "_sub")).alias("r"), F.first("n_shingles").alias("size"))
    reps = reps.select("node", F.col("r._id").alias("rep"), F.col("r._sub").alias("sub"), "size")

    sizes = reps.select("node", "size")
    near = F.expr(f"100 * least(size, lsize) >= {pct} * greatest(size, lsize)")
    if deal == "rare":
        rows = slim.select("text").mapInPandas(_cells(n), "cell int, docs long").groupBy("cell").agg(F.sum("docs").alias("docs")).toPandas()
        cells = np.zeros(1 << CELL_BITS, np.int64)
        cells[rows["cell"]] = rows["docs"]
        postings = slim.select("text").mapInPandas(_prefixes(n, pct, spark.sparkContext.broadcast(cells)), "shingle long, node long, place int")
        postings = postings.repartition("shingle").sortWithinPartitions("shingle", "node")
        postings = cut(postings.mapInPandas(_rare_lists, "shingle long, node long, place int, leader long"))
        pairs = postings.where("node <> leader").select("leader", "node").distinct()
        pairs = cut(pairs.join(sizes, "node").join(sizes.toDF("leader", "lsize"), "leader").where(near).select("leader", "node", "size"))
    else:
        posted = slim.select("text").mapInPandas(_signatures(n, pct), "signature long, node long")
        posted = posted.repartition("signature").sortWithinPartitions("signature", "node")
        pairs = posted.mapInPandas(_lists, "leader long, node long").distinct()
        pairs = cut(pairs.join(sizes, "node").select("leader", "node", "size"))

    def check(groups: DataFrame) -> DataFrame:
        """u, v of the linked nodes of each group."""
        wanted = cut(groups.select("node").distinct().join(reps.select("node", F.col("rep").alias("_id"), F.col("sub").alias("_sub")), "node"))
        texts = texts_of(wanted, slim)
        rows = groups.join(texts, "node").select("group", "node", "component", "text").repartition("group").sortWithinPartitions("group")
        return cut(rows.mapInPandas(_groups(n, pct), "u long, v long"))

    found = check(first_groups(pairs))
    so_far = components(found)
    if deal != "rare":
        more = cut(open_groups(pairs, so_far))
        return nodes, reps, found if more.isEmpty() else found.union(check(more))
    # lists whose members are not yet connected: pairs across components that the places in the prefixes allow
    open_ = postings.join(so_far, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sizes, "node")
    mixed_lists = open_.groupBy("shingle").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("_n")).where("_a < _b and _n > 2").select("shingle")
    open_ = cut(open_.join(mixed_lists, "shingle").select("shingle", "node", "component", "size", "place"))
    most = F.expr(f"(100 + {pct}) * (1 + least(size - place, lsize - lplace) - 1) >= {pct} * (size + lsize)")
    across = open_.join(open_.toDF("shingle", "leader", "lcomponent", "lsize", "lplace"), "shingle").where("leader < node and component <> lcomponent")
    across = across.where(near).where(most).select("leader", "node", "size").distinct()
    return nodes, reps, found.union(check(first_groups(cut(across.join(pairs, ["leader", "node"], "left_anti")))))


def link_components(docs: DataFrame, **how) -> DataFrame:
    """_id, n_shingles and component_id of each row: rows link at a Jaccard similarity of pct / 100 of their n-word shingles."""
    nodes, reps, links = link_nodes(docs, **how)
    names = reps.select("node", "rep")
    links = links.join(names.toDF("u", "ru"), "u").join(names.toDF("v", "rv"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    final = reps.join(components(links).toDF("rep", "component"), "rep", "left")
    final = final.select("node", F.coalesce("component", "rep").alias("component"))
    out = nodes.join(final, "node", "left").withColumn("component", F.coalesce("component", "_id"))
    return out.select("_id", "n_shingles", F.nullif("component", F.lit(LAST)).alias("component_id"))


def link_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    return link_components(docs, **how).withColumn("doc_id", F.nullif("_id", F.lit(LAST))).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each component, the one of the smallest doc_id, and all rows that have no words."""
    nodes, _, links = link_nodes(docs.select("doc_id", "text"), **how)
    nodes = nodes.where("node is not null").select("_id", "_sub", "node")
    rows = nodes.join(components(links), "node", "left").select("_id", "_sub", F.coalesce("component", "node").alias("component"))
    rows = cut(rows.groupBy("component", "_id", "_sub").agg(F.count(F.lit(1)).alias("_n")))
    first = rows.groupBy("component").agg(F.min(F.struct("_id", "_sub")).alias("_first"))
    rows = rows.join(first, "component").withColumn("_stays", F.struct("_id", "_sub") == F.col("_first"))
    keys = {"_id": F.coalesce("doc_id", F.lit(LAST)), "_sub": F.xxhash64("text")}
    kept = docs.select(*[v.alias(k) for k, v in keys.items()], F.struct("*").alias("_row"))
    kept = kept.join(rows.where("not _stays").select("_id", "_sub"), ["_id", "_sub"], "left_anti")
    copies = rows.where("_stays and _n > 1").select("_id", "_sub", "_n")
    if copies.isEmpty():
        return kept.select("_row.*")
    place = F.row_number().over(Window.partitionBy("_id", "_sub").orderBy("_sub"))
    kept = kept.join(copies, ["_id", "_sub"], "left").withColumn("_place", place)
    return kept.where("_n is null or _place = 1").select("_row.*")
