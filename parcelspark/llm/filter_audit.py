"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

The orders are the paths of a trie of permutations. It is walked depth first: a node is a DataFrame of the rows that survive the filters
on its path, persisted while its subtree is walked, and made from its parent's by one more filter. Paths of the same filters in
another order lead to the same survivors, so a node is known by the set of its filters and walked once: 2^n states stand for n! orders.
At every state one aggregation counts, by part, what each remaining filter removes from the survivors: the edges that leave it. Counts go to the
shared folder state by state, and never to the driver; rows of the result are made from them by a join with the fixed table of orders and steps.

At most n + 1 DataFrames are persisted at a time, of slim rows (part, two labels, a flag for each filter). They stem from a table in the shared
folder, so blocks of a lost executor are made again from there. A part of any size is aggregated on the map side first.

Defined results: null text is empty, null source the part of the empty string; null doc_ids come after all others, and rows with the same doc_id
don't repeat each other unless a smaller doc_id has the text as well; equal texts are found by two independent 64-bit hashes; a doc_id with
several labels is good or toxic if one of them says so, and without labels neither; very long texts are judged whole; an empty table
gives an empty table; other columns, whatever their names, are left behind.
"""

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import WORD, hash_pair, shared_path, written

LAST = (1 << 63) - 1
COUNTS = ("present", "removed", "good_lost", "toxic_lost")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """When a text fails: few words (A), few distinct ones (B), many capitals (C), signs that prose seldom has (D)."""
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and a boolean for each of A to E (true: the row fails), E being a copy of a row with a smaller doc_id."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    h1, h2 = hash_pair(F.col("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    fails = text_filters(F.col("text"), F.col("words"))
    rows = written(rows.select("_id", "part", *[x.alias(k) for k, x in fails.items()], h1.alias("_h1"), h2.alias("_h2")), "audit-flags")
    copies = rows.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(copies, ["_h1", "_h2"], "left").join(said, "_id", "left")
    no = F.lit(False)
    return rows.select("part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), *fails, F.coalesce(F.col("_id") > F.col("_first"), no).alias("E"))


def _edges(survivors: DataFrame, state: frozenset, names: str) -> DataFrame:
    """part, filter and COUNTS for each filter that isn't yet applied: what it would remove from the survivors."""
    left = [f for f in names if f not in state]
    count = lambda x: F.count_if(x)
    sums = [count(F.col(f) & extra).alias(f"{f}{k}") for f in left for k, extra in enumerate((F.lit(True), F.col("good"), F.col("toxic")))]
    out = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("present"), *sums)
    each = [F.struct(F.lit(f).alias("filter"), "present", *[F.col(f"{f}{k}").alias(c) for k, c in enumerate(COUNTS[1:])]) for f in left]
    return out.select("part", F.inline(F.array(*each)))


def walk(rows: DataFrame, names: str) -> DataFrame:
    """Counts of every edge of the trie, state by state: part, state (the filters applied before, in order of names), filter, COUNTS."""
    spark = rows.sparkSession
    path, seen = shared_path(spark, "audit-edges"), set()

    def visit(state: frozenset, survivors: DataFrame) -> None:
        seen.add(state)
        survivors.persist()
        _edges(survivors, state, names).write.parquet(f"{path}/state=_{''.join(f for f in names if f in state)}")
        for f in names:
            below = state | {f}
            if f not in state and below not in seen and len(below) < len(names):
                visit(below, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(frozenset(), rows)
    edges = spark.read.parquet(path)
    return edges.withColumn("state", F.substring("state", 2, len(names)))


def steps(names: str) -> list[tuple]:
    """filter_order, step, filter, state before it, of every order."""
    return [("".join(order), i + 1, f, "".join(g for g in names if g in order[:i])) for order in permutations(names) for i, f in enumerate(order)]


def audit(rows: DataFrame, names: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts of each step; rows: part, good, toxic and a boolean column for each filter (one letter, at most six)."""
    spark, n = rows.sparkSession, len(names)
    if not 1 <= n <= 6:
        raise ValueError("one to six filters: every order is listed")
    rows = written(rows.select("part", "good", "toxic", *names), "audit-rows")
    edges = walk(rows, names)

    failed = sum((F.col(f).cast("int") for f in names), F.lit(0))
    sums = [x for f in names for x in (F.count_if(F.col(f)).alias(f"{f}_fails"), F.count_if(F.col(f) & (failed == 1)).alias(f"{f}_only"))]
    each = [F.struct(F.lit(f).alias("filter"), F.col(f"{f}_fails").alias("fails"), F.col(f"{f}_only").alias("unique_fails")) for f in names]
    totals = rows.groupBy("part").agg(*sums).select("part", F.inline(F.array(*each)))
    before = F.length("state")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), before + 1)
    value = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    totals = totals.join(value, ["part", "filter"], "left")

    # a part of which nothing survives has no edge there: its zeros come from the fixed table of steps
    order = spark.createDataFrame(steps(names), "filter_order string, step int, filter string, state string")
    out = totals.join(F.broadcast(order), "filter").join(edges, ["part", "state", "filter"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long")
    return out.select(
        "part", "filter_order", "step", (zero("present") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (zero("fails") - zero("removed")).alias("redundant"),
        zero("unique_fails").alias("unique_fails"), zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), zero("shapley").alias("shapley"),
    )
