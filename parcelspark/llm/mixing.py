"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / size of the source. Within a source the
documents stand in one fixed order; the running sum of expected copies, moved by one random offset, is cut at the integers,
and a document is emitted once for each integer that falls into its share. The order puts documents of like size side by
side, so a source's words come near its target however uneven its documents are.

The running sum is distributed: a source is split into segments (size class, bucket of doc_id), only the segments' counts
are summed up over a source, and rows are numbered within their segment. There is a bucket for every 2^16 rows of the table (at
least 32), so a segment stays small however large the table, and a source that holds a third of all rows is dealt over all buckets.

Defined results: a null text has size 0, a very long one is counted like any other; a null source is a source of its own, the last;
a null doc_id sorts first, its bucket comes from a hash of the text; rows with the same doc_id are separate documents, in the order of
size, then of a hash of the text (rows that agree in all of these are interchangeable), so reruns agree; an empty table gives an empty table.
Other columns are carried along, except that the columns this operator adds replace any of the same name.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SEED = 12345
BUCKETS, BUCKET_ROWS = 32, 1 << 16


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """sizes: one row a source (_none, _key, source_size). Adds target, the share of each document and the source's offset.

    With sources ordered by most * size / weight, the capped ones come first; the others share what is left by weight. The
    first source that isn't above its cap at that rate gives the rate for all after it.
    """
    order = Window.orderBy("_none", "_key")
    by_ratio = Window.orderBy("_ratio", "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.array(*[F.lit(float(x)) for x in weights])
    df = sizes.withColumn("_rank", F.row_number().over(order))
    df = df.withColumn("_w", F.element_at(w, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    df = df.withColumn("_rate", left / weight)
    rate = F.min(F.when(F.col("_rate") <= F.col("_ratio"), F.struct("_ratio", "_rank", "_rate"))).over(whole)["_rate"]
    df = df.withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_w") * rate), F.col("_cap")))
    df = df.withColumn("_share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    return df.withColumn("_offset", ((F.col("_rank").cast("long") * 1103515245 + F.lit(seed)) % 1000003) / F.lit(1000003.0))


def _keys(docs: DataFrame, size: Column, source: str, tie: Column, buckets: int) -> DataFrame:
    docs = docs.withColumns({"size": size, "_tie": tie})
    octave = F.length(F.bin("size")) - 1
    return docs.withColumns({
        "_none": F.col(source).isNull(),
        "_key": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "_class": octave * 4 + F.call_function("shiftright", F.col("size") * 4, octave) % 4,
        "_bucket": F.coalesce(F.pmod(F.col("doc_id"), F.lit(buckets)), F.pmod(F.col("_tie"), F.lit(buckets))),
    })


def plan(docs: DataFrame, size: Column | None = None, source: str = "source", tie: Column | None = None, **how) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the row). tie: what tells rows of one doc_id and size
    apart, a long; by default a hash of the text."""
    buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    keyed = _keys(docs, word_count(F.col("text")) if size is None else size, source, F.xxhash64("text") if tie is None else tie, buckets)
    segment = ["_none", "_key", "_class", "_bucket"]
    counts = cut(keyed.groupBy(*segment).agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_words")))
    per_source = targets(counts.groupBy("_none", "_key").agg(F.sum("_words").alias("source_size")), **how)
    earlier = Window.partitionBy("_none", "_key").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    starts = starts.join(per_source, ["_none", "_key"]).select(*segment, "_start", "source_size", "target", "_share", "_offset")
    rows = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*segment).orderBy("size", "doc_id", "_tie")))
    rows = rows.join(starts, segment)
    upto = lambda n: F.floor((F.col("_start") + n) * F.col("_share") + F.col("_offset"))
    rows = rows.withColumn("copies", (upto(F.col("_n")) - upto(F.col("_n") - 1)).cast("long"))
    return rows.drop(*segment, "_tie", "_n", "_start", "_share", "_offset")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as the plan takes it, with the columns of docs."""
    taken = plan(docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source"), **how).where("copies > 0")
    taken = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.select("_row.*")
