"""Line dedup, in DataFrame functions only.

Lines are exploded with their position and the hash of their key (the line stripped of ASCII white space, A-Z lower-cased).
One aggregation by hash counts the distinct documents and keeps the smallest doc_id; it combines on the map side, so a line
that a third of all documents hold sends one row from each task. Repeated keys are joined back to the lines; Spark splits a
hot key of that join at run time. What travels to the documents is only the positions to drop. They travel by doc_id and a 64-bit
hash of the text, so rows of one doc_id, or of none, keep their own lines; rows that agree in both lose the same ones.

The hash is 128 bits wide (a 64-bit hash of the key, and one that a number before the key gives another seed), so that 10^12 distinct lines don't collide.

Defined results: null or empty text is one empty line and stays; a very long text is exploded line by line, and put together again by one task; of equal
keys (ties) all lines of the smallest doc_id stay; null doc_ids count as one document, after all others; rows with
the same doc_id are one document as to counting, so a line of one never drops that of another; an empty table gives an empty table; other
columns are carried along. Lines whose key has fewer than min_chars code points always stay.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import SPACES, ascii_lower, hash_pair

LAST = (1 << 63) - 1


def _lines(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    lines = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("_id"), F.xxhash64(text).alias("_sub"), F.posexplode(split).alias("_pos", "_line"))
    lines = lines.where(F.length("_line") >= min_chars).withColumn("_key", F.trim("_line", F.lit(SPACES)))
    lines = lines.where(F.length("_key") >= min_chars).withColumn("_key", ascii_lower(F.col("_key")))
    h1, h2 = hash_pair(F.col("_key"))
    return lines.select("_id", "_sub", "_pos", h1.alias("_h1"), h2.alias("_h2"))


def repeated_lines(docs: DataFrame, text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """_h1, _h2, _first (smallest doc_id) of each key in at least min_docs documents."""
    by_key = _lines(docs, text, min_chars).groupBy("_h1", "_h2")
    if min_docs == 2:  # two distinct documents: the smallest isn't the largest
        return by_key.agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    return by_key.agg(F.min("_id").alias("_first"), F.count_distinct("_id").alias("_docs")).where(F.col("_docs") >= min_docs).drop("_docs")


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with n_lines, n_dropped and kept, the text without its dropped lines (null text: empty)."""
    found = _lines(docs, text, min_chars).join(repeated_lines(docs, text, min_chars, min_docs), ["_h1", "_h2"])
    drops = found.where("_id > _first").groupBy("_id", "_sub").agg(F.collect_set("_pos").alias("_drop"))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    out = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(LAST)), "_sub": F.xxhash64(text)}).join(drops, ["_id", "_sub"], "left")
    out = out.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: lines[i]), "\n"))
    return out.withColumn("kept", kept).drop("_id", "_sub", "_drop")
