"""A corpus pipeline: each stage works on all that the stage before kept, written and read again in between."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm import decontaminate, jaccard_join, language_id, mixing, token_records
from parcelspark.llm.common import bounded_batches, give_back, shared_path, table
from parcelspark.llm.queries import TOKENIZER

#: A document stays if its language is known with at least this probability.
LEAST_SCORE = 0.5
#: Bytes of a file of records' text, of what an encoder keeps, and of an Arrow batch of texts: small, as the stages before have filled the executors' heaps.
SHARD_BYTES, KEPT, BATCH = 12 << 20, 32 << 20, 2 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language stays in doubt. Learns from the labelled documents."""
    bounded_batches(spark)
    give_back()
    out = language_id.predict(docs, language_id.train(docs))
    return out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more, smallest doc_id."""
    bounded_batches(spark)
    give_back()
    return jaccard_join.drop_near_copies(docs, n=5, pct=80, deal="rare").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all of a shorter one."""
    bounded_batches(spark)
    give_back()
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    bounded_batches(spark)
    give_back()
    return mixing.mix(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token records, a copy of a document being a record of its own, and returns their index."""
    bounded_batches(spark, BATCH)
    give_back()
    index = token_records.write_records(docs, shared_path(spark, "pipeline-records"), TOKENIZER, shard_bytes=SHARD_BYTES, kept=KEPT)
    return token_records.offsets(index).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_output", token_output),
]

#: SQL can't express the language model, the tokenizer or similarity groups at this size; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
