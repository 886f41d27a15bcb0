"""Helpers that several operators share."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="parcelspark-"))
    return spark.sparkContext.getCheckpointDir()


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """From now on tasks get rows in Arrow batches of at most so many bytes: what a batch needs counts several times over, in the JVM and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """What this process's allocators hold of memory that was let go goes back to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def released(run):
    """run, a function over batches, that gives memory back when it ends: a worker waits for its next task with what its allocators still hold, and counts with it."""

    def out(batches):
        yield from run(batches)
        give_back()

    return out


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: a lost executor then costs a re-read, not a re-run."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z only. lower() is the fast way where the text is ASCII, and would touch other letters where it isn't."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hash_pair(value: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes. The number goes first: after the value it would only be hashed with the value's hash as its seed."""
    return F.xxhash64(value), F.xxhash64(F.lit(7), value)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(df: DataFrame, col: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(col).cast("long")), F.lit(0))).first()[0]


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """So many partitions that each holds about `each` bytes, and no fewer than the session's cores."""
    return max(1, min(spark.sparkContext.defaultParallelism, 1 + size // 65536), -(-size // each))


def written(df: DataFrame, name: str) -> DataFrame:
    """The same as cut, for tables large enough that columns and compression pay."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
