"""Cutting a plan at a table in the folder that all executors share."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where it names none, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="parcelspark-"))
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a folder or file of any store that Spark can write to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sent(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and sent to tasks, never gathered at the driver and broadcast. For tables of a row for each pixel: Spark guesses their size from
    that of the files they came from, whatever rows were made of these, and would broadcast them up to very many."""
    return df.hint("merge")


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """From now on tasks get rows in Arrow batches of at most so many bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
