"""Progress events as streams: windows with a watermark, and the last value of each task."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.operators.tables import shared_folder


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; ts has no zone there, and a watermark needs one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(df: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a stream over all there is and returns what it has written. With the path of an earlier run it goes on from where that one stopped."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
