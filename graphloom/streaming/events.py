"""Event streams over a folder of Parquet files, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import shared_dir

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is available into a table in the shared folder, and reads its last state."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/state" if mode == "complete" else f"{place}/state/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/state")


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days with a watermark."""
    rows = stream(spark, sf_dir).withWatermark("ts", "1 day")
    agg = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    out = finished(agg, "complete")
    return out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("value", 4).alias("value"))


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful dedupe of (user, type)."""
    return finished(stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append").select("user_id", "event_type")
