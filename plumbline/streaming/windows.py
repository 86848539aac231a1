"""Event-time windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a file stream, with an instant for watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, window: Column, keys: list[str], late: str = "1 day") -> DataFrame:
    """STM-06: events and their value per window and key; state older than the watermark goes."""
    kept = events.withWatermark("at", late).groupBy(window.alias("w"), *keys)
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def run_available(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Process what is there (availableNow) and return the result table. Mode complete keeps every window and rewrites the table;
    mode append gives each window once, when the watermark has passed its end, drops its state and later rows of it. A batch that
    is run again overwrites its own folder."""
    append = mode == "append"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}" if append else f"{path}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)
