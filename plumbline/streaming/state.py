"""Polling a table as a stream: what is there is taken in batches, each written once under its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .windows import events_stream


def poll(spark: SparkSession, sf_dir: str, name: str, condition: str, path: str) -> DataFrame:
    """STM-01, STM-07: rows of the table that meet a condition. A batch that is run again overwrites its own folder."""
    stream = events_stream(spark, sf_dir, name).where(condition)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
