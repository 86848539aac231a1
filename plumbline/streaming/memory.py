"""Memory of subjects as keyed state that expires: each event renews its key's entry, and a timer ends it when it is due."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key {kind}, status string, content string, at timestamp, expires timestamp"


class Memory(StatefulProcessor):
    """STM-05: one entry a key: the content of its latest event (of equal times the greatest content) and when it expires.

    An event that is older than the entry changes nothing, one whose own time to live is over by the watermark makes none. An
    entry whose time has come is removed from the state and told once."""

    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "content string, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        best = (held[1], held[0]) if held else None
        for batch in rows:
            for content, at in zip(batch["content"], batch["at"]):
                new = (int(at.timestamp() * 1_000_000), "" if content is None else content)
                best = new if best is None or new > best else best
        due = best[0] // 1000 + self.ttl
        if held and (held[1], held[0]) == best or due <= timerValues.getCurrentWatermarkInMs():
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)
        self.entry.update((best[1], best[0]))
        yield self.told(key, "active", best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            content, at = self.entry.get()
            self.entry.clear()
            yield self.told(key, "expired", (at, content))

    def told(self, key, status: str, best: tuple[int, str]) -> pd.DataFrame:
        at = pd.Timestamp(best[0], unit="us", tz="UTC").tz_localize(None)
        return pd.DataFrame({"key": [key[0]], "status": [status], "content": [best[1]], "at": [at], "expires": [at + pd.Timedelta(milliseconds=self.ttl)]})

    def close(self) -> None:
        pass


def remember(events: DataFrame, ttl_seconds: float, late: str = "1 hour") -> DataFrame:
    """key, status (active or expired), content, at and expires of each change; events has key, content and at. State is kept by
    key in RocksDB, so a hot key is one entry; entries leave it as the watermark passes their end."""
    kind = events.schema["key"].dataType.simpleString()
    kept = events.select("key", "content", "at").withWatermark("at", late).groupBy("key")
    return kept.transformWithStateInPandas(statefulProcessor=Memory(ttl_seconds), outputStructType=OUTPUT.format(kind=kind), outputMode="Update", timeMode="EventTime")


def run_memory(events: DataFrame, path: str, ttl_seconds: float, late: str = "1 hour") -> DataFrame:
    """All that is there worked off; the last change of each key. A batch that is run again overwrites its own folder."""
    spark = events.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        changes = remember(events, ttl_seconds, late)
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        changes.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    told = spark.read.schema(f"{OUTPUT.format(kind=events.schema['key'].dataType.simpleString())}, batch bigint").parquet(f"{path}/out")
    last = told.groupBy("key").agg(F.max_by(F.struct("status", "content", "at", "expires"), F.struct("batch", F.col("status") == "expired")).alias("r"))
    return last.select("key", "r.*")
