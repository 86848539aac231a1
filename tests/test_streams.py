"""Streams in several batches: late rows, closed windows, and state that expires."""

import datetime as dt

from pyspark.sql import functions as F

from plumbline.streaming import memory, windows

DAY = dt.datetime(2024, 1, 1)


def stream(spark, path, batches, schema):
    """A file stream of one file a batch, in this order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")
        part = next((path / str(n)).glob("*.parquet"))
        part.rename(path / f"{n}.parquet")
    import os

    for n in range(len(batches)):
        os.utime(path / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(path))


def test_late_rows_are_dropped_and_windows_come_once(spark, tmp_path):
    at = lambda h: DAY + dt.timedelta(hours=h)
    batches = [[("a", at(1), 1.0), ("a", at(2), 1.0)], [("a", at(60), 1.0)], [("a", at(61), 1.0)], [("a", at(3), 5.0)], [("a", at(120), 1.0)]]
    rows = stream(spark, tmp_path, batches, "kind string, at timestamp, value double")
    out = windows.run_available(windows.windowed(rows, F.window("at", "1 day"), ["kind"], late="1 hour"), str(tmp_path / "out"), mode="append")
    got = sorted((r["w"]["start"], r["n"], r["total"]) for r in out.collect())
    assert got == [(DAY, 2, 2.0), (DAY + dt.timedelta(days=2), 2, 2.0)]  # the row of hour 3 came after its window, the last window is open


def test_memory_of_an_idle_key_goes(spark, tmp_path):
    at = lambda h: DAY + dt.timedelta(hours=h)
    batches = [[("idle", "x", at(0)), ("busy", "a", at(0)), ("busy", "b", at(0))], [("busy", "c", at(5))], [("busy", "late", at(1)), ("new", "n", at(9))], [("new", "n", at(9))], [("idle", "again", at(10)), ("dead", "old", at(1))]]
    rows = stream(spark, tmp_path, batches, "key string, content string, at timestamp")
    out = {r["key"]: (r["status"], r["content"], r["at"]) for r in memory.run_memory(rows, str(tmp_path / "out"), 6 * 3_600, late="1 hour").collect()}
    assert out == {"idle": ("active", "again", at(10)), "busy": ("active", "c", at(5)), "new": ("active", "n", at(9))}
    told = [(r["key"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out/out")).collect()]
    assert told.count(("idle", "expired")) == 1 and ("busy", "expired") not in told and not any(k == "dead" for k, _ in told)
    state = spark.read.format("statestore").option("stateVarName", "entry").load(str(tmp_path / "out/state"))
    assert {r["key"]["key"] for r in state.collect()} == {"idle", "busy", "new"}
