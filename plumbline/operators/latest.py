"""Latest row of a group, first occurrence, next marker and supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """WIN-01..05, WIN-07: per key, the row with the greatest rank tuple. An aggregate combined before the shuffle, so a hot
    key sends one row from each task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rank)).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in rest])


def first_by(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """WIN-11: per key, the row that came first."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("__best"))
    return kept.select(*keys, *[F.col("__best")[c].alias(c) for c in rest])


def supersede(versions: DataFrame, source: str, order: str, approved: Column, key: str) -> DataFrame:
    """WIN-06: versions before a source's newest approved one point at it."""
    newest = versions.where(approved).groupBy(source).agg(F.max_by(key, order).alias("superseded_by"), F.max(order).alias("__newest"))
    joined = versions.join(newest, source, "left")
    return joined.withColumn("superseded_by", F.when(F.col(order) < F.col("__newest"), F.col("superseded_by"))).drop("__newest")


def marker_spans(df: DataFrame, text: str, marker: str) -> DataFrame:
    """WIN-10, DOM-12: spans of a text that begin at each match of `marker`; inside arrays, so no row is shuffled."""
    found, between = F.regexp_extract_all(text, F.lit(marker), F.lit(0)), F.split(text, marker)
    bodies = F.transform(found, lambda m, i: F.struct((i + 1).cast("bigint").alias("ordinal"), F.concat(m, F.get(between, i + 1)).alias("span")))
    return df.withColumn("__s", F.explode(bodies)).select("*", "__s.ordinal", "__s.span").drop("__s")


def rows_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """SRT-03, WIN-08: the first n rows of each key with their rank; Spark cuts each task's rows before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= n).withColumn(name, F.col(name).cast("bigint"))
