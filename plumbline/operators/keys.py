"""Clusters of rule keys: by normal form, under a representative, split where they merge anchors, absorbed by established keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rule_key
from .graph import variant_of

CANONICAL_CHARS = 160

# Words of targets that are no rules.
NO_RULES = [
    "none", "penalty", "fine", "interest_rate", "development_area_number", "clause_number", "table_number", "figure_number", "density_code",
    "density_recode", "residential_density", "fee", "quorum", "other_facility_requirement", "vote", "levy",
]


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ids `key-00001` on in the order of a distinct column: places within the rows of equal first characters, after the counts of
    the earlier ones, so no task gets all rows."""
    begun = df.withColumn("__p", F.substring(column, 1, 4))
    counts = begun.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a beginning
    place = F.row_number().over(Window.partitionBy("__p").orderBy(column)) + F.col("__before")
    return begun.join(before, "__p").withColumn(name, F.format_string("key-%05d", place)).drop("__p", "__before")


def with_norms(rows: DataFrame) -> DataFrame:
    """rule_key, n (candidates) and norm of rows (rule_key, candidate_count); repeated keys are added up."""
    each = rows.groupBy("rule_key").agg(F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("n"))
    return each.withColumn("norm", rule_key(F.col("rule_key")))


def cluster_keys(rows: DataFrame) -> DataFrame:
    """DOM-13: cluster_id, norm, canonical, rule_keys and total: keys of one normal form; keys without one are left out."""
    kept = with_norms(rows).where("norm <> ''")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("rule_key").alias("l"), "rule_key"))), lambda x: x["rule_key"])
    groups = kept.groupBy("norm").agg(listed.alias("rule_keys"), F.sum("n").alias("total"))
    return numbered(groups, "norm", "cluster_id").select("cluster_id", "norm", F.substring("norm", 1, CANONICAL_CHARS).alias("canonical"), "rule_keys", "total")


def anchors(rows: DataFrame, seeds: list[str], least: int) -> DataFrame:
    """norm of every key that is a concept of its own: seeds, and keys with at least `least` candidates."""
    strong = with_norms(rows).where("norm <> ''").groupBy("norm").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("norm")
    return strong.unionByName(rows.sparkSession.createDataFrame([(s,) for s in seeds], "norm string")).distinct()


def established(approved: DataFrame, seeds: list[str], least: int = 5) -> DataFrame:
    """target: keys (canonical) with at least `least` approved rules, and seeds, but those with a word that is no rule's."""
    strong = approved.where("canonical IS NOT NULL").groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("canonical").alias("target"))
    found = strong.unionByName(approved.sparkSession.createDataFrame([(s,) for s in seeds], "target string")).distinct()
    return found.where(~F.greatest(*[F.contains("target", F.lit(w)) for w in NO_RULES]))


def assign_keys(rows: DataFrame, proposals: DataFrame, concepts: DataFrame, targets: DataFrame) -> DataFrame:
    """DOM-13: rule_key, n, canonical and fate of every key of the proposed clusters (cluster, rule_key).

    A cluster's representative is the normal form of the member with the most candidates, then the shortest, then the smallest. A
    cluster with two concepts or more is split: each member keeps its own form. Else, of a cluster under an established target,
    members that are variants of it are absorbed and others keep their own form; a cluster under no target is undone; a cluster
    of one key stays. All by aggregates per cluster, which are combined before they are shuffled."""
    members = proposals.select("cluster", "rule_key").distinct().join(with_norms(rows), "rule_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    members = members.withColumn("norm", F.coalesce("norm", rule_key(F.col("rule_key"))))
    own = F.when(F.col("norm") == "", F.col("rule_key")).otherwise(F.col("norm"))
    marked = members.withColumn("own", own).join(concepts.select("norm", F.lit(True).alias("concept")), "norm", "left")
    best = F.min(F.struct((-F.col("n")).alias("a"), F.length("norm").alias("b"), F.col("own").alias("own")))["own"]
    told = marked.groupBy("cluster").agg(best.alias("top"), F.count_distinct(F.when(F.col("concept"), F.col("norm"))).alias("n_concepts"), F.count(F.lit(1)).alias("size"))
    rows = marked.join(told.join(targets.select(F.col("target").alias("top"), F.lit(True).alias("is_target")), "top", "left"), "cluster")
    split = F.col("n_concepts") >= 2
    takes = F.coalesce("is_target", F.lit(False)) & variant_of(F.col("own"), F.col("top"))
    fate = F.when(split, "split").when(F.col("size") == 1, "single").when(takes, "absorbed").otherwise("reverted")
    canonical = F.when(~split & ((F.col("size") == 1) | takes), F.col("top")).otherwise(F.col("own"))
    return rows.select("cluster", "rule_key", "n", F.substring(canonical, 1, CANONICAL_CHARS).alias("canonical"), fate.alias("fate"))
