"""Votes of several models on a rule: core groups, adjudication and majority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORE = ["rule_key", "operator", "value", "unit"]


def core_groups(votes: DataFrame) -> DataFrame:
    """AGG-14: votes and families per (rule key, operator, value to 4 places, unit)."""
    core = votes.withColumn("value", F.bround("value", 4))
    return core.groupBy(*CORE).agg(F.count(F.lit(1)).alias("n_votes"), F.count_distinct("family").alias("n_families"))


def adjudicate(votes: DataFrame) -> DataFrame:
    """AGG-15, DOM-04, SET-02: one decision per core.

    Votes hold family, pathway, rule_type, codes (array, null or empty where not stated) and dwelling. One family alone blocks;
    so does a leading pathway that ties or has one family. Votes for other pathways are dropped. Of the rest, the most frequent
    rule type counts, code sets are intersected, and a specific dwelling type narrows any; no common code or two specific
    types block. Each loss is a dissent.

    Votes are counted per core and pathway before they meet, with their distinct code sets, rule types and dwelling types; the
    counts of a core are then ranked, so no vote is collected."""
    core = votes.withColumn("value", F.bround("value", 4))
    stated = F.when(F.size("codes") > 0, F.array_sort(F.array_distinct("codes")))
    specific = F.when(F.coalesce("dwelling", F.lit("any")) != "any", F.nullif(F.col("dwelling"), F.lit("")))
    path = [*CORE, "pathway"]
    kinds = core.groupBy(*path, "rule_type").agg(F.count(F.lit(1)).alias("m")).groupBy(*path).agg(F.min(F.struct((-F.col("m")).alias("m"), "rule_type"))["rule_type"].alias("kind"), F.count(F.lit(1)).alias("n_kinds"))
    paths = core.groupBy(*path).agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set("family").alias("families"),
        F.collect_set(stated).alias("sets"),
        F.count(stated).alias("n_stated"),
        F.collect_set(specific).alias("dwellings"),
        F.count(specific).alias("n_specific"),
    )
    paths = paths.join(kinds, path)
    rest = F.struct("families", "sets", "n_stated", "dwellings", "n_specific", "kind", "n_kinds")
    ranked = paths.groupBy(*CORE).agg(F.sum("n").alias("n_votes"), F.array_distinct(F.flatten(F.collect_list("families"))).alias("all"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "pathway", rest.alias("x")))).alias("p"))
    first, second = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    x, n = first["x"], -first["m"]
    common = F.aggregate(x["sets"], F.get(x["sets"], F.lit(0)), lambda acc, s: F.array_intersect(acc, s))
    beaten = second.isNotNull() & ((first["m"] == second["m"]) | (F.size(x["families"]) < 2))
    outcome = (
        F.when(F.size("all") < 2, "single_model_family")
        .when(beaten, "pathway_disagreement")
        .when((F.size(x["sets"]) > 0) & (F.size(common) == 0), "density_disagreement")
        .when(F.size(x["dwellings"]) > 1, "dwelling_disagreement")
        .otherwise("promote")
    )
    lost = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda q: F.concat(F.lit("pathway_dissent_"), q["pathway"]))
    marks = F.filter(
        F.array(
            F.when(x["n_kinds"] > 1, "rule_type_mixed"),
            F.when(F.size(x["sets"]) > 1, "density_codes_narrowed"),
            F.when((x["n_stated"] > 0) & (x["n_stated"] < n), "density_codes_partial"),
            F.when((x["n_specific"] > 0) & (x["n_specific"] < n), "dwelling_type_narrowed"),
        ),
        lambda m: m.isNotNull(),
    )
    dissent = F.array_sort(F.concat(lost, marks))
    confidence = F.when(n >= 3, 0.95).otherwise(0.90)
    confidence = F.when(F.size(dissent) > 0, F.least(confidence, F.lit(0.9)) - 0.05).otherwise(confidence)
    told = lambda c, name: F.when(outcome == "promote", c).alias(name)
    return ranked.select(
        *CORE, "n_votes", outcome.alias("outcome"), told(first["pathway"], "pathway"), told(x["kind"], "rule_type"),
        told(F.coalesce(F.array_join(F.array_sort(common), ","), F.lit("")), "codes"), told(F.coalesce(F.get(x["dwellings"], F.lit(0)), F.lit("any")), "dwelling"),
        told(F.array_join(dissent, ","), "dissent"), told(F.round(confidence, 4), "confidence"),
    )


def majority_of_three(votes: DataFrame, group: str, key: str) -> DataFrame:
    """AGG-16: the most frequent key of a group: three votes or more promote, two challenge, else pending."""
    counts = votes.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(key).alias("k"))).alias("t"))
    n = -F.col("t.m")
    return top.select(group, F.col("t.k").alias("agreed"), n.alias("n_agree"), F.when(n >= 3, "promote").when(n == 2, "challenge").otherwise("pending").alias("outcome"))
