"""Governance audits, clause coverage, ledgers, leases and evaluation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import rows_per_key
from .tables import overlap_counts


def failing(df: DataFrame, code: str, key: str, predicate: Column) -> DataFrame:
    return df.where(predicate).select(F.lit(code).alias("code"), F.col(key).cast("bigint").alias("subject_id"))


def source_audit(versions: DataFrame, today: int) -> DataFrame:
    """DOM-17: versions without an owner, past their due day, not approved or restricted, or overlapping others."""
    overlaps = overlap_counts(versions, "source", "version_id", "valid_from", "valid_to")
    found = [
        failing(versions, "SRC-001", "version_id", F.coalesce(F.trim("owner"), F.lit("")) == ""),
        failing(versions, "SRC-002", "version_id", F.col("due_day").isNull() | (F.col("due_day") < today)),
        failing(versions, "SRC-003", "version_id", ~F.coalesce("approved", F.lit(False)) | F.coalesce("restricted", F.lit(False))),
        failing(overlaps, "SRC-004", "version_id", F.col("n_overlaps") > 0),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def rule_audit(rules: DataFrame, links: DataFrame) -> DataFrame:
    """DOM-17: approved rules without a quote, without a link, or with an operator out of the vocabulary."""
    approved = rules.where("state = 'approved'")
    allowed = ["lte", "gte", "lt", "gt", "eq"]
    out = failing(approved, "RULE-001", "rule_id", F.coalesce(F.trim("quote"), F.lit("")) == "")
    out = out.unionByName(failing(approved.join(links.select("rule_id").distinct(), "rule_id", "left_anti"), "RULE-002", "rule_id", F.lit(True)))
    return out.unionByName(failing(approved, "RULE-003", "rule_id", ~F.coalesce(F.col("operator").isin(allowed), F.lit(False))))


def coverage(clauses: DataFrame, rules: DataFrame, candidates: DataFrame, group: str, key: str) -> DataFrame:
    """JN-03, AGG-03, AGG-23: per group clauses, those with rules or candidates, and those uncovered. Each side is reduced to
    its keys before the joins."""
    has = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = clauses.join(has(rules, "r"), key, "left").join(has(candidates, "c"), key, "left")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_clauses"), count(F.col("r")).alias("with_rules"), count(F.col("c")).alias("with_candidates"), count(F.col("r").isNull() & F.col("c").isNull()).alias("uncovered"))


def daily_spend(spend: DataFrame) -> DataFrame:
    """AGG-04, DT-01: per day calls, cents and users."""
    return spend.groupBy("day").agg(F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.count_distinct("user_id").alias("n_users"))


def quota(uses: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """DOM-20: uses admitted and refused per key; only the count of a key matters, so it is summed before the shuffle."""
    n = uses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*keys, F.least("n", F.lit(limit)).alias("admitted"), F.greatest(F.col("n") - limit, F.lit(0)).cast("bigint").alias("refused"))


def regressions(counters: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """STM-08: rows of a counter below the one before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return counters.withColumn("before", before).where(F.col(value) < F.col("before"))


def claimable(leases: DataFrame, as_of: str, limit: int, group: str) -> DataFrame:
    """STM-02, DT-06: oldest rows of each group whose lease is unset or has run out."""
    free = leases.where(F.col("lease_until").isNull() | (F.col("lease_until") < F.lit(as_of).cast("timestamp_ntz")))
    return rows_per_key(free, [group], [F.col("ts"), F.col("event_id")], limit)


def pass_rates(cases: DataFrame, suite: str, passed: Column, gate: float = 0.8, suites: DataFrame | None = None) -> DataFrame:
    """AGG-17, DOM-18: passed and total per suite, the rate to 4 places, and whether it clears the gate.

    `suites` names all suites: one without cases passes at 1."""
    sums = cases.groupBy(suite).agg(F.count(F.lit(1)).alias("total"), F.count_if(passed).alias("passed"))
    if suites is not None:
        sums = suites.select(suite).distinct().join(sums, suite, "left").fillna(0, ["total", "passed"])
    rate = F.when(F.col("total") == 0, 1.0).otherwise(F.round(F.col("passed") / F.col("total"), 4))
    return sums.withColumn("rate", rate).withColumn("gate", rate >= gate)


def precision_recall(expected: DataFrame, actual: DataFrame, keys: list[str], group: str) -> DataFrame:
    """AGG-18: true and false positives and misses per group, by a full outer join."""
    e, a = expected.select(group, *keys).distinct().withColumn("__e", F.lit(True)), actual.select(group, *keys).distinct().withColumn("__a", F.lit(True))
    both = e.join(a, [group, *keys], "full")
    n = both.groupBy(group).agg(F.count_if(F.col("__e") & F.col("__a")).alias("hits"), F.count_if(F.col("__e").isNull()).alias("extra"), F.count_if(F.col("__a").isNull()).alias("missed"))
    ratio = lambda d: F.when(d > 0, F.round(F.col("hits") / d, 4))
    return n.withColumn("precision", ratio(F.col("hits") + F.col("extra"))).withColumn("recall", ratio(F.col("hits") + F.col("missed")))
