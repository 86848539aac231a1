"""Review findings: four finders of one round, each with its own limit, under ids that a later run finds again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import name_uuid

#: Columns of a finding.
COLUMNS = ["id", "round", "agent_role", "target", "claim", "evidence_quote", "severity", "status"]

# Fixed value: the namespace of finding ids.
NAMESPACE = uuid.UUID("0b8d8b6f-8ee3-4f7d-a98f-f9a3b3cdd7d8")


def _findings(rows: DataFrame, number: int, role: str, target: Column, claim: Column, quote: Column, severity: str) -> DataFrame:
    """Rows as findings; the id names the round, the role, the whole target and the claim."""
    target, claim = F.coalesce(target, F.lit("")), F.coalesce(claim, F.lit(""))
    name = F.concat_ws("|", F.lit("wp8"), F.lit(str(number)), F.lit(role), target, claim)
    return rows.select(
        name_uuid(NAMESPACE, name).alias("id"), F.lit(number).alias("round"), F.lit(role).alias("agent_role"), F.substring(target, 1, 300).alias("target"),
        claim.alias("claim"), quote.alias("evidence_quote"), F.lit(severity).alias("severity"), F.lit("open").alias("status"),
    )


def _first(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """A report of the first rows; all of them where the limit is 0. Tasks send `limit` rows each."""
    return rows.orderBy(*order).limit(limit) if limit > 0 else rows


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def gap_hunter(manifest: DataFrame, number: int, limit: int = 0) -> DataFrame:
    """Manifest rows (manifest_id, instrument_name, category, status, notes) that are still pending or blocked."""
    rows = _first(manifest.where(F.col("status").isin("pending", "blocked")), ["status", "category", "instrument_name", "manifest_id"], limit)
    quote = F.substring(F.coalesce(F.nullif("notes", F.lit("")), F.col("instrument_name")), 1, 1_000)
    claim = F.concat(F.lit("Manifest row remains "), F.col("status"), F.lit(" and cannot support answers: "), F.col("instrument_name"))
    return _findings(rows, number, "gap_hunter", F.concat(F.lit("target_manifest:"), _text("manifest_id")), claim, quote, "major")


def re_extractor(clauses: DataFrame, rules: DataFrame, number: int, limit: int = 0) -> DataFrame:
    """Rule-bearing clauses (clause_id, title, clause_path, disposition, text) without a rule (clause_id)."""
    bare = clauses.where("disposition = 'rule_bearing'").join(rules.select("clause_id").distinct(), "clause_id", "left_anti")
    rows = _first(bare, [F.col("title"), F.asc_nulls_last("clause_path"), F.col("clause_id")], limit)
    claim = F.trim(F.concat(F.lit("Rule-bearing clause has no rule atom: "), F.col("title"), F.lit(" "), F.coalesce("clause_path", F.lit(""))))
    return _findings(rows, number, "re_extractor", F.concat(F.lit("clause:"), _text("clause_id")), claim, F.substring("text", 1, 1_000), "critical")


def prosecutor(results: DataFrame, number: int, limit: int = 0) -> DataFrame:
    """Results (result_id, status, check_key, citations, trace as JSON, created) that pass or fail without citations or a trace."""
    bare = F.coalesce("citations", F.lit("null")).isin("null", "[]") | F.coalesce("trace", F.lit("null")).isin("null", "{}")
    rows = _first(results.where(F.col("status").isin("likely_pass", "likely_fail") & bare), [F.desc("created"), F.col("result_id")], limit)
    claim = F.concat(F.col("status"), F.lit(" check result lacks required citation or decision trace for "), F.col("check_key"))
    return _findings(rows, number, "prosecutor", F.concat(F.lit("check_result:"), _text("result_id")), claim, F.col("trace"), "critical")


def conflict_prosecutor(rules: DataFrame, number: int, limit: int = 0) -> DataFrame:
    """Approved rules (rule_key, pathway, council, codes as JSON, source_id, title, quote, state) of one scope from two sources or more."""
    scope = ["rule_key", "pathway", F.coalesce("council", F.lit("")).alias("council"), F.coalesce("codes", F.lit("ALL")).alias("codes")]
    groups = rules.where("state = 'approved'").groupBy(*scope).agg(
        F.count_distinct("source_id").alias("instruments"), F.count(F.lit(1)).alias("rules"), F.array_join(F.array_sort(F.collect_set("title")), "; ").alias("titles"), F.min("quote").alias("quote")
    )
    rows = _first(groups.where("instruments > 1 AND rules > 1"), [F.desc("rules"), F.col("rule_key"), F.col("pathway"), F.col("council"), F.col("codes")], limit)
    claim = F.concat(F.lit("Multiple instruments provide approved rules for "), F.col("rule_key"), F.lit(" without a demonstrated single winner."))
    quote = F.substring(F.concat(F.col("titles"), F.lit(" :: "), F.coalesce("quote", F.lit(""))), 1, 1_000)
    return _findings(rows, number, "conflict_prosecutor", F.concat(F.lit("rule_key:"), F.col("rule_key"), F.lit(":"), F.col("codes")), claim, quote, "major")


def one_per_id(*found: DataFrame) -> DataFrame:
    """DOM-25: findings of several finders; of equal ids the smallest quote stays, as a table keyed by id holds one."""
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    kept = union.groupBy("id").agg(F.min(F.struct(*COLUMNS[1:])).alias("f"))
    return kept.select("id", "f.*")
