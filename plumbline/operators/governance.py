"""DOM-17: the governance codes beyond sources and rules. Each takes its tables and gives rows of code and subject_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import failing
from .latest import best_by


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def together(parts: list[DataFrame]) -> DataFrame:
    """SET-05: the failures of all codes."""
    return reduce(DataFrame.unionByName, parts)


def cited_unapproved(citing: DataFrame, key: str, reviews: DataFrame) -> DataFrame:
    """JN-01, WIN-03: (key, version_id) of cited versions whose latest review is not an approval, or is missing."""
    latest = best_by(reviews.select("version_id", "reviewed", "review_id", "status"), ["version_id"], ["reviewed", "review_id"])
    cited = citing.select(key, F.explode("citations").alias("version_id")).distinct()
    return cited.join(latest, "version_id", "left").where(~F.coalesce(F.col("status") == "approved", F.lit(False))).select(key, "version_id")


def result_audit(results: DataFrame, runs: DataFrame, requests: DataFrame, projects: DataFrame, reviews: DataFrame) -> DataFrame:
    """SRC-005, CHK-001 to CHK-004."""
    told = results.where(F.col("status").isin("likely_pass", "likely_fail"))
    bare = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    bad = cited_unapproved(results, "result_id", reviews)
    with_results = runs.where("status = 'has_likely_failures'").join(results.select("run_id").distinct(), "run_id", "left_semi")
    asked = results.select("result_id", "run_id").join(requests.select("result_id").distinct(), "result_id", "left_semi").select("run_id").distinct()
    scoped = runs.join(projects.select("project_id", "council", "meta_council"), "project_id")
    return together([
        failing(bad.select("version_id").distinct(), "SRC-005", "version_id", F.lit(True)),
        *[failing(told, "CHK-001", "result_id", missing) for missing in (F.col("rule_id").isNull(), bare("citations"), bare("trace"))],
        failing(bad.join(told.select("result_id"), "result_id", "left_semi"), "CHK-002", "result_id", F.lit(True)),
        failing(with_results.join(asked, "run_id", "left_anti"), "CHK-003", "run_id", F.lit(True)),
        failing(scoped, "CHK-004", "run_id", F.coalesce(F.nullif(F.coalesce("council", "meta_council"), F.lit("")), F.lit("")) == ""),
    ])


def export_audit(exports: DataFrame, results: DataFrame) -> DataFrame:
    """EXP-001 to EXP-003, of completed exports; `valid` is the flag of the manifest, null where it has none."""
    done = exports.where("status = 'completed'")
    weak = results.where(F.col("status").isin("likely_pass", "likely_fail")).where((F.coalesce(F.size("citations"), F.lit(0)) <= 0) | (F.coalesce(F.size("trace"), F.lit(0)) <= 0) | F.col("rule_id").isNull())
    return together([
        failing(done, "EXP-001", "export_id", F.col("sha256").isNull()),
        failing(done, "EXP-001", "export_id", F.col("valid").isNull()),
        failing(done, "EXP-002", "export_id", ~F.col("valid")),
        failing(done.join(weak.select("run_id", "result_id"), "run_id"), "EXP-003", "export_id", F.lit(True)),
    ])


def eval_audit(runs: DataFrame, skills: DataFrame, findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """EVAL-001: failed runs of an active skill that neither a finding nor a review item follows up."""
    failed = runs.where("status = 'failed'").join(skills.where("active").select("skill_id"), "skill_id", "left_semi")
    open_runs = failed.join(findings.select("trace_id").where("trace_id IS NOT NULL").distinct(), "trace_id", "left_anti")
    return failing(open_runs.join(reviews.where("subject_type = 'eval_run'").select(F.col("subject_id").alias("run_id")).distinct(), "run_id", "left_anti"), "EVAL-001", "run_id", F.lit(True))


def control_audit(controls: DataFrame, risks: DataFrame, steps: DataFrame, today: int) -> DataFrame:
    """CTRL-001, CTRL-002 and PIPE-001; days are numbers."""
    overdue = F.col("every").isNotNull() & (F.col("tested").isNull() | (F.col("tested") < F.lit(today) - F.col("every")))
    critical = steps.where("critical").select("step_id", "stage")
    related = critical.join(risks.select("code", F.col("owner").alias("stage")), "stage", "left")
    without = related.join(controls.select("code").distinct(), "code", "left_anti")
    return together([
        failing(controls, "CTRL-001", "control_id", overdue),
        failing(controls, "CTRL-002", "control_id", F.coalesce("owner", F.lit("")) == ""),
        failing(controls.join(risks.select("code").distinct(), "code", "left_anti"), "CTRL-002", "control_id", F.lit(True)),
        failing(without, "PIPE-001", "step_id", F.lit(True)),
    ])


def finding_audit(findings: DataFrame, items: DataFrame, today: int, stale: int = 14) -> DataFrame:
    """FIND-001 to FIND-003 and CAPA-001 to CAPA-003; days are numbers."""
    linked = findings.where("status = 'converted_to_capa'").join(items.select(F.col("item_id").alias("capa_id"), "severity", "owner", "due", F.lit(True).alias("there")), "capa_id", "left")
    closed = items.where(F.col("status").isin("resolved", "closed"))
    back = items.where("proposed_by IS NOT NULL").join(findings.where("status = 'converted_to_capa'").select(F.col("finding_id").alias("proposed_by")), "proposed_by", "left_anti")
    missing = F.col("decided_by").isNull() | (F.coalesce("reason", F.lit("")) == "") | F.col("evidence").isNull() | F.col("capa_id").isNull()
    return together([
        failing(findings, "FIND-001", "finding_id", (F.col("status") == "proposed") & (F.col("created") < today - stale)),
        failing(findings, "FIND-002", "finding_id", (F.col("status") == "accepted") & missing),
        failing(linked, "FIND-003", "finding_id", F.col("there").isNull() | (F.coalesce("severity", F.lit("")) == "") | F.col("owner").isNull() | F.col("due").isNull()),
        failing(closed, "CAPA-001", "item_id", F.col("closure").isNull() | F.col("check_due").isNull()),
        failing(closed, "CAPA-002", "item_id", F.col("effect").isNull() & (F.col("check_due") < today)),
        failing(back, "CAPA-003", "item_id", F.lit(True)),
    ])


def kpi_audit(kpis: DataFrame, results: DataFrame, today: int) -> DataFrame:
    """KPI-001, AGG-06: indicators with a cadence whose latest result is missing or older."""
    latest = results.groupBy("kpi_id").agg(F.max("computed").alias("latest"))
    late = F.col("latest").isNull() | (F.col("latest") < F.lit(today) - F.col("cadence"))
    return failing(kpis.where("cadence IS NOT NULL").join(latest, "kpi_id", "left"), "KPI-001", "kpi_id", late)


def scope_conflicts(rules: DataFrame, key: str = "rule_key") -> DataFrame:
    """RULE-004, JN-08: key, rule_id and n_overlaps of the approved rules of one key whose scopes overlap others'. A null scope
    overlaps anything; councils must be equal, zones and codes share one.

    Rules of one key and scope are one class, so copies are counted, not paired; classes of a key meet in an equi-join."""
    scope = ["council", "zones", "codes"]
    classes = rules.where("state = 'approved'").groupBy(key, *scope).agg(F.count(F.lit(1)).alias("n"))
    ids = rules.where("state = 'approved'").select(key, *scope, "rule_id")
    a, b = classes.select(key, *scope), classes.select(key, *[F.col(c).alias(f"o_{c}") for c in scope], "n")
    meets = lambda c: F.col(c).isNull() | F.col(f"o_{c}").isNull() | F.arrays_overlap(c, f"o_{c}")
    council = F.col("council").isNull() | F.col("o_council").isNull() | (F.col("council") == F.col("o_council"))
    sums = a.join(b, key).where(council & meets("zones") & meets("codes")).groupBy(key, *scope).agg(F.sum("n").alias("n"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (key, *scope)]
    out = ids.alias("l").join(sums.alias("r"), reduce(lambda x, y: x & y, same))
    return out.select(f"l.{key}", "l.rule_id", (F.col("r.n") - 1).alias("n_overlaps")).where("n_overlaps > 0")
