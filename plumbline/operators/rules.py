"""Rule selection by scope and rank, threshold evaluation and roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import compare
from .latest import best_by

ANY, EVERY = "*", "?"
RANK = ["has_threshold", "plain", "code_rank", "created", "rule_id"]


def _scoped(rules: DataFrame) -> DataFrame:
    """Rules under each scope key they apply to: their own, or ANY for a null scope; and EVERY, for projects that state none."""
    council = F.coalesce(F.col("council").cast("string"), F.lit(ANY))
    codes = F.array_append(F.coalesce("r_codes", F.array(F.lit(ANY))), EVERY)
    rows = rules.withColumn("council", F.explode(F.array(council, F.lit(EVERY)))).withColumn("stated", F.col("r_codes").isNotNull())
    return rows.withColumn("code", F.explode(codes))


def select_rules(rules: DataFrame, scopes: DataFrame) -> DataFrame:
    """DOM-01, FLT-02, FLT-03: for each (council, r_code) of `scopes` and each check, the applicable rule of greatest rank.

    Of the rules of one check that state the same council and codes only the best can win anywhere, so these are found first, and only
    they are filed under their scope keys. A scope then looks up its four keys (own or any council, own or any code), so null-means-all
    scopes need no cross join. A scope without a council or code skips that filter."""
    rows = rules.select(
        "check_key", "council", "r_codes", "rule_id", "operator", "threshold", "rule_type", "created",
        (F.col("threshold").isNotNull() & ~F.isnan("threshold")).alias("has_threshold"),
        (F.coalesce("rule_type", F.lit("standard")) != "exception").alias("plain"),
    )
    kinds = best_by(rows, ["check_key", "council", "r_codes"], [c for c in RANK if c != "code_rank"])
    code_rank = F.when(~F.col("stated"), 1).when(F.col("code") == EVERY, 0).otherwise(2)
    ranked = _scoped(kinds).withColumn("code_rank", code_rank).drop("r_codes", "stated")
    best = best_by(ranked, ["check_key", "council", "code"], RANK)
    own = lambda c: F.when(F.col(c).isNull(), F.array(F.lit(EVERY))).otherwise(F.array(F.col(c).cast("string"), F.lit(ANY)))
    keys = scopes.select("council", "r_code").distinct()
    keys = keys.withColumn("__c", F.explode(own("council"))).withColumn("__r", F.explode(own("r_code")))
    found = keys.join(best.withColumnsRenamed({"council": "__c", "code": "__r"}), ["__c", "__r"]).drop("__c", "__r")
    return best_by(found, ["council", "r_code", "check_key"], RANK)


def confirmed(facts: DataFrame, status: str = "review_status", method: str = "method") -> DataFrame:
    """FLT-04: facts that were confirmed, or entered by hand."""
    return facts.where((F.col(status) == "confirmed") | (F.col(method) == "manual_override"))


def council_of(projects: DataFrame, facts: DataFrame, types: tuple[str, ...] = ("council", "local_government")) -> DataFrame:
    """DOM-02: projects with the council that their latest facts name, the first type that does; else their own."""
    kept = best_by(facts.where(F.col("fact_type").isin(*types) & (F.trim("text") != "")).select("project_id", "fact_type", "created", "text"), ["project_id", "fact_type"], ["created", "text"])
    order = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("fact_type"))
    named = kept.groupBy("project_id").agg(F.min_by(F.trim("text"), order).alias("__named"))
    return projects.join(named, "project_id", "left").withColumn("council", F.coalesce("__named", F.col("council").cast("string"))).drop("__named")


def evaluate(projects: DataFrame, facts: DataFrame, rules: DataFrame, checks: list[str]) -> DataFrame:
    """DOM-02: project_id, check_key, rule_id, value, status and reason for every project and check; `checks.run_checks` has the whole run.

    A project is one row until the end: its latest facts and the rules of its scope are maps, and checks are multiplied out last,
    so nothing is shuffled by check. Facts are dealt by project before they are compared: a project has few of one type, so comparing those
    of a task first would only sort whole splits of the input. Rules of a scope are a small table, which Spark broadcasts when it is below its threshold."""
    asked = facts.where(F.col("fact_type").isin(*checks)).select("project_id", "fact_type", "value", "method", "created", "tie")
    latest = best_by(asked.repartition("project_id"), ["project_id", "fact_type"], ["created", "tie"])
    known = latest.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("fact_type", F.struct("value", "method")))).alias("__facts"))
    entry = F.struct("check_key", F.struct("rule_id", "operator", "threshold").alias("rule"))
    chosen = select_rules(rules, projects).groupBy("council", "r_code").agg(F.map_from_entries(F.collect_list(entry)).alias("__rules"))
    scope = F.col("p.council").eqNullSafe(F.col("c.council")) & F.col("p.r_code").eqNullSafe(F.col("c.r_code"))
    met = projects.alias("p").join(chosen.alias("c"), scope, "left").select("p.project_id", "c.__rules").join(known, "project_id", "left")
    each = F.array(*[F.struct(F.lit(c).alias("check_key"), F.try_element_at("__rules", F.lit(c)).alias("r"), F.try_element_at("__facts", F.lit(c)).alias("f")) for c in checks])
    rows = met.select("project_id", F.explode(each).alias("x")).select("project_id", "x.check_key", "x.r.rule_id", "x.r.operator", "x.r.threshold", "x.f.value", "x.f.method")
    rows = rows.withColumn("__ok", compare(F.col("value"), F.col("operator"), F.col("threshold")))  # a column of its own, not computed again by each use
    ok = F.col("__ok")
    reason = (
        F.when(F.col("rule_id").isNull(), "no_rule")
        .when(F.col("method").isNull(), "no_fact")
        .when(F.col("method") == "assumption", "assumption")
        .when(F.col("value").isNull(), "no_value")
        .when(F.col("threshold").isNull(), "no_threshold")
        .when(ok.isNull(), "unknown_operator")
    )
    status = F.when(F.col("rule_id").isNull(), "unsupported").when(F.col("reason").isNotNull(), "needs_more_info").when(ok, "pass").otherwise("fail")
    return rows.withColumn("reason", reason).withColumn("status", status).select("project_id", "check_key", "rule_id", "value", "status", "reason")


def roll_up(results: DataFrame) -> DataFrame:
    """Counts per project and the overall verdict: likely failures, then incomplete, then likely compliant."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = results.groupBy("project_id").agg(count("pass").alias("n_pass"), count("fail").alias("n_fail"), count("needs_more_info").alias("n_info"), count("unsupported").alias("n_unsupported"))
    return out.withColumn("overall", F.when(F.col("n_fail") > 0, "has_likely_failures").when(F.col("n_info") > 0, "incomplete").otherwise("likely_compliant"))


def pack_hash(rules: DataFrame, key: str, buckets: int = 1024) -> DataFrame:
    """AGG-21 for large packs: SHA-256 over the digests of hash buckets of sorted ids, so that no task sorts all ids. For a
    single bucket it is the digest of the sorted ids joined by |."""
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).alias("b") if buckets > 1 else F.lit(0).alias("b")
    parts = rules.groupBy("check_key", bucket).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "|"), 256).alias("d"))
    if buckets == 1:
        return parts.select("check_key", F.col("d").alias("pack_hash"))
    return parts.groupBy("check_key").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "|"), 256).alias("pack_hash"))
