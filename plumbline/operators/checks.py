"""Compliance runs: every check of every project against the rule of its scope, with trace, citation and the hash of the pack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import compare
from .latest import best_by
from .rules import ANY, EVERY, confirmed

ENGINE = "1"
SCOPE = ["council", "zones", "r_codes"]
RANK = ["has_threshold", "plain", "code_rank", "any_dwelling", "key_rank", "created", "rule_id"]

# Checks and the types of facts that measure them, in order; rule keys that count for a check beside its own.
CHECKS = {
    "setback_front": ["proposed_setback_front_m"], "setback_rear": ["proposed_setback_rear_m"], "setback_side_primary": ["proposed_setback_side_primary_m"],
    "setback_side_secondary": ["proposed_setback_side_secondary_m"], "site_cover": ["proposed_site_cover_pct", "site_area_m2", "proposed_covered_area_m2"],
    "open_space": ["proposed_open_space_pct", "site_area_m2", "proposed_open_space_m2"], "garage_width": ["proposed_garage_width_m", "frontage_width_m"],
    "garage_dominance": ["proposed_garage_width_m", "dwelling_facade_width_m"], "boundary_wall_length": ["proposed_boundary_wall_length_m"],
    "height_overall": ["proposed_height_overall_m", "natural_ground_level_m"], "height_wall": ["proposed_wall_height_m", "natural_ground_level_m"],
    "building_storey": ["proposed_building_storey_storeys"], "driveway_width": ["proposed_driveway_width_m"], "outdoor_living_area": ["proposed_outdoor_living_area_m2"],
    "parking_bays_per_dwelling": ["proposed_parking_bays_per_dwelling_count"], "site_area": ["lot_area_m2"], "soft_landscaping": ["proposed_soft_landscaping_pct"],
    "approved_structure_plan_regard": ["proposed_approved_structure_plan_regard_count"], "asset_protection_zone": ["proposed_asset_protection_zone_count"],
    "average_lot_size": ["proposed_average_lot_size_m2"], "car_parking_ratio_per_gla": ["proposed_car_parking_ratio_per_gla_m2"], "ceiling_height": ["proposed_ceiling_height_m"],
    "environmental_management_plan": ["proposed_environmental_management_plan_count"], "exempted_sign_max_size": ["proposed_exempted_sign_max_size_m2"],
    "facility_structure_spacing": ["proposed_facility_structure_spacing_m"], "fence_height_side": ["proposed_fence_height_side_m"],
    "land_use_permissibility": ["proposed_land_use_permissibility_count"], "local_water_management_strategy": ["proposed_local_water_management_strategy_count"],
    "min_frontage": ["lot_width_m", "frontage_width_m"], "min_lot_area_per_dwelling": ["proposed_min_lot_area_per_dwelling_m2"],
    "notification_on_title": ["proposed_notification_on_title_count"], "parking_ratio_hotel_tavern": ["proposed_parking_ratio_hotel_tavern_m2"],
    "parking_ratio_medical_centre": ["proposed_parking_ratio_medical_centre_m2"], "parking_ratio_per_gla": ["proposed_parking_ratio_per_gla_m2"],
    "plot_ratio": ["proposed_plot_ratio"], "retaining_wall_height": ["proposed_retaining_wall_height_m"],
    "urban_water_management_plan": ["proposed_urban_water_management_plan_count"], "vertical_distance_above_water_table": ["proposed_vertical_distance_above_water_table_m"],
}
BASE_KEYS = {
    "setback_front": ["primary_street_setback", "front_setback"], "setback_rear": ["rear_setback"], "setback_side_primary": ["side_setback"],
    "setback_side_secondary": ["secondary_street_setback", "side_setback"], "site_cover": ["site_cover"], "open_space": ["open_space"],
    "garage_width": ["garage_width"], "garage_dominance": ["garage_dominance"], "boundary_wall_length": ["boundary_wall_length", "boundary_wall"],
}


def rules_by_check(rules: DataFrame, checks: dict[str, list[str]] = CHECKS, bases: dict[str, list[str]] = BASE_KEYS) -> DataFrame:
    """DOM-01: approved rules under each check that they serve, with key_rank: by their rule key, their canonical key, or their base
    key (stated, else the text before the first dot), which ranks by its place among the check's keys."""
    accepted = {c: list(dict.fromkeys([c, *bases.get(c, [])])) for c in checks}
    size = {c: 1 + len(bases.get(c, [])) for c in checks}
    table = rules.sparkSession.createDataFrame([(key, c, size[c] - keys.index(key), size[c]) for c, keys in accepted.items() for key in keys], "__key string, check_key string, __place int, __own int")
    base = F.coalesce(F.nullif("base_rule_key", F.lit("")), F.split_part("rule_key", F.lit("."), F.lit(1)))
    keys = F.array_distinct(F.array_compact(F.array(base, F.col("rule_key"), F.col("canonical"))))
    each = rules.where("state = 'approved'").withColumn("__base", base).withColumn("__key", F.explode(keys)).join(F.broadcast(table), "__key")
    each = each.where((F.col("__key") == F.col("check_key")) | (F.col("__key") == F.col("__base"))).drop("__key", "__place")
    places = table.select(F.col("__key").alias("__base"), "check_key", "__place")
    return each.join(F.broadcast(places), ["__base", "check_key"], "left").withColumn("key_rank", F.coalesce("__place", "__own")).drop("__base", "__place", "__own")


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules under each key (council, zone, code) that they apply to: their own, ANY for a null, and EVERY, for scopes that skip a filter."""
    any_of = lambda c: F.array_append(F.coalesce(c, F.array(F.lit(ANY))), EVERY)
    rows = rules.withColumn("__c", F.explode(F.array(F.coalesce("council", F.lit(ANY)), F.lit(EVERY))))
    return rows.withColumn("__z", F.explode(any_of("zones"))).withColumn("__r", F.explode(any_of("r_codes")))


def _lookups(scopes: DataFrame) -> DataFrame:
    """scope and the keys under which its rules are found: its own and ANY, or EVERY where it states none."""
    own = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) < 1, F.array(F.lit(EVERY))).otherwise(F.array_append(c, ANY))
    council = F.when(F.coalesce("council", F.lit("")) == "", F.array(F.lit(EVERY))).otherwise(F.array("council", F.lit(ANY)))
    asked = scopes.select("scope", F.explode(council).alias("__c"), "zones", "r_codes").withColumn("__z", F.explode(own("zones"))).withColumn("__r", F.explode(own("r_codes")))
    return asked.select("scope", "__c", "__z", "__r")


def select_rules(rules: DataFrame, scopes: DataFrame, checks: dict[str, list[str]] = CHECKS, bases: dict[str, list[str]] = BASE_KEYS) -> DataFrame:
    """DOM-01, FLT-02, FLT-03: scope and check_key with the best applicable rule. scopes: scope, council, zones and r_codes; a null
    or empty one skips that filter, as a rule's null applies to all.

    Ranked: a usable threshold, no exception, own codes before none, any dwelling, the place of the key, the newest. The best rule of
    each check among those with one council, zones and codes is found first, so only these few are put under their keys; scopes then
    look up their own keys and those for all, in equi-joins."""
    threshold = F.trim("threshold").try_cast("double")
    ranked = rules_by_check(rules, checks, bases).select(
        "check_key", *SCOPE, "rule_id", "operator", threshold.alias("threshold"), "unit", "pathway", "rule_key", "source_version_id", "created", "key_rank",
        (threshold.isNotNull() & ~F.isnan(threshold)).alias("has_threshold"),
        (F.coalesce("rule_type", F.lit("standard")) != "exception").alias("plain"),
        (F.coalesce(F.nullif("dwelling_type", F.lit("")), F.lit("any")) == "any").alias("any_dwelling"),
    )
    alike = best_by(ranked, ["check_key", *SCOPE], [r for r in RANK if r != "code_rank"])  # they have one code_rank under each key
    code_rank = F.when(F.col("r_codes").isNull(), 1).when(F.col("__r") == EVERY, 0).otherwise(2)
    best = best_by(_keyed(alike).withColumn("code_rank", code_rank).drop(*SCOPE), ["check_key", "__c", "__z", "__r"], RANK)
    found = _lookups(scopes).join(best, ["__c", "__z", "__r"]).drop("__c", "__z", "__r")
    return best_by(found, ["scope", "check_key"], RANK)


def pack_hashes(rules: DataFrame, scopes: DataFrame) -> DataFrame:
    """AGG-21: scope and the SHA-256 of the sorted ids, joined by |, of all approved rules that apply in it.

    Rules with one council, zones and codes are a kind; scopes look up kinds, not rules, and the ids of the kinds of a pack are brought
    together once for all scopes that have it."""
    approved = rules.where("state = 'approved'").withColumn("kind", F.to_json(F.struct(*SCOPE)))
    kinds = approved.groupBy("kind").agg(*[F.first(c).alias(c) for c in SCOPE])
    found = _lookups(scopes).join(_keyed(kinds), ["__c", "__z", "__r"]).groupBy("scope").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    found = found.withColumn("pack", F.sha2(F.to_json("kinds"), 256))
    ids = approved.groupBy("kind").agg(F.collect_set(F.col("rule_id").cast("string")).alias("ids"))
    packs = found.dropDuplicates(["pack"]).select("pack", F.explode("kinds").alias("kind"))
    whole = packs.join(ids, "kind").groupBy("pack").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return found.join(whole.select("pack", F.sha2(F.array_join("ids", "|"), 256).alias("pack_hash")), "pack").select("scope", "pack_hash")


def with_scopes(projects: DataFrame, facts: DataFrame, types: list[str]) -> DataFrame:
    """project_id, council (of confirmed facts, else the project's), its source, zones, r_codes, scope (their text) and `facts`: the
    latest fact of each type. facts: project_id, fact_type, value, text, method, review_status, created, tie.

    Facts are combined per project and type before a project's few types become one row; types are a fixed list."""
    kept = confirmed(facts).where(F.col("fact_type").isin(*types, "zone", "r_code", "council", "local_government"))
    codes = F.collect_set(F.when(F.col("fact_type").isin("zone", "r_code"), F.nullif("text", F.lit("")))).alias("codes")
    latest = kept.groupBy("project_id", "fact_type").agg(F.max_by(F.struct("value", "method", "text"), F.struct("created", "tie")).alias("f"), codes)
    measured = F.col("fact_type").isin(*types)
    own = lambda t: F.max(F.when(F.col("fact_type") == t, F.nullif(F.trim("f.text"), F.lit(""))))
    listed = lambda t: F.flatten(F.collect_list(F.when(F.col("fact_type") == t, F.col("codes"))))
    rows = latest.groupBy("project_id").agg(
        F.map_from_entries(F.collect_list(F.when(measured, F.struct("fact_type", F.struct("f.value", "f.method"))))).alias("facts"),
        own("council").alias("__c"), own("local_government").alias("__l"), F.array_sort(listed("zone")).alias("zones"), F.array_sort(listed("r_code")).alias("r_codes"),
    )
    stated = F.nullif(F.trim("council"), F.lit(""))
    source = F.when(F.col("__c").isNotNull(), "property_fact:council").when(F.col("__l").isNotNull(), "property_fact:local_government").when(stated.isNotNull(), "project.council_scope").otherwise("missing")
    out = projects.select("project_id", F.col("council").cast("string").alias("council")).join(rows, "project_id", "left")
    out = out.withColumn("council_source", source).withColumn("council", F.coalesce("__c", "__l", stated))
    return out.withColumn("scope", F.to_json(F.struct(*SCOPE))).drop("__c", "__l")


def run_checks(projects: DataFrame, facts: DataFrame, rules: DataFrame, checks: dict[str, list[str]] = CHECKS, bases: dict[str, list[str]] = BASE_KEYS, hashes: bool = True, traced: bool = True) -> DataFrame:
    """DOM-02: project_id, check_key, status, measured, threshold, unit, rule_id, citation, reason, trace and pack_hash of every check
    of every project; without `hashes`, pack_hash is null, and without `traced`, trace is its fields, not their JSON.

    A project is one row until the end: its facts and the rules of its scope are maps, and checks are multiplied out last, so
    nothing is shuffled by check. Checks are one literal and look up both maps, as an expression for each would make a method that the
    JVM does not compile. Rules of a scope are a small table, which Spark broadcasts when it is below its threshold."""
    scoped = with_scopes(projects, facts, sorted({t for ts in checks.values() for t in ts}))
    scopes = scoped.select("scope", *SCOPE).distinct()
    chosen = select_rules(rules, scopes, checks, bases)
    rule = F.struct("rule_id", "operator", "threshold", "unit", "pathway", "rule_key", "source_version_id")
    table = chosen.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("check_key", rule))).alias("rules"))
    table = table.join(pack_hashes(rules, scopes), "scope", "left") if hashes else table.withColumn("pack_hash", F.lit(None).cast("string"))
    rows = scoped.join(table, "scope", "left")
    places = range(max(map(len, checks.values())))
    asked = F.explode(F.array(*[F.struct(F.lit(c).alias("check_key"), *[F.lit(ts[i] if i < len(ts) else None).cast("string").alias(f"t{i}") for i in places]) for c, ts in checks.items()]))
    rows = rows.select("project_id", "council", "council_source", "pack_hash", "facts", "rules", asked.alias("x"))
    found = F.coalesce(*[F.try_element_at("facts", F.col("x")[f"t{i}"]) for i in places])
    return _judged(rows.select("project_id", "council", "council_source", "pack_hash", "x.check_key", F.try_element_at("rules", F.col("x.check_key")).alias("r"), found.alias("f")), traced)


def _judged(rows: DataFrame, traced: bool = True) -> DataFrame:
    c = F.col
    rows = rows.withColumn("ok", compare(c("f.value"), c("r.operator"), c("r.threshold")))  # a column of its own, not computed again by each use
    ok = c("ok")
    none = c("r").isNull()
    reason = (
        F.when(none, "missing_rule").when(c("f.method") == "assumption", "assumption_fact_unconfirmed").when(c("f.value").isNull(), "missing_measurement_fact")
        .when(c("r.threshold").isNull(), "missing_rule_threshold").when(ok.isNull(), "unknown_rule_operator")
    )
    rows = rows.withColumn("reason", reason)
    status = F.when(none, "unsupported").when(c("reason").isNotNull(), "needs_more_info").when(ok, "likely_pass").otherwise("likely_fail")
    version = F.when(c("r.source_version_id").isNotNull(), F.concat(F.lit("source_version:"), c("r.source_version_id").cast("string")))
    shown = lambda x: x.cast("string")
    fields = {
        "engine_version": F.lit(ENGINE), "operator": c("r.operator"), "threshold": shown(c("r.threshold")), "measured": shown(c("f.value")),
        "result": c("status"), "missing_info_reason": c("reason"), "council_scope": c("council"), "council_scope_source": c("council_source"),
    }
    trace = F.when(~none, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))) if traced else F.struct(*[F.when(~none, v).alias(k) for k, v in fields.items()])
    return rows.withColumn("status", status).select(
        "project_id", "check_key", "status", c("f.value").alias("measured"), c("r.threshold").alias("threshold"), c("r.unit").alias("unit"), c("r.rule_id").alias("rule_id"),
        F.when(~none, F.concat_ws(" | ", F.nullif(c("r.rule_key"), F.lit("")), version)).alias("citation"), "reason", trace.alias("trace"), "pack_hash",
    )


def overall(results: DataFrame) -> DataFrame:
    """DOM-02: project_id and the run's status: likely failures, then incomplete, then likely compliant. Checks without a rule do not count."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = results.groupBy("project_id").agg(n("likely_fail").alias("n_fail"), n("needs_more_info").alias("n_info"))
    status = F.when(F.col("n_fail") > 0, "has_likely_failures").when(F.col("n_info") > 0, "incomplete").otherwise("likely_compliant")
    return out.select("project_id", status.alias("status"))
