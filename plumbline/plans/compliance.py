"""Queries of compliance runs, with the SQL that they are checked against: every rule against every scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from .catalog import query
from .views import view

_text = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_text, xs)) + "]"
_CHECKS = ", ".join(f"({_text(c)}, {_list(ts)}, {_list([c, *C.BASE_KEYS.get(c, [])])})" for c, ts in C.CHECKS.items())

#: Scopes of projects, the chosen rule of each scope and check, and every check of every project, by their definitions.
_RUN = f"""checks AS (SELECT * FROM (VALUES {_CHECKS}) t(check_key, types, accepted)),
kept AS (SELECT * FROM {{check_facts}} WHERE review_status = 'confirmed' OR method = 'manual_override'),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fact_type ORDER BY created DESC, tie DESC) AS k FROM kept) WHERE k = 1),
named AS (SELECT project_id, max(nullif(trim(text), '')) FILTER (fact_type = 'council') AS c, max(nullif(trim(text), '')) FILTER (fact_type = 'local_government') AS l FROM latest GROUP BY 1),
coded AS (SELECT project_id, list_sort(list(DISTINCT text) FILTER (fact_type = 'zone' AND text <> '')) AS zones, list_sort(list(DISTINCT text) FILTER (fact_type = 'r_code' AND text <> '')) AS codes FROM kept GROUP BY 1),
scoped AS (SELECT p.project_id, coalesce(c, l, nullif(trim(p.council), '')) AS council, coalesce(zones, []) AS zones, coalesce(codes, []) AS codes,
  CASE WHEN c IS NOT NULL THEN 'property_fact:council' WHEN l IS NOT NULL THEN 'property_fact:local_government' WHEN nullif(trim(p.council), '') IS NOT NULL THEN 'project.council_scope' ELSE 'missing' END AS source
  FROM {{check_projects}} p LEFT JOIN named n ON n.project_id = p.project_id LEFT JOIN coded d ON d.project_id = p.project_id),
scopes AS (SELECT DISTINCT council, zones, codes FROM scoped),
applies AS (SELECT s.council, s.zones, s.codes, r.* EXCLUDE (council, zones, codes), r.codes AS own, coalesce(nullif(base_rule_key, ''), split_part(rule_key, '.', 1)) AS base, try_cast(trim(threshold) AS DOUBLE) AS t FROM scopes s JOIN {{check_rules}} r
  ON r.state = 'approved' AND (r.council IS NULL OR s.council IS NULL OR r.council = s.council) AND (r.zones IS NULL OR len(s.zones) = 0 OR len(list_intersect(string_split(r.zones, ','), s.zones)) > 0)
  AND (r.codes IS NULL OR len(s.codes) = 0 OR len(list_intersect(string_split(r.codes, ','), s.codes)) > 0)),
packs AS (SELECT council, zones, codes, sha256(string_agg(CAST(rule_id AS STRING), '|' ORDER BY CAST(rule_id AS STRING))) AS pack_hash FROM applies GROUP BY 1, 2, 3),
chosen AS (SELECT * FROM (SELECT a.*, check_key, row_number() OVER (PARTITION BY a.council, a.zones, a.codes, check_key ORDER BY (t IS NOT NULL AND NOT isnan(t)) DESC, rule_type <> 'exception' DESC,
    CASE WHEN own IS NULL THEN 1 WHEN len(a.codes) = 0 THEN 0 ELSE 2 END DESC, coalesce(nullif(dwelling_type, ''), 'any') = 'any' DESC, coalesce(list_position(accepted, base), 1), created DESC, rule_id DESC) AS k
  FROM applies a JOIN checks ON rule_key = check_key OR list_contains(accepted, base) OR coalesce(canonical = check_key, false)) WHERE k = 1),
held AS (SELECT project_id, list(fact_type) AS held FROM latest GROUP BY 1),
asked AS (SELECT s.project_id, s.council, source, zones, codes, check_key, list_filter(types, lambda x: list_contains(coalesce(held, []), x))[1] AS type FROM scoped s LEFT JOIN held h ON h.project_id = s.project_id, checks),
judged AS (SELECT q.project_id, q.check_key, c.rule_id, c.rule_key, c.source_version_id, c.operator, c.t, c.unit, f.value AS v, p.pack_hash, q.council, q.source,
  CASE WHEN c.rule_id IS NULL THEN 'missing_rule' WHEN f.method = 'assumption' THEN 'assumption_fact_unconfirmed' WHEN f.value IS NULL THEN 'missing_measurement_fact' WHEN c.t IS NULL THEN 'missing_rule_threshold' WHEN c.operator = 'range' THEN 'unknown_rule_operator' END AS reason
  FROM asked q LEFT JOIN chosen c ON c.check_key = q.check_key AND c.council IS NOT DISTINCT FROM q.council AND c.zones = q.zones AND c.codes = q.codes
  LEFT JOIN packs p ON p.council IS NOT DISTINCT FROM q.council AND p.zones = q.zones AND p.codes = q.codes LEFT JOIN latest f ON f.project_id = q.project_id AND f.fact_type = q.type),
told AS (SELECT *, CASE WHEN rule_id IS NULL THEN 'unsupported' WHEN reason IS NOT NULL THEN 'needs_more_info' WHEN isnan(t) THEN 'likely_fail'
  WHEN CASE operator WHEN 'gte' THEN v >= t WHEN '>' THEN v > t WHEN 'eq' THEN v = t ELSE v <= t END THEN 'likely_pass' ELSE 'likely_fail' END AS status FROM judged)"""


def _run(spark, sf_dir, hashes=True, traced=True):
    rules = view(spark, sf_dir, "check_rules").withColumns({"zones": F.split("zones", ","), "r_codes": F.split("codes", ",")})
    return C.run_checks(view(spark, sf_dir, "check_projects"), view(spark, sf_dir, "check_facts"), rules, hashes=hashes, traced=traced)


@query(f"""WITH {_RUN} SELECT project_id, check_key, status, v AS measured, t AS threshold, unit, rule_id, CASE WHEN rule_id IS NOT NULL THEN concat_ws(' | ', rule_key, 'source_version:' || source_version_id) END AS citation, reason, pack_hash,
  CASE WHEN rule_id IS NOT NULL THEN council END AS trace_council, CASE WHEN rule_id IS NOT NULL THEN source END AS trace_source FROM told""")
def compliance_results(spark, sf_dir):
    """DOM-01, DOM-02, FLT-02 to FLT-04: all 38 checks of every project: keys, bases and canonical keys, councils of facts, zones and codes,
    dwelling types, the place of the key, approved rules only, with citation, trace and the hash of the pack."""
    out = _run(spark, sf_dir, traced=False)
    return out.withColumns({"trace_council": F.col("trace.council_scope"), "trace_source": F.col("trace.council_scope_source")}).drop("trace")


@query(f"""WITH {_RUN} SELECT project_id, CASE WHEN count(*) FILTER (status = 'likely_fail') > 0 THEN 'has_likely_failures' WHEN count(*) FILTER (status = 'needs_more_info') > 0 THEN 'incomplete' ELSE 'likely_compliant' END AS status FROM told GROUP BY 1""")
def compliance_runs(spark, sf_dir):
    """DOM-02: the status of every project's run."""
    return C.overall(_run(spark, sf_dir, hashes=False))
