"""Queries of the engine's own operators, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import adjudication, audit, corpus, geo, latest, rules, search, tables
from ..sources import readers
from ..sources.scratch import shared_path
from ..streaming import windows
from .catalog import QUERIES, SQL, query
from .views import view

CHECKS = [f"check_{n}" for n in range(1, 8)]
_COMPARE = """CASE CASE o WHEN '<=' THEN 'lte' WHEN 'pct_lte' THEN 'lte' WHEN '<' THEN 'lt' WHEN '=' THEN 'eq' ELSE coalesce(o, 'lte') END
  WHEN 'lte' THEN v <= t WHEN 'gte' THEN v >= t WHEN 'lt' THEN v < t WHEN 'gt' THEN v > t WHEN 'eq' THEN v = t END"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved rules: others decide nothing."""
    return view(spark, sf_dir, "rules").where("state = 'approved'").withColumn("r_codes", F.split("codes", ","))


# Rules

_CHOSEN = """
(SELECT * FROM (SELECT s.council, s.r_code, r.check_key, r.rule_id, r.operator, r.threshold,
    row_number() OVER (PARTITION BY s.council, s.r_code, r.check_key ORDER BY r.threshold IS NOT NULL DESC, r.rule_type <> 'exception' DESC, r.codes IS NOT NULL DESC, r.created DESC, r.rule_id DESC) AS rn
  FROM (SELECT DISTINCT council, r_code FROM {projects}) s JOIN {rules} r ON r.state = 'approved' AND (r.council IS NULL OR r.council = s.council) AND (r.codes IS NULL OR list_contains(string_split(r.codes, ','), s.r_code))) WHERE rn = 1)"""
_EVALUATED = f"""
(SELECT p.project_id, k.check_key, c.rule_id, f.value AS v, c.threshold AS t, c.operator AS o, f.method,
   CASE WHEN c.rule_id IS NULL THEN 'no_rule' WHEN f.method IS NULL THEN 'no_fact' WHEN f.method = 'assumption' THEN 'assumption' WHEN f.value IS NULL THEN 'no_value'
     WHEN c.threshold IS NULL THEN 'no_threshold' WHEN c.operator = 'range' THEN 'unknown_operator' END AS reason
 FROM {{projects}} p CROSS JOIN (SELECT 'check_' || unnest(range(1, 8)) AS check_key) k
 LEFT JOIN {_CHOSEN} c ON c.council = p.council AND c.r_code = p.r_code AND c.check_key = k.check_key
 LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, fact_type ORDER BY created DESC, tie DESC) AS rn FROM {{facts}}) WHERE rn = 1) f ON f.project_id = p.project_id AND f.fact_type = k.check_key)"""
_STATUS = f"(SELECT project_id, check_key, rule_id, v AS value, CASE WHEN rule_id IS NULL THEN 'unsupported' WHEN reason IS NOT NULL THEN 'needs_more_info' WHEN {_COMPARE} THEN 'pass' ELSE 'fail' END AS status, reason FROM {_EVALUATED})"


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(view(spark, sf_dir, "projects"), view(spark, sf_dir, "facts"), _rules(spark, sf_dir), CHECKS)


@query(f"SELECT * FROM {_STATUS}")
def rule_eval_status(spark, sf_dir):
    """DOM-01, DOM-02, WIN-05, WIN-07, FLT-02, FLT-03, MTH-06."""
    return _evaluated(spark, sf_dir)


@query(f"""SELECT *, CASE WHEN n_fail > 0 THEN 'has_likely_failures' WHEN n_info > 0 THEN 'incomplete' ELSE 'likely_compliant' END AS overall FROM (
SELECT project_id, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'needs_more_info') AS n_info, count(*) FILTER (status = 'unsupported') AS n_unsupported
FROM {_STATUS} GROUP BY project_id)""")
def rule_eval_rollup(spark, sf_dir):
    """DOM-02, AGG-01, AGG-03."""
    return rules.roll_up(_evaluated(spark, sf_dir))


@query(f"SELECT check_key, reason, count(*) AS n FROM {_STATUS} WHERE reason IS NOT NULL GROUP BY 1, 2")
def rule_missing_reason(spark, sf_dir):
    """PRJ-05, AGG-01."""
    return _evaluated(spark, sf_dir).where("reason IS NOT NULL").groupBy("check_key", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT council, r_code, check_key, rule_id FROM {_CHOSEN}")
def rule_scope_filter(spark, sf_dir):
    """FLT-02, FLT-03, JSN-01, WIN-07."""
    return rules.select_rules(_rules(spark, sf_dir), view(spark, sf_dir, "projects")).select("council", "r_code", "check_key", "rule_id")


@query("SELECT check_key, sha256(string_agg(DISTINCT CAST(rule_id AS STRING), '|' ORDER BY CAST(rule_id AS STRING))) AS pack_hash FROM {rules} GROUP BY check_key")
def rule_pack_hash(spark, sf_dir):
    """AGG-21, HSH-01."""
    return rules.pack_hash(view(spark, sf_dir, "rules"), "rule_id", buckets=1)


@query("""SELECT check_key, count(*) AS n_rules, count(DISTINCT council) AS n_councils, min(quote) AS first_quote, arg_max(rule_id, struct_pack(a := length(quote), b := rule_id)) AS longest_rule
FROM {rules} WHERE state = 'approved' AND quote IS NOT NULL GROUP BY check_key HAVING count(*) >= 2""")
def check_derivation(spark, sf_dir):
    """DOM-14, AGG-02, AGG-06, AGG-08, AGG-10."""
    kept = view(spark, sf_dir, "rules").where("state = 'approved' AND quote IS NOT NULL")
    out = kept.groupBy("check_key").agg(F.count(F.lit(1)).alias("n_rules"), F.count_distinct("council").alias("n_councils"), F.min("quote").alias("first_quote"), F.max_by("rule_id", F.struct(F.length("quote"), "rule_id")).alias("longest_rule"))
    return out.where("n_rules >= 2")


@query("SELECT ptype, brand AS top_brand, n FROM (SELECT ptype, brand, count(*) AS n, row_number() OVER (PARTITION BY ptype ORDER BY count(*) DESC, brand) AS rn FROM {rules} GROUP BY 1, 2) WHERE rn = 1")
def most_frequent_value(spark, sf_dir):
    """AGG-07: mode, ties to the smallest value."""
    n = view(spark, sf_dir, "rules").groupBy("ptype", "brand").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("ptype").agg(F.min(F.struct((-F.col("n")).alias("m"), "brand")).alias("t"))
    return top.select("ptype", F.col("t.brand").alias("top_brand"), (-F.col("t.m")).alias("n"))


@query("SELECT check_key, code, n_councils FROM (SELECT check_key, code, count(DISTINCT council) AS n_councils FROM (SELECT *, unnest(string_split(coalesce(codes, 'ALL'), ',')) AS code FROM {rules}) GROUP BY 1, 2) WHERE n_councils > 1")
def cross_instrument_conflicts(spark, sf_dir):
    """AGG-11, AGG-12."""
    rows = view(spark, sf_dir, "rules").withColumn("code", F.explode(F.split(F.coalesce("codes", F.lit("ALL")), ",")))
    return rows.groupBy("check_key", "code").agg(F.count_distinct("council").alias("n_councils")).where("n_councils > 1")


@query("SELECT check_key, codes, n_values FROM (SELECT check_key, coalesce(codes, 'ALL') AS codes, count(DISTINCT coalesce(operator, '') || '/' || coalesce(CAST(CAST(threshold AS BIGINT) AS STRING), '')) AS n_values FROM {rules} GROUP BY 1, 2) WHERE n_values > 1")
def value_disagreements(spark, sf_dir):
    """AGG-13, JSN-07."""
    value = F.concat(F.coalesce("operator", F.lit("")), F.lit("/"), F.coalesce(F.col("threshold").cast("bigint").cast("string"), F.lit("")))
    return view(spark, sf_dir, "rules").groupBy("check_key", F.coalesce("codes", F.lit("ALL")).alias("codes")).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


@query("""SELECT 'RULE-001' AS code, rule_id AS subject_id FROM {rules} WHERE state = 'approved' AND coalesce(trim(quote), '') = ''
UNION ALL SELECT 'RULE-002', rule_id FROM {rules} r WHERE state = 'approved' AND NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_partkey = r.rule_id AND l.l_linenumber = 1)
UNION ALL SELECT 'RULE-003', rule_id FROM {rules} WHERE state = 'approved' AND coalesce(operator NOT IN ('lte', 'gte', 'lt', 'gt', 'eq'), true)""")
def governance_rules(spark, sf_dir):
    """DOM-17 RULE-001..003, JN-05, SET-05, FLT-14."""
    links = view(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("rule_id"))
    return audit.rule_audit(view(spark, sf_dir, "rules"), links)


# Versions and sources


@query("""SELECT 'SRC-001' AS code, version_id AS subject_id FROM {versions} WHERE owner IS NULL
UNION ALL SELECT 'SRC-002', version_id FROM {versions} WHERE due_day IS NULL OR due_day < 200
UNION ALL SELECT 'SRC-003', version_id FROM {versions} WHERE NOT coalesce(approved, false) OR coalesce(restricted, false)
UNION ALL SELECT 'SRC-004', version_id FROM {versions} a WHERE EXISTS (SELECT 1 FROM {versions} b WHERE a.source = b.source AND a.version_id <> b.version_id AND a.valid_from <= b.valid_to AND b.valid_from <= a.valid_to)""")
def governance_sources(spark, sf_dir):
    """DOM-17 SRC-001..004, DT-04, FLT-14."""
    return audit.source_audit(view(spark, sf_dir, "versions"), 200)


@query("""SELECT a.version_id, a.source, count(b.version_id) AS n_overlaps FROM {versions} a LEFT JOIN {versions} b ON a.source = b.source AND a.version_id <> b.version_id AND a.valid_from <= b.valid_to AND b.valid_from <= a.valid_to
WHERE a.valid_from IS NOT NULL GROUP BY 1, 2""")
def window_overlaps(spark, sf_dir):
    """JN-07, DT-09."""
    return tables.overlap_counts(view(spark, sf_dir, "versions"), "source", "version_id", "valid_from", "valid_to")


@query("SELECT source, version_id, owner, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY valid_to DESC, version_id DESC) AS rn FROM {versions}) WHERE rn = 1")
def latest_version(spark, sf_dir):
    """WIN-01..04."""
    return latest.best_by(view(spark, sf_dir, "versions").select("source", "version_id", "owner", "n_chars", "valid_to"), ["source"], ["valid_to", "version_id"]).drop("valid_to")


@query("""SELECT v.version_id, v.source, CASE WHEN v.version_id < n.newest THEN n.newest END AS superseded_by
FROM {versions} v LEFT JOIN (SELECT source, max(version_id) AS newest FROM {versions} WHERE approved GROUP BY source) n ON v.source = n.source""")
def supersede_versions(spark, sf_dir):
    """WIN-06."""
    return latest.supersede(view(spark, sf_dir, "versions").select("version_id", "source", "approved"), "source", "version_id", F.col("approved"), "version_id").select("version_id", "source", "superseded_by")


@query("""SELECT source, count(*) AS n_clauses, count(*) FILTER (r) AS with_rules, count(*) FILTER (c) AS with_candidates, count(*) FILTER (NOT r AND NOT c) AS uncovered FROM (
SELECT source, version_id IN (SELECT l_suppkey * 3 FROM {lineitem}) AS r, version_id IN (SELECT l_partkey FROM {lineitem} WHERE l_linenumber = 2) AS c FROM {versions}) GROUP BY source""")
def coverage_report(spark, sf_dir):
    """JN-03, AGG-02, AGG-03, AGG-23, JN-04."""
    items = view(spark, sf_dir, "lineitem")
    return audit.coverage(view(spark, sf_dir, "versions"), items.select((F.col("l_suppkey") * 3).alias("version_id")), items.where("l_linenumber = 2").select(F.col("l_partkey").alias("version_id")), "source", "version_id")


@query("""SELECT source, state, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT *, CASE WHEN n_chars = 0 THEN 'needs_parsing' WHEN n_chars < 120 THEN 'low_signal' WHEN version_id % 4 = 0 THEN 'needs_citations' WHEN NOT coalesce(approved, false) THEN 'needs_review' ELSE 'ready' END AS state FROM {versions}) GROUP BY 1, 2""")
def readiness_report(spark, sf_dir):
    """DOM-10, AGG-05, AGG-19, FLT-10, PRJ-05."""
    state = corpus.readiness(F.col("n_chars"), F.col("version_id") % 4, F.col("n_chars") < 120, F.col("approved"))
    return view(spark, sf_dir, "versions").groupBy("source", state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT version_id, source, rank FROM (SELECT version_id, source, row_number() OVER (PARTITION BY source ORDER BY due_day NULLS LAST, n_chars DESC, version_id) AS rank FROM {versions} WHERE NOT coalesce(approved, false)) WHERE rank <= 5")
def worklist_topn(spark, sf_dir):
    """SRT-01, SRT-02, SRT-03."""
    rows = view(spark, sf_dir, "versions").where(~F.coalesce("approved", F.lit(False)))
    return latest.rows_per_key(rows, ["source"], [F.asc_nulls_last("due_day"), F.desc("n_chars"), F.col("version_id")], 5).select("version_id", "source", "rank")


@query("SELECT source, n, string_agg(CAST(o AS STRING), ',' ORDER BY o) AS ordinals FROM (SELECT source, n, unnest(CASE WHEN n <= 5 THEN range(1, n + 1) ELSE list_distinct([CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) + 1 FOR i IN range(5)]) END) AS o FROM (SELECT source, count(*) AS n FROM {versions} GROUP BY source)) GROUP BY 1, 2")
def sample_ordinals(spark, sf_dir):
    """SRT-06, MTH-09."""
    n = view(spark, sf_dir, "versions").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "n", F.array_join(tables.sample_ordinals(F.col("n"), 5).cast("array<string>"), ",").alias("ordinals"))


@query("""SELECT version_id, lang FROM (SELECT version_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('s|' || version_id), version_id) AS rn,
greatest(1, round_even(100.0 * count(*) OVER (PARTITION BY lang) / count(*) OVER (), 0)) AS want FROM {versions}) WHERE rn <= want""")
def stratified_sample(spark, sf_dir):
    """SRT-07, SRT-08."""
    return tables.stratified_sample(view(spark, sf_dir, "versions").select("version_id", "lang"), "lang", "version_id", 100)


# Votes and evaluation


@query("SELECT rule_key, operator, value, unit, count(*) AS n_votes, count(DISTINCT family) AS n_families FROM {votes} GROUP BY 1, 2, 3, 4")
def vote_core_groups(spark, sf_dir):
    """AGG-14, MTH-09."""
    return adjudication.core_groups(view(spark, sf_dir, "votes"))


_PATH = """(SELECT rule_key, operator, value, unit, pathway, count(*) AS n, count(DISTINCT family) AS f, count(DISTINCT rule_type) AS n_kinds, count(codes) AS stated,
  count(DISTINCT codes) AS n_sets, count(*) FILTER (coalesce(dwelling, '') NOT IN ('', 'any')) AS specific, count(DISTINCT dwelling) FILTER (dwelling NOT IN ('', 'any')) AS n_dwellings, max(dwelling) FILTER (dwelling NOT IN ('', 'any')) AS dwelling,
  list_sort(list(DISTINCT string_split(codes, ',')) FILTER (codes IS NOT NULL)) AS sets FROM {votes} GROUP BY 1, 2, 3, 4, 5)"""
_KIND = "(SELECT rule_key, operator, value, unit, pathway, arg_min(rule_type, struct_pack(a := -m, b := rule_type)) AS kind FROM (SELECT rule_key, operator, value, unit, pathway, rule_type, count(*) AS m FROM {votes} GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4, 5)"


@query(f"""SELECT rule_key, operator, value, unit, n_votes, outcome, CASE WHEN outcome = 'promote' THEN pathway END AS pathway, CASE WHEN outcome = 'promote' THEN kind END AS rule_type,
CASE WHEN outcome = 'promote' THEN coalesce(array_to_string(list_sort(common), ','), '') END AS codes, CASE WHEN outcome = 'promote' THEN coalesce(dwelling, 'any') END AS dwelling,
CASE WHEN outcome = 'promote' THEN array_to_string(list_sort(marks), ',') END AS dissent, CASE WHEN outcome = 'promote' THEN CASE WHEN len(marks) > 0 THEN 0.85 WHEN n >= 3 THEN 0.95 ELSE 0.9 END END::DOUBLE AS confidence FROM (
SELECT *, CASE WHEN families < 2 THEN 'single_model_family' WHEN next IS NOT NULL AND (n = next OR f < 2) THEN 'pathway_disagreement' WHEN n_sets > 0 AND len(common) = 0 THEN 'density_disagreement' WHEN n_dwellings > 1 THEN 'dwelling_disagreement' ELSE 'promote' END AS outcome,
  list_concat(lost, list_filter([CASE WHEN n_kinds > 1 THEN 'rule_type_mixed' END, CASE WHEN n_sets > 1 THEN 'density_codes_narrowed' END, CASE WHEN stated > 0 AND stated < n THEN 'density_codes_partial' END, CASE WHEN specific > 0 AND specific < n THEN 'dwelling_type_narrowed' END], lambda m: m IS NOT NULL)) AS marks
FROM (SELECT *, CASE WHEN n_sets > 0 THEN list_reduce(sets, lambda a, b: list_intersect(a, b)) END AS common FROM (SELECT p.*, k.kind, c.n_votes, c.families, row_number() OVER w AS rn, lead(p.n) OVER w AS next,
    list_transform(list(p.pathway) OVER (PARTITION BY rule_key, operator, value, unit ORDER BY p.n DESC, p.pathway ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), lambda q: 'pathway_dissent_' || q) AS lost
  FROM {_PATH} p JOIN {_KIND} k USING (rule_key, operator, value, unit, pathway) JOIN (SELECT rule_key, operator, value, unit, count(*) AS n_votes, count(DISTINCT family) AS families FROM {{votes}} GROUP BY 1, 2, 3, 4) c USING (rule_key, operator, value, unit)
  WINDOW w AS (PARTITION BY rule_key, operator, value, unit ORDER BY p.n DESC, p.pathway))) WHERE rn = 1)""")
def vote_adjudicate(spark, sf_dir):
    """AGG-15, DOM-04, SET-02."""
    return adjudication.adjudicate(view(spark, sf_dir, "votes").withColumn("codes", F.split("codes", ",")))


@query("SELECT grp, agreed, n_agree, CASE WHEN n_agree >= 3 THEN 'promote' WHEN n_agree = 2 THEN 'challenge' ELSE 'pending' END AS outcome FROM (SELECT l_orderkey AS grp, l_returnflag AS agreed, count(*) AS n_agree, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM {lineitem} GROUP BY 1, 2) WHERE rn = 1")
def majority_of_three(spark, sf_dir):
    """AGG-16."""
    rows = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), "l_returnflag")
    return adjudication.majority_of_three(rows, "grp", "l_returnflag")


@query("SELECT lang AS suite, count(*) AS total, count(*) FILTER (quality = 1) AS passed, round(count(*) FILTER (quality = 1) / count(*), 4) AS rate, round(count(*) FILTER (quality = 1) / count(*), 4) >= 0.8 AS gate FROM {labels} JOIN {documents} USING (doc_id) GROUP BY lang")
def eval_pass_rate(spark, sf_dir):
    """AGG-17, DOM-18."""
    cases = view(spark, sf_dir, "labels").join(view(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return audit.pass_rates(cases, "lang", F.col("quality") == 1).withColumnRenamed("lang", "suite")


@query("""SELECT *, CASE WHEN hits + extra > 0 THEN round(hits / (hits + extra), 4) END AS precision, CASE WHEN hits + missed > 0 THEN round(hits / (hits + missed), 4) END AS recall FROM (
SELECT coalesce(e.source, a.source) AS source, count(*) FILTER (e.doc_id IS NOT NULL AND a.doc_id IS NOT NULL) AS hits, count(*) FILTER (e.doc_id IS NULL) AS extra, count(*) FILTER (a.doc_id IS NULL) AS missed
FROM (SELECT DISTINCT source, doc_id FROM {documents} JOIN {labels} USING (doc_id) WHERE quality = 0) e FULL JOIN (SELECT DISTINCT source, doc_id FROM {documents} WHERE n_chars < 400) a ON e.source = a.source AND e.doc_id = a.doc_id GROUP BY 1)""")
def parser_precision_recall(spark, sf_dir):
    """AGG-18."""
    docs = view(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return audit.precision_recall(docs.join(view(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id"), docs.where("n_chars < 400"), ["doc_id"], "source")


# Search


_LEX = """(SELECT query_id, doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(t, '[a-z0-9]+')), q)) / len(q) + CASE WHEN contains(t, phrase) THEN 0.25 ELSE 0 END, 6) AS score FROM
 (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM {documents}) CROSS JOIN (SELECT item_id AS query_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS phrase, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM {benchmark})
 WHERE len(list_intersect(list_distinct(regexp_extract_all(t, '[a-z0-9]+')), q)) > 0)"""
_HITS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {_LEX}) WHERE rank <= 5)"


def _hits(spark, sf_dir, k=5):
    queries = view(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return queries, search.lexical_hits(queries, view(spark, sf_dir, "documents"), k)


@query(f"SELECT query_id, doc_id, score, rank FROM {_HITS}")
def lexical_search(spark, sf_dir):
    """FTS-01, FTS-03, STR-01, MTH-04, SET-01, SRT-03."""
    return _hits(spark, sf_dir)[1]


@query(f"SELECT query_id, doc_id, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM {_HITS}) WHERE score >= greatest(0.15, 0.35 * top)")
def lexical_search_floor(spark, sf_dir):
    """FLT-15, WIN-08."""
    return search.relevance_floor(_hits(spark, sf_dir)[1])


@query(f"""SELECT query_id, CASE WHEN n > 0 THEN 'answered' ELSE 'unsupported' END AS status, CASE WHEN n > 0 THEN round(least(0.95, 0.5 + m / 2), 4) ELSE 0 END::DOUBLE AS confidence, coalesce(citations, '') AS citations, coalesce(answer, '') AS answer FROM (
SELECT b.item_id AS query_id, count(h.doc_id) AS n, avg(h.score) AS m, string_agg(CAST(h.doc_id AS STRING), ',' ORDER BY h.rank) AS citations, string_agg(substr(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), 1, 180), ' ' ORDER BY h.rank) AS answer
FROM {{benchmark}} b LEFT JOIN {_HITS} h ON h.query_id = b.item_id AND h.rank <= 4 AND h.score >= 0.5 LEFT JOIN {{documents}} d ON d.doc_id = h.doc_id GROUP BY 1)""")
def cite_or_refuse(spark, sf_dir):
    """DOM-22, MTH-05, AGG-22, PRJ-02."""
    queries, hits = _hits(spark, sf_dir)
    return search.cite_or_refuse(queries, hits.where("score >= 0.5"), view(spark, sf_dir, "documents"))


def _centroids(spark, sf_dir):
    rows = view(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("vector")).select(F.col("label").alias("query_id"), "vector")


@query("""SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT c.label AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v), 4) AS score FROM {embeddings} e CROSS JOIN
(SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {embeddings}) GROUP BY 1, 2) GROUP BY label) c)) WHERE rank <= 5""")
def vector_topk(spark, sf_dir):
    """VEC-01, MTH-01: the vectors nearest to each label's mean."""
    vectors = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return search.top_hits(search.vector_scores(_centroids(spark, sf_dir), vectors), 5)


@query()
def hybrid_search(spark, sf_dir):
    """VEC-02, MTH-03, SRT-04: the best 5 of 25 lexical hits by 0.4 of the lexical score over the query's best and 0.6 of the cosine of hash embeddings."""
    queries, hits = _hits(spark, sf_dir, 5 * 5)
    texts = view(spark, sf_dir, "documents").select("doc_id", N.hash_embedding(F.col("text")).alias("dv"))
    both = hits.join(texts, "doc_id").join(queries.select("query_id", N.hash_embedding(F.col("text")).alias("qv")), "query_id")
    top = F.max("score").over(Window.partitionBy("query_id"))
    blended = both.withColumn("score", F.round(0.4 * F.col("score") / top + 0.6 * F.greatest(F.lit(0.0), N.cosine(F.col("dv"), F.col("qv"))), 6))
    return search.top_hits(blended.select("query_id", "doc_id", "score"), 5)


@query("SELECT doc_id, round(('0x' || substr(sha256(text), 1, 2))::BIGINT / 255.0 * 2 - 1, 6)::DOUBLE AS first, round(('0x' || substr(sha256(text), 31, 2))::BIGINT / 255.0 * 2 - 1, 6)::DOUBLE AS last FROM {documents}")
def hash_embedding(spark, sf_dir):
    """MTH-02, HSH-01, HSH-05."""
    v = N.hash_embedding(F.col("text"), 16)
    return view(spark, sf_dir, "documents").select("doc_id", F.get(v, F.lit(0)).alias("first"), F.get(v, F.lit(15)).alias("last"))


# Text


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS n_distinct, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')) AS n_numbers FROM {documents}")
def text_counts(spark, sf_dir):
    """STR-01, STR-02, STR-17."""
    t = F.col("text")
    return view(spark, sf_dir, "documents").select("doc_id", *[F.size(c).cast("bigint").alias(n) for n, c in (("n_tokens", T.tokens(t)), ("n_distinct", T.token_set(t)), ("n_numbers", T.numbers_in(t)))])


@query()
def paragraph_chunks(spark, sf_dir):
    """DOM-11, its paragraph packer."""
    return corpus.pack_paragraphs(view(spark, sf_dir, "documents").select("doc_id", "text"))


@query("""SELECT clause_id, canonical, round(amount * factor, 6) AS metres, list_contains(regexp_extract_all(quote, '\\d+(?:\\.\\d+)?'), claimed) AS anchored, contains(quote, claimed) AS contained FROM (SELECT *,
CASE unit WHEN 'mm' THEN 'm' WHEN 'sqm' THEN 'm2' ELSE unit END AS canonical, CASE unit WHEN 'mm' THEN 0.001 ELSE 1 END::DOUBLE AS factor FROM {sentences})""")
def claim_checks(spark, sf_dir):
    """MTH-07, STR-17, SET-04: units made canonical; the claimed number as a number of the quote, and as its substring."""
    rows = view(spark, sf_dir, "sentences")
    return rows.select("clause_id", N.canonical_unit(F.col("unit")).alias("canonical"), F.round(N.canonical_value(F.col("amount"), F.col("unit")), 6).alias("metres"), F.array_contains(T.numbers_in(F.col("quote")), F.col("claimed")).alias("anchored"), F.contains("quote", F.col("claimed")).alias("contained"))


@query("SELECT item_id, count(*) FILTER (contains(d.text, b.text)) AS n_anchored FROM {benchmark} b CROSS JOIN {documents} d GROUP BY item_id")
def quote_anchor(spark, sf_dir):
    """JN-13: documents that hold each quote word for word."""
    quotes = view(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = search.quote_hits(quotes, view(spark, sf_dir, "documents")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return quotes.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_anchored"))


@query("""SELECT address_id, trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) AS plain, regexp_extract(trim(regexp_replace(lower(address), '\\s+', ' ', 'g')), '^(?:lot )?([0-9]+)(?: |$)', 1) AS house FROM {addresses}""")
def address_parts(spark, sf_dir):
    """PRJ-01, STR-04."""
    return view(spark, sf_dir, "addresses").select("address_id", T.normalise(F.col("address")).alias("plain"), T.house_number(F.col("address")).alias("house"))


@query("""SELECT expanded, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(address), '\\s+', ' ', 'g')), ' st$', ' street'), ' rd$', ' road'), ' ave$', ' avenue'), ' hwy$', ' highway') AS expanded FROM {addresses}) GROUP BY 1""")
def address_expand(spark, sf_dir):
    """STR-03."""
    return view(spark, sf_dir, "addresses").groupBy(T.expand_street(F.col("address")).alias("expanded")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_nationkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM (SELECT n_nationkey,
list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN regexp_extract_all(lower(n_name), '[a-z0-9]+')])) AS a, list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN regexp_extract_all(lower(r_name), '[a-z0-9]+')])) AS b FROM {nation} JOIN {region} ON n_regionkey = r_regionkey)""")
def trigram_similarity(spark, sf_dir):
    """STR-07."""
    both = view(spark, sf_dir, "nation").join(view(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", F.round(T.trigram_similarity(F.lower("n_name"), F.lower("r_name")), 6).alias("similarity"))


@query("SELECT slug, count(*) AS n FROM (SELECT substr(regexp_replace(lower(p_type || ' & ' || p_brand), '[^a-z0-9]+', '_', 'g'), 1, 40) AS slug FROM {part}) GROUP BY 1")
def slug_groups(spark, sf_dir):
    """STR-12, DOM-13."""
    return view(spark, sf_dir, "part").groupBy(T.slug(F.concat("p_type", F.lit(" & "), F.col("p_brand"))).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT key, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, array_to_string(list_filter(l, lambda w, i: i = 1 OR w <> l[i - 1]), '_') AS key FROM (SELECT p_partkey,
list_transform(regexp_extract_all(lower(p_type || ' and ' || p_type || 's ' || p_brand), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 's') THEN w[1:length(w) - 1] ELSE w END) AS l FROM {part})) GROUP BY key""")
def key_cluster(spark, sf_dir):
    """STR-11, DOM-13: keys of one normal form, with their number and least member."""
    keys = view(spark, sf_dir, "part").select("p_partkey", T.rule_key(F.concat("p_type", F.lit(" & "), F.col("p_type"), F.lit("s "), F.col("p_brand"))).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM {pages}")
def url_parts(spark, sf_dir):
    """STR-15."""
    return view(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query()
def html_text(spark, sf_dir):
    """SRC-09."""
    return readers.html_text(view(spark, sf_dir, "pages")).withColumn("links", F.array_join("links", " "))


@query("""SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) || ' ', '') || text AS question FROM {conversations} WHERE role = 'user'""")
def conversation_query(spark, sf_dir):
    """STR-20: each user turn behind the one before it."""
    rows = view(spark, sf_dir, "conversations").where("role = 'user'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    return rows.select("conv_id", "turn", F.concat(F.coalesce(F.concat(before, F.lit(" ")), F.lit("")), F.col("text")).alias("question"))


# Tables


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1 FROM {orders} WHERE o_orderkey % 10 = 0")
def upsert_merge(spark, sf_dir):
    """SNK-01, JN-17."""
    old = view(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return tables.upsert(old, new, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'N' FROM {orders} WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0")
def insert_ignore(spark, sf_dir):
    """SNK-02."""
    rows = view(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return tables.insert_ignore(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])


@query("SELECT doc_id, source FROM {documents} WHERE source NOT IN (SELECT source FROM {documents} WHERE doc_id = 7) UNION ALL SELECT -doc_id, source FROM {documents} WHERE source IN (SELECT source FROM {documents} WHERE doc_id = 7)")
def replace_by_key(spark, sf_dir):
    """SNK-03."""
    rows = view(spark, sf_dir, "documents").select("doc_id", "source")
    new = rows.join(rows.where("doc_id = 7").select("source"), "source", "left_semi").select((-F.col("doc_id")).alias("doc_id"), "source")
    return tables.replace_by_key(rows, new, "source")


@query("SELECT c_custkey, coalesce(s.s_name, n.n_name, 'none') AS resolved FROM {customer} c LEFT JOIN {supplier} s ON s.s_suppkey = c.c_custkey AND s.s_acctbal > 0 LEFT JOIN {nation} n ON n.n_nationkey = c.c_custkey")
def alias_cascade(spark, sf_dir):
    """JN-14, JN-02."""
    side = view(spark, sf_dir, "supplier").where("s_acctbal > 0")
    found = tables.cascade(view(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", [(side, "s_suppkey", "s_name"), (view(spark, sf_dir, "nation"), "n_nationkey", "n_name")], "resolved")
    return found.withColumn("resolved", F.coalesce("resolved", F.lit("none")))


# Places


def _boxes(spark, sf_dir):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return view(spark, sf_dir, "boxes").select("box_id", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("ring"))


@query("SELECT point_id, box_id FROM {points} JOIN {boxes} ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def point_in_polygon(spark, sf_dir):
    """JN-10."""
    return geo.point_join(view(spark, sf_dir, "points"), _boxes(spark, sf_dir), 4.0).select("point_id", "box_id")


@query("""SELECT point_id, box_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 6), box_id) AS rn FROM (SELECT point_id, box_id,
sqrt(greatest(x0 - x, 0, x - x1) ** 2 + greatest(y0 - y, 0, y - y1) ** 2) AS distance FROM {points} JOIN {boxes} ON x BETWEEN x0 - 2 AND x1 + 2 AND y BETWEEN y0 - 2 AND y1 + 2) WHERE distance <= 2) WHERE rn = 1""")
def nearest_within(spark, sf_dir):
    """JN-11, JN-09."""
    return geo.nearest_polygon(view(spark, sf_dir, "points"), _boxes(spark, sf_dir), 4.0, 2.0, "box_id").select("point_id", "box_id", "distance")


@query("SELECT box_id, (x1 - x0) * (y1 - y0) AS area, x1 - x0 AS width, y1 - y0 AS depth, greatest(x1 - x0, y1 - y0) AS longest_edge FROM {boxes}")
def ring_metrics(spark, sf_dir):
    """MTH-11."""
    return _boxes(spark, sf_dir).select("box_id", *[c.alias(n) for n, c in geo.metrics(F.col("ring")).items()])


# Ledger and events


@query("SELECT day, count(*) AS n_calls, sum(cents)::BIGINT AS cents, count(DISTINCT user_id) AS n_users FROM {spend} GROUP BY day")
def spend_daily(spark, sf_dir):
    """AGG-04, DT-01, WIN-12."""
    return audit.daily_spend(view(spark, sf_dir, "spend"))


@query("SELECT user_id, day, least(count(*), 3) AS admitted, greatest(count(*) - 3, 0) AS refused FROM {spend} GROUP BY 1, 2")
def quota_counters(spark, sf_dir):
    """DOM-20."""
    return audit.quota(view(spark, sf_dir, "spend"), ["user_id", "day"], 3)


@query("SELECT * FROM (SELECT event_id, user_id, cents, lag(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {spend}) WHERE cents < before")
def counter_regressions(spark, sf_dir):
    """STM-08."""
    rows = view(spark, sf_dir, "spend").select("event_id", "user_id", "cents", F.struct("ts", "event_id").alias("at"))
    return audit.regressions(rows, "user_id", "at", "cents").drop("at")


@query("SELECT event_id, event_type, rank FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM {spend} WHERE event_id % 4 = 0 OR ts + INTERVAL 30 MINUTE < TIMESTAMP '2024-01-10 00:00:00') WHERE rank <= 20")
def lease_eligible(spark, sf_dir):
    """STM-02, DT-06, FLT-12."""
    lease = F.when(F.col("event_id") % 4 != 0, F.expr("ts + INTERVAL 30 MINUTES"))
    return audit.claimable(view(spark, sf_dir, "spend").withColumn("lease_until", lease), "2024-01-10 00:00:00", 20, "event_type").select("event_id", "event_type", "rank")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (k >= 50) AS high, count(*) FILTER (k IS NULL) AS missing FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}) GROUP BY 1")
def json_fields(spark, sf_dir):
    """JSN-02, FLT-12, PRJ-04, JSN-03."""
    rows = view(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") >= 50).alias("high"), F.count_if(F.col("k").isNull()).alias("missing"))


def _stream(spark, sf_dir, window, keys, name):
    out = windows.run_available(windows.windowed(windows.events_stream(spark, sf_dir), window, keys), shared_path(spark, name))
    local = lambda c: F.col(c).cast("timestamp_ntz")
    return out.select(local("w.start").alias("start"), local("w.end").alias("end"), *keys, "n")


@query("""SELECT date_trunc('day', ts) AS "start", date_trunc('day', ts) + INTERVAL 1 DAY AS "end", event_type, count(*) AS n FROM {events} GROUP BY 1, 2, 3""")
def stream_tumbling(spark, sf_dir):
    """STM-06."""
    return _stream(spark, sf_dir, F.window("at", "1 day"), ["event_type"], "tumbling")


@query("""SELECT s AS "start", s + INTERVAL 1 DAY AS "end", event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS s FROM {events}) GROUP BY 1, 2, 3""")
def stream_sliding(spark, sf_dir):
    """STM-06."""
    return _stream(spark, sf_dir, F.window("at", "1 day", "12 hours"), ["event_type"], "sliding")


@query("""SELECT min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM {events})) GROUP BY user_id, g""")
def stream_session(spark, sf_dir):
    """STM-06: sessions that end after six quiet hours."""
    return _stream(spark, sf_dir, F.session_window("at", "6 hours"), ["user_id"], "session")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_linestatus)::INT AS total FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def sql_rollup(spark, sf_dir):
    """Engine surface: rollup."""
    rows = view(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping("l_linestatus").cast("int").alias("total"))


from . import compliance, domain, extraction, retrieval, scalars  # noqa: E402, F401 - they add their queries
