"""Queries of measurements, robots rules, key clusters, review findings and manifests, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embedding, findings, manifest, search
from ..operators import derivation as D
from ..operators import keys as K
from ..operators import measurements as M
from ..sources import readers, robots
from ..sources.scratch import shared_path
from .catalog import query
from .views import view

# Measurements. RE2 knows ASCII edges of words only, so the planted phrases are ASCII; tests compare others with a plain version.


def _first_facts(patterns: list[M.Pattern]) -> str:
    """SQL of the facts of `plans`, first of equal ones; each match's value is found again within the match."""
    ascii_ = lambda s: s.replace(M.EDGE, r"\b").replace("m²|", "").replace("'", "''")
    found = []
    for n, p in enumerate(patterns):
        side = f"lower(regexp_extract(m, '(?i){ascii_(p.before)}', 1))"
        named = f"CASE rtrim({side}, 'n') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.SIDE_NAMES.items()) + f" ELSE {side} END"
        key = "'" + p.key.replace("%s", f"' || {named} || '") + "'"
        value = f"regexp_extract(m, '(?is)^{ascii_(p.before)}({ascii_(p.value)}){ascii_(p.behind)}$', {1 + p.before.count('(') - p.before.count('(?')})"
        number, words = (f"CAST({value} AS DOUBLE)", "NULL") if p.unit else ("NULL", f"trim(regexp_replace({value}, '\\s+', ' ', 'g'))")
        whole = f"(?i){ascii_(p.before)}(?:{ascii_(p.value)}){ascii_(p.behind)}" + (r"\b" if p.edge else "")
        unit = f"'{p.unit}'" if p.unit else "NULL"
        found.append(f"SELECT doc_id, {n} AS pattern, i, {key} AS fact_key, {number}::DOUBLE AS value, {words}::VARCHAR AS text_value, {unit}::VARCHAR AS unit, {p.confidence}::DOUBLE AS confidence, m AS source_text FROM (SELECT doc_id, unnest(a) AS m, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{whole}') AS a FROM {{plans}}))")
    return f"""SELECT doc_id, fact_key, value, text_value, unit, confidence, source_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, fact_key, value, lower(text_value) ORDER BY pattern, i) AS k
FROM ({' UNION ALL '.join(found)}) WHERE unit IS NOT NULL OR text_value <> '') WHERE k = 1"""


@query(_first_facts(M.PATTERNS))
def plan_measurements(spark, sf_dir):
    """STR-16: measurements and title blocks of every document, with planted phrases."""
    return M.measurements(view(spark, sf_dir, "plans")).drop("start", "end")


# Key clusters


@query("""SELECT 'key-' || lpad(CAST(row_number() OVER (ORDER BY norm) AS VARCHAR), 5, '0') AS cluster_id, norm, norm AS canonical, string_agg(rule_key, ',' ORDER BY lower(rule_key), rule_key) AS rule_keys, sum(n)::BIGINT AS total
FROM (SELECT rule_key, norm, sum(candidate_count) AS n FROM {key_rows} GROUP BY 1, 2) WHERE norm <> '' GROUP BY norm""")
def key_clusters(spark, sf_dir):
    """DOM-13: clusters by normal form, with dense ids, their keys and candidates."""
    rows = K.cluster_keys(view(spark, sf_dir, "key_rows").select("rule_key", "candidate_count"))
    return rows.withColumn("rule_keys", F.array_join("rule_keys", ",")).withColumn("total", F.col("total").cast("bigint"))


_SEEDS = ["site_area", "open_space"]


@query("""WITH sums AS (SELECT rule_key, norm, sum(candidate_count) AS n FROM {key_rows} GROUP BY 1, 2),
concepts AS (SELECT norm FROM sums WHERE norm <> '' GROUP BY norm HAVING sum(n) >= 400 UNION SELECT unnest(['site_area', 'open_space'])),
targets AS (SELECT norm AS t FROM (SELECT norm, count(*) AS n FROM {key_rows} WHERE approved AND norm <> '' GROUP BY 1 HAVING count(*) >= 5) WHERE NOT contains(norm, 'fee') UNION SELECT unnest(['site_area', 'open_space'])),
members AS (SELECT DISTINCT cluster, rule_key, norm, CASE WHEN norm = '' THEN rule_key ELSE norm END AS own, n FROM {key_rows} JOIN sums USING (rule_key, norm)),
tops AS (SELECT cluster, arg_min(own, struct_pack(a := -n, b := length(norm), c := own)) AS top, count(DISTINCT CASE WHEN norm IN (SELECT norm FROM concepts) THEN norm END) AS k, count(*) AS size FROM members GROUP BY cluster),
told AS (SELECT *, k < 2 AND size > 1 AND top IN (SELECT t FROM targets) AND len(list_filter(string_split(top, '_'), lambda x: NOT list_contains(string_split(own, '_'), x))) = 0
  AND len(list_filter(string_split(own, '_'), lambda x: NOT list_contains(string_split(top, '_'), x) AND NOT regexp_matches(x, '^(r[0-9]+|sl|ac[0-9]*|[0-9]+|min|max|avg)$'))) = 0 AS takes FROM members JOIN tops USING (cluster))
SELECT cluster, rule_key, n::BIGINT AS n, CASE WHEN k < 2 AND (size = 1 OR takes) THEN top ELSE own END AS canonical, CASE WHEN k >= 2 THEN 'split' WHEN size = 1 THEN 'single' WHEN takes THEN 'absorbed' ELSE 'reverted' END AS fate FROM told""")
def key_absorption(spark, sf_dir):
    """DOM-13: representatives, anchors, the collision guard and absorption by established keys."""
    rows = view(spark, sf_dir, "key_rows")
    keys = rows.select("rule_key", "candidate_count")
    approved = rows.where("approved AND norm <> ''").select(F.col("norm").alias("canonical"))
    return K.assign_keys(keys, rows.select("cluster", "rule_key"), K.anchors(keys, _SEEDS, 400), K.established(approved, _SEEDS)).withColumn("n", F.col("n").cast("bigint"))


# Robots rules and URLs


@query("""WITH rules AS (SELECT host, unnest(['/fr', '/fr/8', '/en/', '/en/8', '/de/1']) AS prefix, unnest([1, 2, 3, 4, 5]) AS ordinal, unnest(['disallow', 'allow', 'disallow', 'allow', 'disallow']) AS kind FROM {hosts} WHERE h % 3 <> 2 UNION ALL SELECT host, '/', 0, 'disallow' FROM {hosts} WHERE h % 3 = 1),
paged AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, url FROM {pages}),
best AS (SELECT page_id, arg_max(kind, struct_pack(a := length(prefix), b := -ordinal)) AS kind FROM paged JOIN rules USING (host) WHERE starts_with(path, prefix) GROUP BY page_id)
SELECT page_id, host, coalesce(kind = 'allow', true) AS allowed, NOT regexp_matches(lower(url), 'login|signin|password|private|cart|checkout|captcha') AS public,
  coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(path, '/+$', ''), '[^/]*$'), '\\.(aspx|html|htm|pdf|docx|doc)$', ''), '-|_|%20', ' ', 'g')), ''), url) AS title
FROM paged LEFT JOIN best USING (page_id)""")
def robots_verdicts(spark, sf_dir):
    """STR-15: the longest robots prefix of every page's path, whether a URL is public, and its title."""
    body = F.concat(
        F.lit("User-agent: other\nDisallow: /zz\n# note\nUser-Agent: *\n"), F.when(F.col("h") % 3 == 1, "Disallow: /\n").otherwise("Disallow:\n"),
        F.when(F.col("h") % 3 != 2, "Disallow: /fr # all\nAllow: /fr/8\ndisallow: /en/\nAllow : /en/8\nDISALLOW: /de/1\n").otherwise(""), F.lit("User-agent: other\nAllow: /fr/99\nnonsense"),
    )
    found = robots.rules(view(spark, sf_dir, "hosts").select("host", body.alias("body")), agent="plumbline")
    pages = robots.allowed(view(spark, sf_dir, "pages").select("page_id", "url"), found)
    return pages.select("page_id", "host", "allowed", robots.is_public(F.col("url")).alias("public"), robots.title_of(F.col("url")).alias("title"))


# Evidence and embeddings


@query("""WITH blocks AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS b FROM {documents} WHERE text IS NOT NULL),
norm AS (SELECT doc_id, b, trim(regexp_replace(lower(t), '[\\s]+', ' ', 'g')) AS has FROM blocks),
asked AS (SELECT doc_id * 2 + k AS fact_id, doc_id, CASE WHEN k = 0 THEN trim(regexp_replace(lower(string_split(text, chr(10))[-1]), '[\\s]+', ' ', 'g')) ELSE 'nowhere to be found ' || doc_id END AS need FROM {documents}, (VALUES (0), (1)) v(k) WHERE text IS NOT NULL),
first AS (SELECT fact_id, min(b) AS b FROM asked JOIN norm USING (doc_id) WHERE need <> '' AND contains(has, need) GROUP BY fact_id)
SELECT fact_id, CASE WHEN b % 4 <> 3 THEN b::INT END AS block_number, CASE WHEN b % 4 <> 3 THEN '0,' || b END AS bbox FROM asked LEFT JOIN first USING (fact_id)""")
def evidence_blocks(spark, sf_dir):
    """DOM-28: the first line of each document that holds the text of a fact, if that line has a place."""
    docs = view(spark, sf_dir, "documents").where("text IS NOT NULL")
    blocks = docs.select("doc_id", F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("block_number", "text"))
    blocks = blocks.withColumn("bbox", F.when(F.col("block_number") % 4 != 3, F.concat(F.lit("0,"), F.col("block_number").cast("string"))))
    last = F.concat(F.lit("  "), F.translate(F.element_at(F.split("text", "\n"), -1), "aeinrst", "AEINRST"))
    texts = F.posexplode(F.array(last, F.concat(F.lit("nowhere to be found "), F.col("doc_id").cast("string")))).alias("k", "source_text")
    facts = docs.select("doc_id", F.lit(1).alias("page"), texts).withColumn("fact_id", F.col("doc_id") * 2 + F.col("k"))
    return search.evidence_blocks(facts, blocks)


@query("""SELECT doc_id AS chunk_id, doc_id % 3 <> 0 AS fresh, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) END AS first, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 8 END AS size
FROM (SELECT doc_id, list_transform(range(8), lambda i: ('0x' || substr(sha256(coalesce(text, '')), 2 * i::INT + 1, 2))::BIGINT / 255.0) AS v FROM {documents})""")
def embed_stale(spark, sf_dir):
    """UDF-EmbeddingProvider: documents without a vector, or with one of another model, are embedded by a local provider."""
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    provider = embedding.HashProvider(8)
    model = F.when(F.col("chunk_id") % 3 == 0, provider.model).otherwise("older")
    stored = docs.where("chunk_id % 3 <> 2").select("chunk_id", F.array(F.lit(0.5)).alias("embedding"), F.lit(provider.provider).alias("embedding_provider"), model.alias("embedding_model"))
    out = embedding.embed_stale(docs, stored, provider)
    return out.select("chunk_id", "fresh", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.size("embedding").alias("size"))


# Review findings


def _finding_sql(role: str, rows: str, target: str, claim: str, quote: str, severity: str) -> str:
    return f"SELECT '{role}' AS agent_role, {target} AS target, {claim} AS claim, {quote} AS evidence_quote, '{severity}' AS severity FROM ({rows})"


@query(" UNION ALL ".join([
    _finding_sql("gap_hunter", "SELECT * FROM {manifest_rows} WHERE status IN ('pending', 'blocked') ORDER BY status, category, instrument_name, manifest_id LIMIT 40", "'target_manifest:' || manifest_id", "'Manifest row remains ' || status || ' and cannot support answers: ' || instrument_name", "instrument_name", "major"),
    _finding_sql("re_extractor", "SELECT * FROM {clauses} WHERE disposition = 'rule_bearing' AND clause_key % 9 <> 0", "'clause:' || clause_key", "'Rule-bearing clause has no rule atom: version ' || version_id || CASE WHEN clause_key % 4 <> 0 THEN ' ' || clause_key || '.1' ELSE '' END", "text", "critical"),
    _finding_sql("prosecutor", "SELECT * FROM {results} WHERE status IN ('likely_pass', 'likely_fail') AND (citations IS NULL OR trace IS NULL) ORDER BY run_id DESC, result_id LIMIT 50", "'check_result:' || result_id", "status || ' check result lacks required citation or decision trace for check_' || result_id % 8", "CASE WHEN trace IS NULL THEN '{{}}' ELSE '{{\"s\":1}}' END", "critical"),
    _finding_sql("conflict_prosecutor", "SELECT rule_key, codes, string_agg(DISTINCT 'title ' || source_id, '; ' ORDER BY 'title ' || source_id) AS titles, min(quote) AS quote FROM (SELECT split_part(rule_key, '.', 1) AS rule_key, pathway, coalesce(codes, 'ALL') AS codes, source_id, quote FROM {legal} WHERE state = 'approved') GROUP BY rule_key, pathway, codes HAVING count(DISTINCT source_id) > 1 AND count(*) > 1", "'rule_key:' || rule_key || ':' || codes", "'Multiple instruments provide approved rules for ' || rule_key || ' without a demonstrated single winner.'", "min(titles || ' :: ' || quote)", "major").replace("HAVING count(DISTINCT source_id) > 1 AND count(*) > 1)", "HAVING count(DISTINCT source_id) > 1 AND count(*) > 1) GROUP BY rule_key, codes"),
]))
def review_findings(spark, sf_dir):
    """DOM-25: findings of the four finders, two of them cut at their limits; one row an id."""
    clauses = view(spark, sf_dir, "clauses").withColumn("clause_id", F.col("clause_key")).withColumn("title", F.concat(F.lit("version "), F.col("version_id").cast("string")))
    clauses = clauses.withColumn("clause_path", F.when(F.col("clause_key") % 4 != 0, F.concat(F.col("clause_key").cast("string"), F.lit(".1"))))
    results = view(spark, sf_dir, "results").withColumns({"created": F.col("run_id"), "check_key": F.concat(F.lit("check_"), (F.col("result_id") % 8).cast("string")), "trace": F.when(F.col("trace").isNull(), "{}").otherwise('{"s":1}')})
    legal = view(spark, sf_dir, "legal").withColumns({"rule_key": F.split_part("rule_key", F.lit("."), F.lit(1)), "council": F.lit(None).cast("string"), "title": F.concat(F.lit("title "), F.col("source_id").cast("string"))})
    found = findings.one_per_id(
        findings.gap_hunter(view(spark, sf_dir, "manifest_rows"), 3, 40), findings.re_extractor(clauses, clauses.where("clause_key % 9 = 0"), 3),
        findings.prosecutor(results, 3, 50), findings.conflict_prosecutor(legal, 3),
    )
    return found.drop("id", "round", "status")


# Manifests


@query("""SELECT manifest_id, CASE WHEN d = 'kept' THEN status WHEN d = 'fragment' THEN 'out_of_scope' WHEN source_id IS NOT NULL THEN 'acquired' ELSE 'blocked' END AS recommended, source_id FROM (
SELECT manifest_id, status, d, CASE d WHEN 'alias' THEN (SELECT min(p_partkey) FROM {part} WHERE lower(p_name) = regexp_replace(regexp_replace(lower(instrument_name), '^((the|authority|western australia) +)+', ''), '  +', ' ', 'g'))
  WHEN 'fragment' THEN (SELECT min(p_partkey) FROM {part} WHERE ends_with(' ' || lower(instrument_name), ' ' || lower(p_name))) END AS source_id FROM (
SELECT *, CASE WHEN status <> 'blocked' THEN 'kept' WHEN regexp_matches(lower(instrument_name), 'amendment|commencement|reprint of|operation of|forms ') OR regexp_matches(lower(instrument_name), '^(iii of |when |wiluna |yelbeni )') THEN 'fragment' ELSE 'alias' END AS d FROM {manifest_rows}))""")
def manifest_reconcile(spark, sf_dir):
    """DOM-26: blocked manifest rows against titles: fragments, names that equal a title, names with another beginning."""
    titles = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title"))
    return manifest.reconcile(view(spark, sf_dir, "manifest_rows"), titles)


@query("""SELECT manifest_id, CASE WHEN reason = 'standard' THEN 'metadata_only' WHEN reason IN ('fragment', 'scope') THEN 'out_of_scope' WHEN reason = 'url' THEN 'pending' ELSE 'blocked' END AS recommended, reason FROM (
SELECT manifest_id, CASE WHEN category = 'standard' OR regexp_matches(lower(instrument_name), 'as |as/nzs|australian standard|standards australia') THEN 'standard'
  WHEN category IN ('act', 'regulations') AND regexp_matches(lower(instrument_name), 'amendment|commencement|citation published|repeal|reprint of|validation|savings|transitional|^act and the |^despite the ') THEN 'fragment'
  WHEN category IN ('act', 'regulations') AND NOT regexp_matches(lower(instrument_name), 'planning|development|r-codes|residential design codes|region scheme|subdivision|building|bushfire|heritage') THEN 'scope'
  WHEN coalesce(trim(canonical_url), '') <> '' THEN 'url' ELSE 'no_url' END AS reason FROM {manifest_rows})""")
def manifest_triage(spark, sf_dir):
    """DOM-26: what becomes of pending rows."""
    return manifest.triage(view(spark, sf_dir, "manifest_rows"))


@query("""WITH e AS (SELECT page_id, 'Page ' || page_id % 40 AS title, CASE WHEN page_id % 5 <> 0 THEN 'Albany' ELSE 'Perth' END AS lga FROM {pages}),
o AS (SELECT *, lga <> 'Albany' AS skip, page_id % 11 = 0 AS untitled FROM e), f AS (SELECT *, NOT skip AND NOT untitled AS ok FROM o)
SELECT count(DISTINCT title) FILTER (ok AND title <> 'Page 7')::BIGINT AS imported, (count(*) FILTER (ok) - count(DISTINCT title) FILTER (ok AND title <> 'Page 7'))::BIGINT AS duplicates, count(*) FILTER (skip)::BIGINT AS skipped, count(*) FILTER (NOT skip AND untitled)::BIGINT AS refused FROM f""")
def manifest_import(spark, sf_dir):
    """SRC-17: a YAML manifest, written and read back: imported, duplicate, skipped and refused entries."""
    path, k = shared_path(spark, "manifest"), F.col("page_id")
    title = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("Page "), (k % 40).cast("string")))
    lines = F.concat(
        F.lit("- title: '"), title, F.lit("'\n  local_government: "), F.when(k % 5 != 0, "Albany").otherwise('"Perth"'), F.lit(" # council\n  licence_notes: 'Found in a directory.\n    Verify: it''s\n    public'\n  canonical_url: http://x.example.org/a#b\n  scrape_allowed: true"),
    )
    view(spark, sf_dir, "pages").select(lines).write.text(path)
    entries = readers.yaml_entries(spark, path)
    known = manifest.import_entries(entries.where(F.col("fields")["title"] == "Page 7"), entries.select(F.lit("").alias("identity")).limit(0)).select("identity")
    return manifest.import_report(manifest.import_entries(entries, known, "albany "))


# Derived checks and clauses

_FACT_CASE = " ".join(f"WHEN contains(k, '{w}') THEN '{','.join(v)}'" for w, v in D.FACTS)
_UNIT_CASE = "CASE lower(unit) " + " ".join(f"WHEN '{u}' THEN '{e}'" for u, e in D.UNIT_ENDS.items()) + " ELSE 'count' END"


@query(f"""WITH kept AS (SELECT * FROM {{derivable}} WHERE state = 'approved' AND trim(canonical) <> ''),
units AS (SELECT canonical, arg_min(unit, struct_pack(a := -n, b := unit)) AS unit FROM (SELECT canonical, coalesce(unit, '') AS unit, count(*) AS n FROM kept GROUP BY 1, 2) GROUP BY 1),
sources AS (SELECT canonical, arg_min(s, struct_pack(a := -n, b := s)) AS source FROM (SELECT canonical, CAST(source_version_id AS STRING) AS s, count(*) AS n FROM kept WHERE source_version_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
sums AS (SELECT canonical, count(*) AS n, arg_min(quote, struct_pack(a := -length(quote), b := quote)) FILTER (quote IS NOT NULL) AS quote FROM kept GROUP BY 1 HAVING count(*) >= 5),
told AS (SELECT trim(canonical) AS k, n, trim(unit) AS unit, coalesce(source, '') AS source, substr(trim(replace(coalesce(quote, ''), chr(10), ' ')), 1, 140) AS q FROM sums JOIN units USING (canonical) LEFT JOIN sources USING (canonical))
SELECT k AS check_key, CASE WHEN n >= 20 THEN 'TIER1' ELSE 'TIER2' END AS tier, CASE {" ".join(f"WHEN contains(k, '{w}') THEN '{c}'" for w, c in D.CATEGORIES)} ELSE 'OTHER' END AS category, unit,
  CASE {_FACT_CASE} ELSE 'proposed_' || k || '_' || {_UNIT_CASE} END AS fact_keys, n AS n_approved,
  'Advisory check derived from ' || n || ' approved rules for ''' || replace(k, '_', ' ') || '''.' || CASE WHEN source <> '' THEN ' Most-cited source_version ' || source || '.' ELSE '' END || CASE WHEN q <> '' THEN ' e.g. "' || q || '"' ELSE '' END AS description
FROM told WHERE regexp_matches(k, '^[a-z][a-z0-9_]{{{{2,160}}}}$') AND k NOT IN ('site_cover', 'wall_height') AND NOT regexp_matches(k, '{"|".join(K.NO_RULES)}')""")
def derived_checks(spark, sf_dir):
    """DOM-14, AGG-07, AGG-08, AGG-10: derived checks with tier, category, unit, facts and description."""
    out = D.derive_checks(view(spark, sf_dir, "derivable"), ["site_cover", "wall_height"])
    return out.withColumn("fact_keys", F.array_join("fact_keys", ","))


_MARK = D.CLAUSE_MARK


@query(rf"""WITH cut AS (SELECT version_id, chunk_index, text, regexp_extract_all(text, '{_MARK}', 1) AS paths, regexp_extract_all(text, '{_MARK}') AS marks, string_split(regexp_replace(text, '{_MARK}', '<|cut|>', 'g'), '<|cut|>') AS b FROM {{chunks}}),
parts AS (SELECT version_id, chunk_index, unnest(CASE WHEN len(marks) = 0 THEN [struct_pack(o := 0, path := 'chunk-' || chunk_index, key := 'full', body := text)]
  ELSE list_concat(CASE WHEN b[1] <> '' THEN [struct_pack(o := 0, path := 'chunk-' || chunk_index, key := 'intro', body := b[1])] ELSE [] END,
    list_transform(marks, lambda m, i: struct_pack(o := i::INT, path := paths[i], key := regexp_replace(paths[i], '[^A-Za-z0-9]+', '_', 'g'), body := m || b[i + 1]))) END) AS p FROM cut),
told AS (SELECT version_id, chunk_index, p.o AS o, p.path AS clause_path, 'chunk_' || CASE WHEN chunk_index < 1000 THEN lpad(chunk_index::VARCHAR, 3, '0') ELSE chunk_index::VARCHAR END || '_' || p.key AS clause_key, regexp_replace(p.body, '^\s+|\s+$', '', 'g') AS t FROM parts),
kept AS (SELECT *, row_number() OVER (PARTITION BY version_id, clause_key ORDER BY chunk_index DESC, o DESC) AS k FROM told WHERE length(regexp_replace(t, '\s+', ' ', 'g')) >= 30)
SELECT version_id, clause_key, clause_path, CASE WHEN regexp_matches(lower(t), '{"|".join(D.RULE_WORDS)}') THEN 'rule_bearing' WHEN regexp_matches(substr(lower(t), 1, 200), '\bmeans\b|\bis defined\b') THEN 'definition'
  WHEN regexp_matches(lower(t), '{"|".join(D.PROCEDURE_WORDS)}') THEN 'procedural' ELSE 'informational' END AS disposition, sha256(t) AS text FROM kept WHERE k = 1""")
def clause_pass(spark, sf_dir):
    """DOM-12, WIN-10, PRJ-05: clauses of every document as a chunk, with planted marks; texts by their digest."""
    return D.clause_pass(view(spark, sf_dir, "chunks")).withColumn("text", F.sha2("text", 256))
