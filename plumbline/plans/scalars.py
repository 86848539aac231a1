"""Queries of column expressions: units, names, JSON, dates, ids and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import ids as I
from ..functions import json as J
from ..functions import numbers as N
from ..functions import text as T
from ..operators import graph
from .catalog import query
from .views import view

_KIND = "CASE coalesce(nullif(trim(operator), ''), 'lte') WHEN '>=' THEN 'gte' WHEN '<=' THEN 'lte' WHEN '==' THEN 'eq' ELSE coalesce(nullif(trim(operator), ''), 'lte') END"


@query(f"""SELECT id, CASE WHEN ok IS NOT NULL AND (isnan(value) OR isnan(threshold)) THEN false ELSE ok END AS ok FROM (SELECT *, CASE {_KIND} WHEN 'lte' THEN value <= threshold WHEN 'gte' THEN value >= threshold WHEN 'lt' THEN value < threshold WHEN 'gt' THEN value > threshold WHEN 'eq' THEN value = threshold END AS ok FROM {{measures}})""")
def compare_edges(spark, sf_dir):
    """MTH-06: null and blank operators, unknown ones, NaN and missing numbers."""
    return view(spark, sf_dir, "measures").select("id", N.compare(F.col("value"), F.col("operator"), F.col("threshold")).alias("ok"))


@query("""SELECT id, CASE lower(trim(unit)) WHEN 'mm' THEN 'm' WHEN 'square metres' THEN 'm2' WHEN '%' THEN '%' WHEN 'per cent' THEN '%' WHEN 'db' THEN 'dB' WHEN 'ha' THEN 'm2' ELSE unit END AS canonical,
value * CASE lower(trim(unit)) WHEN 'mm' THEN 0.001 WHEN 'ha' THEN 10000.0 ELSE 1.0 END::DOUBLE AS amount, coalesce(value > 0 AND NOT isnan(value) AND NOT isinf(value), false) AS positive,
value * CASE code WHEN 1 THEN 0.0254 WHEN 2 THEN 0.3048 WHEN 4 THEN 0.001 WHEN 5 THEN 0.01 WHEN 7 THEN 1000.0 WHEN 10 THEN 0.9144 ELSE 1.0 END::DOUBLE AS metres, CASE WHEN code IN (1, 2, 4, 5, 6, 7, 10) THEN 1.0 ELSE 0.4 END::DOUBLE AS most,
CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE ceil(value * 1500 / 1000)::BIGINT END AS cents FROM {measures}""")
def unit_edges(spark, sf_dir):
    """MTH-07, MTH-08, MTH-10, MTH-13: unknown units pass through, unknown drawing codes cap confidence."""
    value, length = F.col("value"), N.drawing_length(F.col("value"), F.col("code"))
    cents = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), N.cost_cents(value, F.lit(1500)))
    return view(spark, sf_dir, "measures").select("id", N.canonical_unit(F.col("unit")).alias("canonical"), N.canonical_value(value, F.col("unit")).alias("amount"), N.finite_positive(value).alias("positive"), length["metres"].alias("metres"), length["most"].alias("most"), cents.cast("bigint").alias("cents"))


_TITLE = lambda x: f"array_to_string(list_transform(string_split(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_BEHIND, _BEFORE = "(?i)^(.*?)[ ,]*, (city|shire|town) of$", "(?i)^(city|shire|town) of (.*)$"
_ALIASES = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.KEY_ALIASES.items()) + " ELSE w END"


@query(f"""WITH clean AS (SELECT id, trim(regexp_replace(trim(coalesce(council, '')), '(?i)[(]bbox extent[)]$', '')) AS c, replace(replace(upper(code), ' ', ''), '_', '-') AS d, code,
  list_transform(list_filter(list_transform(regexp_extract_all(lower(replace(coalesce(rkey, ''), '&', ' and ')), '[a-z0-9]+'), lambda w: {_ALIASES}), lambda w: NOT list_contains({T.KEY_DROPPED}, w)),
    lambda w: CASE WHEN length(w) > 4 AND ends_with(w, 's') AND NOT regexp_matches(w, '^r[0-9]+s?$') THEN w[:-2] ELSE w END) AS k FROM {{names}})
SELECT id, CASE WHEN regexp_matches(c, '{_BEHIND}') THEN {_TITLE(f"regexp_extract(c, '{_BEHIND}', 2)")} || ' of ' || {_TITLE(f"regexp_extract(c, '{_BEHIND}', 1)")}
    WHEN regexp_matches(c, '{_BEFORE}') THEN {_TITLE(f"regexp_extract(c, '{_BEFORE}', 1)")} || ' of ' || {_TITLE(f"regexp_extract(c, '{_BEFORE}', 2)")} WHEN c = upper(c) AND c <> '' THEN {_TITLE("c")} ELSE c END AS council,
  CASE WHEN d = 'RR' THEN 'RR' WHEN regexp_matches(d, '^R-?AC-?[0-9]{{{{0,2}}}}$') THEN 'R-AC' || regexp_extract(d, '([0-9]*)$', 1) WHEN regexp_matches(d, '^R[0-9]{{{{1,3}}}}$') AND d[2:]::INT > 0 THEN 'R' || d[2:]::INT END AS code,
  regexp_matches(replace(trim(code), ' ', ''), '(?i)^R{{{{1,2}}}}-?(AC)?[0-9]+([.][0-9]+)?(/[0-9]+([.][0-9]+)?)?$') AS is_code, array_to_string(list_filter(k, lambda w, i: i = 1 OR w <> k[i - 1]), '_') AS rkey FROM clean""")
def name_edges(spark, sf_dir):
    """STR-08, STR-09, STR-10, STR-11 over the names, codes and keys of every customer."""
    c = F.col
    return view(spark, sf_dir, "names").select("id", T.council_name(c("council")).alias("council"), T.density_code(c("code")).alias("code"), T.is_density_code(c("code")).alias("is_code"), T.rule_key(F.coalesce("rkey", F.lit(""))).alias("rkey"))


@query("""SELECT event_id, json_exists(other, '$.k') AS has_k, coalesce(json_extract_string(other, '$.k'), CASE WHEN json_exists(other, '$.k') THEN 'null' ELSE json_extract_string(props, '$.k') END) AS merged_k,
len(list_filter(json_keys(other), lambda k: k <> 'parked')) AS n_left, json_object('event_id', event_id, 'event_type', event_type)::VARCHAR AS built, CASE WHEN event_id % 4 = 2 THEN 2 ELSE CASE WHEN event_id % 4 IN (0, 1) THEN 1 ELSE 0 END END AS n_numbers,
CASE event_id % 4 WHEN 0 THEN 'k,source' WHEN 1 THEN 'k,parked' WHEN 2 THEN 'a,b,list' ELSE '' END AS keys, json_extract_string(other, '$.list[0]') AS first, len(list_distinct(json_extract_string(other, '$.list[*]'))) AS n_list FROM {objects}""")
def json_edges(spark, sf_dir):
    """JSN-03 to JSN-06, JSN-08 to JSN-12."""
    other, values = F.col("other"), J.as_list(F.get_json_object("other", "$.list"))
    both = J.merged(J.as_map(F.col("props")), J.as_map(other))
    return view(spark, sf_dir, "objects").select(
        "event_id", J.has_key(other, "k").alias("has_k"), F.coalesce(F.element_at(both, "k"), F.lit("null")).alias("merged_k"), F.size(J.without_key(J.as_map(other), "parked")).cast("bigint").alias("n_left"),
        F.to_json(F.struct("event_id", "event_type")).alias("built"), F.size(J.numbers_at_any_depth(other)).alias("n_numbers"), F.array_join(F.array_sort(J.keys_at_any_depth(other)), ",").alias("keys"),
        F.get(values, F.lit(0)).alias("first"), F.size(F.array_distinct(values)).cast("bigint").alias("n_list"),
    )


@query("SELECT event_type, signature, count(*) AS n FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'k=7|source=x' WHEN 1 THEN 'k=null' WHEN 2 THEN 'a={\"B\":[1,2.5]}|list=[\"x\",\"y\",\"x\"]' ELSE '' END AS signature FROM {objects}) GROUP BY 1, 2")
def json_signature(spark, sf_dir):
    """JSN-07, JSN-10: objects grouped by their canonical text, one key left out."""
    signature = J.canonical(J.as_map(F.col("other")), ("parked",)).alias("signature")
    return view(spark, sf_dir, "objects").groupBy("event_type", signature).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, string_agg(k || ':' || n, ',' ORDER BY k) AS counts FROM (SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM {events} GROUP BY 1, 2) WHERE k IS NOT NULL GROUP BY 1")
def nested_counts(spark, sf_dir):
    """JSN-13, AGG-19: a map of counts per group, from counts summed first."""
    n = view(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k")).where("k IS NOT NULL").groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    return m.select("event_type", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("""SELECT event_id, ts >= TIMESTAMP '2024-01-20 00:00:00' AS today, ts < TIMESTAMP '2024-01-20 13:00:00' - INTERVAL 14 DAY AS stale, ts + (user_id % 9) * INTERVAL 1 DAY AS expires, ts + INTERVAL 30 MINUTE AS lease, ts <= TIMESTAMP '2024-01-20 13:00:00' AS expired FROM {events}""")
def date_edges(spark, sf_dir):
    """DT-02, DT-03, DT-05, DT-06, DT-08."""
    ts, now = F.col("ts"), F.lit("2024-01-20 13:00:00").cast("timestamp_ntz")
    return view(spark, sf_dir, "events").select("event_id", D.since_day_start(ts, now).alias("today"), D.is_stale(ts, now, 14).alias("stale"), D.expires(ts, F.col("user_id") % 9).alias("expires"), D.lease_until(ts).alias("lease"), D.is_expired(ts, now).alias("expired"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S')::TIMESTAMP AS parsed, strftime(ts, '%Y-%m-%d')::TIMESTAMP AS day, date_trunc('second', ts) - INTERVAL 8 HOUR AS zoned, NULL::TIMESTAMP AS bad, regexp_matches(CAST(event_id AS VARCHAR), '^(19|20)[0-9][0-9]$') AS year FROM {events}""")
def iso_dates(spark, sf_dir):
    """DT-07, DT-10: instants from ISO texts with Z, an offset, a date alone, and none."""
    text = lambda f: F.date_format("ts", f)
    rows = view(spark, sf_dir, "events").select("event_id", text("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("z"), text("yyyy-MM-dd").alias("d"), F.concat(text("yyyy-MM-dd HH:mm:ss"), F.lit("+08:00")).alias("o"))
    return rows.select("event_id", D.parse_iso(F.col("z")).alias("parsed"), D.parse_iso(F.col("d")).alias("day"), D.parse_iso(F.col("o")).alias("zoned"), D.parse_iso(F.lit("soon")).alias("bad"), D.is_year(F.col("event_id").cast("string")).alias("year"))


@query("""SELECT doc_id, 'src_' || substr(sha256(lang || '|' || source), 1, 16) AS source_key, (('0x' || substr(sha256(text), 1, 16))::UHUGEINT % 9223372036854775808::UHUGEINT)::BIGINT AS lock, substr(sha256(text), 1, 2) || '/' || sha256(text) AS path FROM {documents}""")
def derived_ids(spark, sf_dir):
    """HSH-02, HSH-04, SNK-06."""
    t = F.col("text")
    return view(spark, sf_dir, "documents").select("doc_id", I.stable_id("src_", F.col("lang"), F.col("source")).alias("source_key"), I.lock_key(t).alias("lock"), I.artefact_path(t).alias("path"))


@query()
def name_uuids(spark, sf_dir):
    """HSH-03."""
    return view(spark, sf_dir, "nation").select("n_nationkey", I.name_uuid(uuid.NAMESPACE_URL, F.col("n_name")).alias("id"))


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n_words, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS estimate, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240) AS quote FROM {documents}""")
def token_counts(spark, sf_dir):
    """STR-02 in its three definitions, PRJ-02."""
    t = F.col("text")
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")).cast("bigint")
    return view(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(t)).cast("bigint").alias("n_tokens"), words.alias("n_words"), F.greatest(F.lit(1), words).cast("bigint").alias("estimate"), T.safe_quote(t).alias("quote"))


@query("""SELECT clause_id, regexp_matches(quote, '(^|[^0-9])' || replace(claimed, '.', '[.]') || '([^0-9]|$)') AS alone, len(list_filter(regexp_extract_all(claimed, '\\d+(?:\\.\\d+)?'), lambda n: NOT list_contains(regexp_extract_all(quote, '\\d+(?:\\.\\d+)?'), n))) AS n_unsaid FROM {sentences}""")
def orphan_numbers(spark, sf_dir):
    """STR-18, SET-04: whether the claimed number stands alone in the quote; claimed numbers that the quote lacks."""
    quote, claimed = F.col("quote"), F.col("claimed")
    unsaid = F.array_except(T.numbers_in(claimed), T.numbers_in(quote))
    return view(spark, sf_dir, "sentences").select("clause_id", T.stands_alone(claimed, quote).alias("alone"), F.size(unsaid).cast("bigint").alias("n_unsaid"))


@query("""SELECT address_id, lower(n_name) AS street, regexp_matches(plain, '^(lot )?[0-9]+ ' || substr(lower(n_name), 1, 3)) AS near FROM (SELECT a.address_id, trim(regexp_replace(lower(a.address), '\\s+', ' ', 'g')) AS plain, n.n_name FROM {addresses} a JOIN {customer} c ON c.c_custkey = a.address_id JOIN {nation} n ON n.n_nationkey = c.c_nationkey)""")
def street_names(spark, sf_dir):
    """STR-05, STR-06: the words of the street's name, and whether one is near the first letters of it."""
    name = T.street_tokens(F.col("address"))
    near = F.exists(name, lambda w: T.close_token(F.substring(F.get(name, F.lit(0)), 1, 3), w))
    return view(spark, sf_dir, "addresses").select("address_id", F.array_join(name, " ").alias("street"), near.alias("near"))


@query("""SELECT version_id, coalesce(approved, false) AND lang IN ('en', 'fr') AND owner IS NOT NULL AND version_id % 50 <> 0 AS citable, owner ILIKE 'OWNER_3%' AS prefixed, regexp_matches(coalesce(owner, ''), '(^|[^0-9A-Za-z_])owner_3($|[^0-9A-Za-z_])') AS word, contains(lower(source), 'src1') AS titled,
version_id % 7 / 2.0 <= 2.5 AS small, coalesce(CASE WHEN version_id % 3 = 0 THEN 'true' WHEN version_id % 3 = 1 THEN 'false' END = 'true', false) AS flagged, CASE version_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS empty FROM {versions}""")
def filter_predicates(spark, sf_dir):
    """FLT-05 to FLT-09, FLT-12, FLT-13: each as a column."""
    c = F.col
    size = F.regexp_extract(F.concat(F.lit("Policy (PDF, "), (c("version_id") % 7 / 2.0).cast("string"), F.lit("MB)")), r"\(PDF, ([0-9.]+)MB\)", 1).try_cast("double")
    meta = F.when(c("version_id") % 3 == 0, '{"parked": true}').when(c("version_id") % 3 == 1, '{"parked": false}')
    json = F.when(c("version_id") % 4 == 0, "null").when(c("version_id") % 4 == 1, "[]").when(c("version_id") % 4 == 3, '{"a": 1}')
    citable = F.coalesce("approved", F.lit(False)) & c("lang").isin("en", "fr") & c("owner").isNotNull() & (c("version_id") % 50 != 0)
    return view(spark, sf_dir, "versions").select(
        "version_id", citable.alias("citable"), c("owner").ilike("OWNER_3%").alias("prefixed"), F.coalesce(c("owner"), F.lit("")).rlike(r"\bowner_3\b").alias("word"), F.contains(F.lower("source"), F.lit("src1")).alias("titled"),
        (size <= 2.5).alias("small"), F.coalesce(F.get_json_object(meta, "$.parked") == "true", F.lit(False)).alias("flagged"), (json.isNull() | F.trim(json).isin("null", "[]", "{}")).alias("empty"),
    )


@query("""SELECT vec_id, label % 3 = 0 OR vec_id % 5 = 0 OR len(embedding) <> 64 OR label % 4 = 1 AS stale FROM {embeddings}""")
def stale_embeddings(spark, sf_dir):
    """FLT-11, STM-07: vectors to compute again: no provider, a wrong model, dimension or missing vector, null-safe."""
    c = F.col
    provider, model = F.when(c("label") % 3 != 0, F.lit("p")), F.when(c("vec_id") % 5 != 0, F.lit("m"))
    wrong = ~provider.eqNullSafe(F.lit("p")) | ~model.eqNullSafe(F.lit("m")) | ~F.size("embedding").eqNullSafe(F.lit(64)) | c("embedding").isNull() | (c("label") % 4 == 1)
    return view(spark, sf_dir, "embeddings").select("vec_id", wrong.alias("stale"))


@query("""SELECT vec_id, 64::BIGINT AS size, true AS same, true AS bad FROM {embeddings}""")
def embedding_wire(spark, sf_dir):
    """VEC-03: vectors through their wire text; a broken one is null."""
    v = J.embedding_of(F.to_json("embedding"))
    same = F.forall(F.zip_with(v, F.col("embedding"), lambda a, b: F.abs(a - b.cast("double")) < 1e-6), lambda ok: ok)
    bad = J.embedding_of(F.concat(F.lit('["x",'), F.substring(F.to_json("embedding"), 2, 1_000_000))).isNull() & J.embedding_of(F.lit("nothing")).isNull()
    return view(spark, sf_dir, "embeddings").select("vec_id", F.size(v).cast("bigint").alias("size"), same.alias("same"), bad.alias("bad"))


_THOUGHT = "trim(regexp_replace(regexp_replace(answer, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*$', ''))"


@query(f"""WITH said AS (SELECT conv_id, turn, {_THOUGHT} AS a FROM {{answers}}),
cited AS (SELECT *, list_sort(list_filter(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(a, '\\[([0-9][0-9,\\s]*)\\]', 1), lambda m: regexp_extract_all(m, '[0-9]+'))), lambda n: n::INT)), lambda n: n BETWEEN 1 AND 6)) AS v FROM said),
parts AS (SELECT *, regexp_extract_all(a, '\\[[0-9][0-9,\\s]*\\]') AS m, regexp_split_to_array(a, '\\[[0-9][0-9,\\s]*\\]') AS b FROM cited)
SELECT conv_id, turn, array_to_string(list_transform(b, lambda x, i: x || coalesce(CASE WHEN len(list_filter(regexp_extract_all(m[i], '[0-9]+'), lambda n: list_contains(v, n::INT))) > 0
  THEN '[' || array_to_string(list_transform(list_filter(regexp_extract_all(m[i], '[0-9]+'), lambda n: list_contains(v, n::INT)), lambda n: list_position(v, n::INT)), ', ') || ']' END, '')), '') AS answer, len(v)::INT AS total FROM parts""")
def answer_markers(spark, sf_dir):
    """STR-19: think blocks stripped, markers renumbered, those out of range dropped, in every turn."""
    new = T.renumbered(T.without_reasoning(F.col("answer")), F.lit(6))
    rows = view(spark, sf_dir, "answers").select("conv_id", "turn", new.alias("answer"))
    return rows.select("conv_id", "turn", "answer", F.size(F.array_distinct(T.cited_numbers(F.col("answer")))).alias("total"))


@query(f"""WITH asked AS (SELECT conv_id, turn, 'Please explain the DA and R-Codes: ' || text AS q FROM {{conversations}} WHERE role = 'user'),
kept AS (SELECT *, list_filter(regexp_extract_all(q, '[A-Za-z0-9][A-Za-z0-9-]*'), lambda w: NOT list_contains({T.STOP_WORDS}, lower(trim(w, '-')))) AS k FROM asked)
SELECT conv_id, turn, coalesce(nullif(array_to_string(flatten(list_transform(k, lambda w: CASE lower(trim(w, '-')) {" ".join(f"WHEN '{a}' THEN {b.split()}" for a, b in T.LONG_FORMS.items())} ELSE [w] END))[1:16], ' '), ''), q) AS asked FROM kept""")
def compact_queries(spark, sf_dir):
    """STR-20: the question of every user turn, without stop words and with short forms written out."""
    rows = view(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("Please explain the DA and R-Codes: "), "text").alias("question"))
    return rows.select("conv_id", "turn", T.compact_query(F.col("question")).alias("asked"))


@query(f"""SELECT conv_id, turn, nullif(regexp_extract(reply, '(?s)(\\{{{{.*\\}}}})', 1), '') AS json, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(said, '[0-9]+(?:[.][0-9]+)?'),
  list_filter(list_transform(regexp_extract_all(lower(said), '[a-z0-9]+'), lambda w: CASE w {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.SPELLED.items())} END), lambda x: x IS NOT NULL)))), ',') AS numbers FROM {{answers}}""")
def model_output(spark, sf_dir):
    """STR-17, STR-21: the outermost JSON of an answer; numbers with spelled ones, in every turn."""
    return view(spark, sf_dir, "answers").select("conv_id", "turn", T.outer_json(F.col("reply")).alias("json"), F.array_join(F.array_sort(T.spelled_numbers(F.col("said"))), ",").alias("numbers"))


@query("""SELECT clause_key, CASE WHEN disposition = 'definition' THEN '' ELSE 'Planning Act 2005' END AS refs FROM {clauses}""")
def clause_references(spark, sf_dir):
    """STR-13, STR-14."""
    hits = graph.references(F.col("text"))
    return view(spark, sf_dir, "clauses").select("clause_key", F.array_join(F.transform(hits, lambda h: h["ref"]), "; ").alias("refs"))


@query("""SELECT n_nationkey, 1.0::DOUBLE AS own, greatest(0, 1)::DOUBLE AS inside FROM {nation}""")
def word_similarities(spark, sf_dir):
    """STR-07: a name is wholly similar to itself, and to itself among other words."""
    name = F.col("n_name")
    return view(spark, sf_dir, "nation").select("n_nationkey", T.word_similarity(name, name).alias("own"), T.word_similarity(name, F.concat(F.lit("12 "), name, F.lit(" street west"))).alias("inside"))
