"""Queries of address search, text rank and evidence, each with the SQL that it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import places, ranking, typeahead
from .catalog import query
from .views import view

# Address search. Every customer has an address, every supplier asks for one: as it stands with another spelling, cut inside a
# word, with a wrong number, without a number, for a street that is not there, cut inside the street's name, or not at all.

_quoted = lambda words: ", ".join(f"'{w}'" for w in words)
_FORM = lambda c: f"trim(regexp_replace(lower(replace({c}, ',', ' ')), '\\s+', ' ', 'g'))"
_LONG = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STREET.items()) + " ELSE x END"
_NUMBER = "(x = 'lot' OR regexp_matches(regexp_replace(x, '[/-]', '', 'g'), '^[a-z0-9]*[0-9][a-z0-9]*$'))"

#: Scores of every supplier's query with every address, by their definition.
_PAIRS = f"""
held AS (SELECT address_id, address, {_FORM("address")} AS plain, string_split({_FORM("address")}, ' ') AS t FROM {{homes}}),
asked AS (SELECT query_id, string_split({_FORM("address")}, ' ') AS w FROM {{asked_homes}} WHERE {_FORM("address")} <> ''),
split AS (
  SELECT query_id, w, list_transform(w, lambda x, i: CASE WHEN i = 1 THEN x ELSE {_LONG} END) AS long,
    regexp_extract(array_to_string(w, ' '), '^(?:lot )?([0-9]+)(?: |$)', 1) AS house,
    w[coalesce(list_position(list_transform(w, lambda x: {_NUMBER}), false), len(w) + 1):] AS rest FROM asked),
streets AS (
  SELECT *, CASE WHEN len(rest) < 2 THEN [] ELSE list_filter(rest[1:coalesce(nullif(list_position(list_transform(rest, lambda x: x IN ({_quoted(T.STREET_TYPES)})), true), 0), 2) - 1], lambda x: length(x) >= 2) END AS street FROM split),
near AS (
  SELECT query_id, address_id, address, house, t, plain, unnest([array_to_string(w, ' '), array_to_string(long, ' ')]) AS form FROM streets, held
  WHERE len(street) = 0 OR len(list_filter(street, lambda a: len(list_filter(t, lambda b: a = b OR length(a) >= 3 AND starts_with(b, a) OR length(a) >= 4 AND starts_with(a, b))) > 0)) > 0),
points AS (
  SELECT query_id, address_id, address, max(least(CASE WHEN house <> '' AND NOT list_contains(t, house) THEN 0.4 ELSE 1.0 END, CASE WHEN plain = form THEN 1.0 WHEN starts_with(plain, form) THEN 0.95
    ELSE len(list_filter(string_split(form, ' '), lambda x: list_contains(t, x))) / len(string_split(form, ' ')) * 0.9 END))::DOUBLE AS score FROM near GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, address, address_id) AS rank FROM points WHERE score >= 0.5)"""


@query(f"WITH {_PAIRS} SELECT query_id, rank, address_id, address, round(score, 4) AS score FROM ranked WHERE rank <= 8")
def address_typeahead(spark, sf_dir):
    """DOM-07, SRT-05, STR-03 to STR-06: hits of whole, cut and faulty addresses."""
    return typeahead.typeahead(view(spark, sf_dir, "asked_homes"), view(spark, sf_dir, "homes"), limit=8)


@query(f"""WITH {_PAIRS},
found AS (SELECT query_id, address_id, round(score, 4) AS score FROM points WHERE score = 1 UNION ALL SELECT query_id, address_id, round(score, 4) FROM ranked WHERE rank <= 5 AND score < 1 AND score >= 0.55),
top AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM found),
kept AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM top WHERE CASE WHEN best = 1 THEN score = 1 ELSE best - score < 0.08 END)
SELECT query_id, address_id, score, CASE WHEN n IS NULL THEN 'none' WHEN best = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'clear' END AS outcome FROM (SELECT query_id FROM {{asked_homes}}) LEFT JOIN kept USING (query_id)""")
def address_outcomes(spark, sf_dir):
    """DOM-07: exact, clear, ambiguous and none."""
    return places.match_addresses(view(spark, sf_dir, "asked_homes"), view(spark, sf_dir, "homes"))


_GRAMS = lambda t: f"flatten(list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda x: x <> ''), lambda x: list_transform(range(1, length(x) + 2), lambda i: substr('  ' || x || ' ', i::INT, 3))))"
#: Word similarity of a and b: the best share over all runs of b's trigrams.
_BEST_RUN = """coalesce(list_max(flatten(list_transform(range(1, len(run) + 1), lambda i: list_transform(range(i, len(run) + 1),
  lambda j: len(list_intersect(want, run[i:j])) / len(list_distinct(list_concat(want, run[i:j]))))))), 0.0)"""


@query(f"""WITH asked AS (SELECT query_id, address AS asked, string_split({_FORM("address")}, ' ') AS w FROM {{asked_homes}}),
forms AS (SELECT query_id, asked, array_to_string(w, ' ') AS form, unnest([asked, array_to_string(w, ' '), array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN x ELSE {_LONG} END), ' ')]) AS f, unnest([0, 1, 1]) AS kind FROM asked),
pairs AS (SELECT query_id, address_id, form, kind, h.address, list_distinct({_GRAMS("f")}) AS want, {_GRAMS("h.address")} AS run FROM forms JOIN {{homes}} h ON h.address_id = query_id * 7),
raw AS (SELECT query_id, address_id, address, regexp_extract(form, '^(?:lot )?([0-9]+)(?: |$)', 1) AS house, max({_BEST_RUN}) FILTER (kind = 0) AS s, max({_BEST_RUN}) FILTER (kind = 1) AS r FROM pairs GROUP BY ALL)
SELECT query_id, address_id, round(s, 6) AS similarity, round(CASE WHEN r >= 0.45 THEN least(r + CASE WHEN house <> '' AND list_contains(regexp_extract_all(lower(address), '[a-z0-9]+'), house) THEN 0.05 ELSE 0 END, 1.0) END, 6) AS score FROM raw""")
def address_similarity(spark, sf_dir):
    """STR-07, FLT-07: word similarity with parts of words, of both forms of a query, its floor and the boost of the house number."""
    both = view(spark, sf_dir, "asked_homes").join(view(spark, sf_dir, "homes").withColumnRenamed("address", "has"), F.col("address_id") == F.col("query_id") * 7)
    score = T.address_score(F.col("address"), F.col("has"))
    return both.select("query_id", "address_id", F.round(T.word_similarity(F.col("address"), F.col("has")), 6).alias("similarity"), F.round(score, 6).alias("score"))


@query()
def address_fuzzy(spark, sf_dir):
    """STR-07, SRT-05: hits by word similarity, for misspelled addresses; a test compares them with all pairs."""
    return typeahead.fuzzy(view(spark, sf_dir, "asked_homes"), view(spark, sf_dir, "homes"), limit=5)


# Text rank


@query("""WITH versions AS (SELECT d.doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {documents} d WHERE doc_id IN (SELECT version_id FROM {versions} WHERE approved)),
asked AS (SELECT query_id, unnest(string_split(need, ' ')) AS term, n, veto FROM {cover_queries}),
spots AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM versions),
met AS (SELECT query_id, doc_id, s.term, pos, n FROM asked JOIN spots s USING (term) WHERE NOT EXISTS (SELECT 1 FROM spots v WHERE v.doc_id = s.doc_id AND v.term = asked.veto)),
whole AS (SELECT * FROM met SEMI JOIN (SELECT query_id, doc_id FROM met GROUP BY query_id, doc_id, n HAVING count(DISTINCT term) = n) USING (query_id, doc_id)),
last AS (SELECT a.query_id, a.doc_id, a.pos AS q, b.term, max(b.pos) AS pos FROM whole a JOIN whole b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.pos <= a.pos GROUP BY ALL),
ends AS (SELECT l.query_id, l.doc_id, l.q, min(l.pos) AS p FROM last l JOIN {cover_queries} c USING (query_id) GROUP BY l.query_id, l.doc_id, l.q, c.n HAVING count(*) = c.n),
covers AS (SELECT query_id, doc_id, p, min(q) AS q FROM ends GROUP BY ALL),
noise AS (SELECT query_id, doc_id, (q - p) - (SELECT count(*) FROM whole w WHERE w.query_id = c.query_id AND w.doc_id = c.doc_id AND w.pos BETWEEN p AND q) + 1 AS n FROM covers c),
scored AS (SELECT query_id, doc_id, round(sum(0.1 / (1 + n)), 6) AS score FROM noise GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 40""")
def cover_density(spark, sf_dir):
    """FTS-01, FTS-02: texts of approved versions that hold all words of a query and none that it excludes, by cover density;
    five times the limit of eight; equal ranks by id."""
    approved = view(spark, sf_dir, "versions").where("approved").select(F.col("version_id").alias("doc_id"))
    docs = view(spark, sf_dir, "documents").select("doc_id", "text").join(approved, "doc_id", "left_semi")
    asked = view(spark, sf_dir, "cover_queries").select("query_id", F.concat("need", F.lit(" -"), F.col("veto")).alias("text"))
    return ranking.cover_density(asked, docs, limit=8)
