"""DuckDB SQL for the queries whose whole result SQL can express."""

from __future__ import annotations

from . import licenses

_SOURCES = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, n, (1.0 / (SELECT count(*) FROM counts)) * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM counts),
parts AS (SELECT source, rate, greatest(1, ceil(rate / 8.0))::INT AS parts FROM rates),
draws AS (
  SELECT d.*, p.rate, p.rate / p.parts AS part_rate, j.j,
    ('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || j.j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(p.parts)) AS j) j),
cdf AS (
  SELECT part_rate, k, sum(p) OVER (PARTITION BY part_rate ORDER BY k) AS c FROM (
    SELECT part_rate, k, exp(-part_rate + k * ln(part_rate) - lgamma(k + 1)) AS p
    FROM (SELECT DISTINCT part_rate FROM draws), (SELECT unnest(range(48)) AS k))),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate, d.j, (SELECT count(*) FROM cdf WHERE cdf.part_rate = d.part_rate AND cdf.c < d.u) AS k FROM draws d),
copies AS (SELECT doc_id, text, lang, source, n_chars, rate, sum(k) AS k FROM counted GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, rate AS mix_rate, m.m::INT AS mix_copy,
  md5('17-order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || m.m) AS mix_key
FROM copies, LATERAL (SELECT unnest(range(1, k::BIGINT + 1)) AS m) m
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    """Every sentence against every template, on whole sets of words; places by the index of words."""
    words = lambda text: f"""list_filter(regexp_split_to_array(translate({text}, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.BETWEEN}'), lambda x: x <> '')"""
    places = {p: f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {n}] = {_quoted(x)}' for n, x in enumerate(p.split(), 1))})" for p in licenses.PHRASES}
    bases = ", ".join(f"CASE WHEN len({at}) > 0 THEN {_quoted(licenses.PHRASES[p])} END" for p, at in places.items())
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT r, doc_id, {words("t")} AS w FROM docs),
placed AS (SELECT r, doc_id, len(w) AS n_words, list_concat({", ".join(places.values())}) AS spots, list_filter([{bases}], lambda x: x IS NOT NULL) AS base FROM worded),
templates AS (SELECT row_number() OVER () AS id, label, list_distinct({words("txt")}) AS tw FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licenses.TEMPLATES)}) v(label, txt)),
sentences AS (
  SELECT r, row_number() OVER () AS b, list_distinct({words("s")}) AS sw
  FROM (SELECT r, unnest(string_split(regexp_replace(t, '([.!?]){space}+|
{space}*
', '<|end|>', 'g'), '<|end|>')) AS s FROM docs)),
held AS (
  SELECT r, b, label, len(list_intersect(sw, tw)) AS common, len(list_intersect(sw, tw)) / len(tw) AS share
  FROM sentences, templates WHERE len(list_intersect(sw, tw)) >= ceil(round(0.9 * len(tw), 9))),
best AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY common DESC, share DESC, label) AS k FROM held),
more AS (SELECT r, list(label) FILTER (k = 1) AS labels, max(share) AS score FROM best GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(spots)::BIGINT AS n_base, list_min(spots)::BIGINT AS first_word, list_max(spots)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM placed LEFT JOIN more USING (r)
"""


ORACLES = {"op2_source_mixing": _SOURCES, "op13_license_join": _license_sql()}
