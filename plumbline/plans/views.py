"""Views that bind the generated tables to rules, facts, votes, versions and shapes: SQL that Spark and DuckDB both take.

A {name} stands for a table or another view; braces of texts are doubled."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "rules": """
SELECT p_partkey AS rule_id, 'check_' || CAST(p_partkey % 7 + 1 AS STRING) AS check_key,
  CASE p_partkey % 8 WHEN 0 THEN 'lte' WHEN 1 THEN 'gte' WHEN 2 THEN '<' WHEN 3 THEN 'gt' WHEN 4 THEN '=' WHEN 5 THEN 'pct_lte' WHEN 6 THEN 'range' END AS operator,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS threshold,
  CASE WHEN p_partkey % 5 = 0 THEN 'exception' ELSE 'requirement' END AS rule_type,
  CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 25 END AS council,
  CASE WHEN p_partkey % 3 <> 0 THEN 'R' || CAST(p_partkey % 5 AS STRING) || ',R' || CAST(p_partkey % 4 AS STRING) END AS codes,
  p_partkey % 100 AS created, p_brand AS brand, p_type AS ptype, p_retailprice AS price,
  CASE WHEN p_partkey % 6 = 0 THEN 'pending' ELSE 'approved' END AS state, CASE WHEN p_partkey % 17 <> 0 THEN p_name END AS quote
FROM {part}""",
    "check_rules": """
SELECT p_partkey AS rule_id, CASE p_partkey % 13 WHEN 0 THEN 'setback_front' WHEN 1 THEN 'primary_street_setback.R20' WHEN 2 THEN 'front_setback' WHEN 3 THEN 'side_setback.x.y' WHEN 4 THEN 'secondary_street_setback' WHEN 5 THEN 'site_cover.R40'
    WHEN 6 THEN 'boundary_wall.a' WHEN 7 THEN 'plot_ratio' WHEN 8 THEN 'odd_key' WHEN 9 THEN 'garage_width' WHEN 10 THEN 'height_wall' WHEN 11 THEN 'open_space.z' ELSE 'site_area' END AS rule_key,
  CASE WHEN p_partkey % 17 = 0 THEN 'side_setback' WHEN p_partkey % 17 = 1 THEN '' END AS base_rule_key, CASE WHEN p_partkey % 13 = 8 THEN 'min_frontage' WHEN p_partkey % 19 = 0 THEN 'plot_ratio' END AS canonical,
  CASE p_partkey % 10 WHEN 0 THEN 'x' WHEN 1 THEN 'NaN' WHEN 2 THEN CAST(NULL AS STRING) ELSE CAST(p_size AS STRING) END AS threshold, CASE p_partkey % 6 WHEN 0 THEN 'gte' WHEN 1 THEN '>' WHEN 2 THEN 'range' WHEN 3 THEN 'eq' ELSE 'lte' END AS operator,
  CASE WHEN p_partkey % 7 = 0 THEN 'exception' ELSE 'standard' END AS rule_type, CASE WHEN p_partkey % 3 <> 0 THEN 'City ' || CAST(p_partkey % 8 AS STRING) END AS council, CASE p_partkey % 4 WHEN 0 THEN 'Z1,Z2' WHEN 1 THEN 'Z2' END AS zones,
  CASE p_partkey % 5 WHEN 0 THEN 'R20' WHEN 1 THEN 'R20,R40' WHEN 2 THEN 'R60' END AS codes, CASE p_partkey % 11 WHEN 0 THEN 'grouped' WHEN 1 THEN 'any' END AS dwelling_type, p_partkey % 60 AS created, 'm' AS unit, 'none' AS pathway,
  CASE WHEN p_partkey % 6 = 0 THEN 'pending' ELSE 'approved' END AS state, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 40 END AS source_version_id FROM {part}""",
    "check_facts": """
SELECT l_orderkey AS project_id, CASE l_linenumber WHEN 1 THEN 'proposed_setback_front_m' WHEN 2 THEN 'proposed_setback_side_primary_m' WHEN 3 THEN CASE WHEN l_partkey % 2 = 0 THEN 'proposed_site_cover_pct' ELSE 'site_area_m2' END
    WHEN 4 THEN 'proposed_plot_ratio' WHEN 5 THEN 'r_code' WHEN 6 THEN CASE WHEN l_partkey % 3 = 0 THEN 'council' ELSE 'zone' END ELSE CASE WHEN l_partkey % 2 = 0 THEN 'frontage_width_m' ELSE 'local_government' END END AS fact_type,
  CASE WHEN l_suppkey % 8 <> 0 THEN l_quantity END AS value, CASE WHEN l_linenumber = 5 THEN CASE l_suppkey % 3 WHEN 0 THEN 'R20' WHEN 1 THEN 'R40' ELSE 'R60' END WHEN l_linenumber = 6 AND l_partkey % 3 <> 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'Z1' WHEN 1 THEN 'Z2' ELSE '' END
    WHEN l_linenumber >= 6 THEN CASE WHEN l_suppkey % 4 = 0 THEN ' ' ELSE ' City ' || CAST(l_suppkey % 9 AS STRING) END END AS text,
  CASE WHEN l_suppkey % 7 = 0 THEN 'assumption' WHEN l_linestatus = 'O' THEN 'manual_override' ELSE 'spatial' END AS method, CASE WHEN l_returnflag = 'R' THEN 'pending' ELSE 'confirmed' END AS review_status, l_shipdate AS created,
  l_partkey * 1000000000 + l_suppkey * 100000 + CAST(l_extendedprice AS BIGINT) % 100000 AS tie
FROM {lineitem}""",
    "check_projects": """
SELECT o_orderkey AS project_id, CASE WHEN o_custkey % 4 = 0 THEN ' ' WHEN o_custkey % 4 = 1 THEN 'City ' || CAST(o_custkey % 8 AS STRING) END AS council FROM {orders}""",
    "projects": """
SELECT o_orderkey AS project_id, CAST(c_nationkey AS BIGINT) AS council, 'R' || CAST(c_custkey % 5 AS STRING) AS r_code
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "facts": """
SELECT l_orderkey AS project_id, 'check_' || CAST(l_linenumber AS STRING) AS fact_type, l_quantity AS value, l_shipdate AS created,
  l_partkey * 1000000000 + l_suppkey * 100000 + CAST(l_extendedprice AS BIGINT) % 100000 AS tie,
  CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'assumption' WHEN l_linestatus = 'O' THEN 'manual_override' ELSE 'spatial_derived' END AS method
FROM {lineitem}""",
    "votes": """
SELECT 'key_' || CAST(l_partkey % 50 AS STRING) AS rule_key, CASE WHEN l_linenumber % 2 = 0 THEN 'lte' ELSE 'gte' END AS operator,
  l_quantity AS value, CASE WHEN l_suppkey % 2 = 0 THEN 'm' ELSE 'm2' END AS unit,
  'family_' || CAST(l_suppkey % 3 AS STRING) AS family, l_returnflag AS pathway,
  CASE WHEN l_orderkey % 5 = 0 THEN 'exception' ELSE 'standard' END AS rule_type,
  CASE l_orderkey % 7 WHEN 0 THEN 'R20,R30' WHEN 1 THEN 'R30' WHEN 2 THEN 'R40' END AS codes,
  CASE l_orderkey % 11 WHEN 0 THEN 'grouped' WHEN 1 THEN 'single' WHEN 2 THEN '' WHEN 3 THEN 'any' END AS dwelling
FROM {lineitem}""",
    "versions": """
SELECT d.doc_id AS version_id, d.source, d.lang, d.n_chars, CASE WHEN d.doc_id % 13 <> 0 THEN 'owner_' || CAST(d.doc_id % 7 AS STRING) END AS owner,
  CASE WHEN d.doc_id % 9 <> 0 THEN CAST(d.doc_id % 300 AS BIGINT) END AS valid_from, CAST(d.doc_id % 300 + 5 + d.doc_id % 20 AS BIGINT) AS valid_to,
  CASE WHEN d.doc_id % 10 <> 0 THEN d.doc_id % 400 END AS due_day, l.quality = 1 AS approved, l.toxic = 1 AS restricted
FROM {documents} d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id""",
    "licences": """
SELECT version_id, CASE version_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'verified_open' WHEN 2 THEN 'pending_review' WHEN 3 THEN 'restricted' END AS licence, CASE WHEN approved THEN 'approved' WHEN NOT approved THEN 'rejected' END AS review,
  CASE WHEN version_id % 7 = 0 THEN true WHEN version_id % 7 < 6 THEN false END AS metadata_only, CASE WHEN version_id % 4 = 0 THEN version_id + 1 END AS superseded_by, CASE WHEN version_id % 9 <> 8 THEN n_chars % 11 / 10.0 END AS conf FROM {versions}""",
    "json_facts": """
SELECT p_partkey AS fact_id, CASE p_partkey % 7 WHEN 0 THEN '{{"value": " ", "name": " ' || p_name || ' "}}' WHEN 1 THEN '{{"code": 12, "value": null}}' WHEN 2 THEN '{{"council_scope": "' || p_brand || '", "council": ""}}' WHEN 3 THEN '{{"label": "' || p_type || '", "code": "x"}}'
  WHEN 4 THEN '{{}}' WHEN 5 THEN '{{"other": 1}}' END AS j FROM {part}""",
    "points": """
SELECT c_custkey AS point_id, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 + 0.05 AS x, CAST(c_custkey * 91 % 970 AS DOUBLE) / 10 + 0.05 AS y FROM {customer}""",
    "boxes": """
SELECT s_suppkey AS box_id, CAST(s_suppkey * 13 % 95 AS DOUBLE) AS x0, CAST(s_suppkey * 29 % 93 AS DOUBLE) AS y0,
  CAST(s_suppkey * 13 % 95 + 1 + s_suppkey % 4 AS DOUBLE) AS x1, CAST(s_suppkey * 29 % 93 + 1 + s_suppkey % 3 AS DOUBLE) AS y1 FROM {supplier}""",
    "lots": """
SELECT box_id AS parcel_id, 115.8 + x0 / 1000 AS x0, 115.8 + x1 / 1000 AS x1, -32.0 - y1 / 1000 AS y0, -32.0 - y0 / 1000 AS y1 FROM {boxes}""",
    "spend": """
SELECT event_id, user_id, event_type, CAST(date_trunc('day', ts) AS DATE) AS day, ts, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS cents FROM {events}""",
    "addresses": """
SELECT c_custkey AS address_id, CASE WHEN c_custkey % 6 = 0 THEN 'Lot ' ELSE '' END || CAST(c_custkey % 90 + 1 AS STRING) || '  ' || n_name ||
  CASE c_custkey % 5 WHEN 0 THEN ' St' WHEN 1 THEN ' Rd' WHEN 2 THEN ' Ave' WHEN 3 THEN ' Street' ELSE ' Hwy' END AS address
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "homes": """
SELECT c_custkey AS address_id, CASE WHEN c_custkey % 6 = 0 THEN 'Lot ' ELSE '' END || CAST(c_custkey % 40 + 1 AS STRING) || ' ' || substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) ||
  CASE c_custkey % 4 WHEN 0 THEN ' Street' WHEN 1 THEN ' Road' WHEN 2 THEN ' Rise' ELSE ' Swan Avenue' END || ', ' || n_name || ' WA ' || CAST(6000 + n_nationkey AS STRING) AS address
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "asked_homes": """
SELECT s_suppkey AS query_id, CASE s_suppkey % 7 WHEN 0 THEN replace(replace(replace(upper(address), 'STREET', 'ST'), 'ROAD', 'Rd'), 'AVENUE', 'ave') WHEN 1 THEN substr(address, 1, length(address) - 9)
  WHEN 2 THEN '999' || address WHEN 3 THEN regexp_replace(address, '^(Lot )?[0-9]+ ', '') WHEN 4 THEN '12 zzzz qqqq road' WHEN 5 THEN substr(address, 1, 8) ELSE ' , ' END AS address
FROM {supplier} JOIN {homes} ON address_id = s_suppkey * 7""",
    "cover_queries": """
SELECT query_id, concat_ws(' ', w1, w2, w3) AS need, veto, 3 AS n FROM (SELECT item_id AS query_id, w1, w2, w3, veto FROM (
  SELECT item_id, regexp_extract(lower(text), '^[a-z0-9]+[^a-z0-9]+([a-z0-9]+)', 1) AS w1, regexp_extract(lower(text), '([a-z0-9]+)[^a-z0-9]+[a-z0-9]+[^a-z0-9]*$', 1) AS w2, 'the' AS w3, 'qqqq' AS veto FROM {benchmark}) x
  WHERE w1 <> w2 AND w1 <> 'the' AND w2 <> 'the' AND w1 <> '' AND w2 <> '') y""",
    "derivable": """
SELECT CASE p_partkey % 9 WHEN 0 THEN 'site_cover' WHEN 1 THEN ' fence_height ' WHEN 2 THEN 'Bad Key' WHEN 3 THEN 'fee_amount' WHEN 4 THEN '' WHEN 5 THEN 'min_frontage' WHEN 6 THEN 'boundary_wall_length' WHEN 7 THEN 'odd_' || CAST(p_partkey % 60 AS STRING) ELSE 'visitor_parking_bays' END AS canonical,
  CASE WHEN p_partkey % 7 = 0 THEN 'pending' ELSE 'approved' END AS state, CASE p_size % 4 WHEN 0 THEN 'm' WHEN 1 THEN '%' WHEN 2 THEN ' M2 ' END AS unit, CASE WHEN p_partkey % 5 <> 0 THEN p_name || chr(10) || p_type || ' ' || p_brand END AS quote,
  CASE WHEN p_partkey % 6 <> 0 THEN p_size % 3 END AS source_version_id FROM {part}""",
    "chunks": """
SELECT doc_id % 40 AS version_id, CAST((doc_id - doc_id % 40) / 40 AS BIGINT) AS chunk_index, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN chr(10) || '  C1.2 ' || text || chr(10) || 'P3.4.5   The wall shall not exceed three metres in height.' WHEN 2 THEN text || chr(10) || chr(10) || '1.2 short' || chr(10) || '2.3.4 "Lot" means a piece of land in this scheme.'
  WHEN 3 THEN 'too short' ELSE '5.1 The application is made to the council in writing.' || chr(10) || text || chr(10) || ' 5.1 Repeated ' || text END AS text FROM {documents} WHERE text IS NOT NULL""",
    "key_rows": """
SELECT p_partkey % 23 AS cluster, replace(norm, '_', CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '_' END) AS rule_key, norm, p_size AS candidate_count, p_partkey % 4 <> 0 AS approved FROM (
  SELECT p_partkey, p_size, CASE p_partkey % 23 WHEN 0 THEN 'site_area' WHEN 1 THEN CASE p_partkey % 2 WHEN 0 THEN 'wall_height' ELSE 'open_space' END WHEN 2 THEN 'side_setback' WHEN 3 THEN 'fee_amount' WHEN 4 THEN '' ELSE 'key_' || CAST(p_partkey % 23 AS STRING) END ||
    CASE WHEN p_partkey % 23 <> 4 THEN CASE p_partkey % 5 WHEN 0 THEN '_max' WHEN 1 THEN '_r40' WHEN 2 THEN '_sl' WHEN 3 THEN '_lot' ELSE '' END ELSE '' END AS norm FROM {part}) k""",
    "hosts": """
SELECT host, length(host) AS h FROM (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM {pages}) x""",
    "manifest_rows": """
SELECT p_partkey AS manifest_id, CASE p_partkey % 7 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN 'Amendment of ' || p_name WHEN 2 THEN 'when  ' || p_name WHEN 3 THEN 'Planning ' || p_type WHEN 4 THEN 'AS/NZS ' || p_brand WHEN 5 THEN p_name ELSE 'Road Traffic Act' END AS instrument_name,
  CASE p_partkey % 5 WHEN 0 THEN 'act' WHEN 1 THEN 'regulations' WHEN 2 THEN 'standard' ELSE 'policy' END AS category, CASE p_partkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'acquired' ELSE 'blocked' END AS status,
  CASE p_partkey % 3 WHEN 0 THEN 'http://a.example.org' WHEN 1 THEN ' ' END AS canonical_url, CAST(NULL AS STRING) AS notes FROM {part}""",
    "plans": """
SELECT doc_id, translate(text, 'éèêëàâçùûüîïôöäßñáíóúÉÈÊËÀÂÇÙÛÜÎÏÔÖÄÑÁÍÓÚ', 'eeeeaacuuuiiooasnaiouEEEEAACUUUIIOOANAIOU') || CASE doc_id % 6 WHEN 0 THEN ' Front setback: ' || CAST(n_chars % 9 AS STRING) || '.5 m, rear SETBACK 3 metres; setback to northern boundary of 2m.'
  WHEN 1 THEN ' Gross floor area: ' || CAST(n_chars % 300 AS STRING) || ' m2. Lot area 450sqm and building footprint: 120 sq. m; open space 30%, site coverage: 55.5 per cent'
  WHEN 2 THEN ' Drawing No: A' || CAST(doc_id AS STRING) || '/2. Rev. B, sheet title:  Ground   plan' WHEN 3 THEN ' Garage width 6 meters. Boundary wall length: 9.25 m. Scale: 1 : 100. scale 1 : 100. SCALE as Shown'
  WHEN 4 THEN ' setback 3 m setback 3.0 m; side-setback: 1 m, primary setback: 4m; open space ratio 40 % and open space 40 sqm' ELSE ' 12 m2 and 12 sqm, 7% of 7 percent' END AS text
FROM {documents} WHERE text IS NOT NULL""",
    "sentences": """
SELECT p_partkey AS clause_id, 'Setback shall be ' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '.5' ELSE '' END || ' ' ||
  CASE p_partkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'mm' WHEN 2 THEN 'sqm' ELSE 'lots' END || ' for lot ' || CAST(p_partkey % 40 AS STRING) AS quote,
  CAST(CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS STRING) AS claimed,
  CASE p_partkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'mm' WHEN 2 THEN 'sqm' ELSE 'lots' END AS unit, CAST(p_size AS DOUBLE) AS amount
FROM {part}""",
    "measures": """
SELECT p_partkey AS id, CASE p_partkey % 13 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST(NULL AS DOUBLE) ELSE p_size - 25.5 END AS value,
  CASE p_partkey % 9 WHEN 0 THEN 'lte' WHEN 1 THEN '>=' WHEN 2 THEN 'gte' WHEN 3 THEN '<=' WHEN 4 THEN 'lt' WHEN 5 THEN '  ' WHEN 6 THEN 'range' WHEN 7 THEN '==' END AS operator,
  CASE p_partkey % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST(NULL AS DOUBLE) WHEN 2 THEN p_size - 25.5 ELSE p_partkey % 50 - 25 END AS threshold,
  CASE p_partkey % 8 WHEN 0 THEN 'mm' WHEN 1 THEN 'Square Metres' WHEN 2 THEN 'm' WHEN 3 THEN 'Furlong' WHEN 4 THEN ' % ' WHEN 5 THEN 'per cent' WHEN 6 THEN 'DB' END AS unit,
  CASE p_partkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 7 WHEN 6 THEN 10 WHEN 7 THEN 99 END AS code FROM {part}""",
    "names": """
SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN upper(place) || ', CITY OF' WHEN 1 THEN 'city of  ' || place WHEN 2 THEN 'Shire Of ' || place || ' (bbox extent)' WHEN 3 THEN upper(place) WHEN 4 THEN ' ' || place WHEN 5 THEN 'Town of  ' || upper(place) END AS council,
  CASE c_custkey % 9 WHEN 0 THEN 'R ' || CAST(c_custkey % 100 AS STRING) WHEN 1 THEN 'r_ac' || CAST(c_custkey % 5 AS STRING) WHEN 2 THEN 'RR' WHEN 3 THEN 'R0' WHEN 4 THEN 'R12.5/20' WHEN 5 THEN 'Residential' WHEN 6 THEN 'rr-30' WHEN 7 THEN '' END AS code,
  CASE c_custkey % 6 WHEN 0 THEN 'Pct of Rules & metres ' || place WHEN 1 THEN 'setbacks setback ' || place WHEN 2 THEN 'Maximum r40s walls' WHEN 3 THEN place || ' min & min' WHEN 4 THEN 'glass glasses wall req ' || CAST(c_custkey AS STRING) END AS rkey
FROM (SELECT c_custkey, lower(c_mktsegment) || ' ' || CASE c_custkey % 2 WHEN 0 THEN 'heights' ELSE 'bay' END AS place FROM {customer}) c""",
    "answers": """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>first [9]' || chr(10) || '</think>' || text || ' [' || CAST(length(text) % 8 AS STRING) || '] and [5, 3].' WHEN 1 THEN text || ' [2][8]. <THINK>open [1]' WHEN 2 THEN '[3] ' || text || ' [1,3]' ELSE text END AS answer,
  'Sure: ' || CASE turn % 3 WHEN 0 THEN '```json {{"n": ' || CAST(length(text) AS STRING) || ', "o": {{}}}} ```' WHEN 1 THEN '{{"x": 2}} done' ELSE 'no' END AS reply, CASE turn % 3 WHEN 0 THEN 'one, TWO and 3 of 2' WHEN 1 THEN CAST(conv_id AS STRING) || '.5 seven' ELSE text END AS said
FROM (SELECT conv_id, turn, translate(text, '[]<>{{}}', '      ') AS text FROM {conversations} WHERE text IS NOT NULL) t""",
    "objects": """
SELECT event_id, event_type, props, CASE event_id % 4 WHEN 0 THEN '{{"k": 7, "source": "x"}}' WHEN 1 THEN '{{"parked": true, "k": null}}' WHEN 2 THEN '{{"a": {{"B": [1, 2.5]}}, "list": ["x", "y", "x"]}}' ELSE '{{}}' END AS other FROM {events}""",
    "scoped": """
SELECT p_partkey AS rule_id, p_brand AS rule_key, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 4 END AS council, CASE p_partkey % 5 WHEN 0 THEN 'Z1,Z2' WHEN 1 THEN 'Z2' WHEN 2 THEN 'Z3' END AS zones,
  CASE p_partkey % 7 WHEN 0 THEN 'R20' WHEN 1 THEN 'R20,R40' WHEN 2 THEN 'R60' END AS codes, CASE WHEN p_partkey % 6 = 0 THEN 'pending' ELSE 'approved' END AS state FROM {part}""",
    "legal": """
SELECT p_partkey AS rule_id, p_partkey % 40 AS version_id, p_partkey % 9 AS source_id, 'key' || CAST(p_partkey % 6 AS STRING) || '.x' || CAST(p_partkey AS STRING) AS rule_key, CASE WHEN p_partkey % 4 = 0 THEN 'key' || CAST(p_partkey % 5 AS STRING) END AS stated_base,
  CASE p_partkey % 3 WHEN 0 THEN 'design_principle' ELSE 'deemed_to_comply' END AS pathway, CASE WHEN p_partkey % 6 = 1 THEN 'pending' ELSE 'approved' END AS state, CASE p_partkey % 5 WHEN 0 THEN 'exception' WHEN 1 THEN NULL ELSE 'standard' END AS rule_type,
  'except as in clause ' || CAST(p_partkey % 50 AS STRING) || '.' AS quote, p_name AS clause_text, 'clause ' || CAST((p_partkey + 7) % 50 AS STRING) || '.' AS clause_path, CASE WHEN p_partkey % 7 = 0 THEN '' END AS section_ref,
  CASE WHEN p_partkey % 2 = 0 THEN 'lte' ELSE 'gte' END AS operator, p_size AS value, 'm' AS unit, CASE p_partkey % 4 WHEN 0 THEN 'R20,R30' WHEN 1 THEN 'R30' END AS codes FROM {part}""",
    "clauses": """
SELECT p_partkey AS clause_key, p_partkey % 30 AS version_id, CASE p_partkey % 5 WHEN 0 THEN 'definition' WHEN 1 THEN 'procedural' WHEN 2 THEN 'other' ELSE 'rule_bearing' END AS disposition,
  CASE WHEN p_partkey % 5 = 0 THEN '"' || p_type || '" means a thing of ' || p_brand ELSE 'The ' || lower(p_type) || ' shall follow ' || p_name || ', see Planning Act 2005.' END AS text FROM {part}""",
    "runs": """
SELECT o_orderkey AS run_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'has_likely_failures' ELSE 'incomplete' END AS status, o_orderkey % 50 AS skill_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS trace_id FROM {orders}""",
    "results": """
SELECT l_orderkey * 8 + l_linenumber AS result_id, l_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'likely_pass' WHEN 'R' THEN 'likely_fail' ELSE 'unsupported' END AS status, CASE WHEN l_partkey % 9 <> 0 THEN l_partkey END AS rule_id,
  CASE WHEN l_suppkey % 10 <> 0 THEN CAST(l_suppkey AS STRING) || ',' || CAST(l_partkey % 300 AS STRING) END AS citations, CASE WHEN l_partkey % 11 <> 0 THEN 'step' END AS trace
FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber)""",
    "reviews": """
SELECT event_id AS review_id, user_id % 400 AS version_id, ts AS reviewed, CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'approved' ELSE 'rejected' END AS status FROM {events}""",
    "findings": """
SELECT c_custkey AS finding_id, CASE c_custkey % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'converted_to_capa' ELSE 'rejected' END AS status, c_custkey % 40 AS created, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS decided_by,
  CASE WHEN c_custkey % 7 <> 0 THEN 'why' ELSE '' END AS reason, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey END AS evidence, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 2 % 700 END AS capa_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3 END AS trace_id FROM {customer}""",
    "items": """
SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'closed' ELSE 'open' END AS status, CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS severity, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS owner,
  CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 90 END AS due, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS closure, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 60 END AS check_due, CASE WHEN p_partkey % 2 = 0 THEN 'good' END AS effect,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 200 END AS proposed_by, 'eval_run' AS subject_type, p_partkey * 4 AS subject_id FROM {part}""",
    "controls": """
SELECT s_suppkey AS control_id, 'risk' || CAST(s_suppkey % 30 AS STRING) AS code, CASE WHEN s_suppkey % 6 = 0 THEN '' WHEN s_suppkey % 7 <> 0 THEN 'role' END AS owner, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 50 END AS every, CASE WHEN s_suppkey % 5 <> 0 THEN 100 - s_suppkey % 60 END AS tested FROM {supplier}""",
    "risks": """
SELECT 'risk' || CAST(n_nationkey AS STRING) AS code, 'stage' || CAST(n_nationkey % 8 AS STRING) AS owner FROM {nation}""",
    "steps": """
SELECT c_custkey AS step_id, 'stage' || CAST(c_custkey % 11 AS STRING) AS stage, c_custkey % 3 = 0 AS critical FROM {customer}""",
    "kpis": """
SELECT n_nationkey AS kpi_id, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END AS cadence FROM {nation}""",
    "kpi_results": """
SELECT s_nationkey + 1 AS kpi_id, 100 - s_suppkey % 40 AS computed FROM {supplier}""",
    "exports": """
SELECT o_orderkey AS export_id, o_orderkey AS run_id, CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 5 <> 0 THEN 'sha' END AS sha256, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS valid FROM {orders}""",
    "extracted": """
SELECT p_partkey AS candidate_id, 'setback of ' || CAST(p_size AS STRING) || ' m' AS quote, CASE WHEN p_partkey % 6 = 0 THEN 'No text' ELSE 'The  setback of ' || CAST(p_size AS STRING) || ' m' || CASE WHEN p_partkey % 4 = 0 THEN ' is fine' ELSE ' shall be kept' END END AS clause,
  CASE WHEN p_partkey % 3 = 0 THEN 'definition' ELSE 'rule_bearing' END AS disposition, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1000000 WHEN p_partkey % 7 = 0 THEN p_size * 10 ELSE p_size END AS number,
  CASE p_partkey % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'mm' WHEN 2 THEN '%' WHEN 3 THEN 'storeys' END AS unit, CASE WHEN p_partkey % 8 = 0 THEN 'Bad Key' ELSE 'side_setback' END AS rkey FROM {part}""",
}


def parts(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A bound view, or a table where there is no view of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{p: view(spark, sf_dir, p) for p in set(parts(sql))})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions."""
    used: list[str] = []

    def add(text: str) -> None:
        for p in parts(text):
            if p in VIEWS and p not in used:
                add(VIEWS[p])
                used.append(p)

    add(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], s).replace("AS STRING)", "AS VARCHAR)").replace("{{", "{").replace("}}", "}")
    head = ", ".join(f"v_{n} AS ({plain(VIEWS[n])})" for n in used)
    return f"WITH {head} {', ' if sql.lstrip().upper().startswith('WITH') else ''}{plain(sql).lstrip()[4:] if sql.lstrip().upper().startswith('WITH') else plain(sql)}" if used else plain(sql)
