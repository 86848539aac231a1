"""Copies of places, polygons, rules and texts cost no more tests or rows than one of each."""

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plumbline.operators import advice, checks, geo, graph, measurements, places, ranking, rules, search, tables
from plumbline.plans.registry import QUERIES, SQL
from plumbline.sources import readers
from tests.compare import assert_matches


def square(x, y, n):
    return [(float(x), float(y)), (float(x + n), float(y)), (float(x + n), float(y + n)), (float(x), float(y + n))]


def shapes(spark, rows):
    return spark.createDataFrame(rows, "box_id int, ring array<struct<x:double,y:double>>")


def test_equal_places_and_rings_are_tested_once(spark, monkeypatch):
    tested, real = spark.sparkContext.accumulator(0), geo.distance

    @F.udf("boolean")
    def count(_):
        tested.add(1)
        return True

    monkeypatch.setattr(geo, "distance", lambda ring, x, y: F.when(count(x), real(ring, x, y)))
    points = spark.createDataFrame([(i, 1.5 + i % 2, 1.5) for i in range(40)], "point_id int, x double, y double").coalesce(1)
    boxes = shapes(spark, [(i, square(1, 1, 1)) for i in range(20)]).coalesce(1)
    got = geo.point_join(points, boxes, 4.0).select("point_id", "box_id").collect()
    assert len(got) == 20 * 20 and {r["point_id"] % 2 for r in got} == {0}
    assert tested.value <= 8


def test_equal_places_and_parcels_are_tested_once(spark, monkeypatch):
    tested, real = spark.sparkContext.accumulator(0), geo.metres_to

    @F.udf("boolean")
    def count(_):
        tested.add(1)
        return True

    monkeypatch.setattr(geo, "metres_to", lambda rings, x, y: F.when(count(x), real(rings, x, y)))
    points = spark.createDataFrame([(i, 116.0005 + i % 2 * 0.001, -31.9995) for i in range(40)] + [(3, 116.0005, -31.9995), (50, None, 1.0)], "point_id int, x double, y double").coalesce(1)
    lot = lambda x: [square(x, -32, 0.0009)]
    lots = spark.createDataFrame([(30 - i, lot(116)) for i in range(20)] + [(60 + i, lot(116.003)) for i in range(20)] + [(99, lot(116.00102))], "parcel_id int, rings array<array<struct<x:double,y:double>>>").coalesce(1)
    got = sorted((r["point_id"], r["parcel_id"], r["distance"]) for r in geo.parcels_within(points, lots, 0.01, 40.0).collect())
    assert got == [(i, 99 if i % 2 and i != 3 else 11, 0.0) for i in range(40)]
    assert tested.value <= 4  # envelopes that are too far away are not tested


def test_nearest_takes_the_least_id_of_rounded_ties(spark):
    points = spark.createDataFrame([(0, 1.5, 1.5), (1, 2.0 + 4e-7, 1.5), (2, 5.0, 1.5), (3, 90.0, 90.0)], "point_id int, x double, y double")
    boxes = shapes(spark, [(7, square(1, 1, 1)), (3, square(1, 1, 1)), (9, square(2, 1, 1)), (5, square(6, 1, 1)), (4, square(2, 1, 2))])
    got = {r["point_id"]: (r["box_id"], r["distance"]) for r in geo.nearest_polygon(points, boxes, 4.0, 2.0, "box_id").collect()}
    assert got == {0: (3, 0.0), 1: (3, 0.0), 2: (4, 1.0)}


def test_polygon_pairs_of_copies(spark, monkeypatch):
    tested, real = spark.sparkContext.accumulator(0), geo.intersects

    @F.udf("boolean")
    def count(_):
        tested.add(1)
        return True

    monkeypatch.setattr(geo, "intersects", lambda a, b: count(F.size(a) + F.size(b)) & real(a, b))
    rows = shapes(spark, [(i, square(i % 2, 0, 1)) for i in range(20)] + [(99, square(3, 3, 1))]).coalesce(1)
    left, right = (rows.select(F.col("box_id").alias(f"{s}_id"), F.col("ring").alias(f"{s}_ring")) for s in ("left", "right"))
    got = geo.polygon_join(left, right, 8.0).collect()
    assert len(got) == 20 * 20 + 1 and tested.value <= 10


def test_pairs_of_rules_are_told_once_without_a_shuffle_of_them(spark):
    of = lambda i, version, key, path, state="approved", stated=None: (i, version, key, stated, path, state)
    rows = [of(i, i % 2, f"k{i % 3}.x", "design_principle") for i in range(30)] + [of(i, i % 2, f"k{i % 3}.y", "deemed_to_comply") for i in range(20, 90)]
    rows += [of(1, v, "k9", p) for v in (4, 5, 5) for p in ("design_principle", "deemed_to_comply")] + [of(7, v, "other.z", "deemed_to_comply", stated="k9") for v in (4, 5)]
    rows += [of(8, None, "k9", "deemed_to_comply"), of(9, 4, None, "deemed_to_comply"), of(10, 4, "k9", "deemed_to_comply", "pending"), of(None, 4, "k9", "design_principle")]
    legal = spark.createDataFrame(rows, "rule_id int, version_id int, rule_key string, stated_base string, pathway string, state string")
    base = lambda r: r[3] or (r[2] and r[2].split(".")[0])
    side = lambda p: [(r[0], r[1], base(r)) for r in rows if r[4] == p and r[5] == "approved" and r[1] is not None and base(r)]
    want = {(a, b) for a, v, k in side("design_principle") for b, w, m in side("deemed_to_comply") if (v, k) == (w, m)}
    out = graph.alternative_edges(legal)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and (1, 7) in want
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # not an aggregate of all pairs


def test_pairs_of_a_key_are_whole_in_any_parts_and_bundles(spark, monkeypatch):
    left = [(k, v) for k, n in ((1, 30), (2, 1), (3, 9), (None, 2)) for v in range(n)] + [(1, 5), (1, None)]
    right = [(k, f"r{v}", v) for k, n in ((1, 21), (2, 40), (4, 9), (None, 2)) for v in range(n)] + [(1, "r3", 3), (2, None, None)]
    want = sorted(((k, a, *b) for k, a in left for j, *b in right if k is not None and k == j), key=repr)
    frames = spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b string, c int")
    for pairs, bundles in ((50, (7, 3)), (10**9, (512, 128))):
        monkeypatch.setattr(tables, "SPREAD_PAIRS", pairs)
        monkeypatch.setattr(tables, "SPREAD_BUNDLES", bundles, raising=False)
        for l, r in (frames, (frames[0].limit(0), frames[1])):  # noqa: E741
            got = tables.spread_join(l, r, ["k"])
            assert got.columns == ["k", "a", "b", "c"] and sorted(map(tuple, got.collect()), key=repr) == (want if l is frames[0] else [])


def test_pairs_take_little_room_where_they_are_written(spark, tmp_path):
    of = lambda i, path: F.struct(i.alias("rule_id"), F.lit(1).alias("version_id"), F.lit("k.x").alias("rule_key"), F.lit(None).cast("string").alias("stated_base"), F.lit(path).alias("pathway"), F.lit("approved").alias("state"))
    kind = F.when(F.col("id") < 100, of(F.col("id"), "design_principle")).otherwise(of(F.col("id"), "deemed_to_comply"))
    graph.alternative_edges(spark.range(30_100).select(kind.alias("r")).select("r.*")).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100 * 30_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 100 * 30_000  # a byte a pair


def test_facts_of_a_parcel_are_made_once(spark):
    told = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(kind, value):
        told.add(1)
        return f"{kind} {value}"

    props = spark.createDataFrame([(i, 1 if i < 40 else None) for i in range(50)], "project_id int, parcel_id int").coalesce(1)
    parcels = spark.createDataFrame([(1, 5.0, None, None, "PERTH, CITY OF"), (2, 1.0, 1.0, 1.0, None)], "parcel_id int, area_m2 double, width_m double, depth_m double, local_government string")
    features = spark.createDataFrame([(1, i, "bushfire", "B", None, None, None) for i in range(30)], "parcel_id int, feature_id int, layer_type string, code string, label string, stamped string, meta_code string").coalesce(1)
    old = spark.createDataFrame([(3, "lot_area_m2", "{}", "spatial_derived", None), (3, "mine", "1", None, None), (99, "far", "2", "spatial_derived", None)], "project_id int, fact_type string, value string, method string, feature_id int")
    out = places.synth_facts(props, parcels, features, old, shown=count).collect()
    assert len(out) == 40 * 32 + 2 and {r["shown"] for r in out} == {f"{r['fact_type']} {r['value']}" for r in out}
    assert told.value <= 3 * 40  # not for each of the 1,282 facts


def test_only_facts_of_maps_meet_projects(spark):
    props = spark.createDataFrame([(1, 1), (1, None), (2, None), (None, 5)], "project_id int, parcel_id int")
    parcels = spark.createDataFrame([], "parcel_id int, area_m2 double, width_m double, depth_m double, local_government string")
    features = spark.createDataFrame([], "parcel_id int, feature_id int, layer_type string, code string, label string, stamped string, meta_code string")
    old = [(p, m) for p in (1, 2, 3, None) for m in ("spatial_derived", "manual_override", None)] * 2
    facts = spark.createDataFrame([(p, "t", "v", m, None) for p, m in old], "project_id int, fact_type string, value string, method string, feature_id int")
    out = places.synth_facts(props, parcels, features, facts)
    want = [(p, m) for p, m in old if m != "spatial_derived" or p not in (1, 2)]
    assert sorted(((r["project_id"], r["method"]) for r in out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"Join LeftAnti, \(project_id", plan)) == 1 and not re.search(r"Join LeftSemi, \(project_id", plan)


def test_numbers_meet_distinct_runs_of_quotes(spark):
    clauses = [(v, i, f"of {i} m, {i}.5 and 0 in 2005, {i % 3}") for v in (1, 2) for i in range(60)] + [(None, 1, "9"), (3, 1, "1234567"), (1, 99, None)]
    quotes = [(1, f"set at {i} m") for i in range(40)] + [(1, "v1.2.55x7"), (2, "1" * 30 + "41.5" + "3" * 30), (2, None), (None, "9"), (3, "99123456 7")]

    def numbers(text):
        return {n for n in re.findall(r"\d+(?:\.\d+)?", text or "") if n != "0" and not re.fullmatch(r"(19|20)\d\d", n)}

    want = {(v, k, n) for v, k, t in clauses for n in numbers(t) if not any(v is not None and v == w and q and n in q for w, q in quotes)}
    frames = [spark.createDataFrame(rows, f"version_id int, {rest}").coalesce(1) for rows, rest in ((clauses, "clause_key int, text string"), (quotes, "quote string"))]
    out = advice.unclaimed_numbers(*frames)
    got = [tuple(r) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) and (2, 41, "41.5") not in want
    assert "Contains(quote" not in out._jdf.queryExecution().optimizedPlan().toString()  # no search of each quote for each number


def test_rules_of_one_kind_are_filed_once(spark, monkeypatch):
    filed, real = [], rules._scoped
    monkeypatch.setattr(rules, "_scoped", lambda df: filed.append(df.count()) or real(df))
    rows = [("c", None if i % 2 else 3, [["R1", "R2"], None][i // 2 % 2], i, "lte", 1.0 if i < 150 else None, "exception" if i % 5 == 0 else None, i % 7) for i in range(200)]
    given = spark.createDataFrame(rows, "check_key string, council int, r_codes array<string>, rule_id int, operator string, threshold double, rule_type string, created int")
    scopes = [(3, "R1"), (4, "R2"), (4, "R9"), (None, "R1"), (3, None), (None, None)]
    got = {(r["council"], r["r_code"]): r["rule_id"] for r in rules.select_rules(given, spark.createDataFrame(scopes, "council int, r_code string")).collect()}

    def best(council, code):
        fits = [r for r in rows if (council is None or r[1] in (None, council)) and (code is None or r[2] is None or code in r[2])]
        return max(fits, key=lambda r: (r[5] is not None, r[6] != "exception", 1 if r[2] is None else 0 if code is None else 2, r[7], r[3]))[3]

    assert got == {s: best(*s) for s in scopes} and filed == [4]


def test_checks_of_a_project_are_multiplied_out_in_compiled_code(spark):
    projects = spark.createDataFrame([(1, "c"), (2, " "), (3, None)], "project_id int, council string")
    facts = [(1, "site_area_m2", 7.0, None, "map"), (1, "proposed_covered_area_m2", 3.0, None, "map"), (1, "proposed_plot_ratio", 0.5, None, "assumption"), (1, "r_code", None, "R20", "map"), (2, "frontage_width_m", 5.0, None, "map")]
    facts = spark.createDataFrame([(*f, "confirmed", 1, 1) for f in facts], "project_id int, fact_type string, value double, text string, method string, review_status string, created int, tie int")
    given = [(1, "site_cover", "5"), (2, "plot_ratio.x", "1"), (3, "min_frontage", "4"), (4, "garage_width", None)]
    rules_ = spark.createDataFrame([(i, k, None, None, t, "gte", "standard", None, None, None, None, 1, "m", "none", "approved", i) for i, k, t in given], """rule_id int, rule_key string, base_rule_key string, canonical string, threshold string, operator string,
        rule_type string, council string, zones array<string>, r_codes array<string>, dwelling_type string, created int, unit string, pathway string, state string, source_version_id int""")
    out = checks.run_checks(projects, facts, rules_)
    rows = out.collect()
    assert len(rows) == 3 * len(checks.CHECKS)
    got = {(r["project_id"], r["check_key"]): (r["status"], r["reason"], r["measured"]) for r in rows if r["rule_id"] is not None and r["project_id"] < 3}
    assert got[1, "site_cover"] == ("likely_pass", None, 7.0)  # of the second type, as there is none of the first
    assert got[1, "plot_ratio"] == ("needs_more_info", "assumption_fact_unconfirmed", 0.5) and got[2, "min_frontage"] == ("likely_pass", None, 5.0)
    assert got[2, "garage_width"] == ("needs_more_info", "missing_rule_threshold", 5.0) and got[2, "site_cover"] == ("needs_more_info", "missing_measurement_fact", None)
    fields = {(r["project_id"], r["check_key"]): r["trace"] for r in checks.run_checks(projects, facts, rules_, traced=False).collect()}
    for r in rows:
        told = {k: v for k, v in fields[r["project_id"], r["check_key"]].asDict().items() if v is not None}
        assert (json.loads(r["trace"]) if r["trace"] else {}) == told and (r["trace"] is None) == (r["rule_id"] is None)
    codes = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that all of the plan is there before it runs
    try:
        for traced in (True, False):
            code = checks.run_checks(projects, facts, rules_, traced=traced)._jdf.queryExecution().explainString(codes)
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8_000  # bytes that the JVM compiles
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_facts_are_dealt_by_project_before_they_are_compared(spark):
    facts = spark.createDataFrame([(1, "a", float(i), "map", i, 0) for i in range(9)] + [(2, "a", 1.0, None, 1, 0), (2, "b", 1.0, "map", 1, 0)], "project_id int, fact_type string, value double, method string, created int, tie int")
    projects = spark.createDataFrame([(1, 3, "R1"), (2, 3, "R1"), (3, 4, None)], "project_id int, council int, r_code string")
    given = spark.createDataFrame([("a", 3, ["R1"], 5, "gte", 8.0, None, 1)], "check_key string, council int, r_codes array<string>, rule_id int, operator string, threshold double, rule_type string, created int")
    out = rules.evaluate(projects, facts, given, ["a"])
    assert sorted((r["project_id"], r["rule_id"], r["value"], r["status"]) for r in out.collect()) == [(1, 5, 8.0, "pass"), (2, 5, 1.0, "needs_more_info"), (3, None, None, "unsupported")]
    sides = out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [project_id")
    assert len(sides) == 2 and "Aggregate" not in sides[1]


def test_pages_leave_in_small_batches(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "x")], "page_id int, html string")
    taken = []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, run, kind: taken.append(run) or self)
    readers.html_text(pages)
    sources = [None if i == 3 else f'<title>t{i}</title><p>a</p><p>a</p><a href="u{i}">' for i in range(450)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(450)), pa.array(sources)], ["page_id", "__html"])
    out = list(taken[0](iter([batch])))
    rows = [r for b in out for r in b.to_pylist()]
    assert [b.num_rows for b in out] == [200, 200, 50]
    assert rows == [{"page_id": i, "text": "" if i == 3 else f"t{i}\na", "links": [] if i == 3 else [f"u{i}"]} for i in range(450)]


def test_words_of_patterns_leave_out_no_match(spark):
    texts = ["sheet tıtle: Ground plan", "drawing TİTLE: Roof", "DRAWıNG NO: A1", "9 m² or 8 ſq m", "7 PER CENT", "nothing"]
    found = measurements.measurements(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    got = sorted((r["doc_id"], r["fact_key"], r["value"] or r["text_value"]) for r in found)
    assert got == [(0, "drawing_title", "Ground plan"), (1, "drawing_title", "Roof"), (2, "drawing_number", "A1"), (3, "proposed_area_sqm", 8.0), (3, "proposed_area_sqm", 9.0), (4, "proposed_percentage", 7.0)]


def test_search_sorts_the_best_rows_of_a_shard_only(spark, tmp_path, monkeypatch):
    given, real = [], search.rows_per_key
    monkeypatch.setattr(search, "rows_per_key", lambda df, *a: given.append(df.count()) or real(df, *a))
    monkeypatch.setattr(advice, "rows_per_key", search.rows_per_key, raising=False)
    monkeypatch.setattr(search, "CELLS", 40, raising=False)
    docs = [(i, f"the word w{i % 7} of  The\nword") for i in range(300)] + [(400, None), (401, "")]
    asked = [(1, "The word w3"), (2, "w0 of the"), (3, "nowhere"), (4, None), (5, "the ord")]
    again = (7, "the word w0 twice w0 of the word")  # of an id that is there
    for name, rows in (("lexical_search", [*docs, again]), ("evidence_search", docs)):
        for table, names, of in (("documents", ["doc_id", "text"], rows), ("benchmark", ["item_id", "text"], asked)):
            pq.write_table(pa.table([list(c) for c in zip(*of)], names=names), f"{tmp_path}/{table}.parquet")
        assert_matches(QUERIES[name](spark, str(tmp_path)), str(tmp_path), SQL[name])
    assert given and max(given) <= 4 * 5


def test_rounding_is_sparks(spark):
    x = np.array([[0.1234565, 1 / 128, 0.00390625], [0.65 * 0.7 + 0.35 * 0.1, 0.99999951, 2.5e-7], [1.25, 0.0, 0.0000005]])
    got = [r["y"] for r in spark.createDataFrame([(float(v),) for v in x.flat], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert search.rounded(x, 6).ravel().tolist() == got


def test_cover_density_gathers_positions_of_texts_with_the_rarest_word_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the of " * 20 + (f"rare{i}" if i < 5 else "")) for i in range(200)], "doc_id int, text string")
    asked = spark.createDataFrame([(i, f"the of rare{i}") for i in range(40)], "query_id int, text string")
    made, join = [], type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda *a, **b: made.append(join(*a, **b)) or made[-1])
    got = ranking.cover_density(asked, docs, limit=3).select("query_id", "doc_id").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(5)]
    monkeypatch.undo()
    assert max(df.count() for df in made) <= 200 * 2 * 20 + 5
