"""Distances, projections, holes and parcels against published values and plain versions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geodesy
from plumbline.operators import geo
from plumbline.sources import readers

lit = F.lit


def dms(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3_600, d)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_a_published_geodesic(spark):
    a = (dms(144, 25, 29.52440), dms(-37, 57, 3.72030))
    b = (dms(143, 55, 35.38390), dms(-37, 39, 10.15610))
    got = one(spark, geodesy.distance(*map(lit, (*a, *b))))
    assert abs(got - 54_972.271) < 0.001
    assert one(spark, geodesy.distance(*map(lit, (*a, *a)))) == 0
    assert abs(one(spark, geodesy.distance(lit(0.0), lit(0.0), lit(1.0), lit(0.0))) - math.radians(1) * geodesy.A) < 0.001
    assert one(spark, geodesy.distance(lit(0.0), lit(0.0), lit(180.0), lit(0.0))) is None


def test_a_published_change_of_datum(spark):
    got = one(spark, geodesy.to_gda2020(lit(dms(133, 53, 7.84785)), lit(dms(-23, 40, 12.44602))))
    assert abs(got["y"] - dms(-23, 40, 12.39650)) < 1e-8 and abs(got["x"] - dms(133, 53, 7.87779)) < 1e-8


def test_the_projection_is_conformal_and_true_on_its_parallels(spark):
    for lat in (-18.0, -27.0, -36.0):
        p = [one(spark, geodesy.lambert(lit(116.0 + dx), lit(lat + dy))) for dx, dy in ((0, 0), (1e-4, 0), (0, 1e-4))]
        east, north = (math.hypot(q["x"] - p[0]["x"], q["y"] - p[0]["y"]) for q in p[1:])
        real_east = one(spark, geodesy.distance(lit(116.0), lit(lat), lit(116.0 + 1e-4), lit(lat)))
        real_north = one(spark, geodesy.distance(lit(116.0), lit(lat), lit(116.0), lit(lat + 1e-4)))
        assert abs(east / real_east - north / real_north) < 1e-5
        assert (abs(east / real_east - 1) < 1e-5) == (lat != -27.0)


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


SQUARE = ring((116, -32), (116.002, -32), (116.002, -32.002), (116, -32.002))
HOLE = ring((116.0005, -32.0005), (116.0015, -32.0005), (116.0015, -32.0015), (116.0005, -32.0015))
KIND = "array<array<struct<x:double,y:double>>>"


def test_holes_are_left_out(spark):
    df = spark.createDataFrame([(1, [SQUARE, HOLE]), (2, [SQUARE]), (3, [HOLE])], f"parcel_id int, rings {KIND}")
    m = {r["parcel_id"]: r for r in df.select("parcel_id", *[v.alias(k) for k, v in geo.polygon_metrics(F.col("rings")).items()]).collect()}
    assert math.isclose(m[1]["area"], m[2]["area"] - m[3]["area"], rel_tol=1e-9) and 30_000 < m[1]["area"] < 33_000
    assert m[1]["corner_lot"] and abs(m[2]["longest_edge"] / one(spark, geodesy.distance(lit(116.0), lit(-32.0), lit(116.0), lit(-32.002))) - 1) < 0.02
    inside = df.select("parcel_id", geo.covers(F.col("rings"), lit(116.001), lit(-32.001)).alias("mid"), geo.covers(F.col("rings"), lit(116.0002), lit(-32.001)).alias("rim"), geo.metres_to(F.col("rings"), lit(116.001), lit(-32.001)).alias("d"))
    got = {r["parcel_id"]: tuple(r)[1:] for r in inside.collect()}
    assert got[1][:2] == (False, True) and got[2][:2] == (True, True) and got[3][:2] == (True, False) and got[2][2] == 0
    assert abs(got[1][2] - one(spark, geodesy.distance(lit(116.001), lit(-32.001), lit(116.0015), lit(-32.001)))) < 0.001
    narrow = ring((116, -32), (116.002, -32), (116.002, -32.0001), (116, -32.0001))
    flat = spark.createDataFrame([([narrow],)], f"rings {KIND}").select(geo.polygon_metrics(F.col("rings"))["corner_lot"].alias("c"))
    assert flat.first()["c"] is True  # its two long sides are equal


@pytest.mark.parametrize("cell", [0.0005, 0.01])
def test_parcels_within_equal_all_pairs(spark, cell):
    rng = random.Random(1)
    parcels = [(0, [ring((115, -33), (118, -33), (118, -31), (115, -31)), ring((115.9, -32.1), (116.1, -32.1), (116.1, -31.9), (115.9, -31.9))])]
    for i in range(1, 60):
        x, y, w = 116 + rng.random() * 0.01, -32 + rng.random() * 0.01, 0.0001 + rng.random() * 0.001
        parcels.append((i, [ring((x, y), (x + w, y), (x + w / 2, y + w))]))
    points = [(i, 116 + rng.random() * 0.012 - 0.001, -32 + rng.random() * 0.012 - 0.001) for i in range(150)] + [(900, 115.5, -32.5), (901, 116.05, -32.05), (902, 0.0, 0.0), (903, 115.9 + 1e-5, -32.0)]
    p, q = spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(parcels, f"parcel_id int, rings {KIND}")
    pairs = p.join(q).withColumn("d", geo.metres_to(F.col("rings"), F.col("x"), F.col("y"))).where("d <= 25").collect()
    want = {}
    for r in pairs:
        want[r["point_id"]] = min(want.get(r["point_id"], (math.inf, 0)), (r["d"], r["parcel_id"]))
    got = {r["point_id"]: (r["distance"], r["parcel_id"]) for r in geo.parcels_within(p, q, cell, 25.0).collect()}
    assert got == want and got[900] == (0.0, 0) and 901 not in got and 902 not in got and got[903][1] == 0
    assert geo.parcels_within(p, q.limit(0), cell).count() == 0


def test_geojson_with_holes_and_datum(spark, tmp_path):
    square, hole = ([[p["x"], p["y"]] for p in r] for r in (SQUARE, HOLE))
    shapes = [{"type": "Polygon", "coordinates": [square, hole]}, {"type": "MultiPolygon", "coordinates": [[square], [hole]]}, {"type": "Point", "coordinates": [1, 2]}, None]
    for name, crs in (("new", None), ("old", {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::4283"}})):
        (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", **({"crs": crs} if crs else {}), "features": [{"properties": {"n": i}, "geometry": g} for i, g in enumerate(shapes)]}))
    rows = sorted((r["feature"], len(r["rings"]), r["ring"][0]["x"]) for r in readers.geojson(spark, str(tmp_path / "new.json")).collect())
    assert rows == [(0, 2, 116.0), (1, 1, 116.0), (1, 1, 116.0005)]
    moved = readers.geojson(spark, str(tmp_path / "old.json")).where("feature = 0").first()
    shift = one(spark, geodesy.distance(lit(116.0), lit(-32.0), lit(moved["ring"][0]["x"]), lit(moved["ring"][0]["y"])))
    assert 1.5 < shift < 2.0 and len(moved["rings"][1]) == 4


def test_places_on_edges_and_ties_are_exact(spark):
    wide = lambda i, holed: (i, [SQUARE, HOLE] if holed else [SQUARE])
    beside = (1, [ring((116.0025, -32.0003), (116.0031, -32.0003), (116.0031, -32.0017), (116.0025, -32.0017))])
    q = spark.createDataFrame([wide(2, False), wide(0, True), beside, (9, [ring((116.0025, -31.9), (116.003, -31.9), (116.003, -32.1), (116.0025, -32.1))])], f"parcel_id int, rings {KIND}")
    ys = [-32.0005 - n * 1e-4 / 3 for n in range(30)]
    points = [(n, 116.0005, y) for n, y in enumerate(ys)] + [(100 + n, 116.00237, y) for n, y in enumerate(ys)]
    got = {r["point_id"]: (r["parcel_id"], r["distance"]) for r in geo.parcels_within(spark.createDataFrame(points, "point_id int, x double, y double"), q, 0.002, 40.0).collect()}
    assert all(got[n] == (0, 0.0) for n in range(30))  # on an edge of the hole, not a rounding away from it
    assert all(got[100 + n][0] == 1 for n in range(30))  # two edges on one meridian are equally far


def test_a_corner_of_two_parcels_is_equally_far_from_both(spark):
    box = lambda x0, y0, x1, y1: ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    lots = [(125, box(115.81, -32.094, 115.812, -32.091)), (1411, box(115.80799999999999, -32.094, 115.812, -32.092)), (2155, box(115.88499999999999, -32.094, 115.889, -32.092)), (109, box(115.887, -32.094, 115.889, -32.092))]
    q = spark.createDataFrame([(i, [r]) for i, r in lots], f"parcel_id int, rings {KIND}")
    p = spark.createDataFrame([(1, 115.81205, -32.09405), (2, 115.88905, -32.09405)], "point_id int, x double, y double")
    got = {r["point_id"]: r["parcel_id"] for r in geo.parcels_within(p, q, 0.002, 40.0).collect()}
    assert got == {1: 125, 2: 109}
