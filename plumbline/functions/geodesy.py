"""Positions on the ellipsoid, in degrees: distances, a conic projection, a change of datum, and metres around a place."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid GRS80; the conic projection for areas (first and second parallel, central meridian); the seven
# parameters from GDA94 to GDA2020 (metres, seconds of arc, parts in a million).
A, FLAT = 6_378_137.0, 1 / 298.257222101
PARALLELS, MERIDIAN = (-18.0, -36.0), 134.0
SHIFT, TURN, SCALE = (0.06155, -0.01087, -0.04019), (-0.0394924, -0.0327221, -0.0328979), -0.009994

B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)


def _once(value: Column, body) -> Column:
    """The body over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, steps: int = 15) -> Column:
    """JN-11: metres along the geodesic between two places, by Vincenty's inverse series; null where it does not settle (nearly
    opposite places)."""
    u = lambda lat: F.atan((1 - FLAT) * F.tan(F.radians(lat)))
    first = F.struct(F.radians(lon2 - lon1).alias("l"), F.sin(u(lat1)).alias("s1"), F.cos(u(lat1)).alias("c1"), F.sin(u(lat2)).alias("s2"), F.cos(u(lat2)).alias("c2"))

    def solve(p: Column) -> Column:
        def arc(lam: Column) -> Column:
            y = F.hypot(p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam))
            x = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)
            return F.struct(y.alias("y"), x.alias("x"), F.atan2(y, x).alias("sigma"), F.coalesce(p["c1"] * p["c2"] * F.sin(lam) / F.nullif(y, F.lit(0.0)), F.lit(0.0)).alias("sa"))

        def middle(a: Column) -> Column:
            ca2 = 1 - a["sa"] * a["sa"]
            return F.coalesce(a["x"] - 2 * p["s1"] * p["s2"] / F.nullif(ca2, F.lit(0.0)), F.lit(0.0))

        def step(acc: Column, _: Column) -> Column:
            def moved(a: Column) -> Column:
                ca2, m = 1 - a["sa"] * a["sa"], middle(a)
                c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
                return p["l"] + (1 - c) * FLAT * a["sa"] * (a["sigma"] + c * a["y"] * (m + c * a["x"] * (-1 + 2 * m * m)))

            return _once(_once(arc(acc["lam"]), moved), lambda lam: F.struct(lam.alias("lam"), F.abs(lam - acc["lam"]).alias("moved")))

        def length(last: Column) -> Column:
            def metres(a: Column) -> Column:
                ca2, m = 1 - a["sa"] * a["sa"], middle(a)
                v = ca2 * (A * A - B * B) / (B * B)
                big = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
                small = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
                bend = small * a["y"] * (m + small / 4 * (a["x"] * (-1 + 2 * m * m) - small / 6 * m * (-3 + 4 * a["y"] * a["y"]) * (-3 + 4 * m * m)))
                return B * big * (a["sigma"] - bend)

            return F.when(last["moved"] < 1e-11, _once(arc(last["lam"]), metres))

        start = F.struct(p["l"].alias("lam"), F.lit(1.0).alias("moved"))
        return _once(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step), length)

    same = (lon1 == lon2) & (lat1 == lat2)
    return F.when(same, 0.0).otherwise(_once(first, solve))


def around(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of a place, by its radii of curvature; good to a millimetre for places some hundred metres away."""
    s2 = F.pow(F.sin(F.radians(lat0)), 2)
    w = F.sqrt(1 - E2 * s2)
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * A / w, F.radians(lat - lat0) * A * (1 - E2) / (w * w * w)


def _t(phi: Column) -> Column:
    return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - E * F.sin(phi)) / (1 + E * F.sin(phi)), E / 2)


def lambert(lon: Column, lat: Column) -> Column:
    """MTH-11: x and y in metres of the conformal conic projection with two standard parallels, its origin on the equator."""
    t = lambda phi: math.tan(math.pi / 4 - phi / 2) / ((1 - E * math.sin(phi)) / (1 + E * math.sin(phi))) ** (E / 2)
    m = lambda phi: math.cos(phi) / math.sqrt(1 - E2 * math.sin(phi) ** 2)
    p1, p2 = map(math.radians, PARALLELS)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = m(p1) / (n * t(p1) ** n)
    r, theta = A * big * F.pow(_t(F.radians(lat)), n), n * F.radians(lon - MERIDIAN)
    return F.struct((r * F.sin(theta)).alias("x"), (A * big - r * F.cos(theta)).alias("y"))


def to_gda2020(lon: Column, lat: Column) -> Column:
    """SRC-06: x and y in degrees of a place of GDA94 (height 0) in GDA2020, by the seven parameters."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.pow(F.sin(phi), 2))
    place = F.struct((n * F.cos(phi) * F.cos(lam)).alias("x"), (n * F.cos(phi) * F.sin(lam)).alias("y"), (n * (1 - E2) * F.sin(phi)).alias("z"))
    rx, ry, rz = (math.radians(t / 3_600) for t in TURN)
    k = 1 + SCALE * 1e-6

    def moved(p: Column) -> Column:
        x = SHIFT[0] + k * (p["x"] + rz * p["y"] - ry * p["z"])
        y = SHIFT[1] + k * (-rz * p["x"] + p["y"] + rx * p["z"])
        z = SHIFT[2] + k * (ry * p["x"] - rx * p["y"] + p["z"])
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    def degrees(p: Column) -> Column:
        flat = F.hypot(p["x"], p["y"])
        start = F.atan2(p["z"], flat * (1 - E2))
        again = lambda f, _: F.atan2(p["z"] + E2 * A / F.sqrt(1 - E2 * F.pow(F.sin(f), 2)) * F.sin(f), flat)
        return F.struct(F.degrees(F.atan2(p["y"], p["x"])).alias("x"), F.degrees(F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, again)).alias("y"))

    return _once(_once(place, moved), degrees)
