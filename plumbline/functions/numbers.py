"""Numeric expressions: comparison by name, units, vectors and hash embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of comparison operators; units with their canonical unit and factor; categories of canonical units with
# their bounds.
ALIASES = {
    "lte": "lte", "gte": "gte", "lt": "lt", "gt": "gt", "eq": "eq",
    "pct_lte": "lte", "pct_gte": "gte", "<=": "lte", ">=": "gte", "<": "lt", ">": "gt", "==": "eq", "=": "eq",
}
UNITS = {
    "mm": ("m", 0.001), "millimetre": ("m", 0.001), "millimeter": ("m", 0.001),
    "cm": ("m", 0.01), "centimetre": ("m", 0.01), "centimeter": ("m", 0.01),
    "km": ("m", 1000.0), "metre": ("m", 1.0), "meter": ("m", 1.0), "m": ("m", 1.0),
    "m2": ("m2", 1.0), "m²": ("m2", 1.0), "mÂ²": ("m2", 1.0), "sq m": ("m2", 1.0), "sq.m": ("m2", 1.0), "sqm": ("m2", 1.0),
    "metres squared": ("m2", 1.0), "square metres": ("m2", 1.0), "square meters": ("m2", 1.0), "ha": ("m2", 10000.0),
    "storey": ("storeys", 1.0), "storeys": ("storeys", 1.0), "stories": ("storeys", 1.0),
    "%": ("%", 1.0), "percent": ("%", 1.0), "per cent": ("%", 1.0),
    "°": ("degrees", 1.0), "degree": ("degrees", 1.0), "degrees": ("degrees", 1.0),
    "db": ("dB", 1.0), "decibels": ("dB", 1.0), "lx": ("lx", 1.0), "lux": ("lx", 1.0),
    "count": ("count", 1.0), "bay": ("count", 1.0), "bays": ("count", 1.0), "dwelling": ("count", 1.0), "dwellings": ("count", 1.0),
    "ratio": ("ratio", 1.0), "per dwelling": ("ratio", 1.0),
}
CATEGORIES = {"m": "length", "m2": "area", "%": "percent", "storeys": "count_storeys", "count": "count", "ratio": "ratio", "degrees": "angle", "dB": "decibel", "lx": "illuminance"}
BOUNDS = {
    "length": (0.0, 1000.0), "area": (0.0, 1_000_000.0), "percent": (0.0, 100.0), "count_storeys": (1.0, 60.0), "count": (0.0, 1000.0),
    "ratio": (0.0, 1000.0), "angle": (0.0, 360.0), "decibel": (0.0, 200.0), "illuminance": (0.0, 1_000_000.0),
}
#: Drawing-unit codes and metres of one unit.
DRAWING_UNITS = {1: 0.0254, 2: 0.3048, 4: 0.001, 5: 0.01, 6: 1.0, 7: 1000.0, 10: 0.9144}


def _map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """MTH-06: value against threshold; a null or blank operator is lte; an unknown one or a missing number gives null, NaN false."""
    name = F.coalesce(F.nullif(F.trim(operator), F.lit("")), F.lit("lte"))
    known = F.when(F.isnan(value) | F.isnan(threshold), F.lit(False))
    tests = {"lte": value <= threshold, "gte": value >= threshold, "lt": value < threshold, "gt": value > threshold, "eq": value == threshold}
    told = F.lit(None).cast("boolean")
    for kind, test in tests.items():
        told = F.when(name.isin([a for a, k in ALIASES.items() if k == kind]), F.when(value.isNotNull() & threshold.isNotNull(), F.coalesce(known, test))).otherwise(told)
    return told


def _unit_key(unit: Column) -> Column:
    return F.lower(F.trim(unit))


def canonical_unit(unit: Column) -> Column:
    """MTH-07: the canonical name; an unknown unit passes through as it is."""
    return F.coalesce(F.try_element_at(_map({k: v[0] for k, v in UNITS.items()}), _unit_key(unit)), unit)


def canonical_value(value: Column, unit: Column) -> Column:
    return value * F.coalesce(F.try_element_at(_map({k: v[1] for k, v in UNITS.items()}), _unit_key(unit)), F.lit(1.0))


def unit_category(unit: Column) -> Column:
    """MTH-07: the category of a canonical unit; no unit is a count."""
    return F.when(unit.isNull(), "count").otherwise(F.try_element_at(_map(CATEGORIES), unit))


def in_category(value: Column, category: Column) -> Column:
    """MTH-08: whether a number lies in the bounds of its category; false for an unknown category or NaN."""
    low, high = (F.try_element_at(_map({k: v[n] for k, v in BOUNDS.items()}), category) for n in (0, 1))
    return F.coalesce(~F.isnan(value) & value.between(low, high), F.lit(False))


def drawing_length(value: Column, code: Column) -> dict[str, Column]:
    """MTH-10: metres of a drawing length, and the most confidence it may have: 0.4 where the unit code is unknown."""
    factor = F.try_element_at(_map(DRAWING_UNITS), code)
    return {"metres": value * F.coalesce(factor, F.lit(1.0)), "most": F.when(factor.isNull(), 0.4).otherwise(1.0)}


def cost_cents(tokens: Column, cents_per_thousand: Column) -> Column:
    """MTH-13: cents of a number of tokens, rounded up."""
    return F.ceil(tokens * cents_per_thousand / 1000)


def finite_positive(x: Column) -> Column:
    """MTH-08: neither null, NaN, infinite nor at most zero."""
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < F.lit(float("inf")))


def dot(a: Column, b: Column) -> Column:
    """Over the common prefix, in double precision."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """MTH-01: over the common prefix; 0 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def hash_embedding(text: Column, dim: int = 16) -> Column:
    """MTH-02: bytes of the text's SHA-256, cycled, scaled to [-1, 1], rounded to 6 places."""
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.round(byte(i) / 255.0 * 2.0 - 1.0, 6))
