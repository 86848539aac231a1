"""Expressions over JSON text and maps: keys, merging, canonical text, and walks to any depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]|\\.)*"'
_MAP = "map<string,string>"


def as_map(text: Column) -> Column:
    """JSN-10: an object as a map of texts; anything else is empty."""
    return F.coalesce(F.from_json(text, _MAP), F.from_json(F.lit("{}"), _MAP))


def as_list(text: Column) -> Column:
    """JSN-10: an array of texts; a text that is no array is a list of itself, a null or blank one is empty."""
    one = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.coalesce(F.from_json(text, "array<string>"), one)).otherwise(one)


def has_key(text: Column, key: str) -> Column:
    """JSN-03: whether an object has the key, be its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def merged(a: Column, b: Column) -> Column:
    """JSN-04: a shallow merge of maps in which the right side wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def without_key(m: Column, key: str) -> Column:
    """JSN-05."""
    return F.map_filter(m, lambda k, _: k != key)


def canonical(m: Column, dropped: tuple[str, ...] = ()) -> Column:
    """JSN-07: keys in order with their values, some left out, as text to group by."""
    kept = F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: ~k.isin(*dropped)) if dropped else m))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), "|")


def keys_at_any_depth(text: Column) -> Column:
    """JSN-08: distinct keys of all objects, lower-cased and trimmed."""
    found = F.regexp_extract_all(text, F.lit(_STRING + r"(?:\s*:)?"), F.lit(0))
    keys = F.filter(found, lambda x: F.endswith(x, F.lit(":")))
    return F.array_distinct(F.transform(keys, lambda x: F.lower(F.trim(F.regexp_extract(x, r'^"(.*)"\s*:$', 1)))))


def numbers_at_any_depth(text: Column) -> Column:
    """JSN-09: all numbers, as texts in their order; true counts as 1 and false as 0."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _STRING, "_"), "true", "1"), "false", "0")
    return F.regexp_extract_all(bare, F.lit(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), F.lit(0))


def embedding_of(text: Column) -> Column:
    """VEC-03: a vector from its wire text; null where it is none or holds anything but numbers."""
    v = F.from_json(text, "array<double>")
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), v)
