"""Validators of extracted rules, and the promotion gate over them and evaluation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import numbers_at_any_depth
from ..functions.numbers import UNITS, in_category, unit_category
from ..functions.text import stands_alone

# Words of which a rule-bearing clause holds one; letters that a quote has at least.
NORMATIVE = ["must", "shall", "required", "requirement", "maximum", "minimum", "not exceed", "not less than", "at least", "no more than"]
LEAST_QUOTE = 5


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _all_numbers(value: Column, test) -> Column:
    return F.forall(F.coalesce(numbers_at_any_depth(value), F.array().cast("array<string>")), test)


def validators(quote: Column, clause: Column, disposition: Column, value: Column, unit: Column, key: Column) -> dict[str, Column]:
    """DOM-05: whether each of seven validators passes; `value` is JSON text."""
    q = squeezed(quote)
    canonical = sorted({c for c, _ in UNITS.values()})
    number = lambda x: x.try_cast("double")
    return {
        "quote_anchor": (F.length(q) >= LEAST_QUOTE) & F.contains(squeezed(clause), q),
        "normative_language": F.coalesce(disposition != "rule_bearing", F.lit(True)) | F.exists(F.array(*[F.lit(w) for w in NORMATIVE]), lambda w: F.contains(F.lower(squeezed(clause)), w)),
        "no_orphan_numbers": _all_numbers(value, lambda x: stands_alone(x, q)),
        "unit_normalization": unit.isNull() | unit.isin(canonical),
        "value_finite": _all_numbers(value, lambda x: F.coalesce(F.abs(number(x)) <= 1_000_000, F.lit(False))),
        "unit_category_sanity": _all_numbers(value, lambda x: in_category(number(x), unit_category(unit))),
        "rule_key": F.coalesce(key.rlike(r"^[a-z][a-z0-9_]{2,60}\z"), F.lit(False)),
    }


def failed_validators(**columns: Column) -> Column:
    """Names of the validators that fail, in their order."""
    told = validators(**columns)
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in told.items()]), lambda n: n.isNotNull())


def promotion_gate(candidates: DataFrame, cases: DataFrame, key: str = "candidate_id", gate: float = 0.8) -> DataFrame:
    """DOM-06: key, n_cases and promoted: no failed validator (`failed`), and each active case scores the gate at least; no
    case passes."""
    scores = cases.where("active").groupBy(key).agg(F.count(F.lit(1)).alias("n_cases"), F.bool_and(F.coalesce(F.col("score") >= gate, F.lit(False))).alias("__ok"))
    out = candidates.join(scores, key, "left")
    return out.select(key, F.coalesce("n_cases", F.lit(0)).alias("n_cases"), ((F.size("failed") == 0) & F.coalesce("__ok", F.lit(True))).alias("promoted"))


def match_score(expected: Column, output: Column) -> Column:
    """DOM-18: the share of expected fields (maps of texts) that the output holds alike, to 4 places; 1 where none is expected."""
    keys = F.map_keys(expected)
    hits = F.size(F.filter(keys, lambda k: F.element_at(expected, k).eqNullSafe(F.try_element_at(output, k)) & F.map_contains_key(output, k)))
    return F.when(F.size(keys) > 0, F.round(hits / F.size(keys), 4)).otherwise(1.0)


def fact_promotion(value: Column, unit: Column, key: Column, confidence: Column, drawing: Column, calibrated: Column, least: float = 0.7) -> Column:
    """DOM-21: reasons against promoting a document fact; empty where it may be promoted."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reasons = [
        F.when(value.try_cast("double").isNull(), "value"),
        F.when(blank(unit), "unit"),
        F.when(blank(key), "key"),
        F.when(F.coalesce(confidence, F.lit(0.0)) < least, "confidence"),
        F.when(F.coalesce(drawing, F.lit(False)) & ~F.coalesce(calibrated, F.lit(False)), "calibration"),
    ]
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())

