"""Conditions on sources, versions, datasets and confidences, and texts of JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licences that allow citation, and full text; the reference system of datasets; JSON names that hold a text, in order.
CITABLE_LICENCES = ["open", "verified_open"]
STORABLE_LICENCES = ["open", "verified_open", "pending_review"]
TARGET_CRS = "EPSG:7844"
TEXT_NAMES = ["value", "name", "label", "code", "council", "council_scope"]


def citable(review: Column, licence: Column, metadata_only: Column, superseded_by: Column) -> Column:
    """FLT-05: approved, of an open licence, with its text, and not superseded; false where something is not known."""
    return F.coalesce((review == "approved") & licence.isin(CITABLE_LICENCES) & ~metadata_only, F.lit(False)) & superseded_by.isNull()


def storable(licence: Column) -> Column:
    """Whether the full text may be kept."""
    return F.coalesce(licence.isin(STORABLE_LICENCES), F.lit(False))


def authoritative(licensed: Column, review: Column, source_version: Column, crs: Column) -> Column:
    """Whether a dataset may place addresses: licensed, approved, with a source version, in the target reference system."""
    return F.coalesce(licensed & (review == "approved") & (crs == TARGET_CRS), F.lit(False)) & source_version.isNotNull()


def confidence_label(x: Column) -> Column:
    """high from 0.9, medium from 0.4, low above 0, else none."""
    return F.when(x >= 0.9, "high").when(x >= 0.4, "medium").when(x > 0, "low").otherwise("none")


def confidence_of(label: Column) -> Column:
    """The inverse: 1, 0.5, 0.25 and 0."""
    return F.when(label == "high", 1.0).when(label == "medium", 0.5).when(label == "low", 0.25).otherwise(0.0)


def first_text(json: Column) -> Column:
    """PRJ-03: the first of the six names of an object whose value is not blank, trimmed; null where there is none."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, f"$.{n}")), F.lit("")) for n in TEXT_NAMES])


def coordinates(point: Column) -> tuple[Column, Column]:
    """PRJ-07: x and y of a point's text, with or without a reference system before it; null where it is none."""
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf"(?i)^\s*(?:SRID=[0-9]+;)?\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    return tuple(F.regexp_extract(point, pattern, n).try_cast("double") for n in (1, 2))
