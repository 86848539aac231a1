"""Addresses and parcels: matching, resolution and facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import geo, typeahead
from .tables import spread_join

FLOOR, GAP = 0.55, 0.08
# Method and confidence of facts from maps; layers that are no overlays; zones that are roads or reserves.
SPATIAL, SPATIAL_CONFIDENCE = "spatial_derived", 0.9
NO_OVERLAYS = ["zone", "r_code", "rcode", "lga", "local_government"]
ROADS = r"(?i)road|reserve|laneway|right.of.way|drainage"


def match_addresses(asked: DataFrame, points: DataFrame) -> DataFrame:
    """DOM-07: query_id, address_id, score and outcome. Exact matches win, all of them; else of the best five the best hit above
    the floor, or all within the gap of it, which are ambiguous; a query without a match has one row of outcome none."""
    asked = asked.select("query_id", "address")
    forms = T.address_form(F.col("address"))
    wanted = asked.select("query_id", F.explode(F.array_distinct(F.array(forms, T.expand_street(F.col("address"))))).alias("form")).where("form <> ''")
    equal = wanted.join(points.select("address_id", forms.alias("form")), "form").select("query_id", "address_id").distinct().withColumn("score", F.lit(1.0))
    hits = typeahead.typeahead(asked, points, limit=5).select("query_id", "address_id", "score").where(F.col("score") < 1)
    top = F.max("score").over(Window.partitionBy("query_id"))
    found = equal.unionByName(hits.where(F.col("score") >= FLOOR)).withColumn("top", top)
    kept = found.where(F.when(F.col("top") == 1.0, F.col("score") == 1.0).otherwise(F.col("top") - F.col("score") < GAP))
    n = F.count("address_id").over(Window.partitionBy("query_id"))
    outcome = F.when(n == 0, "none").when(F.col("top") == 1.0, "exact").when(n > 1, "ambiguous").otherwise("clear")
    every = asked.select("query_id").distinct().join(kept, "query_id", "left")
    return every.withColumn("outcome", outcome).select("query_id", "address_id", "score", "outcome")


def resolution_state(override: Column, address: Column, authoritative: Column, n_matches: Column, has_parcel: Column) -> Column:
    """DOM-08: the first state that holds."""
    return (
        F.when(override, "needs_more_info")
        .when(F.trim(F.coalesce(address, F.lit(""))) == "", "missing_info")
        .when(~authoritative, "unsupported")
        .when(n_matches > 1, "needs_more_info")
        .when(n_matches == 0, "missing_info")
        .when(~has_parcel, "point_only")
        .otherwise("resolved")
    )


def parcel_facts(parcels: DataFrame, key: str) -> DataFrame:
    """DOM-09: key, fact_type and value of each parcel (ring, and codes of the features it meets, in order). What is not known is
    left out."""
    m = geo.metrics(F.col("ring"))
    code = F.get(F.filter("codes", lambda c: T.is_density_code(c)), F.lit(0))
    known = {"lot_area": m["area"].cast("string"), "lot_width": m["width"].cast("string"), "lot_depth": m["depth"].cast("string"), "r_code": code}
    facts = F.explode(F.array(*[F.struct(F.lit(k).alias("fact_type"), v.alias("value")) for k, v in known.items()])).alias("f")
    return parcels.select(key, facts).select(key, "f.fact_type", "f.value").where("value IS NOT NULL")


def synth_facts(properties: DataFrame, parcels: DataFrame, features: DataFrame, facts: DataFrame, **more: Callable[[Column, Column], Column]) -> DataFrame:
    """DOM-09: the facts of projects (project_id, fact_type, value as JSON, method, feature_id) after a run: those that a map gave
    before go, others stay, and each property (project_id, parcel_id) with a parcel gets those of its parcel (parcel_id, area_m2, width_m,
    depth_m, local_government) and of the features that it meets (parcel_id, feature_id, layer_type, code, label, stamped, meta_code).

    Of the features, by layer and id, the first with a density code (stamped, else its own) gives r_code, the first usable zone gives
    zone, and each overlay gives its presence. What is not known is left out. Firsts are aggregates, combined before the shuffle.

    Each overlay becomes a fact of each project on its parcel, so the result grows with their product: all values, and columns in `more`
    made of a fact's type and value, are made once for a parcel, and the pairs are only put together."""
    code = F.trim(F.coalesce("code", F.lit("")))
    layer = F.lower(F.trim(F.coalesce("layer_type", F.lit(""))))
    density = F.coalesce(F.nullif("stamped", F.lit("")), F.when(T.is_density_code(code), code))
    zone = (layer == "zone") & (code != "") & ~code.rlike(ROADS)
    value = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    place = F.struct("layer_type", "feature_id")
    first = features.groupBy("parcel_id").agg(
        F.min_by(F.struct(value(code=density, label=F.coalesce("label", density)).alias("value"), "feature_id"), F.when(density.isNotNull(), place)).alias("r_code"),
        F.min_by(F.struct(value(code=code, name=F.col("label")).alias("value"), "feature_id"), F.when(zone, place)).alias("zone"),
    )
    overlays = features.where(~layer.isin(NO_OVERLAYS)).select(
        "parcel_id", F.col("layer_type").alias("fact_type"), value(present=F.lit(True), code=F.coalesce(F.nullif("meta_code", F.lit("")), F.nullif("code", F.lit(""))), label=F.col("label")).alias("value"), "feature_id"
    )
    good = lambda c: F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.round(c, 2))
    number = lambda c: F.when(good(c).isNotNull(), value(value=good(c), unit=F.lit("m2" if c == "area_m2" else "m")))
    both = good("width_m").isNotNull() & good("depth_m").isNotNull()
    council = T.council_name(F.col("local_government"))
    own = {"lot_area_m2": number("area_m2"), "lot_width_m": F.when(both, number("width_m")), "lot_depth_m": F.when(both, number("depth_m")), "local_government": F.when(council != "", value(name=council))}
    fact = lambda t, v, f: F.struct(F.lit(t).alias("fact_type"), v.alias("value"), f.alias("feature_id"))
    none = F.lit(None).cast(features.schema["feature_id"].dataType)
    mine = [fact(t, v, none) for t, v in own.items()] + [fact(t, F.col(t)["value"], F.col(t)["feature_id"]) for t in ("r_code", "zone")]
    rows = parcels.join(first, "parcel_id", "left").select("parcel_id", F.explode(F.filter(F.array(*mine), lambda x: x["value"].isNotNull())).alias("f")).select("parcel_id", "f.*")
    rows = rows.unionByName(overlays.join(parcels.select("parcel_id"), "parcel_id", "left_semi"))
    columns = ["project_id", "fact_type", "value", "method", "feature_id", *more]
    told = lambda df: df.withColumns({n: f(F.col("fact_type"), F.col("value")) for n, f in more.items()}) if more else df
    asked = properties.where("parcel_id IS NOT NULL").select("project_id", "parcel_id")
    new = spread_join(asked, told(rows), ["parcel_id"]).withColumn("method", F.lit(SPATIAL))
    from_map = F.col("method").eqNullSafe(F.lit(SPATIAL))  # facts of another method stay, whoever's they are
    old = facts.where(~from_map).unionByName(facts.where(from_map).join(properties.select("project_id"), "project_id", "left_anti"))
    return told(old).select(*columns).unionByName(new.select(*columns))
